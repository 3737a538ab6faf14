"""Queries of this subpackage: each applies one operator, with production parameters, to its
whole table. ``QUERIES`` maps names to builders (spark, sf_dir); ``ORACLES`` holds DuckDB SQL
where SQL can express the operator."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm import bpe, filters, pii, prefixes
from concordia.llm.attention import score
from concordia.llm.common import crc_mod
from concordia.llm.cotrain import classify
from concordia.llm.decontam import contaminated
from concordia.llm.embed import near_vectors
from concordia.llm.langid import identify
from concordia.llm.minhash import near_duplicates
from concordia.llm.pages import extract
from concordia.llm.sharding import shard
from concordia.llm.suffix import remove_repeats
from concordia.sources.tables import table

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labelled ones; kept where it is 0.5 at least."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", F.col("good").alias("score"), F.coalesce(F.col("good") >= 0.5, F.lit(True)).alias("kept"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text by rank, decode the ids, digest both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.col("bpe.ids")
    return bpe.decode(bpe.encode(docs, BPE_RANKS), BPE_RANKS).select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold: a row for each document and item, with the window
    of highest similarity."""
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("matches") > 0).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that 50-byte strings of earlier documents cover."""
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every whole text, learned from four fifths of the documents."""
    return score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 1, BPE_RANKS)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from three quarters of the documents."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    found = identify(docs.select("doc_id", "text"), docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"),
                        F.col("language.score").alias("score"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings of equal labels."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards of near equal bytes (and tokens, and rows)."""
    return shard(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents in all 120 orders."""
    return filters.interactions(filters.masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: counts and digest of the base spans, all spans, and
    how many of them the field adds."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, pii.KINDS),
        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"),
        F.size(F.filter("pii", lambda x: ~x["base"])).cast("long").alias("n_added"))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, rebuilt so that they share first turns."""
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"), heads=prefixes.rebuilt_heads)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_pages": op3_pages,
    "op4_decontaminate": op4_decontaminate,
    "op5_minhash": op5_minhash,
    "op6_suffix": op6_suffix,
    "op7_attention": op7_attention,
    "op8_langid": op8_langid,
    "op9_embeddings": op9_embeddings,
    "op10_sharding": op10_sharding,
    "op11_filters": op11_filters,
    "op12_pii": op12_pii,
    "op13_prefixes": op13_prefixes,
}

ORACLES: dict[str, str] = {"op11_filters": filters.SQL}
