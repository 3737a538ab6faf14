import hashlib
import random

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from test_decontam import brute as held_items
from test_minhash import brute as components
from test_suffix import corpus

import __spark_entry__ as entry
from concordia.llm.bpe import load_ranks
from concordia.llm.langid import identify
from concordia.llm.common import crc_mod

SF = "/root/testdata/sf0.001"


def cut(rows):
    """The rows' texts without windows of 50 bytes that an earlier row holds."""
    first = {}
    for i, t in rows:
        b = t.encode()
        for k in range(len(b) - 49):
            first[b[k:k + 50]] = min(first.get(b[k:k + 50], i), i)
    out = []
    for i, t in rows:
        b = t.encode()
        gone = set()
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < i:
                gone.update(range(k, k + 50))
        out.append((i, bytes(c for k, c in enumerate(b) if k not in gone).decode("utf-8", "ignore")))
    return out


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = identify(docs, docs.where(crc_mod("doc_id", 4) != 2)).select("doc_id", "text", "language.*").collect()
    rows = [(r.doc_id, r.text) for r in found if r.lang != "und" and r.score >= 0.5]
    root = components(rows)
    rows = cut([(i, t) for i, t in rows if root[i][1] == i])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, _ in held_items(rows, items)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    want = {i: (enc.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows if i not in bad}
    out = entry.queries()["pipeline"](spark, SF).collect()
    assert {r.doc_id: (r.ids, r.decoded_sha256) for r in out} == want
    assert len(out) == len(want) and 0 < len(want) < docs.count()


@pytest.mark.parametrize("name,function", corpus_pipeline.STAGES)
def test_odd_rows(spark, name, function):
    t = "the cat and the dog went to the house with the other one of them all "
    rows = [(i, x, "en", "s", 1) for i, x in corpus(3)[:60]]
    rows += [(900, t, "en", None, 2), (900, t, "en", None, 2), (901, None, None, None, None), (902, "", "en", "s", 0),
             (None, t, "en", "s", 3), (903, "12 34 $$", "de", "s", 3), (904, t * 3000, "en", "s", 5)]
    extra = ["component_id", "kept", "cell", "body", "ids", "bpe", "matches", "key", "node", "language"]
    df = spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, "
                               + ", ".join(f"{c} string" for c in extra))
    out = function(spark, df, SF)
    if name != "tokenize":
        assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    got = out.collect()
    ids = [r.doc_id for r in got]
    assert {"language": 901 not in ids and 903 not in ids and 904 in ids, "near_dedup": ids.count(900) == 1 and None in ids,
            "passages": len(got) == len(rows), "decontaminate": len(got) == len(rows), "tokenize": len(got) == len(rows)}[name]
    assert function(spark, df.limit(0), SF).count() == 0


def test_mixtures_stay_and_junk_goes(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    docs = df.collect()
    by = {x: [w for d in docs if d.lang == x for w in d.text.split()] for x in ("en", "de", "es")}
    mixed = " ".join(by["en"][:45] + by["de"][:30] + by["es"][:25])
    r = random.Random(2)
    junk = " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randrange(4, 9))) for _ in range(60))
    extra = spark.createDataFrame([(10**9, mixed, None), (10**9 + 1, junk, None), (10**9 + 2, "\u3042\u3044\u3046 \u3048\u304a" * 9, None)], df.schema)
    found = identify(df.union(extra), df, evidence=True).select("doc_id", "lang", "language.score", "language.evidence").collect()
    print("OLD", sum(x.score < 0.5 for x in found), "NEW", sum(x.evidence <= 0 for x in found), "of", len(found),
          sorted((x.evidence, x.score, x.doc_id) for x in found)[:5], [x for x in found if x.doc_id >= 10**9])
    ids = {x.doc_id for x in corpus_pipeline.language(spark, df.union(extra), SF).collect()}
    assert ids == {d.doc_id for d in docs} | {10**9}


def test_rows_are_shuffled_once_for_near_dedup(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(3, " ".join(words), "x"), (5, " ".join(words[:-1]), "y"), (7, "other text", None), (7, "another one", "z"), (None, "nameless", "n"), (8, None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.near_dedup(spark, docs, None)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, out.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted([rows[0], *rows[2:]], key=repr)
    assert "Bucketed: true" in plan
