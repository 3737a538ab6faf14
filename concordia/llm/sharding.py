"""Sharding by vector bin packing.

Documents with equal texts form a group; a group's size is a vector of bytes, tokens and
rows. Groups above a 1024th of the whole in any dimension (there are at most 3 * 1024) are
packed one by one, all others by the bundle of 4096 that their hash names, so what the
driver packs is bounded however many groups there are. Items go, largest first, to the
shard whose residual capacity has the highest dot product with them. A group above half a
shard is split by a hash of doc_id, for whole it could not be balanced.

Defined cases: a null text is as an empty one; a null doc_id is a plain row; repeated rows
each take a slot; an empty table gives an empty table; extra columns are not read."""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concordia.llm.common import stage

FINE = 1024
BUNDLES = 4096
DIMS = ("size", "tokens", "rows")
WEIGHTS = np.array([4.0, 2.0, 1.0])
KEY = ("h", "text_crc32", "size")
ROWS_A_CELL = 8192
TOLERANCE = 0.001


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (a row of shares of the whole), by the highest dot product of the
    item with the residual capacity; ties go to the lowest shard. Bytes come first in the
    order and weigh most, as the law asks for their balance above all."""
    residual = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-items[:, 0], kind="stable"):
        out[i] = int(np.argmax(residual @ (items[i] * WEIGHTS)))
        residual[out[i]] -= items[i]
    for _ in range(4 * len(items)):  # then move items where that evens out the residuals
        for d in range(items.shape[1]):
            full, empty = int(np.argmin(residual[:, d])), int(np.argmax(residual[:, d]))
            mine = np.flatnonzero(out == full)
            gain = ((residual[full] ** 2 + residual[empty] ** 2) - (residual[full] + items[mine]) ** 2
                    - (residual[empty] - items[mine]) ** 2) @ WEIGHTS
            if len(mine) and gain.max() > TOLERANCE ** 2 / shards ** 2:
                break
        else:
            break
        i = mine[np.argmax(gain)]
        out[i] = empty
        residual[full] += items[i]
        residual[empty] -= items[i]
    return out


def shard(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size (bytes plus 1), text_crc32, tokens, shard, slot."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    slim = stage(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.regexp_count(body, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.xxhash64(body).alias("h")), "shard-docs").withColumn("rows", F.lit(1).cast("long"))
    sums = [F.sum(d).alias(f"sum_{d}") for d in DIMS]
    total = slim.agg(*sums).first()
    total = np.array([float(total[f"sum_{d}"] or 0) for d in DIMS])
    whole = np.maximum(total, 1.0)

    large = slim.groupBy(*KEY).agg(*sums).where(" or ".join(f"sum_{d} > {float(w) / FINE!r}" for d, w in zip(DIMS, whole)))
    groups = large.collect()  # at most 3 * FINE rows
    share = np.array([[g[f"sum_{d}"] for d in DIMS] for g in groups], float).reshape(-1, 3) / whole
    cuts = [math.ceil(s * 4 * shards) if s > 0.5 / shards else 1 for s in share.max(axis=1)] if groups else []
    known = spark.createDataFrame([(g.h, g.text_crc32, g["size"], k) for g, k in zip(groups, cuts)],
                                  "h long, text_crc32 long, size long, cuts int")
    # known and placed hold at most 3 * FINE * 5 + BUNDLES rows: safe to broadcast
    marked = (slim.join(F.broadcast(known), list(KEY), "left")
              .withColumn("item", F.when(F.col("cuts").isNull(), F.concat(F.lit("b"), F.pmod("h", F.lit(BUNDLES))))
                          .otherwise(F.concat_ws(":", *KEY, F.pmod(F.xxhash64("doc_id"), F.col("cuts"))))))
    items = marked.groupBy("item").agg(*sums).orderBy("item").collect()
    vectors = np.array([[r[f"sum_{d}"] for d in DIMS] for r in items], float).reshape(-1, 3) / whole
    where = pack(vectors, shards)
    placed = spark.createDataFrame([(r.item, int(s)) for r, s in zip(items, where)], "item string, shard int")

    cells = max(1, int(total[2]) // ROWS_A_CELL)
    laid = (marked.join(F.broadcast(placed), "item")
            .withColumn("cell", F.pmod(F.xxhash64("doc_id", "h"), F.lit(cells))))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = (laid.groupBy("shard", "cell").agg(F.count("*").alias("n"))
             .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "h"))
    return (laid.withColumn("inside", inside).join(bases, ["shard", "cell"])
            .select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("base") + F.col("inside") - 1).alias("slot")))
