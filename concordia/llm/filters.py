"""Interaction of filters: what each of five filters removes in every order of application.

Four filters read one text each. The fifth, identical to an earlier document's text, is
decided by radix tries: texts are inserted whole into compressed tries whose edges are
slices of texts and whose terminals hold the smallest doc_id; every other document at a
terminal is a duplicate. Each task first inserts what it reads into tries of its own, so
that of a group of copies one row a task travels. The rest is range-partitioned by adaptive
prefixes: the first characters, and where the texts behind a prefix hold more than LIMIT
bytes, ever longer ones, until the prefix is the whole text. A trie holds one prefix's
distinct texts, so it stays bounded however many copies there are.

The failures of a document are a mask of five bits. Masks are counted per part, and the
counts of all orders and steps are products of those 32 numbers with fixed 0/1 matrices.

Defined cases: a null text is as an empty one; a null lang is the part ''; a row with a null
doc_id is no duplicate and makes none; rows of one doc_id and text are not duplicates of
each other, each counts as a document; texts of any length are read whole; a document with
several labels is good (toxic) if any of them says so; an empty table gives an empty table;
extra columns are not read."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import as_bytes, drop_stage, ship, stage

FILTERS = "ABCDE"
DUPLICATE = 16  # the bit of E
LIMIT = 16 << 20  # bytes of texts behind one prefix, beyond which it is extended
SHARDS = 20_000  # at most so many prefixes hold more than LIMIT or this part of the whole
FIRST = 8  # characters of the shortest prefix; extended by GROW
GROW = 4
LOCAL = 32 << 20  # bytes of texts in a reading task's trie
UPPER = bytes(range(65, 91))
MARKS = b"#$%&*|"
INNER = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that start no code point
ROWS = 4096
BATCH = 8 << 20


class Node:
    """Inner node or terminal of a trie."""

    __slots__ = ("edges", "holder")

    def __init__(self):
        self.edges: dict[int, list] = {}  # first byte -> [text, start, end, node]
        self.holder: list | None = None  # [id, text, mask, {part: rows}] of the smallest id


def common(a: bytes, i: int, m: int, b: bytes, j: int) -> int:
    """Length of the common prefix of a[i:i + m] and b[j:]."""
    m = min(m, len(b) - j)
    low, step = 0, 16
    while low < m:  # gallop over equal stretches, then halve the unequal one
        to = min(m, low + step)
        if a[i + low:i + to] == b[j + low:j + to]:
            low, step = to, step * 2
        else:
            while to - low > 1:
                mid = (low + to) // 2
                if a[i + low:i + mid] == b[j + low:j + mid]:
                    low = mid
                else:
                    to = mid
            return low
    return m


class Trie:
    """Compressed trie over whole texts, smallest ids at the terminals."""

    def __init__(self):
        self.root, self.held = Node(), 0

    def terminal(self, text: bytes) -> Node:
        node, at = self.root, 0
        while at < len(text):
            edge = node.edges.get(text[at])
            if edge is None:
                leaf = Node()
                node.edges[text[at]] = [text, at, len(text), leaf]
                return leaf
            label, start, end, child = edge
            k = common(label, start, end - start, text, at)
            if start + k < end:
                split = Node()
                split.edges[label[start + k]] = [label, start + k, end, child]
                edge[2:] = start + k, split
                child = split
            node, at = child, at + k
        return node

    def insert(self, text: bytes, doc_id: int, mask: int, part: str, rows: int) -> list[tuple]:
        """Duplicates that this row makes known: (id, part, mask, rows), itself or a holder."""
        node = self.terminal(text)
        held = node.holder
        if held is None or doc_id < held[0]:
            node.holder = [doc_id, text, mask, {part: rows}]
            if held is None:
                self.held += len(text)
                return []
            return [(held[0], p, held[2] | DUPLICATE, n) for p, n in held[3].items()]
        if doc_id > held[0]:
            return [(doc_id, part, mask | DUPLICATE, rows)]
        held[3][part] = held[3].get(part, 0) + rows
        return []

    def holders(self) -> Iterator[tuple]:
        """Traverse: (id, part, mask, rows, text) of what each terminal holds."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.holder is not None:
                doc_id, text, mask, parts = node.holder
                for part, rows in parts.items():
                    yield doc_id, part, mask, rows, text
            stack.extend(edge[3] for edge in node.edges.values())


def own_mask(text: bytes) -> int:
    """Failures A to D: under 100 words, under 80 % distinct words, over 10 % capitals, marks."""
    words = text.split()
    points = len(text.translate(None, INNER))
    capitals = len(text) - len(text.translate(None, UPPER))
    return ((len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * capitals > 10 * points) << 2
            | (len(text.translate(None, MARKS)) < len(text)) << 3)


def _batches(rows: Iterator[tuple], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Rows (id, part, mask, rows[, text]) as record batches bounded in rows and bytes."""
    names = ["doc_id", "part", "mask", "rows", "text"][:4 + with_text]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    out, size = [], 0

    def cut() -> pa.RecordBatch:
        cols = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
        if with_text:
            cols[4] = cols[4].cast(pa.string())
        return pa.RecordBatch.from_arrays(cols, names)

    for row in rows:
        out.append(row)
        size += len(row[4] or b"") if with_text else 0
        if len(out) >= ROWS or size >= BATCH:
            yield cut()
            out, size = [], 0
    if out:
        yield cut()


def read_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task reads, through tries of its own: duplicates without, others with their text."""

    def rows() -> Iterator[tuple]:
        trie = Trie()
        for batch in batches:
            for doc_id, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                mask = own_mask(text)
                if doc_id is None:
                    yield None, part, mask, 1, None
                    continue
                for found in trie.insert(text, doc_id, mask, part, 1):
                    yield *found, None
                if trie.held > LOCAL:
                    yield from trie.holders()
                    trie = Trie()
        yield from trie.holders()

    return _batches(rows(), True)


def shard_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A trie for each run of rows of one prefix."""

    def rows() -> Iterator[tuple]:
        trie, at = Trie(), None
        for batch in batches:
            for shard, doc_id, part, mask, n, text in zip(*(batch.column(i).to_pylist() for i in range(5)), as_bytes(batch.column(5))):
                if shard != at:
                    yield from (h[:4] for h in trie.holders())
                    trie, at = Trie(), shard
                yield from trie.insert(text, doc_id, mask, part, n)
        yield from (h[:4] for h in trie.holders())

    return _batches(rows(), False)


def prefixes(texts: DataFrame) -> tuple[DataFrame, int]:
    """Add ``shard``, the hash of each text's adaptive prefix; also the bytes of all texts.
    Fewer than SHARDS prefixes a level are open, each holding more than that part of the whole."""
    spark = texts.sparkSession
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    limit = max(LIMIT, total // SHARDS)
    width = FIRST
    texts = texts.withColumn("shard", F.xxhash64(F.substring("text", 1, width)))
    rest = texts
    while True:
        open_ = [(r.shard,) for r in rest.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("size"), F.max(F.length("text")).alias("longest"))
                 .where(f"size > {limit} and longest > {width}").select("shard").collect()]
        if not open_:
            return texts, total
        width *= GROW
        # fewer than SHARDS hashes: safe to broadcast
        marked = F.broadcast(spark.createDataFrame(open_, "shard long").withColumn("open", F.lit(True)))
        longer = F.xxhash64(F.substring("text", 1, width))
        texts = texts.join(marked, "shard", "left").withColumn("shard", F.when(F.col("open"), longer).otherwise(F.col("shard"))).drop("open")
        rest = rest.join(marked, "shard").withColumn("shard", longer).drop("open")


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, mask, rows): the filters that each document fails, as bits of FILTERS."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.col(text).cast("string").alias("text"))
    read = stage(slim.mapInArrow(read_tries, "doc_id long, part string, mask int, rows long, text string"), "read-tries")
    found, total = prefixes(read.where("text is not null"))
    cells = max(1, -(-total // (2 * LIMIT)))
    dealt = (found.select("shard", "doc_id", "part", "mask", "rows", "text", F.substring("text", 1, FIRST).alias("head"))
             .repartitionByRange(cells, "head", "shard").sortWithinPartitions("head", "shard").drop("head"))
    decided = dealt.mapInArrow(shard_tries, "doc_id long, part string, mask int, rows long")
    out = stage(decided.union(read.where("text is null").drop("text")), "masks")
    drop_stage(read)
    return out


def matrices() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) of each result row, and per count a row of 0 and 1 (or of orders, for the
    sum over all of them) for each mask."""
    of = np.arange(1 << len(FILTERS))
    keys, out = [], {k: [] for k in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    sums = {f: np.zeros(len(of), np.int64) for f in FILTERS}
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            fails, gone = of & bit > 0, of & before > 0
            keys.append(("".join(order), step))
            out["kept"].append(of & (before | bit) == 0)
            out["removed"].append(fails & ~gone)
            out["redundant"].append(fails & gone)
            out["unique_fails"].append(of == bit)
            sums[f] += fails & ~gone
            before |= bit
    out["shapley"] = [sums[order[step - 1]] for order, step in keys]
    return keys, {k: np.array(v).astype(np.int64) for k, v in out.items()}


def interactions(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every part, order and step; see the module's text."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")).alias("toxic"))
    named, unnamed = masks.where("doc_id is not null"), masks.where("doc_id is null")
    unnamed = unnamed.select("*", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    counts = (named.join(marks, "doc_id", "left").union(unnamed).groupBy("part", "mask")
              .agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in
                     ((F.col("rows"), "n"), (F.col("rows") * F.col("good"), "good"), (F.col("rows") * F.col("toxic"), "toxic")))))
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("of"))  # 32 at most
    longs = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, m = matrices()
        for batch in batches:
            for part, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, good, toxic = (np.zeros(1 << len(FILTERS), np.int64) for _ in range(3))
                for r in of:
                    n[r["mask"]], good[r["mask"]], toxic[r["mask"]] = r["n"], r["good"], r["toxic"]
                found = {k: v @ n for k, v in m.items()} | {"good_lost": m["removed"] @ good, "toxic_lost": m["removed"] @ toxic}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(keys), pa.string()), pa.array([k for k, _ in keys], pa.string()),
                     pa.array([s for _, s in keys], pa.int32()), *(pa.array(found[c], pa.int64()) for c in longs)],
                    ["part", "filter_order", "step", *longs])

    return by_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in longs))


# DuckDB: the same counts by definition
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  min(doc_id) OVER (PARTITION BY text) AS low FROM d),
m AS (SELECT doc_id, part,
  (len(ws) < 100) AS a, (100 * len(list_distinct(ws)) < 80 * len(ws)) AS b,
  (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text)) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, coalesce(low < doc_id, false) AS e FROM w),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
t AS (SELECT *, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
  || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM g),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS failing, fails = f AS alone,
  length(before) > 0 AND length(translate(fails, before, '')) < length(fails) AS gone FROM t, s),
x AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, f,
  CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failing), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND failing), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE gone AND failing), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (WHERE alone), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (WHERE NOT gone AND failing), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (WHERE NOT gone AND failing), 0) AS BIGINT) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM x
"""

ship(__name__)
