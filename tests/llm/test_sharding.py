import zlib
from collections import defaultdict

from concordia.llm.queries import op10_sharding
from concordia.llm.sharding import shard


def checked(rows, out, shards=16):
    text = dict(rows)
    slots = defaultdict(list)
    for r in out:
        t = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert len(out) == len(rows)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_test_data(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = op10_sharding(spark, sf).collect()
    checked(rows, out)
    sizes, counts, tokens = [0] * 16, [0] * 16, [0] * 16
    for r in out:
        sizes[r.shard] += r["size"]
        counts[r.shard] += 1
        tokens[r.shard] += r.tokens
        assert r.law == "bytes" and r.grown_shard is None
    assert max(sizes) <= 1.02 * min(sizes), sizes
    assert max(tokens) <= 1.03 * min(tokens), tokens
    assert max(counts) <= 1.25 * min(counts), counts
    texts = dict(rows)
    groups = defaultdict(set)
    for r in out:
        groups[texts[r.doc_id]].add(r.shard)
    assert all(len(g) == 1 for g in groups.values())


def test_hot_group_is_split(spark):
    rows = [(i, "same text of a third of all rows") for i in range(3000)] + [(3000 + i, f"text {i} " * (i % 40)) for i in range(6000)]
    out = shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    checked(rows, out)
    sizes = [0] * 16
    for r in out:
        sizes[r.shard] += r["size"]
    assert max(sizes) <= 1.02 * min(sizes), sizes


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1, 2), (1, "", 1, 2), (1, "", 1, 2), (2, "é", 0, 0), (3, "x" * 100_000, 0, 0)],
                               "doc_id long, text string, shard int, slot int")
    out = shard(df, 2).collect()
    assert len(out) == 5 and sorted(r["size"] for r in out) == [1, 1, 1, 3, 100_001]
    assert shard(df.limit(0)).count() == 0
