
import numpy as np
from pyspark.sql import functions as F

from concordia.llm import cotrain
from concordia.llm.common import crc_mod
from concordia.llm.queries import op1_quality

SF = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    truth = {r.doc_id: int(r.quality == 1 and r.toxic == 0) for r in labels.collect()}
    part = docs.where(crc_mod("doc_id", 2) == 0)
    out = cotrain.classify(docs.where(crc_mod("doc_id", 2) == 1).select("doc_id", "text", "source", "lang", "n_chars").withColumn("held", F.lit(1))
                           .unionByName(part.select("doc_id", "text", "source", "lang", "n_chars").withColumn("held", F.lit(0))),
                           labels.where(crc_mod("doc_id", 2) == 0)).collect()
    held = [(r.good, truth[r.doc_id]) for r in out if r.held and r.doc_id in truth]
    p, y = np.array(held).T
    assert len(p) > 500
    assert ((p >= 0.5) == y).mean() >= 0.97
    assert (p[y == 1] >= 0.5).mean() >= 0.98
    bins = np.clip((p * 5).astype(int), 0, 4)  # calibrated: mean score near mean label, over all
    assert abs(p.mean() - y.mean()) < 0.03 and len(set(bins)) > 1


def test_query_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    out = op1_quality(spark, sf).collect()
    assert len(out) == 1000 and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in out)


def test_pool_rows_are_exchanged():
    rng = np.random.default_rng(0)
    n = 400
    y = rng.integers(0, 2, n)
    stats = np.zeros((n, cotrain.STATS))
    stats[:, 0] = y + rng.normal(scale=0.01, size=n)  # the text tells
    meta = np.column_stack([y, np.full(n, 9), np.full(n, 8)])  # and so does the source
    words = [np.array([1, 2], np.uint64)] * n
    few = np.arange(24)
    model = cotrain.fit((stats[few], [words[i] for i in few], meta[few], y[few]), (stats[24:], words[24:], meta[24:]))
    p = model.score(stats, words, meta)
    assert ((p >= 0.5) == (y == 1)).mean() > 0.97


def test_the_sample_is_bounded_and_copies_have_their_share(spark):
    rows = [(i, "the same text", "en", "a", 13) for i in range(20_000)] + [(20_000 + i, f"text {i}", "en", "b", 6) for i in range(10_000)]
    df = spark.createDataFrame(rows, "__id long, text string, lang string, source string, n_chars long")
    cols = ("text", "source", "lang", "n_chars")
    _, words, _ = cotrain._features(df, cols, 3000, None)
    copies = sum(len(w) == 3 for w in words)  # the, same, text
    assert len(words) == 3000 and abs(copies / 3000 - 2 / 3) < 0.05
    repeated = df.unionByName(df.where("__id = 7").crossJoin(spark.range(5000).select()))
    assert len(cotrain._features(repeated, cols, 40_000, None)[1]) == len(rows)  # fully equal rows count once


def test_odd_rows(spark):
    rows = [(i, f"good text number {i} with words", "en", "a", 20, 1) for i in range(40)] + [(100 + i, "bad bad bad bad", None, None, None, 1) for i in range(40)]
    rows += [(200, None, None, None, None, 1), (201, "", "en", "a", 0, 1), (None, "x " * 100_000, "en", "a", 3, 1), (0, "good text number 0 with words", "en", "a", 20, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, good int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(100 + i, 0, 0) for i in range(30)] + [(0, 1, 0), (35, None, 0), (None, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    out = cotrain.classify(df, labels).collect()
    by = {r.doc_id: r.good for r in out}
    assert len(out) == len(rows) and by[39] > 0.5 > by[139] and all(r.good is not None for r in out)
    assert {r.good for r in cotrain.classify(df, labels.limit(0)).collect()} == {None}
    assert cotrain.classify(df.limit(0), labels).count() == 0


def test_only_ids_and_hashes_are_joined(spark, monkeypatch):
    rows = [(i % 90 if i % 9 else None, f"text {i % 80}", "en", "a", i % 7) for i in range(300)]
    docs = spark.createDataFrame(rows, "__id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame([(i, i % 3) for i in range(0, 120, 2)], "__id long, good int")
    cols = ("text", "source", "lang", "n_chars")
    plans, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or collect(self))
    for n in (1000, 20):
        for label, joined in (("good", docs.join(known, "__id")), (None, docs.join(known, "__id", "left_anti"))):
            at = F.xxhash64("__id", *cols, *([label] if label else [])).bitwiseAND(F.lit(2**63 - 1))
            want = joined.select(at.alias("at"), "text").distinct().orderBy("at").limit(n).collect()
            plans.clear()
            got = cotrain._features(docs, cols, n, label, known)
            assert len(got[1]) == len(want) and {w.tobytes() for w in got[1]} == {
                w.tobytes() for w in cotrain.text_stats([r.text.encode() for r in want], cotrain.WordHashes())[1]}
            joins = [p for p in plans[-1].split("\n") if "Join " in p and "__id" in p]
            assert joins and "rightHint=(strategy=broadcast)" in plans[-1]
