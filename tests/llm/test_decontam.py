import random
import re
from collections import Counter

import numpy as np

from concordia.llm import decontam
from concordia.llm.queries import op4_decontaminate


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            if not v:
                continue
            k = min(5, len(v))
            item = Counter(tuple(v[a:a + k]) for a in range(len(v) - k + 1))
            known = {p for s in item for p in s}
            for s in range(len(w) - len(v) + 1):
                if sum(p in known for p in w[s:s + len(v)]) * 2 < len(v):
                    continue
                win = Counter(tuple(w[a:a + k]) for a in range(s, s + len(v) - k + 1))
                value = sum((item & win).values()) / sum((item | win).values())
                if value >= 0.75 and (-value, s) < out.get((d, i), (0, 0, 0))[:2]:
                    out[d, i] = (-value, s, len(v))
    return {k: (s, n, -v) for k, (v, s, n) in out.items()}


def corpus(seed=4):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate([1, 2, 4, 5, 6, 9, *[r.randrange(10, 60) for _ in range(30)]])]
    items += [(90, None), (91, " "), (92, "a b a b a b a b a b a b a b"), (93, items[20][1]), (93, items[20][1])]
    docs = []
    for d in range(150):
        body = text(r.randrange(0, 80))
        for _ in range(r.randrange(0, 3)):
            p = (r.choice(items)[1] or "").split()
            for _ in range(r.randrange(0, 4)):
                if p:
                    p[r.randrange(len(p))] = r.choice(vocab)
            if r.random() < 0.3 and p:
                p.insert(r.randrange(len(p)), "extra")
            at = r.randrange(len(body) + 1)
            body[at:at] = p
        docs.append((d, r.choice([" ", "\n"]).join(body).upper() if r.random() < 0.2 else " ".join(body)))
    return docs + [(500, None), (501, ""), (502, "a b " * 40), (503, "W1"), (504, " ".join(text(20_000)) + " " + items[25][1])], items


def test_against_every_window(spark, tmp_path, monkeypatch):
    docs, items = corpus()
    spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(docs, dict(items).items())
    for size in (decontam.BLOCK_BYTES, 2000):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        out = op4_decontaminate(spark, str(tmp_path)).collect()
        assert {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in out} == want
        assert len(out) == len(want)


def test_test_data(spark):
    sf = "/root/testdata/sf0.001"
    rows = {n: [tuple(r) for r in spark.read.parquet(f"{sf}/{n}.parquet").select(k, "text").collect()]
            for n, k in (("documents", "doc_id"), ("benchmark", "item_id"))}
    out = op4_decontaminate(spark, sf).collect()
    want = brute(rows["documents"], rows["benchmark"])
    assert {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in out} == want


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", 1), (1, "a b c d e f", 1), (1, "a b c d e f", 1)], "doc_id long, text string, matches int")
    items = spark.createDataFrame([(7, "a b c d e f"), (None, "b c d e f")], "item_id long, text string")
    got = decontam.contaminated(docs, items).collect()
    assert all([m.item_id for m in r.matches] == [7, None] for r in got) and len(got) == 3
    assert all(r.matches == [] for r in decontam.contaminated(docs, items.limit(0)).collect())
    assert decontam.contaminated(docs.limit(0), items).count() == 0


def brute_short(docs, items):
    """Of documents with fewer words than an item, the whole one as the window."""
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            k = min(5, len(v))
            if k <= len(w) < len(v):
                item, win = (Counter(tuple(s[a:a + k]) for a in range(len(s) - k + 1)) for s in (v, w))
                value = sum((item & win).values()) / sum((item | win).values())
                if value >= 0.75:
                    out[d, i] = (0, len(w), value)
    return out


def test_documents_shorter_than_the_item(spark):
    r = random.Random(9)
    items = corpus()[1]
    docs = [(0, None), (1, ""), (2, "w1")]
    for i, x in items:
        p = words(x)
        for cut in (0, 1, 2, 3, 5, 8):
            for part in (p[:len(p) - cut], p[cut:], p[cut // 2:len(p) - (cut - cut // 2)], [*p[:3], *p[3 + cut:]]):
                docs.append((len(docs), " ".join(part)))
                if part and r.random() < 0.5:
                    part = [*part]
                    part[r.randrange(len(part))] = "other"
                    docs.append((len(docs), " ".join(part)))
    short = brute_short(docs, dict(items).items())
    assert len(short) > 100
    out = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x.doc_id, m.item_id): (m.start_word, m.n_words, m.similarity) for x in out for m in x.matches}
    assert got == brute(docs, dict(items).items()) | short


def test_share_of_pairs_after_each_step():
    r = np.random.default_rng(2)
    items = decontam.Items(40, [(i, r.integers(0, 1 << 63, 40).astype(np.uint64)) for i in range(200)])
    prints = r.integers(0, 256, (500, decontam.PRINT_BITS // 8)).astype(np.uint8)
    radius = decontam.reach(np.full(500, 36), np.zeros(500), 36, items.norm)
    assert set(radius.tolist()) == {74}
    bits = decontam.BITS[prints[:, None] ^ items.prints[None]].reshape(500, 200, decontam.BLOCKS, -1).sum(axis=3)
    assert (bits <= 74 // decontam.BLOCKS).any(axis=2).mean() < 0.5
    assert len(items.candidates(prints, radius)[0]) / 100_000 < 0.01


def test_windows_with_a_shingle_repeated_often(spark):
    r = random.Random(8)
    items, docs = [], []
    for i in range(60):
        item = [f"i{i}w{k}" for k in range(r.randrange(120, 200))]
        n = (len(item) - 4) // 8
        items.append((i, " ".join(item)))
        docs.append((i, " ".join(["x"] * n + item[n:])))  # n - 4 windows of one shingle
    out = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x.doc_id, m.item_id): (m.start_word, m.n_words, m.similarity) for x in out for m in x.matches}
    want = brute(docs, items)
    assert len(want) > 20 and got == want
