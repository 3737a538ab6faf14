import random
import re

import numpy as np

from concordia.llm import minhash
from concordia.llm.components import components
from concordia.llm.queries import op5_minhash


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, x in enumerate(ids):
        for y in ids[:n]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 75 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.randrange(1, 120))] for _ in range(30)]
    rows = []
    for b in base:
        rows.append(" ".join(b))
        for _ in range(r.randrange(0, 6)):  # copies with a few words changed, some of copies
            c = list(b)
            for _ in range(r.randrange(0, 4)):
                c[r.randrange(len(c))] = r.choice(words)
            if r.random() < 0.3:
                b = c
            rows.append(r.choice([" ", "\n", "\t  "]).join(c).upper() if r.random() < 0.2 else " ".join(c))
    hub = [r.choice(words) for _ in range(300)]
    for k in range(60):  # a chain: each near its neighbour, far from most others
        hub[(5 * k) % 300:(5 * k) % 300 + 3] = [f"c{k}a", f"c{k}b", f"c{k}c"]
        rows.append(" ".join(hub))
    passage = " ".join(r.choice(words) for _ in range(40))
    rows += [passage + " " + " ".join(r.choice(words) for _ in range(25)) for _ in range(80)]
    rows += [None, "", "  \n", "one", "ONE", "one two", "x " * 5000, "x " * 5001, "é É", "É é"]
    r.shuffle(rows)
    return list(enumerate(rows))


def write(spark, path, rows):
    spark.createDataFrame([(i, t, 0, 0, "k") for i, t in rows], "doc_id long, text string, node int, root int, key string") \
        .write.parquet(f"{path}/documents.parquet")


def test_against_all_pairs(spark, tmp_path):
    rows = corpus()
    write(spark, tmp_path, rows)
    want = brute(rows)
    got = op5_minhash(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_keys_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(minhash, "MEMBERS", 3)
    rows = corpus(6)
    write(spark, tmp_path, rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op5_minhash(spark, str(tmp_path)).collect()} == brute(rows)


def test_test_data(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op5_minhash(spark, sf).collect()} == brute(rows)


def test_null_ids_repeated_rows_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e f")],
                               "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 2, None, True), (4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False)], key=repr)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_minima_do_not_depend_on_blocks():
    x = np.random.default_rng(0).integers(0, 2**63, 500, dtype=np.uint64)
    sizes = np.array([0, 3, 200, 0, 297])
    assert (minhash.minima(x, sizes, 7) == minhash.minima(x, sizes)).all()


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 130)] + [(200, 200), (None, 3), (7, 6), (7, 6)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(1, 51)} | {k: 100 for k in range(101, 130)}


def test_only_texts_of_shared_keys_are_kept_for_comparison(spark, monkeypatch):
    staged, stage = {}, minhash.stage
    monkeypatch.setattr(minhash, "stage", lambda df, name: staged.setdefault(name, stage(df, name)) if name == "texts" else stage(df, name))
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1])), *((k, f"lone text number {k} of few words") for k in range(3, 9)), (9, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1} | {k: k for k in range(3, 10)}
    assert {1, 2} <= {r.node for r in staged["texts"].collect()} and staged["texts"].count() < 6
