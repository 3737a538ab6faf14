import numpy as np

from concordia.llm import embed
from concordia.llm.queries import op9_embeddings


def brute(rows, least=0.98):
    """{vec_id: (links, component)} over all pairs of equal labels."""
    ids, links = [r[0] for r in rows], {r[0]: set() for r in rows}
    ok = [r for r in rows if r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    for lab, size in {(r[2], len(r[1])) for r in ok}:
        part = [r for r in ok if (r[2], len(r[1])) == (lab, size)]
        m = np.array([r[1] for r in part], float)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(m @ m.T >= least)):
            if a != b:
                links[part[a][0]].add(part[b][0])
    comp = {}
    for i in sorted(ids):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = i
                todo += links[x]
    return {i: (len(links[i]), comp[i]) for i in ids}, links


def data(seed=0, n=2500):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 16)).astype("f4")
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)]
    for i in range(400):  # near copies, some scaled
        v = base[i] + rng.normal(scale=0.08, size=16)
        rows.append((n + i, (v * rng.choice([1, 3])).astype("f4").tolist(), int(i % 3)))
    rows += [(9000 + i, base[5].tolist(), 2) for i in range(900)]  # a hot vector
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, x string, node int")


def test_recall_and_no_false_links(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(embed, "LEAF", 64)
    rows = data()
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, _ = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in op9_embeddings(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert np.mean([got[i] == want[i] for i in want]) >= 0.98


def test_bounds_of_sketches_hold():
    rng = np.random.default_rng(3)
    for width in (1, 3, 64, 1100):
        m = embed.normal(rng.normal(size=(60, width)) * rng.choice([1e-30, 1, 1e30], size=(60, 1)))
        m = np.vstack([m, embed.normal(m[:20] + rng.normal(scale=0.2 / np.sqrt(width), size=(20, width)))])
        low, high = embed.cosine_bounds(embed.sketch(m), embed.sketch(m))
        assert (low <= m @ m.T).all() and (m @ m.T <= high).all() and (high - low).max() < 0.08


def test_pairs_near_the_limit_are_confirmed(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):  # cosines within the sketches' error of 0.98
        u, v = rng.normal(size=(2, 16))
        u /= np.linalg.norm(u)
        v -= (v @ u) * u
        c = 0.98 + rng.uniform(-0.004, 0.004)
        rows += [(2 * i, u.tolist(), i), (2 * i + 1, (c * u + np.sqrt(1 - c * c) * v / np.linalg.norm(v)).tolist(), i)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embed.near_vectors(df).collect()} == brute(rows)[0]


def test_large_leaves_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(embed, "MOST", 64)
    rows = data(1, 700)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed.near_vectors(frame(spark, rows), trees=1).collect()}
    monkeypatch.setattr(embed, "LEAF", 10_000)
    full = {r.vec_id: (r.n_links, r.component_id) for r in embed.near_vectors(frame(spark, rows), trees=1).collect()}
    assert full == brute(rows)[0] and len(got) == len(full)


def test_test_data(spark):
    for sf in ("/root/testdata/sf0.01",):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
        assert {r.vec_id: (r.n_links, r.component_id) for r in op9_embeddings(spark, sf).collect()} == brute(rows)[0]


def test_odd_rows(spark):
    v = [1.0, 2.0, 2.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, v, None), (4, None, 0), (5, [], 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 2.0], 0),
            (8, [float("nan"), 1.0, 1.0], 0), (9, [float("inf"), 1.0, 1.0], 0), (None, v, 0), (10, [1e-30, 2e-30, 2e-30], 0), (11, [1.0, 2.0], 0),
            (12, [0.0, -0.0, 1.0], 0), (13, [-0.0, 0.0, 1.0], 0)]
    got = sorted((tuple(r) for r in embed.near_vectors(frame(spark, rows)).collect()), key=repr)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (10, 3, 1, False), (None, 0, None, True), (12, 1, 12, True), (13, 1, 12, False)]
    want += [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11)]
    assert got == sorted(want, key=repr)
    assert embed.near_vectors(frame(spark, rows).limit(0)).count() == 0


def test_recall_where_the_sample_is_small(spark, monkeypatch):
    monkeypatch.setattr(embed, "SAMPLE", 500)
    monkeypatch.setattr(embed, "LEAF", 16)
    rng = np.random.default_rng(5)
    rows = data(2, 12_000)[:-900]
    centre = rng.normal(size=16)
    rows += [(20_000 + i, (centre + rng.normal(scale=0.05, size=16)).astype("f4").tolist(), 1) for i in range(300)]
    rows += [(30_000 + i, rng.normal(size=16).astype("f4").tolist(), 3) for i in range(20)]
    want, _ = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed.near_vectors(frame(spark, rows), trees=4).collect()}
    for part in ([i for i in want if i < 20_000], [i for i in want if i >= 20_000]):  # copies, dense group
        recall = sum(got[i][0] for i in part) / sum(want[i][0] for i in part)
        print("RECALL", recall)
        assert recall >= 0.98
