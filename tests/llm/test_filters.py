from itertools import permutations

from hypothesis import given, settings, strategies as st

from concordia.llm import filters
from concordia.llm.filters import Trie, interactions, masks

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    out, w = [], ""
    for ch in text + " ":
        if ch in SPACE:
            out += [w] if w else []
            w = ""
        else:
            w += ch
    return out


def brute(docs, labels):
    good = {d for d, q, t in labels if q == 1 and d is not None}
    toxic = {d for d, q, t in labels if t == 1 and d is not None}
    fails = []
    for d, text, lang in docs:
        t = text or ""
        ws = words(t)
        f = set()
        f |= {"A"} if len(ws) < 100 else set()
        f |= {"B"} if 100 * len(set(ws)) < 80 * len(ws) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else set()
        f |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        f |= {"E"} if d is not None and any(o is not None and o < d and (x or "") == t for o, x, _ in docs) else set()
        fails.append((d, lang or "", f))
    out = {}
    for part in {p for _, p, _ in fails}:
        mine = [(d, f) for d, p, f in fails if p == part]
        removed_in = {}
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, f in enumerate(order, 1):
                now = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed_in[order, f] = len(now)
                out[part, order, step] = [len(left), len(now), sum(f in x for _, x in mine) - len(now), sum(x == {f} for _, x in mine),
                                          sum(d in good for d, _ in now), sum(d in toxic for d, _ in now)]
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(sum(n for (_, g), n in removed_in.items() if g == f))
    return {k: tuple(v) for k, v in out.items()}


def result(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as part", "2 as mask", "3 as shard").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as rows")
    rows = [tuple(r) for r in interactions(masks(d), lab).collect()]
    assert len(rows) == len({r[:3] for r in rows})
    return {r[:3]: r[3:] for r in rows}


LONG = " ".join(f"word{i}" for i in range(120))
DOCS = [(1, LONG, "en"), (2, LONG, "en"), (3, LONG, "fr"), (3, LONG, "en"), (4, None, "en"), (5, "", None), (6, "", ""), (None, "", "en"),
        (None, LONG, "en"), (7, "ABC def", "en"), (8, "a a a a\x0ba\x1ca", "fr"), (9, LONG + "#", "fr"), (9, LONG + "#", "fr"),
        (10, LONG + " é", None), (11, LONG + " éA", "en"), (12, LONG[:-1], "en"), (13, LONG[:40], "en"), (0, LONG[:40], "de"),
        (14, " ".join(["same"] * 200), "de"), (15, "x" * 3_000_000, "de"), (16, "x" * 3_000_000, "de"), (17, "x" * 2_999_999 + "y", "de")]
LABELS = [(1, 1, 0), (2, 1, None), (3, 0, 1), (3, 1, 0), (None, 1, 1), (7, None, 1), (14, 1, 1), (99, 1, 1)]


def test_small(spark):
    assert result(spark, DOCS, LABELS) == brute(DOCS, LABELS)


def test_long_prefixes_and_small_tries(spark, monkeypatch):
    monkeypatch.setattr(filters, "LIMIT", 600)  # prefixes are extended over many levels
    monkeypatch.setattr(filters, "LOCAL", 500)
    monkeypatch.setattr(filters, "SHARDS", 10 ** 9)
    docs = DOCS[:-3] + [(20 + i, LONG + "z" * (i % 7) + "q" * (i % 3), "en") for i in range(60)]
    assert result(spark, docs, LABELS) == brute(docs, LABELS)


def test_empty(spark):
    assert result(spark, [], []) == {}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=40).map(str.encode), st.integers(0, 9)), max_size=30))
def test_trie(rows):
    trie, found = Trie(), []
    for text, i in rows:
        found += [(r[0], r[3]) for r in trie.insert(text, i, 0, "", 1)]
    low = {}
    for text, i in rows:
        low[text] = min(i, low.get(text, i))
    assert sorted((h[4], h[0]) for h in trie.holders()) == sorted(low.items())
    assert sum(n for _, n in found) + sum(h[3] for h in trie.holders()) == len(rows)
    assert sum(n for _, n in found) == sum(i > low[t] for t, i in rows)


def test_common_prefix():
    a = bytes(range(256)) * 300
    for n in (0, 1, 15, 16, 17, 4000, 70000):
        b = a[:n] + b"\xff\x00" if a[n:n + 1] != b"\xff" else a[:n] + b"\x00"
        assert filters.common(a, 0, len(a), b"zz" + b, 2) == n
    assert filters.common(a, 0, len(a), a, 0) == len(a)
