import hashlib
import random
import zlib

import numpy as np
import pytest

from concordia.llm import prefixes
from concordia.llm.prefixes import RECORD, own_heads, prefix_trie, rebuilt_heads
from concordia.llm.queries import op13_prefixes

SPACE = " \t\n\x0b\x0c\r"


def n_words(text):
    for ch in SPACE:
        text = text.replace(ch, " ")
    return len([w for w in text.split(" ") if w])


def brute(rows, rebuilt=True):
    """{(conv, depth): (parent, members, children, leaves, saved, digest)} by definition."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    seqs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuilt else 0
        lender = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        seqs[c] = tuple(own.get(lender, [])[:h] + ts[h:]) if rebuilt else tuple(ts)
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    kids = {}
    for s in nodes:
        if s:
            kids.setdefault(s[:-1], []).append(s)

    out = {}
    for s in sorted(nodes, key=len, reverse=True):
        own_saved = (len(nodes[s]) - 1) * n_words(s[-1][1]) if s else 0
        below = [out[k] for k in kids.get(s, [])]
        at_end = ",".join(map(str, sorted(c for c in nodes[s] if len(seqs[c]) == len(s))))
        out[s] = (min(nodes[s]), len(s), min(nodes[s[:-1]]) if s else None, len(nodes[s]), len(below), sum(b[5] for b in below) or 1,
                  own_saved + sum(b[6] for b in below), hashlib.sha256(at_end.encode()).hexdigest())
    return sorted(out.values(), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as conv", "2 as path", "3 as range").repartition(4)


def result(spark, rows, heads=rebuilt_heads):
    return sorted((tuple(r) for r in prefix_trie(frame(spark, rows), heads=heads).collect()), key=str)


def random_rows(seed, n, alphabet=3, longest=8):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 3 * n), n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, t, None]) if t == 0 else t, rng.choice(["user", "bot", None]), rng.choice(["a b", "a", "", None, "é\x1c x"][:alphabet])))
    return rows


CASES = [(1, 0, "u", "hi there"), (1, 1, None, None), (2, 0, "u", "hi there"), (2, 0, "u", "hi there"), (None, 0, "u", "x"), (3, None, "a", "b"), (3, None, "a", "a"),
         (40, 5, "u", "hi there"), (41, 0, "u", "hi there"), (5, 0, "", ""), (25, 1, None, "long " * 100_000)]


def test_cases(spark):
    assert result(spark, CASES) == brute(CASES)
    assert result(spark, []) == []
    assert result(spark, CASES, own_heads) == brute(CASES, rebuilt=False)


@pytest.mark.parametrize("seed,piece,nodes,rows_a_range", [(1, 256, 200_000, 200_000), (2, 2, 5, 7), (3, 3, 40, 30)])
def test_random(spark, monkeypatch, seed, piece, nodes, rows_a_range):
    """Whole, and cut into many short pieces, small tries and ranges."""
    monkeypatch.setattr(prefixes, "PIECE", piece)
    monkeypatch.setattr(prefixes, "NODES", nodes)
    monkeypatch.setattr(prefixes, "ROWS_A_RANGE", rows_a_range)
    monkeypatch.setattr(prefixes, "CHUNK", 12)
    rows = random_rows(seed, 60)
    assert result(spark, rows) == brute(rows)


def test_a_third_in_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE", 4)
    monkeypatch.setattr(prefixes, "ROWS_A_RANGE", 50)
    rows = random_rows(7, 30, longest=4) + [(c, t, "u", "same" if t < 90 else f"{c}") for c in (500, 501, 502) for t in range(97)]
    rows += [(1000 + i, t, "u", "copy") for i in range(40) for t in range(2)]
    assert result(spark, rows) == brute(rows)


def test_double_array():
    rng = np.random.default_rng(4)
    for alphabet, n in ((3, 50), (500, 800), (4, 4000)):
        seqs = sorted({tuple(rng.integers(1, alphabet + 1, rng.integers(1, 7)).tolist()) for _ in range(n)})
        codes, lens = np.array([c for s in seqs for c in s]), np.array([len(s) for s in seqs])
        base, check, shared = prefixes.build(codes, lens, alphabet + 1)
        nodes = {s[:d] for s in seqs for d in range(1, len(s) + 1)}
        assert (check >= 0).sum() == len(nodes)
        slot = {(): 0}
        for s in sorted(nodes, key=len):
            slot[s] = int(base[slot[s[:-1]]] + s[-1])
            assert check[slot[s]] == slot[s[:-1]]
        assert len(set(slot.values())) == len(nodes) + 1
        for i in range(1, len(seqs)):
            assert shared[i] == next((k for k, (a, b) in enumerate(zip(seqs[i - 1], seqs[i])) if a != b), len(seqs[i - 1]))


def test_common():
    a = bytes(range(60))
    assert prefixes.common(a, a) == 3 and prefixes.common(a, a[:RECORD]) == 1 and prefixes.common(a, a[:30] + b"x" * 30) == 1 and prefixes.common(b"", a) == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op13_prefixes(spark, sf)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
