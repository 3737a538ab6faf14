"""Rule logic: clauses against truth tables, the score program against a direct fold."""
import itertools
import random

from concordia.operators.rules import skeleton_columns
from concordia.operators.similarity import fold_similarity
from pyspark.sql import functions as F

FACTOR = 0.85


def analyse(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, templated string").repartition(8)
    return [r for r in skeleton_columns(df, ["i"]).orderBy("i").collect()]


def formula(r, depth, slots):
    """(text, truth, score) of a random rule text; ``truth`` and ``score`` take slot values."""
    def atom():
        pick = r.random()
        if depth and pick < 0.4:
            text, truth, score = formula(r, depth - 1, slots)
            return f"({text})", truth, score
        k = next(slots)
        if pick < 0.6:
            return "!({})", lambda e: not e[k], lambda e: e[k] * FACTOR
        if pick < 0.7:
            return "!(!({}))", lambda e: e[k], lambda e: 1 - e[k] * FACTOR
        return ("({})" if pick < 0.85 else "{}"), lambda e: e[k], lambda e: e[k]

    parts = [atom() for _ in range(r.randrange(1, 4))]
    text, truth, score = parts[-1]
    for t, h, s in reversed(parts[:-1]):
        op = r.choice(["->", "&&", "||", " ^ "])
        text = t + op + text
        either = op == "||"
        truth = (lambda h, g, o: lambda e: (h(e) or g(e)) if o else (h(e) and g(e)))(h, truth, either)
        score = (lambda s, g, o: lambda e: (max if o else min)(s(e), g(e)))(s, score, either)
    return text, truth, score


def test_random_rules(spark):
    r = random.Random(1)
    made = []
    while len(made) < 300:
        slots = itertools.count()
        text, truth, score = formula(r, 2, slots)
        n = next(slots)
        if 2 <= n <= 7:
            made.append((text, truth, score, n))
    rows = analyse(spark, [m[0] for m in made])
    scores = [[round(r.random(), 2) for _ in range(m[3])] for m in made]
    df = spark.createDataFrame([(i, row.rpn, s) for i, (row, s) in enumerate(zip(rows, scores))],
                               "i int, rpn array<int>, s array<double>")
    folded = [x.v for x in df.select("i", fold_similarity(F.col("rpn"), F.col("s")).alias("v")).orderBy("i").collect()]
    for (text, truth, score, n), row, s, v in zip(made, rows, scores, folded):
        assert row.skeleton_error is None and row.n_slots == n, text
        for env in itertools.product([False, True], repeat=n):
            got = any(all(env[abs(x) - 1] == (x > 0) for x in c) for c in row.dnf)
            assert got == truth(env), text
        assert abs(v - score(s)) < 1e-12, text


def test_given_shapes(spark):
    a, b, c, d, e, f, g, h, i, j, k, m = analyse(spark, [
        "({})->({})", "(({})||({}))->({})", "!({})->({})", "({})", "!({}&&{})->({})", "{}&&{}||{}", None, "no logic",
        "({})&&", "!(({}))->{}", "{} {} -> {}", "so ({}) -> {} -> {}"])
    assert a.logic == "{0}^{1}" and a.dnf == [[1, 2]] and a.rpn == [0, 1, -1]
    assert b.dnf == [[1, 3], [2, 3]]
    assert c.logic == "[{0}]^{1}" and c.dnf == [[-1, 2]] and c.rpn == [-1000, 1, -1]
    assert d.skeleton_error == "single_literal" and d.dnf == [[1]] and d.rpn is None
    assert e.skeleton_error == "fold" and e.dnf == [[-1, 3], [-2, 3]] and e.rpn is None
    assert f.dnf == [[1, 2], [1, 3]]
    assert (g.skeleton_error, g.n_slots, g.dnf) == ("null", 0, None)
    assert h.skeleton_error == "no_literal" and h.dnf is None
    assert i.skeleton_error == "single_literal"
    assert j.skeleton_error == "skeleton" and j.dnf is None
    assert k.dnf == [[1]]
    assert m.logic == "{0}^{1}" and m.n_slots == 3


def test_long_and_wide_rules(spark):
    chain, wide = "->".join(["({})"] * 600), "->".join(["({}||{})"] * 11)
    x, y = analyse(spark, [chain, wide])
    assert x.dnf == [list(range(1, 601))] and len(x.rpn) == 1199
    assert len(y.dnf) == 2 ** 11 and y.skeleton_error is None
