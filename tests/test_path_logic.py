"""Paths with OR, NOT and comparisons of two variables, against enumeration."""
import itertools
import random

import pytest

from concordia.operators import decide, difference, paths as P
from concordia.plans.audit import AuditPlan

GRID = [x / 4 for x in range(-4, 17)]  # separates chains of three variables between whole numbers
OPS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def literal(rng, ordered=True):
    var = rng.choice("abc")
    if ordered and rng.random() < 0.4:
        return var, "V", rng.choice(["<", "<=", ">", ">="]), None, rng.choice([v for v in "abc" if v != var])
    return var, "R", rng.choice(list(OPS)), float(rng.randint(0, 3)), None


def holds(lit, env):
    var, sort, op, num, other = lit
    return OPS[op](env[var], env[other] if sort == "V" else num)


def solvable(clauses):
    """Some assignment meets every literal of one of the clauses."""
    envs = [dict(zip("abc", v)) for v in itertools.product(GRID, repeat=3)]
    return any(any(all(holds(lit, env) for lit in c) for env in envs) for c in clauses)


def test_conflicts_against_enumeration(spark):
    rng = random.Random(11)
    rules = {(u, r): [[literal(rng) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 2))] for u in range(8) for r in range(2)}
    paths = {(u, p): [[literal(rng) for _ in range(rng.randint(1, 2))] for _ in range(rng.randint(1, 2))] for u in range(8) for p in range(3)}
    cl = spark.createDataFrame([(u, r, i, k, *lit[:2], lit[2], lit[3], None, lit[4], False) for (u, r), cs in rules.items() for i, c in enumerate(cs) for k, lit in enumerate(c)],
                               "unit int, rule_id int, clause_id int, slot int, var string, sort string, rop string, num double, sv string, sval string, falsum boolean")
    pl = spark.createDataFrame([(u, p, "full", i, *lit[:2], lit[2], lit[3], None, lit[4], False) for (u, p), cs in paths.items() for i, c in enumerate(cs) for lit in c],
                               "unit int, path_no int, scope string, pclause int, var string, sort string, rop string, num double, sv string, sval string, falsum boolean")
    got = {(r.unit, r.rule_id, r.path_no) for r in decide.jointly_satisfiable(cl, pl).collect()}
    want = {(u, r, p) for (u, r), cs in rules.items() for (v, p), ps in paths.items() if u == v and solvable([c + q for c in cs for q in ps])}
    assert got == want and 0 < len(want) < 48


def test_chains(spark):
    """``a < b, a = 5, b = 2`` and longer chains, strict and not."""
    def unsolvable(*systems):
        rows = [(i, var, "V" if isinstance(x, str) else "R", op, None if isinstance(x, str) else float(x), x if isinstance(x, str) else None)
                for i, s in enumerate(systems) for var, op, x in s]
        lits = spark.createDataFrame(rows, "k int, var string, sort string, rop string, num double, sval string")
        bad = difference.unsolvable(difference.edges(lits, ["k"]), lits.where("sort = 'R' and rop = '!='").select("k", "var", "num"), ["k"])
        return {r.k for r in bad.collect()}

    long = [(f"v{i}", "<=", f"v{i + 1}") for i in range(20)]
    assert unsolvable([("a", "<", "b"), ("a", "=", 5), ("b", "=", 2)], [("a", "<", "b"), ("a", "=", 2), ("b", "=", 5)],
                      [("a", "<", "b"), ("b", "<", "a")], [("a", "<=", "b"), ("b", "<=", "a")], [("a", "<=", "b"), ("b", "<=", "a"), ("a", "=", 3), ("b", "!=", 3)],
                      [*long, ("v20", "<", "v0")], [*long, ("v20", "<=", "v0")], [*long, ("v0", ">=", 1), ("v20", "<", 1)], [*long, ("v0", ">=", 1), ("v20", "<=", 1), ("v7", "!=", 1)],
                      [*long, ("v0", ">=", 1), ("v20", "<=", 2), ("v7", "!=", 1)]) == {0, 2, 4, 5, 7, 8}


PATHS = ["!(a = 1) -> (b = 2) -> \"(c = 0)\"", "(a = 1) || (b = 2) -> \"(c = 0)\"", "((a < 2) || (b > 1)) && (c = 1) -> \"(a = 0)\"",
         "!(a = 1 || b = 2) -> \"(c = 3)\"", "(a = 1) -> \"(b = 2)\"", "(a < b) -> (b <= c) -> \"(c = 2)\"", "(a = 1) || -> \"(c = 0)\""]


def value(path, env):
    """Truth of a path: AND of its parts, each read as given in this list."""
    a, b, c = (env[v] for v in "abc")
    return [a != 1 and b == 2 and c == 0, a == 1 or (b == 2 and c == 0), (a < 2 or b > 1) and c == 1 and a == 0,
            not (a == 1 or b == 2) and c == 3, a == 1 and b == 2, a < b <= c == 2][path]


RULES = ["(a = 1) -> (b = 2)", "(a < b) -> (c >= a)", "(b > 2) -> (c <= 1)", "(c = 3) -> (a != 1)"]


def rule_value(rule, env):
    a, b, c = (env[v] for v in "abc")
    return [a == 1 and b == 2, a < b and c >= a, b > 2 and c <= 1, c == 3 and a != 1][rule]


@pytest.fixture(scope="module")
def parts(spark):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(PATHS)], "unit int, path_no int, text string")
    return P.path_parts(df).cache()


@pytest.mark.parametrize("negate", [False, True])
def test_clauses_of_paths(spark, parts, negate):
    lits = {(r.path_no, r.pos): (r.var, r.sort, r.rop, r.num, r.sval) for r in P.path_literals(parts, with_logic=True).collect()}
    logical = {r.path_no for r in P.path_literals(parts, with_logic=True).where("logical").collect()}
    assert logical == {0, 1, 2, 3, 6} and [r.path_no for r in P.path_logic_error(parts).collect()] == [6]
    found = {}
    for r in P.path_clauses(parts, negate=negate).collect():
        found.setdefault(r.path_no, {}).setdefault(r.pclause, []).append((lits[r.path_no, r.pos], r.negated))
    assert set(found) == {0, 1, 2, 3}
    for p, clauses in found.items():
        for v in itertools.product([0, 0.5, 1, 2, 3], repeat=3):
            env = dict(zip("abc", v))
            dnf = any(all(holds(lit, env) != neg for lit, neg in c) for c in clauses.values())
            assert dnf == (value(p, env) != negate), (PATHS[p], env)


def test_whole_plan(spark):
    """V1 and V2 of the audit on such paths."""
    envs = [dict(zip("abc", v)) for v in itertools.product(GRID, repeat=3)]
    rules = spark.createDataFrame([(1, i, r) for i, r in enumerate(RULES)], "unit int, rule_id int, text string")
    paths = spark.createDataFrame([(1, i, p) for i, p in enumerate(PATHS[:6])], "unit int, path_no int, text string")
    plan = AuditPlan(rules, paths, exempt_names=("a", "b", "c"))
    reasons = {r.rule_id: r.reason for r in plan.st.collect()}
    assert reasons == {i: None for i in range(4)}
    got = {(r.rule_id, r.path_no) for r in plan.decision["sat"].where("scope = 'full'").collect()}
    assert got == {(r, p) for r in range(4) for p in range(6) if any(rule_value(r, e) and value(p, e) for e in envs)}
    holds_ = {(r.rule_id, r.path_no): r.holds for r in plan.entailment().collect()}
    names = [set("ab"), set("ac"), set("bc"), set("ca")]  # of the left sides of literals
    in_path = [set("abc")] * 4 + [set("ab"), set("abc")]
    for (r, p), h in holds_.items():
        covered = names[r] <= in_path[p]
        assert h == (not covered or not any(rule_value(r, e) and not value(p, e) for e in envs)), (RULES[r], PATHS[p])
    assert len(holds_) == 24


def test_pairs_are_decided_in_their_row(spark):
    """Literals are shuffled once by owner and its rows once by unit; no round over pairs."""
    sides = [spark.createDataFrame([(1, 1, "full", 0, "a", "V", "<", None, None, "b", False), (1, 1, "full", 0, "b", "R", "<=", x, None, None, False)],
                                   "unit int, key int, scope string, clause int, var string, sort string, rop string, num double, sv string, sval string, falsum boolean")
             for x in (2.0, 3.0)]
    paths = sides[0].withColumnsRenamed({"key": "path_no", "clause": "pclause"}).unionByName(spark.createDataFrame(
        [(1, 2, "full", 0, "a", "R", ">=", 3.0, None, None, False)], "unit int, path_no int, scope string, pclause int, var string, sort string, rop string, num double, sv string, sval string, falsum boolean"))
    found = decide.jointly_satisfiable(sides[1].drop("scope").withColumnsRenamed({"key": "rule_id", "clause": "clause_id"}), paths)
    assert [tuple(r) for r in found.collect()] == [(1, 1, 1, "full")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    physical = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Join") == 1 and physical.count("Exchange hashpartitioning") <= 4
