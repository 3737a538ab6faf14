"""Paths read in their own row give what gathering their literals gives, on in-line rows."""
import random

from concordia.operators import decide, paths as P, rules as R
from concordia.plans import audit
from pyspark.sql import functions as F

KEYS = ["unit", "path_no"]


def _text(r):
    lit = lambda: r.choice(["(a = {})", "(a != {})", "({} < a)", "(b <= {})", "(b > {})", "(a = 'x{}')", "(call_f = {})", "(a < b)", "(b >= a)", "({} = b)",
                            "(c = True)", "(c != None)", "(d = )"]).format(r.randint(0, 2))
    conds = [r.choice([lit, lit, lambda: f"({lit()} || {lit()})", lambda: "!" + lit(), lambda: f"!({lit()} || "])() for _ in range(r.randint(0, 4))]
    return " -> ".join([*conds, r.choice([f'"{lit()} ^ {lit()}"', "'(a)_(b)_ERROR_END'", "'(c)_ERROR_END'", '""'])])


def _plain(v):
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return sorted(map(_plain, v))
    return str(v.asDict() | {k: _plain(x) for k, x in v.asDict().items() if isinstance(x, list)}) if hasattr(v, "asDict") else str(v)


def _rows(df):
    return sorted(_plain([f"{c}:{_plain(r[c])}" for c in df.columns]) for r in df.collect())


def test_rows_equal_the_gathered_literals(spark):
    r = random.Random(5)
    paths = spark.createDataFrame([(i % 7, i, _text(r)) for i in range(400)] + [(1, -1, None)], "unit int, path_no int, text string")
    rows = P.path_rows(P.path_parts(paths))
    assert rows.where("not alone").count() == 0
    assert _rows(audit.path_info(rows)) == _rows(audit._gathered(rows, KEYS))
    negated = P.with_logic(rows, negate=[True]).select(*KEYS, decide.row_forms("not").alias("forms")).where("forms is not null")
    want = decide.path_forms(decide.negated_path_scopes(P.row_literals(rows), P.path_clauses(rows, negate=True))).select(*KEYS, "forms")
    assert _rows(negated) == _rows(want) and negated.count() > 100
    cols = ["pos", "var", "op", "sval", "nval", "lit_error", "logical", "in_error", "sort", "rop", "num", "sv"]
    assert _rows(P.row_literals(rows).select(*KEYS, *cols)) == _rows(P.path_literals(P.path_parts(paths), with_logic=True).select(*KEYS, *cols))


def test_paths_that_share_their_keys_are_gathered(spark):
    paths = spark.createDataFrame([(1, 1, '(a = 1) -> "(b = 2)"'), (1, 1, '(a = 2) -> "(b = 2)"'), (1, 2, '(a = 1) -> "(b = 2)"'), (None, 1, '"(a = 1)"')],
                                  "unit int, path_no int, text string")
    info = {(r.unit, r.path_no, r.first): r.full for r in audit.path_info(P.path_rows(P.path_parts(paths))).collect()}
    assert set(info) == {(1, 1, True), (1, 1, False), (1, 2, True), (None, 1, False)}
    assert info[1, 1, True] is None and len(info[1, 2, True]) == 1 and info[None, 1, False] is None


def test_signs_that_mark_literals_may_stand_in_a_text(spark):
    texts = ["(a = 'x\x01y\x02') -> (b != '\x03\x05\x03') && (3 < c)", "(a = '\x03') -> (b = f('\x02'))", "(a = None) -> (b != 'True')"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [tuple(r) for r in R.literals_from_text(df, "text", ["i"]).orderBy("i", "slot").select("i", "var", "op", "sval", "nval").collect()]
    assert got[:3] == [(0, "a", "=", "x\x01y\x02", ""), (0, "b", "!=", "\x03\x05\x03", ""), (0, "c", ">", "", "3")]
    assert got[3:] == [(1, "a", "=", "\x03", ""), (1, "b", "=", "f('\x02')", ""), (2, "a", "=", "None", ""), (2, "b", "!=", "True", "")]
    in_row = R.literals_in_row(df, "text", "lits").select("i", F.posexplode("lits").alias("slot", "x"))
    assert [tuple(r) for r in in_row.orderBy("i", "slot").select("i", "x.var", "x.op", "x.sval", "x.nval").collect()] == got


def test_flat_texts_are_told_by_one_look(spark):
    df = spark.createDataFrame([("(a) -> (b)",), ("()" * 30000,), ("",), ("(a", ), ("a)",), ("((a))",), ("(a)\n)",)], "t string")
    flat = [r[0] for r in df.select(F.col("t").rlike(P.FLAT_RE)).collect()]
    assert flat == [True, True, True, False, False, False, False]
    assert [r[0] for r in df.select(P.balance_parens(F.col("t"))).collect()] == ["(a) -> (b)", "()" * 30000, "", "a", "a", "((a))", "(a)\n"]
