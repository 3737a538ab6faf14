"""Run-log blocks, placed results, names in sources and split units, on in-line rows."""
from concordia.operators import rules as R, similarity as L
from concordia.sources import text as S

BLOCK = """normal results: [False, False, True]


\x1b[91m[ BAD CONSTRAINT WITH ERROR ]\x1b[0m
##################################################
Type: Raise Error
path: (a != 0) -> '(a)_ERROR_END'
Library: c1-1
Class: K
Memberfunc: fit
Constraint: (a = 'x: y') -> (b != 'None')
path file: /info/c1-1/fit_path.txt
##################################################

BAD CONSTRAINT"""


def logs(spark, texts):
    return S.scan_lines(spark.createDataFrame(texts, "file string, text string"), "file")


def test_blocks_of_a_log(spark):
    got = S.parse_findings(logs(spark, [("a", BLOCK), ("b", "no block\n" + "#" * 50 + "\nClass: none"), ("e", ""), ("n", None)])).collect()
    assert [tuple(r) for r in got] == [("a", 4, "BAD_ERROR", "Raise Error", "(a != 0) -> '(a)_ERROR_END'", "c1-1", "K", "fit", None,
                                        "(a = 'x: y') -> (b != 'None')", "/info/c1-1/fit_path.txt", 3, 1)]


def test_blocks_of_a_long_log(spark):
    filler = "Class: outside\n" * 500
    text = filler.join([BLOCK, BLOCK.replace("c1-1", "c2").replace("[False, False, True]", "[]"), BLOCK.split("\n", 1)[1].replace(" WITH ERROR", "")])
    got = sorted(S.parse_findings(logs(spark, [("a", text)])).select("line_no", "verdict", "library", "unit", "n_results", "n_true").collect())
    n = [i for i, line in enumerate(text.split("\n"), 1) if "[ BAD" in line]
    assert [tuple(r) for r in got] == [(n[0], "BAD_ERROR", "c1-1", "K", 3, 1), (n[1], "BAD_ERROR", "c2", "K", 0, 0), (n[2], "BAD", "c1-1", "K", 0, 0)]


def test_placed_results_are_read_by_folder(spark, tmp_path):
    rows = spark.createDataFrame([("p", "1", 1), ("p", "2", 2), ("q/r", "1", 3), (None, "1", 4)], "project string, unit string, n int")
    S.place_results(rows, str(tmp_path / "placed"))
    assert sorted(S.read_placed(spark, str(tmp_path / "placed"), rows.schema).select("n").collect()) == [(1,), (2,), (3,), (4,)]
    one = S.read_placed(spark, str(tmp_path / "placed"), rows.schema, project="q/r", unit="1")
    assert [r.n for r in one.collect()] == [3]
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "project" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert [r.n for r in S.read_placed(spark, str(tmp_path / "placed"), rows.schema, project=None).collect()] == [4]


def test_rule_blocks_read_the_lines_after_a_marker(spark):
    text = "Logical Format: (a = 1) -> (b = 2)\nLogical format:\n```\n`x -> y`.\nLogical format:\n```z: (c) -> (d)```\nLogical format: end"
    got = S.scan_rule_blocks(S.scan_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "unit long, text string"), "unit")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, "(a = 1) -> (b = 2)"), (1, 2, "x -> y"), (1, 5, "(c) -> (d)")]


def test_names_in_source(spark):
    names = spark.createDataFrame([(1, 1, "alpha"), (1, 1, "beta"), (1, 2, "alpha"), (2, 3, "alpha"), (3, 4, "alpha")], "unit long, rule_id long, name string")
    sources = spark.createDataFrame([(1, "def f(alpha):"), (1, "beta = 1"), (2, "alph"), (2, None)], "unit long, text string")
    assert sorted(map(tuple, R.names_in_source(names, sources).collect())) == [(1, 1, True), (1, 2, True), (2, 3, False), (3, 4, False)]
    assert sorted(map(tuple, R.names_in_source(names, sources.where("text like 'd%'")).collect())) == [(1, 1, False), (1, 2, True), (2, 3, False), (3, 4, False)]


def test_a_unit_with_most_literals_is_split(spark, monkeypatch):
    lits = "unit long, path_no long, pos int, var string, op string, sval string, nval string"
    paths = spark.createDataFrame([(1, i, 0, f"name{i % 97}", "=", f"value{i}", "") for i in range(600)] + [(2, 0, 0, "x", "=", "y", "")], lits)
    rules = spark.createDataFrame([(1, 1, 0, "name13", "=", "value401", ""), (1, 1, 1, "name7", "!=", "value", ""), (2, 2, 0, "x", "=", "z", "")],
                                  "unit long, rule_id long, slot int, var string, op string, sval string, nval string")
    whole = sorted(map(tuple, L.best_match(rules, paths).collect()))
    monkeypatch.setattr(L, "SPLIT", 50)
    split = L.best_match(rules, paths)
    assert sorted(map(tuple, split.collect())) == whole and len(whole) == 3
    cells = L.score_candidates(rules, L.unit_candidates(paths))
    assert cells.count() == 2 * 600 + 1


def test_other_lines_are_left_out_of_the_findings_scan(spark, monkeypatch):
    log = ["a step", "Library: none", "normal results: [True, False]", "b: c", "[ BAD CONSTRAINT ]", "#" * 50, "x", "Type: t", "Other: o", "Type: u", "#" * 50, "Type: v"] + ["a step"] * 300
    seen = []
    scan = S.exclusive_scan
    monkeypatch.setattr(S, "exclusive_scan", lambda df, *a, **k: seen.append(df.count()) or scan(df, *a, **k))
    lines = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(log)], "file string, line_no int, line string")
    (row,) = S.parse_findings(lines).collect()
    assert (row.line_no, row.verdict, row.kind, row.library, row.n_results, row.n_true) == (5, "BAD", "t", None, 2, 1) and seen == [8]
