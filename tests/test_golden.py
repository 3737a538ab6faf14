"""Golden cases transcribed from recorded runs, as small in-line rule/path tables."""
from concordia.plans.audit import audit


def run(spark, rules, paths):
    r = spark.createDataFrame(rules, "unit long, rule_id long, text string")
    p = spark.createDataFrame(paths, "unit long, path_no int, text string")
    return {row["rule_id"]: row for row in audit(r, p).collect()}


def test_error_path_hit_is_bad_error(spark):
    # (strategy = 'uniform') -> (sample_weight != 'None'): the code raises on a path where
    # the documented rule holds
    paths = [(1, 1, "(strategy = 'uniform') -> (sample_weight != 'None') -> '(strategy)_(sample_weight)_ERROR_END'"),
             (1, 2, "(strategy = 'quantile') -> \"(sample_weight = 'None')\"")]
    out = run(spark, [(1, 1, "(strategy = 'uniform') -> (sample_weight != 'None')")], paths)
    assert out[1]["verdict"] == "BAD_ERROR"
    assert out[1]["similarity"] == 100


def test_some_path_satisfies_rule(spark):
    paths = [(1, 1, "(strategy = 'uniform') -> \"(sample_weight = 'None')\""),
             (1, 2, "(strategy = 'kmeans') -> \"(sample_weight = 'None')\"")]
    out = run(spark, [(1, 1, "(strategy = 'uniform') -> (sample_weight = 'None')")], paths)
    assert out[1]["verdict"] == "CONSISTENT" and out[1]["n_true"] == 1


def test_self_contradictory_rule_is_bad(spark):
    paths = [(1, 1, "(solver = 'sgd') -> \"(lr = 1)\""), (1, 2, "(solver = 'adam') -> \"(lr = 2)\"")]
    out = run(spark, [(1, 1, "(solver = 'sgd') && (solver = 'adam') -> (lr = 1)")], paths)
    assert out[1]["verdict"] == "BAD" and out[1]["n_true"] == 0


def test_misspelt_name_is_rewritten(spark):
    # add_indicatoror matches add_indicator with a value of a different length: 0.72
    paths = [(1, 1, "(add_indicator = 'True') -> \"(features = 'missing')\""),
             (1, 2, "(add_indicator = 'False') -> \"(features = 'all')\"")]
    out = run(spark, [(1, 1, "(add_indicatoror = 'x') -> (features = 'all')")], paths)
    assert out[1]["similarity"] < 85
    assert out[1]["verdict"] in ("BAD", "CONSISTENT")


def test_screens(spark):
    paths = [(1, 1, "(a = 1) -> \"(b = 2)\"")]
    rules = [(1, 1, "(a = 'float32') -> (b = 2)"), (1, 2, "(a = 1) && (b = 2)"),
             (1, 3, "(a = 1) -> (b = 'ignore')"), (1, 4, "(a = '[x]') -> (b = 2)")]
    out = run(spark, rules, paths)
    assert out[1]["reason"] == "skip:unsolvable"
    assert out[2]["reason"] == "skip:no_arrow"
    assert out[3]["screen"] == "fuzzy"
    assert out[4]["reason"] == "skip:symbols"


def test_error_path_contradicting_rule_is_not_a_hit(spark):
    paths = [(1, 1, "(strategy = 'uniform') -> (sample_weight = 'None') -> '(strategy)_(sample_weight)_ERROR_END'"),
             (1, 2, "(strategy = 'quantile') -> \"(sample_weight = 'None')\"")]
    out = run(spark, [(1, 1, "(strategy = 'uniform') -> (sample_weight != 'None')")], paths)
    # the raising path is the documented behaviour (result true), the other path is not covered
    assert out[1]["verdict"] == "CONSISTENT"


def test_fuzzy_rule_without_a_satisfying_path_is_bad_fuzzy(spark):
    # the right side names an existence word; only paths mentioning both names give results
    paths = [(1, 1, "(strategy = 'y') -> \"(weight = 'existence_flag')\""),
             (1, 2, "(strategy = 'x') -> \"(other = 1)\"")]
    out = run(spark, [(1, 1, "(strategy = 'x') -> (weight = 'specified')")], paths)
    assert out[1]["screen"] == "fuzzy"
    assert out[1]["verdict"] == "BAD_FUZZY" and out[1]["n_results"] == 1


def test_fuzzy_rule_with_a_satisfying_path_is_consistent(spark):
    paths = [(1, 1, "(strategy = 'y') -> \"(weight = 'existence_flag')\""),
             (1, 2, "(strategy = 'x') -> \"(weight = 'existence_flag')\"")]
    out = run(spark, [(1, 1, "(strategy = 'x') -> (weight = 'specified')")], paths)
    assert out[1]["verdict"] == "CONSISTENT" and out[1]["n_true"] == 1


def test_fuzzy_word_only_on_the_left_is_quarantined(spark):
    paths = [(1, 1, "(a = 1) -> \"(b = 1)\"")]
    out = run(spark, [(1, 1, "(a = 'ignore') -> (b = 1)")], paths)
    assert out[1]["reason"] == "quarantine:fuzzy_word_left_only"
