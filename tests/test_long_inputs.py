"""Inputs beyond former limits: long and deep parentheses, deep and wide trees."""
import random

import pytest
from pyspark.sql import functions as F

from concordia.operators.extract import clean_param_rows
from concordia.operators.paths import balance_parens
from concordia.operators.trees import enumerate_paths, flip_condition


def repaired(text):
    out, depth = [], 0
    for c in text:
        if c != ")" or depth > 0:
            out.append(c)
            depth += (c == "(") - (c == ")")
    back, depth = [], 0
    for c in reversed(out):
        if c != "(" or depth > 0:
            back.append(c)
            depth += (c == ")") - (c == "(")
    return "".join(reversed(back))


def test_parentheses(spark):
    r = random.Random(0)
    texts = ["", "a", "()", ")(", "(" * 2000, ")" * 2000, "(" + "x" * 2000 + ")", "(" * 500 + "x" + ")" * 500,
             " -> ".join(f"(a{i} = {i})" for i in range(5000)), "(" + " -> ".join(f"(a{i} = {i})" for i in range(1500))]
    texts += ["".join(r.choice("()ab ") for _ in range(r.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [x.r for x in df.select("t", balance_parens(F.col("t")).alias("r")).collect()] == [repaired(t) for t in texts]


def test_deep_chain_wide_root_and_cycle(spark):
    chain = [("u", f"n{i}", f"n{i + 1}", i % 2) for i in range(70)] + [("w", "r", f"c{i}", 1) for i in range(1500)]
    edges = spark.createDataFrame(chain, "unit string, parent string, child string, label int")
    roots = spark.createDataFrame([("u", "n0"), ("w", "r"), ("x", "alone")], "unit string, root string")
    out = enumerate_paths(spark, edges, roots)
    assert {(r.unit, r.depth): r["count"] for r in out.groupBy("unit", "depth").count().collect()} == {("u", 70): 1, ("w", 1): 1500, ("x", 0): 1}
    loop = spark.createDataFrame([("u", "a", "b", 1), ("u", "b", "a", 1)], edges.schema)
    with pytest.raises(ValueError):
        enumerate_paths(spark, loop, spark.createDataFrame([("u", "a")], "unit string, root string"))


def test_double_equals_and_repeated_names(spark):
    df = spark.createDataFrame([("a == 1", 0), ("a == 1", 1), ("!a == 1", 1), ("a = 1", 0)], "c string, l int")
    assert [r.o for r in df.select(flip_condition(F.col("c"), F.col("l")).alias("o")).collect()] == ["a != 1", "a == 1", "a != 1", "a != 1"]
    params = spark.createDataFrame([("u", "p", "param", n, d, i) for i, (n, d) in enumerate([("a", "x"), ("b", "y"), ("a", "z")])],
                                   "unit string, project string, section string, name string, descr string, pos int")
    assert [(r.name, r.descr) for r in clean_param_rows(params).orderBy("pos").collect()] == [("a", "z"), ("b", "y")]
