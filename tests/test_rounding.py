"""Similarity rounding matches Python's round(x, 2) exactly (binary half-even)."""
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from concordia.functions.exprs import op_cosine_table, py_round2


def test_py_round2_edge_values(spark):
    vals = [0.975, 0.725, 0.625, 0.735, 0.125, 0.0, 1.0, 0.9999999999999999, 1.0000000000000002,
            0.85, 0.15, 0.005, 0.015, 0.0049, 0.4999999999999999, 0.5]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(py_round2(F.col("v"))).collect()]
    assert got == [round(v, 2) for v in vals]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(min_value=0.0, max_value=1.0000000000000002), min_size=1, max_size=50))
def test_py_round2_random(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(py_round2(F.col("v"))).collect()]
    assert got == [round(v, 2) for v in vals]


def test_operator_cosines():
    t = op_cosine_table()
    assert t[("=", "=")] == 1.0
    assert abs(t[("=", "!=")] - 0.7071067811865475) < 1e-15
    assert t[("<", ">")] == 0.4999999999999999
