"""Documented vs declared names (A1-A3)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.operators.extract import UNIT


def keep_name(name: Column) -> Column:
    """A1: names kept for alignment (no ``*``, no ``kwargs``, not ``cls``)."""
    return ~name.contains("*") & ~name.contains("kwargs") & (name != "cls")


def drop_variadic(names: DataFrame, col: str = "name") -> DataFrame:
    """A1 on a long name table."""
    return names.where(keep_name(F.col(col)))


def declared_names(signatures: DataFrame) -> DataFrame:
    """Declared parameter names (``project, unit, member, name``) from signature arrays: positional and
    keyword-only names, without ``self`` and without ``*args`` / ``**kw``."""
    return (signatures.select(*UNIT, F.explode("params").alias("name"))
            .where((F.col("name") != "self") & ~F.col("name").startswith("*")))


def _sides(doc: DataFrame, code: DataFrame) -> DataFrame:
    d = drop_variadic(doc.select(*UNIT, "name")).distinct().withColumn("in_doc", F.lit(True))
    c = drop_variadic(code.select(*UNIT, "name")).distinct().withColumn("in_code", F.lit(True))
    return d.join(c, [*UNIT, "name"], "full_outer")


def mismatch_side(doc: DataFrame, code: DataFrame) -> DataFrame:
    """A3: every name documented but not declared ('doc') or declared but not documented
    ('code'); one full outer join on the unit's keys and the name."""
    s = _sides(doc, code).where(F.col("in_doc").isNull() | F.col("in_code").isNull())
    return s.select(*UNIT, "name", F.when(F.col("in_doc").isNull(), F.lit("code")).otherwise(F.lit("doc")).alias("side"))


def param_mismatch(doc: DataFrame, code: DataFrame) -> DataFrame:
    """A2: units whose documented and declared name sets differ, with both sets and the
    symmetric difference (arrays sorted)."""
    s = _sides(doc, code)
    return (s.groupBy(*UNIT).agg(
        F.sort_array(F.collect_set(F.when(F.col("in_doc").isNotNull(), F.col("name")))).alias("doc"),
        F.sort_array(F.collect_set(F.when(F.col("in_code").isNotNull(), F.col("name")))).alias("code"),
        F.sort_array(F.collect_set(F.when(F.col("in_doc").isNull() | F.col("in_code").isNull(), F.col("name"))))
        .alias("difference"))
        .where(F.size("difference") > 0))
