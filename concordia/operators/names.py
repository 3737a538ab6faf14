"""Name universes and dictionary coding."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from concordia.session import materialize


def name_universe(*tables: DataFrame) -> DataFrame:
    """Union of several (unit, name) lists, deduplicated, in long form
    ``unit, name, n_lists`` (no per-unit array: a unit's universe may be large)."""
    tagged = [t.select("unit", "name").distinct().withColumn("list", F.lit(i)) for i, t in enumerate(tables)]
    u = tagged[0]
    for t in tagged[1:]:
        u = u.unionByName(t)
    return u.groupBy("unit", "name").agg(F.countDistinct("list").alias("n_lists"))


def undefined_names(uses: DataFrame, defs: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Used names that no definition provides (``left_anti``)."""
    return uses.join(defs.select(*keys).distinct(), list(keys), "left_anti")


def dictionary(df: DataFrame, col: str) -> DataFrame:
    """D3 dictionary ``value, code``: dense 1-based codes in value order, computed
    distributed: range-sorted distinct values, a row number inside each sorted
    partition, plus the count of all earlier partitions (a table as small as the
    partition count)."""
    vals = df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct().orderBy("value")
    vals = materialize(vals.withColumn("pid", F.spark_partition_id()))  # written once: both readers see the same ranges
    local = vals.withColumn("rn", F.row_number().over(Window.partitionBy("pid").orderBy("value")))
    sizes = vals.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.withColumn("offset", F.coalesce(
        F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(offsets.select("pid", "offset")), "pid").select(
        "value", (F.col("offset") + F.col("rn")).cast("long").alias("code"))


def dict_encode(df: DataFrame, col: str, dictionary_df: DataFrame) -> DataFrame:
    """D3 encode: add ``<col>_code``."""
    return df.join(dictionary_df.withColumnRenamed("value", col).withColumnRenamed("code", col + "_code"), col, "left")


def dict_decode(df: DataFrame, code_col: str, dictionary_df: DataFrame, out: str) -> DataFrame:
    """D3 decode: code back to its value."""
    return df.join(dictionary_df.withColumnRenamed("code", code_col).withColumnRenamed("value", out), code_col, "left")
