"""Cross-reference graph over documented names and unit pruning."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.operators.extract import UNIT

MIN_PLAIN_LEN = 3  # FIXED VALUE: shorter names count only when quoted in backticks


def xref_edges(pa: DataFrame) -> DataFrame:
    """G1: edge (project, unit, member, src, dst) when src != dst and dst's description mentions
    src: as a plain substring for names of 3+ characters, else only in backticks.
    A self equi-join on the unit's keys with a residual predicate: never a global cross join."""
    s, d = pa.select(*UNIT, F.col("name").alias("src")), pa.select(*UNIT, F.col("name").alias("dst"), "descr")
    mention = F.when(F.length("src") >= MIN_PLAIN_LEN, F.col("descr").contains(F.col("src"))).otherwise(
        F.col("descr").contains(F.concat(F.lit("`"), F.col("src"), F.lit("`"))))
    return s.join(d, UNIT).where((F.col("src") != F.col("dst")) & mention).select(*UNIT, "src", "dst")


def xref_degree(edges: DataFrame) -> DataFrame:
    """Out-degree per unit and src."""
    return edges.groupBy(*UNIT, "src").agg(F.count(F.lit(1)).alias("n"))


def has_xref(edges: DataFrame) -> DataFrame:
    """Units (and members) with any edge."""
    return edges.select(*UNIT).distinct()


def prune_units(units: DataFrame, edges: DataFrame) -> DataFrame:
    """``project, unit, member, has_map`` of what survives pruning: a unit whose own map has
    an edge, and with it every member; a member's map stays only if it has an edge itself."""
    marked = units.select(*UNIT).distinct().join(has_xref(edges).withColumn("has_map", F.lit(True)), UNIT, "left")
    survivors = marked.where("member = '' and has_map").select("project", "unit")
    return (marked.join(survivors, ["project", "unit"], "left_semi")
            .select(*UNIT, F.coalesce("has_map", F.lit(False)).alias("has_map")))


def prune_summary(units: DataFrame, edges: DataFrame, group: str = "project") -> DataFrame:
    """Units and members before and after pruning per group, one aggregate over left joins."""
    marked = units.select(*UNIT).distinct().join(prune_units(units, edges).select(*UNIT, F.lit(True).alias("kept")), UNIT, "left")
    unit, member = F.col("member") == "", F.col("member") != ""
    return marked.groupBy(group).agg(
        F.count_if(unit).alias("n_before"), F.count_if(unit & F.coalesce("kept", F.lit(False))).alias("n_after"),
        F.count_if(member).alias("members_before"), F.count_if(member & F.coalesce("kept", F.lit(False))).alias("members_after"))
