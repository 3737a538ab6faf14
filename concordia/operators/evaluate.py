"""Evaluation of verdicts against an oracle."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_outcomes(verdicts: DataFrame, predicted: str = "predicted", oracle: str = "oracle") -> DataFrame:
    """Consistent / inconsistent when prediction and oracle agree; otherwise FN when
    the rule was predicted consistent, FP when it was reported."""
    p, o = F.col(predicted), F.col(oracle)
    label = (F.when(p != o, F.when(p, F.lit("FN")).otherwise(F.lit("FP")))
             .when(p, F.lit("consistent")).otherwise(F.lit("inconsistent")))
    return verdicts.withColumn("label", label)


def confusion_counts(labels: DataFrame) -> DataFrame:
    """Total, consistent, inconsistent, fp, fn in one aggregate."""
    lab = F.col("label")
    return labels.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(lab == "consistent").alias("consistent"),
        F.count_if(lab == "inconsistent").alias("inconsistent"),
        F.count_if(lab == "FP").alias("fp"),
        F.count_if(lab == "FN").alias("fn"))


def quality_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall and accuracy of reporting inconsistencies (positives are
    reported BAD rules): precision = TP/(TP+FP), recall = TP/(TP+FN)."""
    tp, fp, fn, tn = F.col("inconsistent"), F.col("fp"), F.col("fn"), F.col("consistent")
    return counts.select(
        "total", "consistent", "inconsistent", "fp", "fn",
        F.try_divide(tp.cast("double"), (tp + fp).cast("double")).alias("precision"),
        F.try_divide(tp.cast("double"), (tp + fn).cast("double")).alias("recall"),
        F.try_divide((tp + tn).cast("double"), F.col("total").cast("double")).alias("accuracy"))


def verdict_matrix(labels: DataFrame, variants=(0, 1, 2)) -> DataFrame:
    """Family x variant pivot (several cases per cell: the smallest label), in
    natural family order."""
    wide = labels.groupBy("family").pivot("variant", list(variants)).agg(F.min("label"))
    return wide.select("family", *[F.col(str(v)).alias(f"v{v}") for v in variants]).orderBy("family")


def method_comparison(records: DataFrame) -> DataFrame:
    """Correct / incorrect / missing / accuracy per extraction method."""
    miss = F.coalesce(F.col("note") == "miss", F.lit(False))
    return records.groupBy("method").agg(
        F.count_if(~miss & (F.col("consistent") == 1)).alias("correct"),
        F.count_if(~miss & (F.col("consistent") == 0)).alias("incorrect"),
        F.count_if(miss).alias("missing"),
        (F.count_if(~miss & (F.col("consistent") == 1)) / F.count(F.lit(1))).alias("accuracy"))


def confirmation_rate(issues: DataFrame, group: str = "source") -> DataFrame:
    """Confirmed / reported per group."""
    return issues.groupBy(group).agg(
        F.count_if(F.col("quality") == 1).alias("confirmed"),
        F.count(F.lit(1)).alias("reported")).withColumn(
        "rate", F.col("confirmed") / F.col("reported"))
