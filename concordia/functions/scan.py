"""Scans along ordered rows with an associative operation, in chunks of bounded size."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.session import materialize

CHUNK = 128


def exclusive_scan(df: DataFrame, keys: Sequence[str], order: str, value: str, zero: Column,
                   combine: Callable[[Column, Column], Column], to: str = "before", chunk: int = CHUNK,
                   top: int | None = None) -> DataFrame:
    """Add ``to``: ``combine`` over ``value`` of all earlier rows of the same keys, ``zero``
    for the first. ``order`` holds distinct whole numbers from 0 or 1 on.

    Two levels, as often as needed: rows are gathered into chunks of ``chunk`` places, each
    chunk is combined to one value, the chunks' values are scanned the same way, and a second
    pass carries each chunk's start through its rows. So the longest sequence is spread over
    tasks, no task sees more of it than a chunk, and the depth is logarithmic."""
    if top is None:
        top = df.agg(F.max(order)).first()[0] or 0
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c != order and c != value]
    up = "__chunk"
    rows = (df.groupBy(*keys, F.floor(F.col(order) / chunk).cast("long").alias(up))
            .agg(F.sort_array(F.collect_list(F.struct(order, value, *rest))).alias("__rows")))  # by order, its first field
    if top >= chunk:
        rows = materialize(rows)  # read twice: for the chunks' values and for the second pass
        whole = rows.select(*keys, up, F.aggregate("__rows", zero, lambda acc, x: combine(acc, x[value])).alias(value))
        starts = exclusive_scan(whole, keys, up, value, zero, combine, "__start", chunk, top // chunk)
        starts = starts.select(*(F.col(k).alias(f"__at{i}") for i, k in enumerate((*keys, up))), "__start")
        match = [F.col(k).eqNullSafe(F.col(f"__at{i}")) for i, k in enumerate((*keys, up))]
        rows = rows.join(starts.hint("merge"), match).select(*keys, up, "__rows", "__start")
    else:
        rows = rows.withColumn("__start", zero)
    element = F.struct(F.col("__start").alias("at"), F.slice(F.array(F.col("__start")), 1, 0).alias("out"))
    befores = F.aggregate("__rows", element, lambda acc, x: F.struct(
        combine(acc["at"], x[value]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    pairs = rows.select(*keys, F.explode(F.arrays_zip(F.col("__rows").alias("r"), befores.alias("b"))).alias("x"))
    return pairs.select(*keys, *(F.col(f"x.r.{c}").alias(c) for c in (order, value, *rest)), F.col("x.b").alias(to))
