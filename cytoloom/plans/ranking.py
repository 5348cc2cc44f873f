"""Row numbers and running totals that never sort one hot key in one task.

A plain ``row_number() over (partition by key order by v)`` sends every row of a key to one task. Here the
rows of a key are first cut into buckets that rise with the sort order. Bucket sizes come from a
map-side-combined count, their prefix sums are small, and the real sort runs per (key, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _scoped(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if keys:
        return df, list(keys)
    return df.withColumn("_all", F.lit(0)), ["_all"]


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    name: str = "position",
    fine: Column | None = None,
) -> DataFrame:
    """1-based row numbers of ``order`` within ``keys``.

    ``bucket`` must be a non-null value that never falls along ``order``. Where many rows can share a bucket
    (copies with equal sort values), ``fine`` cuts it further; it must never fall along ``order`` within a bucket.
    """
    cols = df.columns
    df, scope = _scoped(df, keys)
    df = df.withColumn("_bucket", bucket).withColumn("_fine", F.lit(0) if fine is None else fine)
    before = (Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*scope).orderBy("_bucket").rowsBetween(*before)
    level = [*scope, "_bucket"] if fine is None else [*scope, "_bucket", "_fine"]
    sizes = df.groupBy(*level).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0)
    coarse = (
        sizes.groupBy(*scope, "_bucket")
        .agg(F.sum("_n").alias("_n"))
        .select(*scope, "_bucket", F.coalesce(F.sum("_n").over(earlier), zero).alias("_before"))
    )
    if fine is None:
        offsets = coarse
    else:
        within = Window.partitionBy(*scope, "_bucket").orderBy("_fine").rowsBetween(*before)
        inner = sizes.select(*level, F.coalesce(F.sum("_n").over(within), zero).alias("_inner"))
        offsets = inner.join(coarse, [*scope, "_bucket"]).select(*level, (F.col("_before") + F.col("_inner")).alias("_before"))
    return (
        df.withColumn("_rank", F.row_number().over(Window.partitionBy(*level).orderBy(*order)))
        .join(offsets, level)
        .select(*cols, (F.col("_rank") + F.col("_before")).cast("long").alias(name))
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    bucket: Column,
    sums: dict[str, str],
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sums of ``sums`` (output name -> input column) along ``order`` within ``keys``.

    Input must hold one row per (keys, order) value: aggregate first, so that copies cost nothing.
    """
    cols = df.columns
    df, scope = _scoped(df, keys)
    df = df.withColumn("_bucket", bucket)
    direction = (lambda c: F.col(c).desc()) if descending else F.col
    earlier = Window.partitionBy(*scope).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*scope, "_bucket").agg(*[F.sum(src).alias(f"_s_{out}") for out, src in sums.items()])
    offsets = offsets.select(
        *scope,
        "_bucket",
        *[F.coalesce(F.sum(f"_s_{out}").over(earlier), F.lit(0)).alias(f"_b_{out}") for out in sums],
    )
    inside = (
        Window.partitionBy(*scope, "_bucket")
        .orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = [(F.sum(src).over(inside) + F.col(f"_b_{out}")).alias(out) for out, src in sums.items()]
    return df.join(offsets, [*scope, "_bucket"]).select(*cols, *totals)
