"""Range joins on a grid: an equi-join on grid cells, then the exact predicate.

Copies of the same box or point are folded into one row with a count before any pair is formed, so a
group of identical rows costs one row, whatever its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("x", "y", "w", "h")


def _covered(df: DataFrame, prefix: str, keys: Sequence[str], reach: int, cell: int) -> DataFrame:
    """One row per grid cell that the box, grown by ``reach``, touches."""
    p = prefix
    near = df.selectExpr(*[c if c in keys else f"{c} as {p}{c}" for c in df.columns])
    return near.selectExpr(
        "*", f"explode(sequence({_first(p, 'x', reach, cell)}, floor(({p}x + {p}w + {reach}) / {cell}))) as gx"
    ).selectExpr("*", f"explode(sequence({_first(p, 'y', reach, cell)}, floor(({p}y + {p}h + {reach}) / {cell}))) as gy")


def _first(prefix: str, axis: str, reach: int, cell: int) -> str:
    return f"floor(({prefix}{axis} - {reach}) / {cell})"


def near_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = ("image_id",),
    reach: int = 0,
    cell: int = 128,
    where: Column | None = None,
) -> DataFrame:
    """Pairs of boxes whose gap is at most ``reach`` on both axes, each pair once.

    Left columns come back with prefix ``a_`` and right ones with ``b_``; ``where`` may use both. A pair that
    shares several cells is kept only in the first of them, so no ``distinct`` is needed. The merge hint keeps
    the exploded rows out of a broadcast (their size is not known from the files) and lets a dense cell be
    split by the skew-join rule.
    """
    a = _covered(left, "a_", keys, reach, cell)
    b = _covered(right, "b_", keys, 0, cell)
    shared = [f"greatest({_first('a_', axis, reach, cell)}, {_first('b_', axis, 0, cell)})" for axis in "xy"]
    close = f"""gx = {shared[0]} and gy = {shared[1]}
        and greatest(a_x, b_x) - least(a_x + a_w, b_x + b_w) <= {reach}
        and greatest(a_y, b_y) - least(a_y + a_h, b_y + b_h) <= {reach}"""
    joined = a.join(b.hint("merge"), [*keys, "gx", "gy"]).where(close)
    if where is not None:
        joined = joined.where(where)
    return joined.drop("gx", "gy")


def near_points(
    left: DataFrame,
    right: DataFrame,
    radius: int,
    keys: Sequence[str] = ("image_id",),
    where: Column | None = None,
) -> DataFrame:
    """Pairs of points (columns x, y) with squared distance ``d2`` at most ``radius`` squared."""
    d2 = F.expr("(a_x - b_x) * (a_x - b_x) + (a_y - b_y) * (a_y - b_y)")
    near = d2 <= F.lit(radius * radius)
    sized = [df.selectExpr("*", "0L as w", "0L as h") for df in (left, right)]
    pairs = near_pairs(*sized, keys, reach=radius, cell=max(radius, 1), where=near if where is None else near & where)
    return pairs.drop("a_w", "a_h", "b_w", "b_h").withColumn("d2", d2)


def fold_points(points: DataFrame, node: str, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """One row per distinct location: lowest node id and number of nodes there."""
    return points.groupBy(*keys, "x", "y").agg(F.min(node).alias("node"), F.count(F.lit(1)).alias("n"))
