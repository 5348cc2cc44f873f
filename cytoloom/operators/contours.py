"""Operators on ordered contour points (image_id, contour_id, seq, x, y).

Steps along a contour are windows over chunks of ``seq``; chunk ends are linked through a small table of
first and last points, so one very long contour is still many small windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoloom.operators.boxes import hull_of

KEYS = ["image_id", "contour_id"]
CHUNK = 1 << 16


def segments(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Each point with the next one (nx, ny); the last point leads back to the first."""
    cut = points.select(*KEYS, "seq", "x", "y").withColumn("_c", F.floor(F.col("seq") / chunk))
    inside = Window.partitionBy(*KEYS, "_c").orderBy("seq")
    steps = cut.select(*KEYS, "seq", "x", "y", F.lead("x").over(inside).alias("nx"), F.lead("y").over(inside).alias("ny"))
    point = F.struct("x", "y")
    ends = cut.groupBy(*KEYS, "_c").agg(
        F.min_by(point, "seq").alias("a"), F.max_by(point, "seq").alias("b"), F.max("seq").alias("seq")
    )
    along = Window.partitionBy(*KEYS).orderBy("_c")
    nxt = F.coalesce(F.lead("a").over(along), F.first("a").over(along))
    bridges = ends.select(*KEYS, "seq", F.col("b.x").alias("x"), F.col("b.y").alias("y"), nxt.alias("n"))
    return steps.where("nx is not null").unionByName(
        bridges.select(*KEYS, "seq", "x", "y", F.col("n.x").alias("nx"), F.col("n.y").alias("ny"))
    )


def bounding_boxes(points: DataFrame) -> DataFrame:
    box = points.groupBy(*KEYS).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x1"), F.max("y").alias("y1"),
        F.count(F.lit(1)).alias("n_points"),
    )
    return box.selectExpr(*KEYS, "x", "y", "x1 - x + 1 as w", "y1 - y + 1 as h", "n_points")


def polygon_area(points: DataFrame) -> DataFrame:
    cross = F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))
    return segments(points).groupBy(*KEYS).agg((F.abs(cross) / 2).alias("area"))


def morphometrics(points: DataFrame) -> DataFrame:
    """Area, perimeter and circularity 4 pi A / P^2."""
    cross = F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))
    shape = segments(points).groupBy(*KEYS).agg(
        (F.abs(cross) / 2).alias("area"), F.sum(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))).alias("perimeter")
    )
    return shape.withColumn(
        "circularity", F.when(F.col("perimeter") > 0, 4 * F.pi() * F.col("area") / (F.col("perimeter") * F.col("perimeter")))
    )


def fill_spans(points: DataFrame) -> DataFrame:
    """Filled polygon as row spans (image_id, contour_id, y, x0, x1): inside by even-odd rule, or on the border."""
    lines = segments(points)
    crossing = (
        lines.where("y <> ny")
        .selectExpr(*KEYS, "x", "y as y0", "nx", "ny", "explode(sequence(least(y, ny), greatest(y, ny) - 1)) as y")
        .selectExpr(*KEYS, "y", "((y - y0) * (nx - x) + x * (ny - y0)) / (ny - y0) as cx")
    )
    ordered = Window.partitionBy(*KEYS, "y").orderBy("cx")
    paired = crossing.select(
        *KEYS, "y", "cx", F.row_number().over(ordered).alias("k"), F.lead("cx").over(ordered).alias("cx2")
    ).where("k % 2 = 1")
    inner = paired.selectExpr(*KEYS, "y", "ceil(cx) as x0", "floor(cx2) as x1").where("x0 <= x1")
    border = lines.selectExpr(
        *KEYS, "y", "case when y = ny then least(x, nx) else x end as x0", "case when y = ny then greatest(x, nx) else x end as x1"
    )
    every = inner.unionByName(border)
    run = Window.partitionBy(*KEYS, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(run.rowsBetween(Window.unboundedPreceding, -1))
    starts = every.withColumn("fresh", F.when(reach.isNull() | (F.col("x0") > reach + 1), 1).otherwise(0))
    grouped = starts.withColumn("g", F.sum("fresh").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return grouped.groupBy(*KEYS, "y", "g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("g")


def _hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [*KEYS, "seq", "x", "y"]
    key, pts = None, []

    def finish(out):
        if key is not None:
            out.extend((*key, i, *p) for i, p in enumerate(hull_of(pts), 1))

    for pdf in batches:
        out: list[tuple] = []
        for image, contour, x, y in zip(*(pdf[c].tolist() for c in (*KEYS, "x", "y"))):
            if (image, contour) != key:
                finish(out)
                key, pts = (image, contour), []
            pts.append((x, y))
        yield pd.DataFrame(out, columns=names)
    out = []
    finish(out)
    yield pd.DataFrame(out, columns=names)


def convex_hull(points: DataFrame) -> DataFrame:
    """Hull vertices per contour, counter-clockwise in image coordinates.

    Only the outermost two points of each row can be vertices, so a contour is first thinned to two points
    per row by a map-side-combined aggregate; the small remainder goes through a monotone chain.
    """
    rows = points.groupBy(*KEYS, "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    thin = rows.selectExpr(*KEYS, "y", "explode(array_distinct(array(lo, hi))) as x")
    ready = thin.repartition(*KEYS).sortWithinPartitions(*KEYS)
    return ready.mapInPandas(_hulls, "image_id long, contour_id long, seq long, x long, y long")


def border_hull_closure(points: DataFrame, width: int, height: int, margin: int = 4) -> DataFrame:
    """Outline used for each cell's mask: the hull where the box touches the frame, else the contour itself."""
    touches = f"x <= {margin} or y <= {margin} or x + w >= {width - margin} or y + h >= {height - margin}"
    edge = bounding_boxes(points).where(touches).select(*KEYS)
    hulls = convex_hull(points.join(edge, KEYS, "left_semi")).withColumn("is_hull", F.lit(True))
    plain = points.join(edge, KEYS, "left_anti").select(*KEYS, "seq", "x", "y").withColumn("is_hull", F.lit(False))
    return hulls.unionByName(plain)


def endpoints(points: DataFrame, min_points: int = 10) -> DataFrame:
    """First and last point of every contour with enough points."""
    point = F.struct("x", "y")
    ends = points.groupBy(*KEYS).agg(
        F.min_by(point, "seq").alias("a"), F.max_by(point, "seq").alias("b"), F.count(F.lit(1)).alias("n_points")
    )
    return ends.where(F.col("n_points") >= min_points).selectExpr(
        *KEYS, "n_points", "a.x as ax", "a.y as ay", "b.x as bx", "b.y as by",
        "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as d2",
    )


SELF_GAP = "d2 between 4 and {far}"


def self_gap_close(ends: DataFrame, max_gap: int = 30) -> DataFrame:
    return ends.where(SELF_GAP.format(far=max_gap * max_gap))


def open_endpoints(ends: DataFrame, max_gap: int = 30) -> DataFrame:
    """Both ends of the contours that their own gap does not close, numbered start then end."""
    left = ends.where(f"not ({SELF_GAP.format(far=max_gap * max_gap)})")
    return left.selectExpr(
        "image_id", "contour_id",
        "explode(array(named_struct('node', contour_id * 2, 'x', ax, 'y', ay), named_struct('node', contour_id * 2 + 1, 'x', bx, 'y', by))) as e",
    ).selectExpr("image_id", "contour_id", "e.node as node", "e.x as x", "e.y as y")


def raster_lines(lines: DataFrame, thickness: int = 2) -> DataFrame:
    """Pixels of straight segments (x0, y0, x1, y1), one per step along the longer axis, grown to ``thickness``."""
    lo, hi = -((thickness - 1) // 2), thickness // 2
    steps = lines.selectExpr(
        "image_id", "x0", "y0", "x1 - x0 as dx", "y1 - y0 as dy", "greatest(abs(x1 - x0), abs(y1 - y0), 1L) as n"
    ).selectExpr("*", "explode(sequence(0L, n)) as i")
    core = steps.selectExpr(
        "image_id", "x0 + floor((2 * dx * i + n) / (2 * n)) as cx", "y0 + floor((2 * dy * i + n) / (2 * n)) as cy"
    )
    grown = core.selectExpr("image_id", "cx", f"explode(sequence(cy + {lo}, cy + {hi})) as y").selectExpr(
        "image_id", f"explode(sequence(cx + {lo}, cx + {hi})) as x", "y"
    )
    return grown.distinct()


def union_pixels(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("image_id", "y", "x").unionByName(b.select("image_id", "y", "x")).distinct()


def merged_points(points: DataFrame, legs: DataFrame) -> DataFrame:
    """Points of each body together with the points of the legs joined to it (legs: image_id, leg, parent)."""
    moved = points.join(legs.withColumnRenamed("leg", "contour_id"), KEYS).select(
        "image_id", F.col("parent").alias("contour_id"), "x", "y"
    )
    own = points.join(legs.withColumnRenamed("leg", "contour_id"), KEYS, "left_anti").select(*KEYS, "x", "y")
    return own.unionByName(moved).distinct()
