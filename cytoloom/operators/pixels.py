"""Pixel projections and per-image scaling.

A pixel table has image_id, width, height, y, x and value columns. Per-image extremes are aggregates joined
back on image_id, never windows over a whole image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.functions.color import CYAN_HIGH, CYAN_LOW, HSV_H, HSV_S, HSV_V, cyan, gray, in_cyan_range
from cytoloom.session import tasks_for


def add(df: DataFrame, **exprs: str) -> DataFrame:
    return df.selectExpr("*", *[f"{e} as {n}" for n, e in exprs.items()])


def by_image(df: DataFrame) -> DataFrame:
    """Deals a stored table of small images by image; tasks hold a bounded number of pixels, however few bytes those have."""
    return df.repartition(tasks_for(df.sparkSession, df.count()), "image_id")


def with_image_stats(df: DataFrame, together: bool = False, **aggs: str) -> DataFrame:
    """Aggregates per image, joined back to its pixels.

    ``together``: the pixels of an image lie in one partition (hash partitioned by image_id); images are then hashed, which spares sorting the pixels.
    """
    stats = df.groupBy("image_id").agg(*[F.expr(e).alias(n) for n, e in aggs.items()])
    return df.join(stats.hint("shuffle_hash") if together else stats, "image_id")


def signal(px: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Cyan signal, or gray for images without any cyan; ``images(image_id, colored)`` spares a pass over the pixels where that is known."""
    both = add(px, cyan=cyan(), gray=gray())
    if images is not None:
        known = both.join(images.select("image_id", "colored").hint("shuffle_hash"), "image_id")
        return add(known, v="case when colored then cyan else gray end").drop("colored")
    found = with_image_stats(both, top=f"max({cyan()})")
    return add(found, v="case when top = 0 then gray else cyan end").drop("top")


def hsv(px: DataFrame) -> DataFrame:
    return add(px, h=HSV_H, s=HSV_S, v=HSV_V)


def cyan_mask(px: DataFrame, low=CYAN_LOW, high=CYAN_HIGH, invert: bool = False) -> DataFrame:
    inside, outside = (0, 255) if invert else (255, 0)
    return add(hsv(px), mask=f"case when {in_cyan_range(low=low, high=high)} then {inside} else {outside} end")


def minmax_normalize(df: DataFrame, col: str, out: str, together: bool = False) -> DataFrame:
    """(v - min) / (max - min) * 255 per image, truncated; a flat image gives 0."""
    spread = with_image_stats(df, together, _lo=f"min({col})", _hi=f"max({col})")
    scaled = f"case when _hi > _lo then cast(floor(({col} - _lo) / (_hi - _lo) * 255) as bigint) else 0 end"
    return add(spread, **{out: scaled}).drop("_lo", "_hi")


def max_normalize(df: DataFrame, col: str, out: str, together: bool = False) -> DataFrame:
    """v / max * 255 per image, truncated; an all-zero image gives 0 instead of dividing by zero."""
    spread = with_image_stats(df, together, _hi=f"max({col})")
    scaled = f"case when _hi > 0 then cast(floor({col} / _hi * 255) as bigint) else 0 end"
    return add(spread, **{out: scaled}).drop("_hi")


def with_marks(df: DataFrame, marks: DataFrame, out: str) -> DataFrame:
    """255 on the pixels of ``marks(image_id, y, x)``, else 0.

    For images no larger than a tile: the marks of an image are one map of rows, which its pixels meet by image_id, so pixels are not
    shuffled where their image lies in one partition already.
    """
    rows = marks.groupBy("image_id", "y").agg(F.collect_list("x").alias("xs"))
    held = rows.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("y", "xs"))).alias("_marks"))
    met = df.join(held.hint("shuffle_hash"), "image_id", "left")
    return add(met, **{out: "case when array_contains(try_element_at(_marks, y), x) then 255 else 0 end"}).drop("_marks")


def clear_frame(df: DataFrame, col: str, out: str, margin: int = 3) -> DataFrame:
    inside = f"x >= {margin} and y >= {margin} and x < width - {margin} and y < height - {margin}"
    return add(df, **{out: f"case when {inside} then {col} else 0 end"})


def compose_overlay(layers: DataFrame) -> DataFrame:
    """Several drawings of a pixel (columns priority, color): the latest layer wins."""
    return layers.groupBy("image_id", "y", "x").agg(F.max_by("color", "priority").alias("color"))


def white_canvas(crop: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels of a crop that lie in the cell's mask; everything else white."""
    keys = ["image_id", "cell_id", "y", "x"]
    inside = mask.select(*keys, F.lit(True).alias("_in"))
    out = crop.join(inside, keys, "left")
    return out.selectExpr(*keys, *[f"case when _in then {c} else 255 end as {c}" for c in ("b", "g", "r")])


def pixels_in_boxes(px: DataFrame, cells: DataFrame, tile: int = 128, together: bool = False) -> DataFrame:
    """Range join of pixels with cell boxes (cell_id, x, y, w, h).

    ``together``: images are no larger than a tile and each lies in one partition (hash partitioned by image_id); boxes meet pixels by image_id alone,
    and no pixel is shuffled. Else a pixel lies in one grid tile, a box is listed in each tile it covers, so the join is an equi-join on
    (image_id, tile) with no duplicates and a large image is spread over its tiles.
    """
    inside = "x >= bx and x < bx + bw and y >= by and y < by + bh"
    boxes = cells.selectExpr("image_id", "cell_id", "x as bx", "y as by", "w as bw", "h as bh")
    if together:
        return px.join(boxes.hint("shuffle_hash"), "image_id").where(inside)
    spread = (
        boxes.selectExpr("*", f"explode(sequence(floor(bx / {tile}), floor((bx + bw - 1) / {tile}))) as gx")
        .selectExpr("*", f"explode(sequence(floor(by / {tile}), floor((by + bh - 1) / {tile}))) as gy")
    )
    tiled = px.selectExpr("*", f"floor(x / {tile}) as gx", f"floor(y / {tile}) as gy")
    return tiled.join(spread, ["image_id", "gx", "gy"]).where(inside).drop("gx", "gy")
