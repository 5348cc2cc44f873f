"""Connected regions of a mask, their boxes and contour areas, holes and fills.

Pixels are labelled per tile first (each tile also sees one column and row of its right and lower
neighbours), then labels that meet in such a shared pixel are joined by the component plan. Only seam labels
take part in that, so the iterations see a perimeter's worth of rows, not an image's. A region's id is its
first pixel in raster order: y * 2^31 + x.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.plans.components import connected_components, lowest_linked
from cytoloom.session import cut_lineage, tasks_for, written

ROW = 1 << 31
TILE = 256
_LABELLED = "image_id long, y long, x long, own boolean, local long, quad long"


def _tile_labels(tile: int, diagonal: bool, holes: bool):
    """Label one tile's pixels and attach to each the doubled contour area of the 2 x 2 blocks it leads."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        image, ty, tx = (int(k) for k in key)
        yy = (pdf["y"].to_numpy() - ty * tile).astype(np.int64)
        xx = (pdf["x"].to_numpy() - tx * tile).astype(np.int64)
        h, w = int(yy.max()) + 2, int(xx.max()) + 2
        ids = np.full((h, w), -1, dtype=np.int64)
        order = np.lexsort((xx, yy))
        yy, xx = yy[order], xx[order]
        ids[yy, xx] = np.arange(len(yy))

        pairs = [(ids[:, :-1], ids[:, 1:]), (ids[:-1], ids[1:])]
        if diagonal:
            pairs += [(ids[:-1, :-1], ids[1:, 1:]), (ids[:-1, 1:], ids[1:, :-1])]
        a = np.concatenate([p.ravel() for p, _ in pairs])
        b = np.concatenate([q.ravel() for _, q in pairs])
        both = (a >= 0) & (b >= 0)
        root = lowest_linked(len(yy), a[both], b[both])

        # 2 x 2 blocks led by the pixel above-left of (1, 1), padded so that blocks may start outside.
        pad = np.pad(ids, ((1, 0), (1, 0)), constant_values=-1)
        corners = [pad[:-1, :-1], pad[:-1, 1:], pad[1:, :-1], pad[1:, 1:]]
        here = [c >= 0 for c in corners]
        count = sum(c.astype(np.int64) for c in here)
        lead = np.select(here, corners, -1)
        quad = np.zeros(len(yy), dtype=np.int64)
        # A block belongs to the tile that owns its top-left pixel.
        gy = np.arange(h)[:, None] - 1 + ty * tile
        gx = np.arange(w)[None, :] - 1 + tx * tile
        mine = (gy // tile == ty) & (gx // tile == tx)
        if ty == 0:
            mine |= (gy < 0) & (gx // tile == tx)
        if tx == 0:
            mine |= (gx < 0) & ((gy // tile == ty) | ((ty == 0) & (gy < 0)))
        if holes:
            slant = ((here[0] & here[3]) | (here[1] & here[2])) & (count == 2)
            np.add.at(quad, lead[mine & (count == 1)], 1)
            np.add.at(quad, lead[mine & (count >= 2) & ~slant], 2)
            for corner, present in zip(corners, here):
                np.add.at(quad, corner[mine & slant & present], 1)
        else:
            np.add.at(quad, lead[mine & (count == 3)], 1)
            np.add.at(quad, lead[mine & (count == 4)], 2)

        y, x = yy + ty * tile, xx + tx * tile
        return pd.DataFrame(
            {
                "image_id": image,
                "y": y,
                "x": x,
                "own": (yy < tile) & (xx < tile),
                "local": y[root] * ROW + x[root],
                "quad": quad,
            }
        )

    return run


def label_pixels(mask: DataFrame, diagonal: bool = True, holes: bool = False, tile: int = TILE) -> DataFrame:
    """``mask(image_id, y, x)`` -> every pixel with its region id; seam pixels also as copies (own = false)."""

    def tiles(axis: str) -> str:
        own = f"floor({axis} / {tile})"
        return f"explode(case when {axis} % {tile} = 0 and {axis} > 0 then array({own}, {own} - 1) else array({own}) end)"

    # The mask is stored first, so that its pixels can be counted: few bytes per pixel must not fold the Python work into few tasks.
    mask = written(mask.select("image_id", "y", "x"), "label-mask")
    tasks = tasks_for(mask.sparkSession, mask.count())
    placed = mask.selectExpr("*", f"{tiles('y')} as ty").selectExpr("*", f"{tiles('x')} as tx")
    tiled = placed.repartition(tasks, "image_id", "ty", "tx").groupBy("image_id", "ty", "tx")
    local = written(tiled.applyInPandas(_tile_labels(tile, diagonal, holes), _LABELLED), "labels")
    shared = local.where("not own").select("image_id", "y", "x", F.col("local").alias("u"))
    if shared.isEmpty():  # every image lies in one tile
        return local.select("image_id", "y", "x", "own", "quad", F.col("local").alias("region_id"))
    owner = local.where(f"own and (y % {tile} = 0 or x % {tile} = 0)").select(
        "image_id", "y", "x", F.col("local").alias("v")
    )
    edges = shared.join(owner.hint("merge"), ["image_id", "y", "x"]).select(F.col("image_id").alias("key"), "u", "v")
    roots = connected_components(edges).select(F.col("key").alias("image_id"), F.col("u").alias("local"), "root")
    return (
        local.join(roots, ["image_id", "local"], "left")
        .withColumn("region_id", F.coalesce("root", "local"))
        .drop("root", "local")
    )


def region_stats(labelled: DataFrame) -> DataFrame:
    """Box, pixel count and doubled block area per region (all combined map-side)."""
    own = F.col("own")
    stats = labelled.groupBy("image_id", "region_id").agg(
        F.count_if(own).alias("n_pixels"),
        F.min(F.when(own, F.col("x"))).alias("x"),
        F.min(F.when(own, F.col("y"))).alias("y"),
        F.max(F.when(own, F.col("x"))).alias("x1"),
        F.max(F.when(own, F.col("y"))).alias("y1"),
        F.sum("quad").alias("quad"),
    )
    return stats.selectExpr(
        "image_id", "region_id", "x", "y", "x1 - x + 1 as w", "y1 - y + 1 as h", "n_pixels", "quad"
    )


@dataclass
class RegionParts:
    """Labelled pixels and region tables of one mask; what is slow to redo is already materialised."""

    foreground: DataFrame  # image_id, y, x, own, quad, region_id
    background: DataFrame
    holes: DataFrame  # region_id, x, y, w, h, n_pixels, quad, owner
    outer: DataFrame  # region_id, x, y, w, h, n_pixels, quad

    def contours(self) -> DataFrame:
        """Outer borders and hole borders with their boxes and contour areas.

        A border encloses its part and every part nested in it, so its area is the sum of their block areas.
        """
        quads = self.outer.selectExpr("image_id", "region_id as inner", "quad").unionByName(
            self.holes.selectExpr("image_id", "region_id as inner", "quad")
        )
        areas = (
            self.enclosure().join(quads, ["image_id", "inner"])
            .groupBy("image_id", "region_id")
            .agg((F.sum("quad") / 2).alias("area"))
        )
        both = self.outer.selectExpr(
            "image_id", "region_id", "'outer' as kind", "x", "y", "w", "h", "n_pixels"
        ).unionByName(
            self.holes.selectExpr(
                "image_id", "region_id", "'hole' as kind", "x - 1 as x", "y - 1 as y", "w + 2 as w", "h + 2 as h", "n_pixels"
            )
        )
        return both.join(areas, ["image_id", "region_id"])

    def enclosure(self) -> DataFrame:
        """(image_id, inner, region_id): every part that lies inside a region or hole, itself included."""
        top = self.outer.selectExpr("image_id", "region_id as inner", f"region_id div {ROW} - 1 as y", f"region_id % {ROW} as x")
        around = self.background.where("own").select("image_id", "y", "x", "region_id")
        up = top.join(around.hint("merge"), ["image_id", "y", "x"]).select("image_id", "inner", F.col("region_id").alias("parent"))
        up = up.join(self.holes.selectExpr("image_id", "region_id as parent"), ["image_id", "parent"], "left_semi")
        up = up.select("image_id", "inner", "parent").unionByName(
            self.holes.selectExpr("image_id", "region_id as inner", "owner as parent")
        )
        up = cut_lineage(up)
        every = self.outer.select("image_id", "region_id").unionByName(self.holes.select("image_id", "region_id"))
        found = [every.selectExpr("image_id", "region_id as inner", "region_id")]
        level = up.selectExpr("image_id", "inner", "parent as region_id")
        while True:  # parents start earlier, so levels run out
            level = cut_lineage(level)
            if level.isEmpty():
                break
            found.append(level)
            step = up.selectExpr("image_id", "inner as region_id", "parent")
            level = level.join(step, ["image_id", "region_id"]).selectExpr("image_id", "inner", "parent as region_id")
        out = found[0]
        for part in found[1:]:
            out = out.unionByName(part)
        return out


def region_parts(mask: DataFrame, tile: int = TILE) -> RegionParts:
    """Regions and holes of a mask (image_id, width, height, y, x, v).

    A hole belongs to the region of the pixel above its first pixel.
    """
    foreground = label_pixels(mask.where("v > 0"), tile=tile)
    background = label_pixels(mask.where("v = 0"), diagonal=False, holes=True, tile=tile)
    size = mask.groupBy("image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    enclosed = region_stats(background).join(size, "image_id").where(
        "x > 0 and y > 0 and x + w < width and y + h < height"
    )
    above = enclosed.selectExpr("*", f"region_id div {ROW} - 1 as ay", f"region_id % {ROW} as ax").drop("width", "height")
    owners = foreground.where("own").selectExpr("image_id", "y as ay", "x as ax", "region_id as owner")
    holes = cut_lineage(above.join(owners.hint("merge"), ["image_id", "ay", "ax"]).drop("ay", "ax"))
    return RegionParts(foreground, background, holes, cut_lineage(region_stats(foreground)))


def connected_regions(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """Contours of a mask: outer borders and hole borders with box, pixel count and area.

    Area is that of the polygon through border pixel centres: full 2 x 2 blocks count 1 and blocks with three
    pixels 1/2. A hole border runs through the pixels around the hole.
    """
    return region_parts(mask, tile).contours()


def _air_runs() -> str:
    """Runs of background around a pixel, from ``near``: bit k is set if the k-th neighbour clockwise from the left is set.

    A run counts if it holds one of the four direct neighbours, and is named by the first of those.
    """
    first = [
        f"case when near & {1 << k} = 0 and near & {1 << (k + 7) % 8 | 1 << (k + 6) % 8} <> 0 then {k} end" for k in (0, 2, 4, 6)
    ]
    return f"case when near = 0 then array(0) else filter(array({', '.join(first)}), k -> k is not null) end"


CLOCKWISE = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]


def contour_tips(parts: RegionParts) -> DataFrame:
    """First and last point of every contour and the length of its walk, without walking the contour.

    A walk starts at the first pixel in raster order and ends at the neighbour it would look at first: for an
    outer border the first set pixel clockwise from the left, for a hole border clockwise from the right. It comes to a
    pixel once for each run of background around it; what lies outside of the image is background.

    Merge hints: sizes estimated from the tables behind a mask miss what explodes, and pixels or borders would be broadcast through the driver.
    """
    own = parts.foreground.where("own").select("image_id", "y", "x", "region_id")
    # Each pixel tells its neighbours where it is: seen from there, in the opposite direction.
    tell = ", ".join(f"named_struct('dy', {-dy}, 'dx', {-dx}, 'bit', {1 << k})" for k, (dy, dx) in enumerate(CLOCKWISE))
    near = (
        own.selectExpr("image_id", "y", "x", f"explode(array({tell})) as o")
        .selectExpr("image_id", "y + o.dy as y", "x + o.dx as x", "o.bit as bit")
        .groupBy("image_id", "y", "x")
        .agg(F.bit_or("bit").alias("near"))
    )
    dy, dx = (", ".join(str(step[i]) for step in CLOCKWISE) for i in (0, 1))
    runs = (
        own.join(near.hint("merge"), ["image_id", "y", "x"], "left")
        .na.fill(0, ["near"])
        .selectExpr("image_id", "region_id", "y", "x", f"explode({_air_runs()}) as k")
        .selectExpr("image_id", "region_id", f"y + array({dy})[k] as y", f"x + array({dx})[k] as x")
    )
    air = parts.background.where("own").selectExpr("image_id", "y", "x", "region_id as air")
    # Air that is not a hole of the region lies outside it, and so does what is outside of the image.
    held = parts.holes.selectExpr("image_id", "region_id as air", "owner")
    marked = runs.join(air.hint("merge"), ["image_id", "y", "x"], "left").join(held.hint("merge"), ["image_id", "air"], "left")
    count = F.count(F.lit(1)).alias("n_points")
    outer_rim = marked.where("owner is null or owner <> region_id").groupBy("image_id", F.col("region_id").alias("contour_id")).agg(count)
    hole_rim = marked.where("owner = region_id").groupBy("image_id", F.col("air").alias("contour_id")).agg(count)
    outer_start = parts.outer.selectExpr("image_id", "region_id as contour_id", f"region_id div {ROW} as ay", f"region_id % {ROW} as ax")
    hole_start = parts.holes.selectExpr("image_id", "region_id as contour_id", f"region_id div {ROW} as ay", f"region_id % {ROW} - 1 as ax")

    def last(start: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
        listed = ", ".join(f"named_struct('k', {k}, 'dy', {dy}, 'dx', {dx})" for k, (dy, dx) in enumerate(steps))
        look = start.selectExpr("*", f"explode(array({listed})) as o").selectExpr(
            "image_id", "contour_id", "ay", "ax", "o.k as k", "ay + o.dy as y", "ax + o.dx as x"
        )
        hit = look.hint("merge").join(own.select("image_id", "y", "x").hint("merge"), ["image_id", "y", "x"])
        ends = hit.groupBy("image_id", "contour_id").agg(F.min_by(F.struct("x", "y"), "k").alias("b"))
        return start.join(ends.hint("merge"), ["image_id", "contour_id"], "left").selectExpr(
            "image_id", "contour_id", "ax", "ay", "coalesce(b.x, ax) as bx", "coalesce(b.y, ay) as by"
        )

    from_right = CLOCKWISE[4:] + CLOCKWISE[:4]
    tips = last(outer_start, CLOCKWISE).join(outer_rim.hint("merge"), ["image_id", "contour_id"], "left").unionByName(
        last(hole_start, from_right).join(hole_rim.hint("merge"), ["image_id", "contour_id"], "left")
    )
    return tips.selectExpr(
        "*", "(ax - bx) * (ax - bx) + (ay - by) * (ay - by) as d2"
    ).na.fill(0, ["n_points"])


def filled_regions(mask: DataFrame, min_area: float = 50) -> DataFrame:
    return connected_regions(mask).where(F.col("area") >= min_area)


def keep_target(mask: DataFrame, anchors: DataFrame) -> DataFrame:
    """Pixels of the regions that hold an anchor pixel (image_id, y, x); everything else is debris."""
    labelled = label_pixels(mask).where("own")
    wanted = labelled.join(anchors.select("image_id", "y", "x").hint("merge"), ["image_id", "y", "x"], "left_semi")
    held = wanted.select("image_id", "region_id").distinct()
    return labelled.join(held.hint("merge"), ["image_id", "region_id"], "left_semi").select(
        "image_id", "region_id", "y", "x"
    )


def hysteresis(edges: DataFrame) -> DataFrame:
    """Weak edge pixels stay only in regions that hold a strong one (column edge: 1 weak, 2 strong).

    Merge hint: compressed files say little of how many pixels they hold, and those would be broadcast through the driver.
    """
    marked = written(edges.where("edge > 0").select("image_id", "y", "x", "edge"), "edge-pixels")
    labelled = label_pixels(marked).where("own").select("image_id", "y", "x", "region_id")
    strong = (
        labelled.join(marked.where("edge = 2").select("image_id", "y", "x").hint("merge"), ["image_id", "y", "x"], "left_semi")
        .select("image_id", "region_id")
        .distinct()
    )
    return labelled.join(strong.hint("merge"), ["image_id", "region_id"], "left_semi").select("image_id", "y", "x")
