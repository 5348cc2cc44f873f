"""Whole extraction flows: sharpened maps, candidate boxes, filters, numbered cells, border closing.

Layers that several later steps read (sharpened map, closed mask, labels) are materialised once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.functions import color as C
from cytoloom.operators import boxes as B
from cytoloom.operators import contours as T
from cytoloom.operators import graph as G
from cytoloom.operators import histograms as H
from cytoloom.operators import pixels as P
from cytoloom.operators import regions as R
from cytoloom.operators import stencils as N
from cytoloom.operators import tracing as TR
from cytoloom.operators.cells import homogeneity
from cytoloom.session import cut_lineage, written

FRAME = ["image_id", "width", "height", "y", "x"]


def image_facts(px: DataFrame) -> DataFrame:
    """(image_id, width, height, colored): one pass over the pixels, one row per image."""
    return cut_lineage(
        P.add(px, cyan=C.cyan()).groupBy("image_id")
        .agg(F.max("width").alias("width"), F.max("height").alias("height"), (F.max("cyan") > 0).alias("colored"))
    )


def baseline_map(px: DataFrame, clip: float = 3.5, grid: int = 8, images: DataFrame | None = None, together: bool = False) -> DataFrame:
    """Signal, tile-adaptive contrast, unsharp mask."""
    lifted = H.clahe(P.signal(px, images).select(*FRAME, "v"), "v", "cl", clip, grid)
    return N.own_pixels(N.unsharp(N.halo_tiles(lifted, 2, together=together), "cl", "sharp")).select(*FRAME, "sharp")


def boundary_map(px: DataFrame, clip: float = 3.5, grid: int = 8, images: DataFrame | None = None, together: bool = False) -> DataFrame:
    """Signal, bilateral filter, Scharr and edge fusion, tile-adaptive contrast, two-scale unsharp mask."""
    raw = P.signal(px, images).select(*FRAME, "v")
    smooth = written(N.own_pixels(N.bilateral(N.halo_tiles(raw, 2, together=together), "v", "soft")).select(*FRAME, "soft"), "smooth")
    if not together:
        tiles = N.halo_tiles(smooth.join(H.otsu(smooth, "soft"), "image_id"), 2)
        edges = R.hysteresis(N.own_pixels(N.canny_candidates(tiles, "soft", "0.5D * otsu", "otsu")))
        own = P.add(N.own_pixels(N.scharr(tiles, "soft")), mag=N.MAGNITUDE)
        norm = P.minmax_normalize(own, "mag", "norm")
        marked = norm.join(edges.withColumn("hit", F.lit(255)).hint("merge"), ["image_id", "y", "x"], "left")
    else:
        smooth = P.by_image(smooth)
        tiles = N.halo_tiles(smooth.join(H.otsu(smooth, "soft").hint("shuffle_hash"), "image_id"), 2, together=True)
        edges = R.hysteresis(N.own_pixels(N.canny_candidates(tiles, "soft", "0.5D * otsu", "otsu")))
        # Stored, since extremes, contrast tables and the map itself all read it.
        own = written(P.add(N.own_pixels(N.scharr(tiles, "soft")), mag=N.MAGNITUDE).select(*FRAME, "mag"), "gradient")
        marked = P.with_marks(P.minmax_normalize(P.by_image(own), "mag", "norm", together=True), edges, "hit")
    fused = P.add(marked, fused=C.saturated("cast(rint((7 * norm + 3 * coalesce(hit, 0)) / 10) as bigint)"))
    lifted = H.clahe(fused.select(*FRAME, "fused"), "fused", "cl", clip, grid)
    return N.own_pixels(N.unsharp_two_scale(N.halo_tiles(lifted, 4, together=together), "cl", "sharp")).select(*FRAME, "sharp")


def closed_mask(sharp: DataFrame, together: bool = False) -> DataFrame:
    """Otsu-calibrated threshold, cleared frame, 3 x 3 closing."""
    sharp = written(sharp, "sharp")
    if together:
        sharp = P.by_image(sharp)
    limits = H.otsu(sharp, "sharp")
    mask = P.clear_frame(H.calibrated_mask(sharp, "sharp", "bin", limits.hint("shuffle_hash") if together else limits), "bin", "bin0")
    tiles = N.halo_tiles(mask.select(*FRAME, "bin0"), N.close_halo("cross3"), together=together)
    return written(N.own_pixels(N.morph_close(tiles, "bin0", "v")).select(*FRAME, "v"), "closed")


def extract_cells(
    px: DataFrame, sharp: DataFrame, min_area: int = 80, pad: int = 5, max_std: float = 10, min_level: int = 220,
    images: DataFrame | None = None, together: bool = False,
) -> DataFrame:
    """Numbered cells of every image from a sharpened map.

    Candidates come from border pieces, one row per piece; only contours that are still wanted after the box filters are listed point by point and
    filled, and only their pixels are looked up.
    """
    images = image_facts(px) if images is None else images
    size = images.select("image_id", "width", "height")
    traced = TR.Traced(closed_mask(sharp, together))
    found = traced.table().join(size, "image_id").withColumn("j", F.col("region_id"))
    candidates = cut_lineage(B.gate(found, "width", "height", min_area).select("image_id", "j", "x", "y", "w", "h", "area"))
    merged = cut_lineage(B.leg_attach(B.non_composite(candidates)))

    # A cell's mask is its contour filled; legs that joined it are included in the box only. Merge hint: the outlines' files are far smaller than
    # the pixels they enclose, which would be broadcast through the driver.
    outlines = cut_lineage(traced.points(merged.selectExpr("image_id", "j as contour_id")))
    member = TR.enclosed_pixels(outlines).withColumnRenamed("contour_id", "cell_id")
    flat = homogeneity(px.join(member.hint("merge"), ["image_id", "y", "x"]), images.select("image_id", "colored"), max_std, min_level).where("not keep")
    kept = merged.join(flat.selectExpr("image_id", "cell_id as j"), ["image_id", "j"], "left_anti")
    named = B.name_cells(kept).join(size, "image_id")
    return named.selectExpr(
        "image_id", "cell_id", "number", "j", "x", "y", "w", "h", "area", "legs",
        f"greatest(0L, x - {pad}) as x1", f"greatest(0L, y - {pad}) as y1",
        f"least(width, x + w + {pad}) as x2", f"least(height, y + h + {pad}) as y2",
    )


def baseline_cells(px: DataFrame, grid: int = 8, together: bool = False) -> DataFrame:
    """``together``: as for ``halo_tiles``; images are no larger than a tile and lie in one partition each, so stages shuffle pixels by image alone, or not at all."""
    images = image_facts(px)
    return extract_cells(px, baseline_map(px, grid=grid, images=images, together=together), images=images, together=together)


def sharpened_cells(px: DataFrame, grid: int = 8, together: bool = False) -> DataFrame:
    images = image_facts(px)
    return extract_cells(px, boundary_map(px, grid=grid, images=images, together=together), images=images, together=together)


def border_mask(px: DataFrame, together: bool = False) -> DataFrame:
    """Cyan border map of a whole slide: HSV range, then 5 x 5 closing."""
    tiles = N.halo_tiles(P.cyan_mask(px).select(*FRAME, "mask"), N.close_halo("ellipse5"), together=together)
    return N.own_pixels(N.morph_close(tiles, "mask", "v", "ellipse5")).select(*FRAME, "v")


def close_borders(borders: DataFrame, max_gap: int = 30, min_points: int = 10, together: bool = False) -> dict[str, DataFrame]:
    """Bridge contour gaps: own start-end gaps first, then nearest open ends, then a 5 x 5 closing."""
    borders = written(borders, "borders")
    parts = R.region_parts(borders)
    tips = cut_lineage(R.contour_tips(parts))
    ends = tips.where(F.col("n_points") >= min_points)
    gaps = T.self_gap_close(ends, max_gap).selectExpr("image_id", "ax as x0", "ay as y0", "bx as x1", "by as y1")
    loose = cut_lineage(T.open_endpoints(ends, max_gap))
    pairs = G.greedy_match(loose, max_gap)
    spot = loose.select("image_id", "node", "x", "y")
    joined = (
        pairs.join(spot.selectExpr("image_id", "node as i", "x as x0", "y as y0").hint("merge"), ["image_id", "i"])
        .join(spot.selectExpr("image_id", "node as j", "x as x1", "y as y1").hint("merge"), ["image_id", "j"])
        .select("image_id", "x0", "y0", "x1", "y1")
    )
    bridges = cut_lineage(gaps.unionByName(joined))
    drawn = T.raster_lines(bridges, 2)
    if together:
        bridged = P.with_marks(P.by_image(borders), drawn, "line")
    else:
        bridged = borders.join(drawn.withColumn("line", F.lit(255)).hint("merge"), ["image_id", "y", "x"], "left")
    grown = P.add(bridged, b="case when line = 255 then 255 else v end").select(*FRAME, "b")
    tiles = N.halo_tiles(grown, N.close_halo("ellipse5"), together=together)
    closed = N.own_pixels(N.morph_close(tiles, "b", "v", "ellipse5")).select(*FRAME, "v")
    return {"contours": tips, "bridges": bridges, "closed": written(closed, "closed")}


def closing_report(px: DataFrame, together: bool = False, min_area: float = 50) -> DataFrame:
    """Per image: contours, gaps closed, closed border pixels and filled regions (borders that enclose ``min_area``; traced, so nothing is labelled for them)."""
    out = close_borders(border_mask(px, together), together=together)
    total = out["contours"].groupBy("image_id").agg(F.count(F.lit(1)).alias("total_contours"))
    gaps = out["bridges"].groupBy("image_id").agg(F.count(F.lit(1)).alias("gaps_closed"))
    pixels = out["closed"].groupBy("image_id").agg(F.count_if(F.col("v") > 0).alias("closed_pixels"))
    filled = TR.contour_table(out["closed"]).where(F.col("area") >= min_area).groupBy("image_id").agg(F.count(F.lit(1)).alias("filled_regions"))
    joined = total.join(gaps, "image_id", "left").join(pixels, "image_id", "left").join(filled, "image_id", "left")
    return joined.na.fill(0)
