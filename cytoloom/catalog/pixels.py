"""Registered pixel queries: projections, masks, scaling, crops and stain separation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoloom.catalog.registry import query
from cytoloom.functions import color as C
from cytoloom.operators import pixels as P
from cytoloom.operators import stain as S
from cytoloom.operators.cells import cell_pixels, colored_images, homogeneity
from cytoloom.sources.views import with_views

PX = with_views("px")
KEY = "image_id, y, x"
NON_WHITE = "(b < 240 or g < 240 or r < 240)"


def layer(df, *cols):
    return df.select("image_id", "y", "x", *cols)


@query("cyan_signal", PX + f"select {KEY}, {C.cyan()} cyan from px")
def _cyan(v):
    return layer(P.add(v.px, cyan=C.cyan()), "cyan")


@query("gray_signal", PX + f"select {KEY}, (b * 3735 + g * 19235 + r * 9798 + 16384) >> 15 gray from px")
def _gray(v):
    return layer(P.add(v.px, gray=C.gray()), "gray")


# Every third image loses its cyan so that the fallback is exercised.
MUTED = "case when image_id % 3 = 0 then greatest({c}, r) else {c} end"
MUTED_R = "case when image_id % 3 = 0 then greatest(b, g, r) else r end"


@query(
    "signal_fallback",
    PX
    + f""", muted as (select {KEY}, b, g, {MUTED_R} r from px)
, s as (select {KEY}, {C.cyan()} cyan, {C.gray()} gray from muted)
select {KEY}, case when max(cyan) over (partition by image_id) = 0 then gray else cyan end v from s""",
)
def _fallback(v):
    return layer(P.signal(v.px.withColumn("r", F.expr(MUTED_R))), "v")


HSV_SQL = PX + f", hsv as materialized (select *, {C.HSV_H} h, {C.HSV_S} s, {C.HSV_V} v from px)\n"


@query("hsv_convert", HSV_SQL + f"select {KEY}, h, s, v from hsv")
def _hsv(v):
    return layer(P.hsv(v.px), "h", "s", "v")


@query(
    "cyan_range_mask",
    HSV_SQL
    + f"select {KEY}, case when h between 75 and 115 and s between 40 and 255 and v between 140 and 255 then 255 else 0 end mask from hsv",
)
def _mask(v):
    return layer(P.cyan_mask(v.px), "mask")


@query(
    "mask_invert",
    HSV_SQL
    + f"select {KEY}, 255 - case when h between 75 and 115 and s between 40 and 255 and v between 140 and 255 then 255 else 0 end mask from hsv",
)
def _invert(v):
    return layer(P.cyan_mask(v.px, invert=True), "mask")


@query("fixed_threshold", PX + f"select {KEY} from px where {C.cyan()} > 35")
def _threshold(v):
    return layer(v.px.where(f"{C.cyan()} > 35"))


@query(
    "frame_zero",
    PX + f"select {KEY}, case when x < 3 or y < 3 or x >= width - 3 or y >= height - 3 then 0 else {C.cyan()} end v from px",
)
def _frame(v):
    return layer(P.clear_frame(P.add(v.px, cyan=C.cyan()), "cyan", "v"), "v")


@query("weighted_blend", PX + f"select {KEY}, greatest(0, least(255, cast(round_even((7 * b + 3 * r) / 10, 0) as bigint))) v from px")
def _blend(v):
    return layer(P.add(v.px, v=C.saturated("cast(rint((7 * b + 3 * r) / 10) as bigint)")), "v")


@query(
    "minmax_normalize",
    PX
    + f""", w as (select {KEY}, g v, min(g) over (partition by image_id) lo, max(g) over (partition by image_id) hi from px)
select {KEY}, cast(floor((v - lo) / (hi - lo) * 255) as bigint) n from w""",
)
def _minmax(v):
    return layer(P.minmax_normalize(v.px, "g", "n"), "n")


@query(
    "max_normalize",
    PX
    + f""", w as (select {KEY}, {C.cyan()} v from px), t as (select *, max(v) over (partition by image_id) hi from w)
select {KEY}, case when hi > 0 then cast(floor(v / hi * 255) as bigint) else 0 end n from t""",
)
def _max(v):
    return layer(P.max_normalize(P.add(v.px, cyan=C.cyan()), "cyan", "n"), "n")


CELLS_PX = with_views("px", "px_cells") + (
    ", inside as materialized (select c.cell_id, c.cx, c.cy, c.r cr, p.* from px p join px_cells c on p.image_id = c.image_id"
    " and p.x >= c.x and p.x < c.x + c.w and p.y >= c.y and p.y < c.y + c.h)\n"
)
IN_DISC = "(x - cx) * (x - cx) + (y - cy) * (y - cy) <= cr * cr + cr"


@query("pixel_region_join", CELLS_PX + "select image_id, cell_id, y, x, b, g, r from inside")
def _region_join(v):
    found = P.pixels_in_boxes(v.px, v.px_cells)
    return found.select("image_id", "cell_id", "y", "x", "b", "g", "r")


@query(
    "bbox_crop",
    CELLS_PX
    + """select i.image_id, i.cell_id, i.y - c.y y, i.x - c.x x, b, g, i.r from inside i join px_cells c
  on c.image_id = i.image_id and c.cell_id = i.cell_id""",
)
def _crop(v):
    found = P.pixels_in_boxes(v.px, v.px_cells)
    return found.selectExpr("image_id", "cell_id", "y - by as y", "x - bx as x", "b", "g", "r")


@query(
    "non_white_interior",
    CELLS_PX
    + f""", i as (select *, {C.HSV_H} h, {C.HSV_S} s, {C.HSV_V} v from inside where {IN_DISC})
select image_id, cell_id, y, x from i where {NON_WHITE} and not ({C.in_cyan_range()})""",
)
def _interior(v):
    found = cell_pixels(v.px, v.px_cells).where("in_mask")
    return P.hsv(found).where(f"{NON_WHITE} and not ({C.in_cyan_range()})").select("image_id", "cell_id", "y", "x")


@query(
    "white_canvas",
    CELLS_PX
    + ", ".join(["select image_id, cell_id, y, x"] + [f"case when {IN_DISC} then {c} else 255 end {c}" for c in "bgr"])
    + " from inside",
)
def _canvas(v):
    found = cell_pixels(v.px, v.px_cells)
    return P.white_canvas(found, found.where("in_mask"))


@query(
    "homogeneity",
    CELLS_PX
    + f""", i as (select *, {C.HSV_H} h, {C.HSV_S} s, {C.HSV_V} v, {C.gray()} gray from (select * replace ({MUTED_R} as r) from inside) where {IN_DISC})
, f as (select *, {NON_WHITE} nw, {NON_WHITE} and not ({C.in_cyan_range()}) core from i)
, seen as (select image_id, max({C.cyan()}) > 0 colored from (select * replace ({MUTED_R} as r) from px) group by all)
, a as (select image_id, cell_id, any_value(colored) colored, count(*) n_all, stddev_pop(gray) s_all, min(gray) m_all, count(*) filter (core) n_core, count(*) filter (nw) n_nw,
  stddev_pop(gray) filter (core) s_core, stddev_pop(gray) filter (nw) s_nw, min(gray) filter (core) m_core, min(gray) filter (nw) m_nw
  from f join seen using (image_id) group by image_id, cell_id)
, b as (select image_id, cell_id, case when not colored then n_all when n_core > 0 then n_core else n_nw end n_px,
  case when not colored then s_all when n_core > 0 then s_core else s_nw end s, case when not colored then m_all when n_core > 0 then m_core else m_nw end low
  from a)
select image_id, cell_id, n_px, round(s, 6) std, low, not coalesce(s < 25 and low > 130, false) keep from b""",
)
def _homogeneity(v):
    px = v.px.withColumn("r", F.expr(MUTED_R))
    flat = homogeneity(cell_pixels(px, v.px_cells).where("in_mask"), colored_images(px), max_std=25, min_level=130)
    return flat.select("image_id", "cell_id", "n_px", F.round("std", 6).alias("std"), "low", "keep")


@query(
    "overlay_color_masks",
    PX + f"select {KEY}, case when g > 200 and r < 50 then 'green' else 'red' end mask from px where (g > 200 and r < 50) or (r > 200 and g < 50)",
)
def _overlay_masks(v):
    df = P.add(v.px, mask="case when g > 200 and r < 50 then 'green' when r > 200 and g < 50 then 'red' end")
    return layer(df.where("mask is not null"), "mask")


@query(
    "overlay_compose",
    PX
    + f""", l as (select {KEY}, 1 p, 'green' color from px where ring = 1
  union all select {KEY}, 2, 'red' from px where b < 170)
select {KEY}, color from l qualify row_number() over (partition by {KEY} order by p desc) = 1""",
)
def _overlay(v):
    borders = layer(v.px.where("ring = 1")).selectExpr("*", "1 as priority", "'green' as color")
    bridges = layer(v.px.where("b < 170")).selectExpr("*", "2 as priority", "'red' as color")
    return P.compose_overlay(borders.unionByName(bridges))


# ---- stain separation ----------------------------------------------------------------------------------

OD = [f"{C.optical_density(c)} od_{c}" for c in "bgr"]
OD_SQL = PX + f", od as materialized (select {KEY}, {', '.join(OD)} from px)\n"
TISSUE = "(od_b >= 0.15 or od_g >= 0.15 or od_r >= 0.15)"


@query("optical_density", OD_SQL + f"select {KEY}, {', '.join(f'round(od_{c}, 6) od_{c}' for c in 'bgr')} from od")
def _od(v):
    return layer(S.optical_density(v.px), *[F.round(f"od_{c}", 6).alias(f"od_{c}") for c in "bgr"])


@query("tissue_filter", OD_SQL + f"select {KEY} from od where {TISSUE}")
def _tissue(v):
    return layer(S.tissue(S.optical_density(v.px)))


COV = ", ".join(f"covar_pop(od_{a}, od_{b}) c_{a}{b}" for a, b in S.PAIRS)
ROUNDED = ", ".join(f"round(c_{a}{b}, 6) c_{a}{b}" for a, b in S.PAIRS)


@query(
    "stain_covariance",
    OD_SQL + f", cov as (select image_id, count(*) n, {COV} from od where {TISSUE} group by all)\nselect image_id, n, {ROUNDED} from cov",
)
def _covariance(v):
    cov = S.covariance(S.tissue(S.optical_density(v.px)))
    return cov.select("image_id", "n", *[F.round(f"c_{a}{b}", 6).alias(f"c_{a}{b}") for a, b in S.PAIRS])


@query("stain_vectors")
def _vectors(v):
    return S.stain_vectors(S.covariance(S.tissue(S.optical_density(v.px))))


# Fixed reference stain matrix (two unit vectors over b, g, r) used where a given matrix is needed.
GIVEN = {"s1": (0.29, 0.72, 0.63), "s2": (0.11, 0.99, 0.07)}


def _dot(name: str) -> str:
    return " + ".join(f"od_{c} * cast({w} as double)" for c, w in zip("bgr", GIVEN[name]))


@query("stain_concentration", OD_SQL + f"select {KEY}, round({_dot('s1')}, 6) c1, round({_dot('s2')}, 6) c2 from od")
def _concentration(v):
    images = v.px.select("image_id").distinct()
    matrix = images.selectExpr("image_id", *[f"array({', '.join(f'{w}D' for w in ws)}) as {n}" for n, ws in GIVEN.items()])
    out = S.concentrations(S.optical_density(v.px), matrix)
    return layer(out, F.round("c1", 6).alias("c1"), F.round("c2", 6).alias("c2"))


def _recolored(i: int) -> str:
    mix = " + ".join(f"({_dot(n)}) * cast({S.TARGET[n][i]} as double)" for n in ("s1", "s2"))
    return f"cast(floor(greatest(0, least(255, 240 * power(cast(10 as double), -({mix}))))) as bigint)"


@query("stain_recolor", OD_SQL + f"select {KEY}, {', '.join(f'{_recolored(i)} {c}' for i, c in enumerate('bgr'))} from od")
def _recolor(v):
    images = v.px.select("image_id").distinct()
    matrix = images.selectExpr("image_id", *[f"array({', '.join(f'{w}D' for w in ws)}) as {n}" for n, ws in GIVEN.items()])
    return layer(S.recolor(S.concentrations(S.optical_density(v.px).drop("b", "g", "r"), matrix)), "b", "g", "r")
