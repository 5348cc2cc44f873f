"""Registered region, contour and shape queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoloom.catalog.registry import query
from cytoloom.catalog.stencils import BASE, close_sql, cte, grad_sql, start
from cytoloom.functions import color as C
from cytoloom.operators import contours as T
from cytoloom.operators import histograms as H
from cytoloom.operators import pixels as P
from cytoloom.operators import regions as R
from cytoloom.operators import shape_measures as M
from cytoloom.operators import stencils as N
from cytoloom.session import tasks_for, written
from cytoloom.sources.views import SQL_VIEWS, with_views

EIGHT = "abs(n.y - c.y) <= 1 and abs(n.x - c.x) <= 1"


def recursive(base: str) -> str:
    return base.replace("with ", "with recursive ", 1)


def label_sql(source: str, name: str, diagonal: bool = True) -> str:
    """Lowest raster id reachable over neighbouring pixels, by repeated relaxation of changed pixels."""
    steps = "(values (-1, 0), (1, 0), (0, -1), (0, 1)" + (", (-1, -1), (-1, 1), (1, -1), (1, 1))" if diagonal else ")")
    return f""", {name}_px as materialized (select image_id, y, x, y * 2147483648 + x l from {source})
, {name}_nb as materialized (select a.image_id, a.y, a.x, b.y ny, b.x nx from {name}_px a cross join {steps} d(dy, dx)
   join {name}_px b on b.image_id = a.image_id and b.y = a.y + d.dy and b.x = a.x + d.dx)
, {name} (image_id, y, x, l) using key (image_id, y, x) as (select * from {name}_px union
  (select k.image_id, k.ny, k.nx, min(c.l) from {name} c join {name}_nb k on k.image_id = c.image_id and k.y = c.y and k.x = c.x
   join recurring.{name} o on o.image_id = k.image_id and o.y = k.ny and o.x = k.nx where c.l < o.l group by all))\n"""


def regions_sql(fg: str, bg: str) -> str:
    block = "cross join (values (-1, -1), (-1, 0), (0, -1), (0, 0)) b(dy, dx)"
    return (
        label_sql(fg, "fl")
        + f""", bg0 as materialized (select image_id, y, x from {bg})
, air (image_id, y, x) as (select image_id, y, x from bg0 where y = 0 or x = 0 or y = 47 or x = 47 union
  select b.image_id, b.y, b.x from air a cross join (values (-1, 0), (1, 0), (0, -1), (0, 1)) d(dy, dx)
  join bg0 b on b.image_id = a.image_id and b.y = a.y + d.dy and b.x = a.x + d.dx)
, enclosed as materialized (select * from bg0 anti join air using (image_id, y, x))\n"""
        + label_sql("enclosed", "bl", diagonal=False)
        + f""", fq as (select image_id, l, sum(case when n = 4 then 1.0 when n = 3 then 0.5 else 0 end) a from
   (select image_id, l, y + dy, x + dx, count(*) n from fl {block} group by all) group by all)
, fs as (select image_id, l, min(x) x, min(y) y, max(x) - min(x) + 1 w, max(y) - min(y) + 1 h, count(*) n from fl group by all)
, hs as (select image_id, l, min(x) x, min(y) y, max(x) - min(x) + 1 w, max(y) - min(y) + 1 h, count(*) n from bl group by all)
, hq as (select image_id, l, sum(case when n = 1 then 0.5 else 1.0 end) a from
   (select image_id, l, y + dy, x + dx, count(*) n from bl {block} group by all) group by all)
, ha as (select hs.*, hq.a, fl.l owner from hs join hq using (image_id, l)
   join fl on fl.image_id = hs.image_id and fl.y = hs.l // 2147483648 - 1 and fl.x = hs.l % 2147483648)
, up as materialized (select image_id, l, owner p from ha union all
   select fs.image_id, fs.l, bl.l from fs join bl on bl.image_id = fs.image_id and bl.y = fs.l // 2147483648 - 1 and bl.x = fs.l % 2147483648)
, anc (image_id, l, p) as (select image_id, l, l from fs union select image_id, l, l from ha union
   select anc.image_id, anc.l, up.p from anc join up on up.image_id = anc.image_id and up.l = anc.p)
, ar as (select anc.image_id, anc.p, cast(sum(q.a) as double) area from anc join (select * from fq union all select * from hq) q
   on q.image_id = anc.image_id and q.l = anc.l group by all)
, regions as materialized (select s.image_id, s.l region_id, s.kind, s.x, s.y, s.w, s.h, s.n n_pixels, ar.area from
   (select image_id, l, 'outer' kind, x, y, w, h, n from fs union all select image_id, l, 'hole', x - 1, y - 1, w + 2, h + 2, n from ha) s
   join ar on ar.image_id = s.image_id and ar.p = s.l)\n"""
    )


CLOSED = cte("m0", "s0", mask="case when v > 35 then 255 else 0 end") + close_sql("m0", "mask", "c3", "cross3")
REGIONS = recursive(BASE) + CLOSED + regions_sql("c3 where c3_v > 0", "c3 where c3_v = 0")


def closed_mask(v):
    t = N.halo_tiles(P.add(start(v), mask="case when v > 35 then 255 else 0 end").drop("v"), N.close_halo("cross3"), together=True)
    return N.own_pixels(N.morph_close(t, "mask", "v")).select("image_id", "width", "height", "y", "x", "v")


@query("connected_regions", REGIONS + "select * from regions")
def _regions(v):
    return R.connected_regions(closed_mask(v))


@query("filled_regions", REGIONS + "select * from regions where area >= 50")
def _filled(v):
    return R.filled_regions(closed_mask(v))


@query(
    "keep_target_component",
    recursive(with_views("px", "px_cells"))
    + f", s0 as materialized (select image_id, y, x, {C.cyan()} v from px)\n"
    + label_sql("s0 where v > 35", "fl")
    + """, anchors as (select image_id, cy y, cx + r x from px_cells)
select fl.image_id, fl.l region_id, fl.y, fl.x from fl where exists
 (select 1 from fl a join anchors using (image_id, y, x) where a.image_id = fl.image_id and a.l = fl.l)""",
)
def _target(v):
    mask = start(v).where("v > 35")
    anchors = v.px_cells.selectExpr("image_id", "cy as y", "cx + r as x")
    return R.keep_target(mask, anchors)


# ---- edges ---------------------------------------------------------------------------------------------


def canny_sql(source: str, col: str, low: str, high: str, name: str = "canny") -> str:
    from cytoloom.functions.stencil import shifted

    one = "image_id"
    rows = cte(f"{name}_m", f"{name}_g", m="abs(gx) + abs(gy)")
    rows += cte(f"{name}_n", f"{name}_m", _l=shifted("m", "x", -1, "0", one), _r=shifted("m", "x", 1, "0", one))
    rows += cte(
        f"{name}_s",
        f"{name}_n",
        **{
            out: shifted(src, "y", d, "0", one)
            for out, src, d in (
                ("_u", "m", -1), ("_d", "m", 1), ("_ul", "_l", -1), ("_ur", "_r", -1), ("_dl", "_l", 1), ("_dr", "_r", 1),
            )
        },
    )
    edge = f"case when m > floor({low}) and ({N.THIN}) then case when m > floor({high}) then 2 else 1 end else 0 end"
    return (
        grad_sql(source, col, 1, 2, "replicate", f"{name}_g")
        + rows
        + f", {name}_e as materialized (select image_id, y, x, {edge} edge from {name}_s)\n"
        + f""", {name} (image_id, y, x) as (select image_id, y, x from {name}_e where edge = 2 union
  select n.image_id, n.y, n.x from {name} c join {name}_e n on n.image_id = c.image_id and {EIGHT} where n.edge > 0)\n"""
    )


@query("canny", recursive(BASE) + canny_sql("s0", "gray", "50", "150") + "select * from canny")
def _canny(v):
    t = N.canny_candidates(N.halo_tiles(start(v), 2, together=True), "gray", "50", "150")
    return R.hysteresis(N.own_pixels(t))


def fused_gradient(own, edges):
    """.7 of the normalised Scharr magnitude and .3 of the edge map."""
    norm = P.minmax_normalize(P.add(own, mag=N.MAGNITUDE), "mag", "norm")
    marked = P.with_marks(norm, edges, "hit")
    return P.add(marked, fused=C.saturated("cast(rint((7 * norm + 3 * hit) / 10) as bigint)"))


@query(
    "gradient_fusion",
    recursive(BASE)
    + canny_sql("s0", "gray", "50", "150")
    + grad_sql("s0", "gray", 3, 10)
    + cte("mag", "grad", mag=N.MAGNITUDE)
    + """, nm as (select *, cast(floor((mag - min(mag) over w) / (max(mag) over w - min(mag) over w) * 255) as bigint) norm
  from mag window w as (partition by image_id))
select image_id, y, x, greatest(0, least(255, cast(round_even((7 * norm + 3 * (case when exists (select 1 from canny c
  where c.image_id = nm.image_id and c.y = nm.y and c.x = nm.x) then 255 else 0 end)) / 10, 0) as bigint))) v from nm""",
)
def _fusion(v):
    tiles = N.halo_tiles(start(v).drop("v"), 2, together=True)
    edges = R.hysteresis(N.own_pixels(N.canny_candidates(tiles, "gray", "50", "150")))
    own = N.own_pixels(N.scharr(tiles, "gray"))
    return fused_gradient(own, edges).selectExpr("image_id", "y", "x", "fused as v")


@query(
    "fused_composite",
    recursive(BASE)
    + cte("m0", "s0", mask="case when v > 35 then 255 else 0 end")
    + canny_sql("m0", "mask", "50", "150")
    + __import__("cytoloom.catalog.stencils", fromlist=["clahe_sql"]).clahe_sql("m0", "gray", "cl", 3.0)
    + grad_sql("cl", "cl_v", 3, 10)
    + cte("mag", "grad", mag=N.MAGNITUDE)
    + """, nm as (select *, cast(floor(mag / max(mag) over (partition by image_id) * 255) as bigint) norm from mag)
select image_id, y, x, greatest(0, least(255, (50 * cl_v + 30 * case when mask > 0 then norm else 0 end + 20 * (case when exists
  (select 1 from canny c where c.image_id = nm.image_id and c.y = nm.y and c.x = nm.x) then 255 else 0 end)) // 100)) v from nm""",
)
def _composite(v):
    masked = P.add(start(v), mask="case when v > 35 then 255 else 0 end").drop("v")
    return composite(masked).select("image_id", "y", "x", "v")


def composite(masked, clip: float = 3.0):
    """.5 contrast-lifted gray + .3 gradient inside the mask + .2 thin mask edges, truncated."""
    edges = R.hysteresis(N.own_pixels(N.canny_candidates(N.halo_tiles(masked, 2, together=True), "mask", "50", "150")))
    lifted = H.clahe(masked, "gray", "cl", clip)
    own = N.own_pixels(P.add(N.scharr(N.halo_tiles(lifted, 1, together=True), "cl"), mag=N.MAGNITUDE))
    norm = P.max_normalize(own, "mag", "norm")
    marked = P.with_marks(norm, edges, "hit")
    mixed = "(50 * cl + 30 * case when mask > 0 then norm else 0 end + 20 * hit)"
    return P.add(marked, v=C.saturated(C.idiv(mixed, 100)))


@query("crop_silhouette")
def _silhouette(v):
    """Per crop: contrast lift on 4 x 4 tiles, gradient, Otsu, closing, then only the part at the soma anchor."""
    return silhouettes(v).select("image_id", "y", "x")


def silhouettes(v):
    cells = P.pixels_in_boxes(v.px, v.px_cells, together=True)
    crops = cells.selectExpr(
        "cell_id as image_id", "bw as width", "bh as height", "y - by as y", "x - bx as x", f"{C.gray()} as gray"
    )
    # Crops are dealt by their pixels, not by their bytes: a task then holds the contrast tables of few crops. What comes of the windows is stored once.
    tasks = tasks_for(v.spark, v.px_cells.agg(F.expr("coalesce(sum(w * h), 0)")).first()[0])
    lifted = H.clahe(crops.repartition(tasks, "image_id"), "gray", "cl", 4.0, grid=4)
    own = N.own_pixels(P.add(N.scharr(N.halo_tiles(lifted, 1, together=True), "cl"), mag=N.MAGNITUDE))
    held = P.by_image(written(own.select("image_id", "width", "height", "y", "x", "mag"), "crop-gradients"))
    norm = P.max_normalize(held, "mag", "norm", together=True).select("image_id", "width", "height", "y", "x", "norm")
    edge = P.add(norm.join(H.otsu(norm, "norm").hint("shuffle_hash"), "image_id"), mask="case when norm > otsu then 255 else 0 end")
    closed = N.own_pixels(N.morph_close(N.halo_tiles(edge, 2, together=True), "mask", "v"))
    anchors = v.px_cells.selectExpr("cell_id as image_id", "cy - y as y", "least(cx + r - x, w - 1) as x")
    return R.keep_target(closed.where("v > 0"), anchors)


# ---- contours --------------------------------------------------------------------------------------------

PTS = with_views("contour_pts")
KEYS = "image_id, contour_id"
SEG = """, seg as materialized (select image_id, contour_id, seq, x, y,
  coalesce(lead(x) over w, first_value(x) over w) nx, coalesce(lead(y) over w, first_value(y) over w) ny
  from contour_pts window w as (partition by image_id, contour_id order by seq))\n"""


@query(
    "region_bbox",
    PTS + f"select {KEYS}, min(x) x, min(y) y, max(x) - min(x) + 1 w, max(y) - min(y) + 1 h, count(*) n_points from contour_pts group by all",
)
def _bbox(v):
    return T.bounding_boxes(v.contour_pts)


@query("polygon_area", PTS + SEG + f"select {KEYS}, cast(abs(sum(x * ny - nx * y)) as double) / 2 area from seg group by all")
def _area(v):
    return T.polygon_area(v.contour_pts)


@query(
    "morphometrics",
    PTS
    + SEG
    + f""", a as (select {KEYS}, cast(abs(sum(x * ny - nx * y)) as double) / 2 area,
  sum(sqrt(cast((nx - x) * (nx - x) + (ny - y) * (ny - y) as double))) p from seg group by all)
select {KEYS}, area, round(p, 6) perimeter, round(case when p > 0 then 4 * pi() * area / (p * p) end, 6) circularity from a""",
)
def _morphometrics(v):
    shape = T.morphometrics(v.contour_pts)
    return shape.select(
        "image_id", "contour_id", "area", F.round("perimeter", 6).alias("perimeter"), F.round("circularity", 6).alias("circularity")
    )


# Inside test point by point: odd number of crossings to the left, or on an edge.
@query(
    "region_fill",
    PTS
    + SEG
    + f""", ext as (select {KEYS}, min(x) x0, max(x) x1, min(y) y0, max(y) y1 from contour_pts group by all)
, grid as (select {KEYS}, y, unnest(range(x0, x1 + 1)) x from (select *, unnest(range(y0, y1 + 1)) y from ext))
, hit as (select g.image_id, g.contour_id, g.y, g.x from grid g join seg s on s.image_id = g.image_id and s.contour_id = g.contour_id
  group by all having bool_or(g.y between least(s.y, s.ny) and greatest(s.y, s.ny) and g.x between least(s.x, s.nx) and greatest(s.x, s.nx)
    and (s.nx - s.x) * (g.y - s.y) = (s.ny - s.y) * (g.x - s.x))
   or count(*) filter (s.y <> s.ny and g.y >= least(s.y, s.ny) and g.y < greatest(s.y, s.ny)
    and ((g.y - s.y) * (s.nx - s.x) + s.x * (s.ny - s.y)) * sign(s.ny - s.y) < g.x * abs(s.ny - s.y)) % 2 = 1)
select {KEYS}, y, cast(count(*) as bigint) n, cast(sum(x) as bigint) sx from hit group by all""",
)
def _fill(v):
    spans = T.fill_spans(v.contour_pts)
    return spans.groupBy("image_id", "contour_id", "y").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("n"), F.sum(F.expr("(x0 + x1) * (x1 - x0 + 1) div 2")).alias("sx")
    )


HULL = (
    f""", d as (select distinct {KEYS}, x, y from contour_pts)
, e as (select p.image_id, p.contour_id, p.x, p.y, q.x qx, q.y qy from d p join d q
   on q.image_id = p.image_id and q.contour_id = p.contour_id and (p.x <> q.x or p.y <> q.y))
, hull as materialized (select e.* from e join d r on r.image_id = e.image_id and r.contour_id = e.contour_id
  group by all having bool_and((qx - e.x) * (r.y - e.y) > (qy - e.y) * (r.x - e.x) or
   ((qx - e.x) * (r.y - e.y) = (qy - e.y) * (r.x - e.x) and r.x between least(e.x, qx) and greatest(e.x, qx)
     and r.y between least(e.y, qy) and greatest(e.y, qy)))
  union select image_id, contour_id, x, y, x, y from d qualify count(*) over (partition by image_id, contour_id) = 1)\n"""
)


@query("convex_hull", PTS + HULL + f"select distinct {KEYS}, x, y from hull")
def _hull(v):
    return T.convex_hull(v.contour_pts).select("image_id", "contour_id", "x", "y")


@query(
    "border_hull_closure",
    PTS
    + SEG
    + HULL
    + f""", box as (select {KEYS}, min(x) <= 4 or min(y) <= 4 or max(x) + 1 >= 199 - 4 or max(y) + 1 >= 211 - 4 touches from contour_pts group by all)
select {KEYS}, true is_hull, count(distinct (x, y)) n_points, cast(abs(sum(x * qy - qx * y)) as double) / 2 area
  from hull join box using (image_id, contour_id) where touches group by all
union all select {KEYS}, false, count(*), cast(abs(sum(x * ny - nx * y)) as double) / 2 from seg join box using (image_id, contour_id)
  where not touches group by all""",
)
def _closure(v):
    outline = T.border_hull_closure(v.contour_pts, 199, 211)
    area = T.polygon_area(outline)
    counts = outline.groupBy("image_id", "contour_id", "is_hull").agg(F.count(F.lit(1)).alias("n_points"))
    return counts.join(area, ["image_id", "contour_id"])


ENDS = f""", ends as materialized (select * exclude (b_y), b_y "by", (ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y) d2 from (
  select {KEYS}, count(*) n_points, arg_min(x, seq) ax, arg_min(y, seq) ay, arg_max(x, seq) bx, arg_max(y, seq) b_y
  from contour_pts group by all having count(*) >= 10))\n"""


@query("contour_endpoints", PTS + ENDS + f"select {KEYS}, n_points, ax, ay, bx, \"by\", d2 from ends")
def _endpoints(v):
    return T.endpoints(v.contour_pts)


@query("self_gap_close", PTS + ENDS + f"select {KEYS}, ax, ay, bx, \"by\", d2 from ends where d2 between 4 and 900")
def _gaps(v):
    return T.self_gap_close(T.endpoints(v.contour_pts)).drop("n_points")


LINE_SQL = """, ln as (select image_id, ax x0, ay y0, bx - ax dx, "by" - ay dy, greatest(abs(bx - ax), abs("by" - ay), 1) n from ends where d2 between 4 and 900)
, core as (select image_id, x0 + floor((2 * dx * i + n) / (2 * n)) cx, y0 + floor((2 * dy * i + n) / (2 * n)) cy
  from (select *, unnest(range(0, n + 1)) i from ln))
, bridge as (select distinct image_id, cast(cy + dy as bigint) y, cast(cx + dx as bigint) x from core
  cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) t(dy, dx))\n"""


def bridges(v):
    gaps = T.self_gap_close(T.endpoints(v.contour_pts))
    return T.raster_lines(gaps.selectExpr("image_id", "ax as x0", "ay as y0", "bx as x1", "by as y1"), 2)


@query("bridge_raster", PTS + ENDS + LINE_SQL + "select image_id, y, x from bridge")
def _bridges(v):
    return bridges(v).select("image_id", "y", "x")


@query(
    "mask_union",
    PTS + ENDS + LINE_SQL + "select image_id, y, x from bridge union select image_id, y, x from contour_pts",
)
def _mask_union(v):
    return T.union_pixels(bridges(v), v.contour_pts)


# Short contours (under 5 points) are the legs here; each joins the lowest longer contour of its image and tens group.
LEGS_SQL = """, sizes as (select image_id, contour_id, count(*) n, contour_id // 8 grp from contour_pts group by all)
, legs as (select s.image_id, s.contour_id leg, min(b.contour_id) parent from sizes s join sizes b
  on b.image_id = s.image_id and b.grp = s.grp and b.n >= 5 where s.n < 5 group by all)\n"""


@query(
    "merge_points",
    PTS
    + LEGS_SQL
    + """select distinct p.image_id, coalesce(l.parent, p.contour_id) contour_id, p.x, p.y from contour_pts p
left join legs l on l.image_id = p.image_id and l.leg = p.contour_id""",
)
def _merge(v):
    sizes = T.bounding_boxes(v.contour_pts).selectExpr("image_id", "contour_id", "n_points as n", "contour_id div 8 as grp")
    parents = sizes.where("n >= 5").groupBy("image_id", "grp").agg(F.min("contour_id").alias("parent"))
    legs = sizes.where("n < 5").join(parents, ["image_id", "grp"]).selectExpr("image_id", "contour_id as leg", "parent")
    return T.merged_points(v.contour_pts, legs)


# ---- shape measures ----------------------------------------------------------------------------------------

RING = with_views("px") + ", ring as materialized (select image_id, y, x from px where ring = 1)\n"
SCALED = """, scales(s) as (values (1), (2), (4), (8), (16))
, mass as materialized (select image_id, s, y // s gy, x // s gx, count(*) m from ring cross join scales group by all)\n"""


def ring(v):
    return v.px.where("ring = 1").select("image_id", "y", "x")


@query(
    "fractal_dimension",
    RING
    + SCALED
    + """, n as (select image_id, s, count(*) n from mass group by all)
select image_id, round(regr_slope(ln(n), ln(1 / s)), 6) dimension from n group by all""",
)
def _fractal(v):
    return M.fractal_dimension(ring(v)).select("image_id", F.round("dimension", 6).alias("dimension"))


@query(
    "lacunarity",
    RING
    + SCALED
    + """, t as (select image_id, cast(s as bigint) s, sum(m) m1, sum(m * m) m2, ceil(48 / s) * ceil(48 / s) nb from mass group by all)
select image_id, s, round((m2 / nb - (m1 / nb) * (m1 / nb)) / ((m1 / nb) * (m1 / nb)), 6) lacunarity from t""",
)
def _lacunarity(v):
    sizes = v.px.groupBy("image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    return M.lacunarity(ring(v), sizes).select("image_id", "s", F.round("lacunarity", 6).alias("lacunarity"))


RATIO = with_views("px", "px_cells") + (
    ", inside as (select c.cell_id, c.cx, c.cy, c.r cr, p.image_id, p.y, p.x from px p join px_cells c on p.image_id = c.image_id"
    " and p.x >= c.x and p.x < c.x + c.w and p.y >= c.y and p.y < c.y + c.h)\n"
)
D2 = "(x - cx) * (x - cx) + (y - cy) * (y - cy)"


@query(
    "soma_cell_ratio",
    RATIO
    + f""", a as (select image_id, cell_id, count(*) filter ({D2} <= (cr // 2) * (cr // 2)) soma_area, count(*) filter ({D2} <= cr * cr + cr) cell_area from inside group by all)
select image_id, cell_id, soma_area, cell_area, round(soma_area / cell_area, 6) ratio from a""",
)
def _ratio(v):
    found = P.pixels_in_boxes(v.px, v.px_cells).join(
        v.px_cells.selectExpr("image_id", "cell_id", "cx", "cy", "r as cr"), ["image_id", "cell_id"]
    )
    soma = found.groupBy("image_id", "cell_id").agg(F.expr(f"count_if({D2} <= (cr div 2) * (cr div 2)) as soma_area"))
    cell = found.groupBy("image_id", "cell_id").agg(F.expr(f"count_if({D2} <= cr * cr + cr) as cell_area"))
    return M.soma_cell_ratio(soma, cell).withColumn("ratio", F.round("ratio", 6))


@query(
    "branch_endpoints",
    RING
    + """, n as (select c.image_id, c.y, c.x, count(n.x) k from ring c left join ring n on n.image_id = c.image_id
  and n.y between c.y - 1 and c.y + 1 and n.x between c.x - 1 and c.x + 1 and (n.y <> c.y or n.x <> c.x) group by all)
select image_id, count(*) length, count(*) filter (k = 1) ends from n group by all""",
)
def _branches(v):
    return M.branch_endpoints(ring(v))


AGREE = BASE + ", pred as materialized (select image_id, y, x from s0 where v > 35 and (x + y) % 9 > 0)\n, truth as materialized (select image_id, y, x from s0 where ring = 1)\n"


def prediction(v):
    return start(v).where("v > 35 and (x + y) % 9 > 0")


@query(
    "dice_iou",
    AGREE
    + """, n as (select image_id, count(p.y) n_pred, count(t.y) n_true, count(*) filter (p.y is not null and t.y is not null) n_both
  from (select *, y py from pred) p full join (select *, y ty from truth) t using (image_id, y, x) group by all)
select image_id, n_pred, n_true, n_both, round(2 * n_both / (n_pred + n_true), 6) dice, round(n_both / (n_pred + n_true - n_both), 6) iou from n""".replace(
        "count(p.y)", "count(py)"
    ).replace("count(t.y)", "count(ty)").replace("p.y is not null and t.y is not null", "py is not null and ty is not null"),
)
def _dice(v):
    out = M.dice_iou(prediction(v), ring(v))
    return out.withColumns({"dice": F.round("dice", 6), "iou": F.round("iou", 6)})


NEAR2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4 and b.y between a.y - 2 and a.y + 2"


@query(
    "boundary_f1",
    AGREE
    + f""", pr as (select a.image_id, count(*) n, count(*) filter (exists (select 1 from truth b where b.image_id = a.image_id and {NEAR2})) hit from pred a group by all)
, rc as (select a.image_id, count(*) n, count(*) filter (exists (select 1 from pred b where b.image_id = a.image_id and {NEAR2})) hit from truth a group by all)
, f as (select image_id, pr.hit / pr.n p, rc.hit / rc.n r from pr join rc using (image_id))
select image_id, round(p, 6) "precision", round(r, 6) recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) f1 from f""",
)
def _boundary(v):
    out = M.boundary_f1(prediction(v), ring(v))
    return out.select("image_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
