"""Registered queries on traced contours: ordered points of every border, and what is measured on them.

Tiles are 16 pixels wide here, so that borders of the bound 48-pixel images cross seams.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoloom.catalog.regions import HULL, REGIONS, closed_mask
from cytoloom.catalog.registry import query
from cytoloom.operators import contours as T
from cytoloom.operators import tracing as TR
from cytoloom.session import cut_lineage

SMALL = 16

_ROW = 2147483648
_STEPS = "(values (0, 0, -1), (1, -1, -1), (2, -1, 0), (3, -1, 1), (4, 0, 1), (5, 1, 1), (6, 1, 0), (7, 1, -1)) s(k, dy, dx)"

#: A walk is at a pixel and knows the side it came from; it turns counter-clockwise from there to the next set pixel.
TRACED = (
    REGIONS
    + f""", on3 as materialized (select image_id, y, x from c3 where c3_v > 0)
, sides as materialized (select a.image_id, a.y, a.x, list(s.k order by s.k) ks from on3 a cross join {_STEPS}
   join on3 b on b.image_id = a.image_id and b.y = a.y + s.dy and b.x = a.x + s.dx group by all)
, turns as materialized (select e.image_id, e.y, e.x, e.came, s.k, e.y + s.dy ny, e.x + s.dx nx, (s.k + 4) % 8 ncame from (
   select image_id, y, x, came, list_min(list_transform(ks, lambda k: (came - k + 7) % 8)) t from
   (select *, unnest(ks) came from sides) u) e join {_STEPS} on s.k = (e.came - e.t + 7) % 8)
, begins as materialized (select r.image_id, r.region_id, r.kind, r.region_id // {_ROW} y, r.region_id % {_ROW} - case when r.kind = 'hole' then 1 else 0 end x,
   case when r.kind = 'hole' then 4 else 0 end look from regions r)
, firsts as materialized (select b.*, (look + list_min(list_transform(ks, lambda k: (k - look + 8) % 8))) % 8 came
   from begins b left join sides using (image_id, y, x))
, walks (image_id, region_id, kind, seq, y, x, came, y0, x0, c0) as (
   select image_id, region_id, kind, cast(0 as bigint), y, x, came, y, x, came from firsts union all
   select w.image_id, w.region_id, w.kind, w.seq + 1, t.ny, t.nx, t.ncame, y0, x0, c0 from walks w
   join turns t on t.image_id = w.image_id and t.y = w.y and t.x = w.x and t.came = w.came
   where not (t.ny = y0 and t.nx = x0 and t.ncame = c0))
, contour_pts as materialized (select image_id, region_id contour_id, kind, seq, x, y from walks)\n"""
)


def traced(v):
    return TR.trace_contours(closed_mask(v), SMALL)


@query("contour_points", TRACED + "select * from contour_pts")
def _points(v):
    return traced(v)


@query("contour_corners", TRACED + """, bends as (select *, count(*) over (partition by image_id, contour_id) n,
  lead(x) over w nx, lead(y) over w ny, lag(x) over w px, lag(y) over w py,
  first_value(x) over w fx, first_value(y) over w fy, last_value(x) over (w rows between unbounded preceding and unbounded following) lx,
  last_value(y) over (w rows between unbounded preceding and unbounded following) ly from contour_pts window w as (partition by image_id, contour_id order by seq))
select image_id, contour_id, seq, x, y from bends where n = 1 or coalesce(nx, fx) - x <> x - coalesce(px, lx) or coalesce(ny, fy) - y <> y - coalesce(py, ly)""")
def _corners(v):
    return TR.corners(cut_lineage(traced(v)))


@query("traced_area", REGIONS + "select image_id, region_id contour_id, area from regions")
def _area(v):
    return T.polygon_area(cut_lineage(traced(v)))


@query("traced_boxes", TRACED + "select image_id, contour_id, min(x) x, min(y) y, max(x) - min(x) + 1 w, max(y) - min(y) + 1 h, count(*) n_points from contour_pts group by all")
def _boxes(v):
    return T.bounding_boxes(traced(v))


@query("traced_hull", TRACED + HULL.replace("from contour_pts)", "from contour_pts where kind = 'outer')", 1) + "select distinct image_id, contour_id, x, y from hull")
def _hull(v):
    outer = traced(v).where("kind = 'outer'")
    return T.convex_hull(outer).select("image_id", "contour_id", "x", "y")


@query(
    "traced_endpoints",
    TRACED
    + """, ends as (select image_id, contour_id, count(*) n_points, arg_min(x, seq) ax, arg_min(y, seq) ay, arg_max(x, seq) bx, arg_max(y, seq) b_y
  from contour_pts group by all having count(*) >= 10)
select image_id, contour_id, n_points, ax, ay, bx, b_y "by", (ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y) d2 from ends""",
)
def _ends(v):
    return T.endpoints(traced(v))


@query(
    "traced_fill",
    REGIONS + """, inside as (select anc.image_id, anc.p, q.y, q.x from anc join (select * from fl union all select * from bl) q
   on q.image_id = anc.image_id and q.l = anc.l)
select i.image_id, i.p contour_id, cast(count(*) as bigint) n_pixels from inside i join regions r
  on r.image_id = i.image_id and r.region_id = i.p where r.kind = 'outer' group by all""",
)
def _fill(v):
    spans = T.fill_spans(cut_lineage(traced(v).where("kind = 'outer'")))
    return spans.groupBy("image_id", "contour_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n_pixels"))


@query(
    "contour_table",
    TRACED + """select r.image_id, r.region_id, r.kind, r.x, r.y, r.w, r.h, r.area, n_points from regions r join
  (select image_id, contour_id region_id, count(*) n_points from contour_pts group by all) using (image_id, region_id)""",
)
def _table(v):
    return TR.contour_table(closed_mask(v), SMALL)
