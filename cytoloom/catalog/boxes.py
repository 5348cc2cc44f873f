"""Registered queries over the ``boxes`` and ``files`` views."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoloom.catalog.registry import greedy_sql, query
from cytoloom.functions.geometry import padded, touches_border
from cytoloom.functions.naming import extension, numbered
from cytoloom.operators import attachment as AT
from cytoloom.operators import boxes as B
from cytoloom.operators import reports as R
from cytoloom.session import cut_lineage, written
from cytoloom.sources.views import SLIDE_H, SLIDE_W, with_views

GATE_SQL = (
    "area >= {low} and not (area > 0.70 * 1800 * 1300 or (w > 0.85 * 1800 and h > 0.85 * 1300))"
)
SIDE_X = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))"
SIDE_Y = "greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
INTER = f"({SIDE_X} * {SIDE_Y})"
MEET = "a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h"
FOLDED = ", f as materialized (select image_id, x, y, w, h, area, min(j) j, count(*) n from boxes group by all)\n"


def gated_sql(low: int = 80) -> str:
    return f", gated as materialized (select * from boxes where {GATE_SQL.format(low=low)})\n"


def held_sql(source: str, least: int, name: str = "held") -> str:
    return f""", {name} as materialized (select a.image_id, a.j oj, b.j ij, b.x, b.y, b.w, b.h
  from {source} a join {source} b on a.image_id = b.image_id and a.j <> b.j and {MEET}
  where {INTER} >= 0.80 * (b.w * b.h) and a.area > b.area and b.area >= {least})\n"""


def single_sql(source: str, held: str = "held", name: str = "single") -> str:
    inter = (
        "(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))"
        " * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))"
    )
    return f""", {name}_first as (select * from {held} qualify row_number() over (partition by image_id, oj order by ij) = 1)
, {name}_bad as (select distinct b.image_id, b.oj from {held} b join {name}_first a on a.image_id = b.image_id and a.oj = b.oj
  where not ({inter} > 0.60 * (a.w * a.h + b.w * b.h - {inter})))
, {name} as materialized (select * from {source} s where not exists
  (select 1 from {name}_bad k where k.image_id = s.image_id and k.oj = s.j))\n"""


def deduped_sql(source: str, name: str = "kept") -> str:
    return f""", {name} as materialized (select a.* from {source} a where not exists (select 1 from {source} b
  where a.image_id = b.image_id and b.area > a.area and {MEET} and {INTER} >= 0.75 * (a.w * a.h)))\n"""


KEPT_SQL = with_views("boxes") + gated_sql() + held_sql("gated", 200) + single_sql("gated") + deduped_sql("single")
LEGACY_SQL = (
    gated_sql(100).replace("gated", "gated100")
    + held_sql("gated100", 300, "held300")
    + """, legacy as materialized (select * from gated100 s where not exists (select 1 from
  (select image_id, oj from held300 group by all having count(*) >= 2) k where k.image_id = s.image_id and k.oj = s.j))\n"""
)


def gated(v, low: int = 80):
    return B.gate(v.boxes, SLIDE_W, SLIDE_H, low)


def kept(v):
    """Gate, composite filter, duplicate filter; single boxes are read by both sides of the last step."""
    return B.duplicate_subset(cut_lineage(B.non_composite(gated(v))))


def legacy(v):
    return B.non_composite_legacy(gated(v, 100), min_inner=300)


@query(
    "pad_and_clamp",
    with_views("boxes")
    + """select image_id, j, greatest(0, x - 5) x1, greatest(0, y - 5) y1, least(1800, x + w + 5) x2,
  least(1300, y + h + 5) y2 from boxes""",
)
def _pad(v):
    return v.boxes.withColumns(padded(5, SLIDE_W, SLIDE_H)).select("image_id", "j", "x1", "y1", "x2", "y2")


@query(
    "touches_border",
    with_views("boxes")
    + """select image_id, j, (x <= 4 or y <= 4 or x + w >= 1796 or y + h >= 1296) touches,
  (x <= 5 or y <= 5 or x + w >= 1795 or y + h >= 1295) touches_legacy from boxes""",
)
def _touch(v):
    return v.boxes.select(
        "image_id",
        "j",
        touches_border(SLIDE_W, SLIDE_H, 4).alias("touches"),
        touches_border(SLIDE_W, SLIDE_H, 5).alias("touches_legacy"),
    )


@query(
    "candidate_gate",
    with_views("boxes") + f"select image_id, j, x, y, w, h, area from boxes where {GATE_SQL.format(low=80)}",
)
def _gate(v):
    return gated(v).select("image_id", "j", "x", "y", "w", "h", "area")


@query(
    "bbox_intersection",
    with_views("boxes")
    + FOLDED
    + f"""select a.image_id, a.j a_j, b.j b_j, {INTER} overlap, a.n * b.n n_pairs
from f a join f b on a.image_id = b.image_id and a.j < b.j and {MEET}
union all select image_id, j, j, w * h, n * (n - 1) // 2 from f where n > 1""",
)
def _intersections(v):
    return B.overlaps(v.boxes)


@query(
    "containment",
    with_views("boxes")
    + FOLDED
    + f"""select a.image_id, a.j outer_j, b.j inner_j, {INTER} overlap, a.n outer_n, b.n inner_n
from f a join f b on a.image_id = b.image_id and {MEET}
where {INTER} >= 0.80 * (b.w * b.h) and a.area > b.area and b.area >= 200""",
)
def _containment(v):
    return B.containment(v.boxes).select(
        "image_id",
        F.col("a_j").alias("outer_j"),
        F.col("b_j").alias("inner_j"),
        B.intersection_area().alias("overlap"),
        F.col("a_n").alias("outer_n"),
        F.col("b_n").alias("inner_n"),
    )


@query(
    "non_composite",
    with_views("boxes") + gated_sql() + held_sql("gated", 200) + single_sql("gated") + "select image_id, j, area from single",
)
def _non_composite(v):
    return B.non_composite(gated(v)).select("image_id", "j", "area")


@query(
    "non_composite_legacy",
    with_views("boxes") + LEGACY_SQL + "select image_id, j, area from legacy",
)
def _non_composite_legacy(v):
    return legacy(v).select("image_id", "j", "area")


@query(
    "duplicate_subset",
    with_views("boxes") + deduped_sql("boxes") + "select image_id, j, area from kept",
)
def _duplicate(v):
    return B.duplicate_subset(v.boxes).select("image_id", "j", "area")


PARTNER_SQL = (
    with_views("boxes")
    + """, found as (select a.*, b.j partner, (INTER >= 0.75 * (a.w * a.h) and b.area > a.area) dup
  from boxes a join boxes b on a.image_id = b.image_id and a.j <> b.j and b.area > a.area
   and a.x <= b.x + b.w + 3 and b.x <= a.x + a.w + 3 and a.y <= b.y + b.h + 3 and b.y <= a.y + a.h + 3
  where (INTER >= 0.75 * (a.w * a.h) and b.area > a.area) or (a.area < 200 and b.area >= 250 and
   (INTER >= 0.08 * (a.w * a.h) or (greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w) <= 3
     and greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h) <= 3))))
, one as materialized (select * from found qualify row_number() over (partition by image_id, j order by partner) = 1)
""".replace("INTER", INTER)
)


@query(
    "first_match",
    PARTNER_SQL + "select image_id, j, partner, case when dup then 'duplicate' else 'leg' end kind from one",
)
def _first_match(v):
    found = B.first_partner(v.boxes)
    shape = [F.col(f"a_{c}").alias(c) for c in B.SHAPE[1:]]
    return (
        v.boxes.join(found.select("image_id", *shape, "partner", "kind"), B.SHAPE)
        .select("image_id", "j", "partner", "kind")
    )


@query(
    "leg_attach",
    PARTNER_SQL
    + """select b.image_id, b.j, least(b.x, coalesce(min(o.x), b.x)) x, least(b.y, coalesce(min(o.y), b.y)) y,
  greatest(b.x + b.w, coalesce(max(o.x + o.w), 0)) - least(b.x, coalesce(min(o.x), b.x)) w,
  greatest(b.y + b.h, coalesce(max(o.y + o.h), 0)) - least(b.y, coalesce(min(o.y), b.y)) h,
  b.area, count(o.j) legs
from boxes b left join (select * from one where not dup) o on o.image_id = b.image_id and o.partner = b.j
where not exists (select 1 from one k where k.image_id = b.image_id and k.j = b.j)
group by b.image_id, b.j, b.x, b.y, b.w, b.h, b.area""",
)
def _leg_attach(v):
    return B.leg_attach(v.boxes)


@query(
    "axis_gap",
    with_views("boxes")
    + FOLDED
    + """select a.image_id, a.j a_j, b.j b_j, greatest(0, greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w)) gap_x,
  greatest(0, greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h)) gap_y, a.n * b.n n_pairs
from f a join f b on a.image_id = b.image_id and a.area < 200 and b.area >= 250
where greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w) <= 3 and greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h) <= 3""",
)
def _axis_gap(v):
    return B.leg_gaps(v.boxes)


@query("dup_leg_sequential")
def _sequential(v):
    return AT.dup_leg_in_order(v.boxes)


@query(
    "iomin_dedup",
    with_views("boxes")
    + f""", f as materialized (select image_id, x, y, w, h, min(j) j, max(area) area from boxes group by all)
select image_id, j, x, y, w, h, area from f a where not exists (select 1 from f b where a.image_id = b.image_id
  and (b.w * b.h > a.w * a.h or (b.w * b.h = a.w * a.h and b.j < a.j)) and {MEET}
  and {INTER} > 0.50 * least(a.w * a.h, b.w * b.h))""",
)
def _iomin(v):
    return B.iomin_dedup(v.boxes)


NMS_SQL = (
    with_views("boxes", recursive=True)
    + f""", sh as materialized (select image_id, x, y, w, h, max(area) area, arg_max(j, (area, -j)) j from boxes group by all)
, it as materialized (select (image_id, j) id, * from sh)
, cf as materialized (select a.id win, b.id lose from it a join it b on a.image_id = b.image_id and {MEET}
  and (a.area > b.area or (a.area = b.area and a.j < b.j)) and {INTER} > 0.5 * (a.w * a.h + b.w * b.h - {INTER}))\n"""
    + greedy_sql("it", "cf")
    + "select image_id, j, x, y, w, h, area from it join settled using (id) where s = 1"
)


@query("seam_nms", NMS_SQL)
def _nms(v):
    return B.seam_nms(v.boxes).select("image_id", "j", "x", "y", "w", "h", "area")


@query(
    "tile_assign",
    with_views("boxes")
    + """select image_id, j, tx.i tile_x, ty.i tile_y from boxes
  join (select range i from range(0, 10)) tx on x < tx.i * 896 + 1024 and x + w > tx.i * 896
  join (select range i from range(0, 10)) ty on y < ty.i * 896 + 1024 and y + h > ty.i * 896""",
)
def _tiles(v):
    return B.tile_assign(v.boxes).select("image_id", "j", "tile_x", "tile_y")


ORDERED = "row_number() over (partition by image_id order by y, x, j)"


@query("reading_order", with_views("boxes") + f"select image_id, j, {ORDERED} number from boxes")
def _reading(v):
    return B.reading_order(v.boxes).select("image_id", "j", "number")


@query(
    "cell_numbering",
    KEPT_SQL
    + f""", o as (select *, {ORDERED} n from kept)
select image_id, j, format('subcell_{{:03d}}', n) cell_id, format('subcell_{{:02d}}', n) legacy_id,
  format('cell_{{:03d}}', n) outer_id from o""",
)
def _numbering(v):
    cells = B.name_cells(kept(v))
    return cells.select(
        "image_id",
        "j",
        "cell_id",
        numbered("subcell_", "number", 2).alias("legacy_id"),
        numbered("cell_", "number", 3).alias("outer_id"),
    )


@query(
    "largest_region",
    with_views("boxes")
    + """, strong as (select * from boxes where area >= 9000)
select image_id, j, area, false fallback from strong union all
select image_id, j, area, true from boxes where image_id not in (select image_id from strong)
qualify row_number() over (partition by image_id order by area desc, j) = 1""",
)
def _largest(v):
    strong = v.boxes.where("area >= 9000")
    return B.largest_region(v.boxes, strong).select("image_id", "j", "area", "fallback")


CROPS_SQL = """, crops as materialized (select image_id, j, least(1800, x + w + 5) - greatest(0, x - 5) crop_w,
  least(1300, y + h + 5) - greatest(0, y - 5) crop_h from kept)
, edge as (select image_id, j, least(1800, x + w + 5) - greatest(0, x - 5) crop_w,
  least(1300, y + h + 5) - greatest(0, y - 5) crop_h from boxes
  where area >= 100 and (x <= 5 or y <= 5 or x + w >= 1795 or y + h >= 1295))
, rebuilt as materialized (select c.image_id, c.j, min(e.j) contour_j from crops c left join edge e using (image_id, crop_w, crop_h)
  group by all)
"""


def rebuilt(v):
    crops = (
        kept(v)
        .withColumns(padded(5, SLIDE_W, SLIDE_H))
        .select("image_id", "j", (F.col("x2") - F.col("x1")).alias("crop_w"), (F.col("y2") - F.col("y1")).alias("crop_h"))
    )
    return B.border_reconstruct_legacy(crops, v.boxes, SLIDE_W, SLIDE_H)


@query(
    "border_reconstruct_legacy",
    KEPT_SQL + CROPS_SQL + "select image_id, j, contour_j from rebuilt where contour_j is not null",
)
def _rebuilt(v):
    return rebuilt(v).where("contour_j is not null").select("image_id", "j", "contour_j")


# ---- lookups -----------------------------------------------------------------------------------------

STEP1_SQL = f""", step1 as materialized (select image_id, format('cell_{{:03d}}', {ORDERED}) cell_key, greatest(0, x - 10) gx1,
  greatest(0, y - 10) gy1, least(1800, x + w + 10) gx2, least(1300, y + h + 10) gy2 from boxes where area >= 5000)
, local as materialized (select image_id, j, format('cell_{{:03d}}', 1 + j % 40) cell_key, x % 40 x1, y % 40 y1, x % 40 + w x2,
  y % 40 + h y2 from kept)
"""


def step1(v):
    outer = B.name_cells(v.boxes.where("area >= 5000"), "cell_").withColumns(padded(10, SLIDE_W, SLIDE_H))
    return outer.select(
        "image_id",
        F.col("cell_id").alias("cell_key"),
        *[F.col(c).alias(f"g{c}") for c in ("x1", "y1", "x2", "y2")],
    )


def local_boxes(v):
    return (
        kept(v)
        .withColumn("slot", 1 + F.col("j") % 40)
        .select(
            "image_id", "j", numbered("cell_", "slot").alias("cell_key"),
            (F.col("x") % 40).alias("x1"), (F.col("y") % 40).alias("y1"),
            (F.col("x") % 40 + F.col("w")).alias("x2"), (F.col("y") % 40 + F.col("h")).alias("y2"),
        )
    )


@query(
    "cell_box_lookup",
    KEPT_SQL + STEP1_SQL + "select image_id, j, cell_key, gx1, gy1, gx2, gy2 from local left join step1 using (image_id, cell_key)",
)
def _lookup(v):
    found = local_boxes(v).join(step1(v), ["image_id", "cell_key"], "left")
    return found.select("image_id", "j", "cell_key", "gx1", "gy1", "gx2", "gy2")


@query(
    "local_to_global",
    KEPT_SQL
    + STEP1_SQL
    + """select image_id, j, x1 + coalesce(gx1, 0) x1, y1 + coalesce(gy1, 0) y1, x2 + coalesce(gx1, 0) x2,
  y2 + coalesce(gy1, 0) y2 from local left join step1 using (image_id, cell_key)""",
)
def _global(v):
    found = local_boxes(v).join(step1(v), ["image_id", "cell_key"], "left")
    zero = F.lit(0).cast("long")
    return found.select(
        "image_id", "j", *[(F.col(f"{a}{k}") + F.coalesce(f"g{a}1", zero)).alias(f"{a}{k}") for k in (1, 2) for a in "xy"]
    )


# ---- output rows ---------------------------------------------------------------------------------------

MARKS_SQL = (
    KEPT_SQL
    + f""", marks as materialized (select image_id, {ORDERED} number, greatest(0, x - 5) x1, greatest(0, y - 5) y1,
  least(1800, x + w + 5) x2, least(1300, y + h + 5) y2 from kept)\n"""
)


def marks(v):
    return B.name_cells(kept(v)).withColumns(padded(5, SLIDE_W, SLIDE_H))


@query(
    "marked_context",
    MARKS_SQL + "select image_id, format('subcell_{:03d}', number) cell_id, x1, y1, x2, y2, format('Subcell #{:03d}', number) label from marks",
)
def _marked(v):
    return marks(v).select("image_id", "cell_id", "x1", "y1", "x2", "y2", numbered("Subcell #", "number").alias("label"))


@query(
    "overview_annotations",
    MARKS_SQL
    + """select image_id, (number - 1) // 500 page, string_agg(concat_ws(',', number, x1, y1, x2, y2), ';' order by number) boxes
from marks group by all""",
)
def _overview(v):
    entry = F.concat_ws(",", *[F.col(c).cast("string") for c in ("number", "x1", "y1", "x2", "y2")])
    pages = R.annotation_pages(marks(v), entry)
    return pages.select("image_id", "page", F.array_join("entries", ";").alias("boxes"))


@query(
    "html_gallery",
    MARKS_SQL
    + """, c as (select image_id, count(*) n from marks group by all)
select image_id, 0 part, concat('<html><head><title>Gallery ', image_id, '</title></head><body><h1>Gallery ', image_id,
  '</h1><p>', n, ' cells</p>') html from c
union all select image_id, (number - 1) // 200 + 1, string_agg(concat('<div class="card"><p>', format('subcell_{:03d}', number),
  '</p></div>'), '' order by number) from marks group by all
union all select image_id, (n - 1) // 200 + 2, '</body></html>' from c""",
)
def _gallery(v):
    # Cards, heads and feet read the cells; they are found once.
    return R.html_gallery(written(marks(v).select("image_id", "number", "cell_id"), "gallery-cells"))


# ---- yields --------------------------------------------------------------------------------------------


def image_names(v):
    return v.files.select("image_id", F.col("name"), extension("name").alias("format"))


@query(
    "image_yield",
    KEPT_SQL
    + """, files as (FILES) select f.image_id, lower(regexp_extract(f.name, '(\\.[^.]*)$', 1)) format, count(k.j) n_cells
from files f left join kept k using (image_id) group by all""".replace("FILES", __import__("cytoloom.sources.views", fromlist=["FILES"]).FILES),
)
def _yield(v):
    return R.image_yield(image_names(v), kept(v)).select("image_id", "format", "n_cells")


@query(
    "grand_total",
    KEPT_SQL + "select coalesce(cast(image_id as varchar), 'GRAND TOTAL') image, cast(count(*) as bigint) n_cells from kept group by rollup(image_id)",
)
def _grand_total(v):
    yields = kept(v).groupBy(F.col("image_id").cast("string").alias("image")).agg(F.count(F.lit(1)).alias("n_cells"))
    return R.with_total(yields, "image", ["n_cells"])


@query(
    "two_step_yield",
    KEPT_SQL
    + """, outers as (select image_id, count(*) n from boxes where area >= 5000 group by all)
, inners as (select image_id, count(*) n from kept group by all)
select coalesce(cast(image_id as varchar), 'GRAND TOTAL') image, cast(sum(coalesce(o.n, 0)) as bigint) n_outer,
  cast(sum(coalesce(i.n, 0)) as bigint) n_sub from outers o full join inners i using (image_id) group by rollup(image_id)""",
)
def _two_step(v):
    outer = v.boxes.where("area >= 5000").select("image_id", F.lit(1).alias("o"), F.lit(0).alias("s"))
    inner = kept(v).select("image_id", F.lit(0).alias("o"), F.lit(1).alias("s"))
    per = outer.unionByName(inner).groupBy(F.col("image_id").cast("string").alias("image")).agg(
        F.sum("o").alias("n_outer"), F.sum("s").alias("n_sub")
    )
    return R.with_total(per, "image", ["n_outer", "n_sub"])


@query(
    "reconstructed_yield",
    KEPT_SQL
    + CROPS_SQL
    + """select coalesce(cast(image_id as varchar), 'GRAND TOTAL') image, cast(count(*) as bigint) n_sub,
  cast(count(contour_j) as bigint) n_rebuilt from rebuilt group by rollup(image_id)""",
)
def _rebuilt_yield(v):
    per = rebuilt(v).groupBy(F.col("image_id").cast("string").alias("image")).agg(
        F.count(F.lit(1)).alias("n_sub"), F.count_if(F.col("contour_j").isNotNull()).alias("n_rebuilt")
    )
    return R.with_total(per, "image", ["n_sub", "n_rebuilt"])


COMPARE_SQL = (
    KEPT_SQL
    + LEGACY_SQL
    + """, cmp as materialized (select s_suppkey image_id, coalesce(b.n, 0) baseline, coalesce(s.n, 0) sharpened from supplier
  left join (select image_id, count(*) n from legacy group by all) b on b.image_id = s_suppkey
  left join (select image_id, count(*) n from kept group by all) s on s.image_id = s_suppkey)
"""
)
DIFF_SQL = "case when d > 0 then concat('+', d) when d < 0 then cast(d as varchar) else '=' end diff"


def compared(v):
    images = v.files.select("image_id")
    return R.yield_compare(images, legacy(v), kept(v))


@query(
    "yield_compare",
    COMPARE_SQL + f"select image_id, baseline, sharpened, {DIFF_SQL} from (select *, sharpened - baseline d from cmp)",
)
def _compare(v):
    return compared(v)


@query(
    "compare_totals",
    COMPARE_SQL
    + f"""select cast(baseline as bigint) baseline, cast(sharpened as bigint) sharpened, {DIFF_SQL} from (select sum(baseline) baseline,
  sum(sharpened) sharpened, cast(sum(sharpened) - sum(baseline) as bigint) d from cmp)""",
)
def _compare_totals(v):
    return R.compare_totals(compared(v))


@query(
    "fix_before_after",
    with_views("boxes")
    + gated_sql()
    + held_sql("gated", 200)
    + single_sql("gated")
    + """, many as (select image_id, oj from held group by all having count(*) >= 2)
, t as (select image_id, count(*) before_raw, 0 after_raw from gated g where not exists
    (select 1 from many m where m.image_id = g.image_id and m.oj = g.j) group by all
  union all select image_id, 0, count(*) from single group by all)
select coalesce(cast(image_id as varchar), 'GRAND TOTAL') image, cast(sum(before_raw) as bigint) n_before,
  cast(sum(after_raw) as bigint) n_after, cast(sum(after_raw) - sum(before_raw) as bigint) diff from t group by rollup(image_id)""",
)
def _fix(v):
    boxes = gated(v)
    before = B.non_composite_legacy(boxes, min_inner=200).select("image_id", F.lit(1).alias("b"), F.lit(0).alias("a"))
    after = B.non_composite(boxes).select("image_id", F.lit(0).alias("b"), F.lit(1).alias("a"))
    per = before.unionByName(after).groupBy(F.col("image_id").cast("string").alias("image")).agg(
        F.sum("b").alias("n_before"), F.sum("a").alias("n_after")
    )
    per = per.withColumn("diff", F.col("n_after") - F.col("n_before"))
    return R.with_total(per, "image", ["n_before", "n_after", "diff"])
