"""Views that bind the driver's tables to the library's inputs (see FIXTURES.md, part C).

``Views`` gives the Spark side; ``with_views`` gives the same definitions as CTE text for the SQL checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.session import tasks_for

SLIDE_W, SLIDE_H = 1800, 1300
SIDE = 48
RINGS = 4


def _ring(k: int) -> tuple[str, str, str]:
    return (
        f"((image_id * 37 + {k * 29 + 7}) % {SIDE})",
        f"((image_id * 53 + {k * 41 + 11}) % {SIDE})",
        f"(3 + (image_id + {3 * k}) % 8)",
    )


def _on_ring(k: int) -> str:
    cx, cy, r = _ring(k)
    d2 = f"((x - {cx}) * (x - {cx}) + (y - {cy}) * (y - {cy}))"
    return f"({d2} between {r} * {r} - {r} and {r} * {r} + {r})"


ANY_RING = " or ".join(_on_ring(k) for k in range(RINGS))

# A marked pixel as one number: spot (place in the image) * MARK + RING_MARK if it lies on a ring + hit (at most 27).
MARK, RING_MARK = 64, 32

_RINGS = ", ".join(f"named_struct('cx', {cx}, 'cy', {cy}, 'r', {r})" for cx, cy, r in map(_ring, range(RINGS)))
_BOX = "sequence(0L, (2 * c.r + 1) * (2 * c.r + 1) - 1)"
_PLACED = "transform({box}, i -> named_struct('dy', i div (2 * c.r + 1) - c.r, 'dx', i % (2 * c.r + 1) - c.r))".format(box=_BOX)
_ON = f"""o -> o.dy * o.dy + o.dx * o.dx between c.r * c.r - c.r and c.r * c.r + c.r
  and c.cy + o.dy between 0 and {SIDE - 1} and c.cx + o.dx between 0 and {SIDE - 1}"""
# The first entry of an image, then the pixels of its rings.
_RING_MARKS = f"""concat(array(named_struct('spot', -1, 'value', 0)), coalesce(flatten(transform(array({_RINGS}), c -> transform(filter({_PLACED}, {_ON}),
  o -> named_struct('spot', cast((c.cy + o.dy) * {SIDE} + c.cx + o.dx as int), 'value', {RING_MARK})))), array()))"""
# Values from the first entry to the last pixel: each mark's, then zeros up to the next mark.
_LAID_OUT = f"""flatten(transform(m, (e, i) -> concat(array(pmod(e, {MARK})),
  array_repeat(0, coalesce(shiftright(get(m, i + 1), 6), {SIDE * SIDE}) - shiftright(e, 6) - 1))))"""

PIXEL_COLUMNS = f"""image_id, cast({SIDE} as bigint) width, cast({SIDE} as bigint) height, y, x,
  case when ring = 1 then 220 else 150 + (x * 7 + y * 13 + image_id * 3) % 60 - hit end b,
  case when ring = 1 then 220 else 146 + (x * 7 + y * 13 + image_id * 3) % 60 - hit end g,
  case when ring = 1 then 40 + hit else 150 + (x * 7 + y * 13 + image_id * 3) % 60 - (x * y + image_id) % 20 - hit end r,
  ring"""

CELL_BOXES = ",\n".join(f"({_ring(k)[0]}, {_ring(k)[1]}, {_ring(k)[2]})" for k in range(RINGS))

STATE_CASE = """case event_type when 'view' then 'Resting' when 'click' then 'Surveilling'
  when 'purchase' then 'Activated' when 'signup' then 'Resolution' else 'Dystrophic' end"""

BOXES = """select l_suppkey image_id,
  l_orderkey * 8388608 + l_linenumber * 1048576
    + (l_partkey * 31 + cast(floor(l_extendedprice * cast(100 as double) + cast(0.5 as double)) as bigint)) % 1048576 j,
  (l_orderkey * 7 + l_linenumber * 131) % 1800 x, (l_partkey * 13 + l_orderkey * 3) % 1300 y,
  4 + l_partkey % 110 w, 4 + l_orderkey % 90 h,
  cast(floor((4 + l_partkey % 110) * (4 + l_orderkey % 90) * (40 + 10 * (l_linenumber % 6)) / cast(100 as double)) as bigint) area
from lineitem"""

CONTOUR_PTS = """select user_id % 10 image_id, user_id * 8 + event_id % 8 contour_id, event_id seq,
  (event_id * event_id * 31 + event_id * 7 + user_id * 17) % 199 x,
  (event_id * event_id * 17 + event_id * 101 + user_id * 29) % 211 y
from events"""

CELLS = f"""select user_id image_id, event_id cell_id, user_id % 5 dose, {STATE_CASE} state,
  (event_id * event_id * 31 + event_id * 7) % 997 x, (event_id * event_id * 17 + event_id * 101) % 1009 y,
  event_id % 10 cluster_id, ts
from events"""

FILES = """select s_suppkey image_id, concat('img_', cast(s_suppkey as varchar(20)), case cast(s_suppkey % 7 as int)
  when 0 then '.jpg' when 1 then '.JPG' when 2 then '.tif' when 3 then '.TIFF' when 4 then '.png'
  when 5 then '.jpeg' else '.txt' end) name
from supplier"""

# The same views for the SQL engine that checks results; order matters, later ones use earlier ones.
SQL_VIEWS: dict[str, str] = {
    "boxes": BOXES,
    "contour_pts": CONTOUR_PTS,
    "cells": CELLS,
    "files": FILES,
    "hits": f"""select l_suppkey image_id, (l_partkey * 13 + l_orderkey * 3) % {SIDE} y,
  (l_orderkey * 7 + l_linenumber * 131) % {SIDE} x, cast(count(*) % 10 * 3 as bigint) hit
from lineitem group by all""",
    "px": f"""select {PIXEL_COLUMNS} from (
  select g.image_id, g.y, g.x, coalesce(hit, 0) hit, case when {ANY_RING.replace('image_id', 'g.image_id')
    .replace('(x -', '(g.x -').replace('(y -', '(g.y -')} then 1 else 0 end ring
  from (select s_suppkey image_id, ys.v y, xs.v x from supplier
        cross join (select range v from range({SIDE})) ys cross join (select range v from range({SIDE})) xs) g
  left join hits on g.image_id = hits.image_id and g.y = hits.y and g.x = hits.x)""",
    "px_cells": " union all ".join(
        f"""select s_suppkey image_id, s_suppkey * 8 + {k} cell_id,
  greatest(0, cx - r - 1) x, greatest(0, cy - r - 1) y,
  least({SIDE}, cx + r + 2) - greatest(0, cx - r - 1) w, least({SIDE}, cy + r + 2) - greatest(0, cy - r - 1) h,
  cx, cy, r from (select s_suppkey, {', '.join(f'{e.replace("image_id", "s_suppkey")} {n}' for e, n in zip(_ring(k), ('cx', 'cy', 'r')))} from supplier)"""
        for k in range(RINGS)
    ),
}
NEEDS = {"px": ["hits"]}


def with_views(*names: str, recursive: bool = False) -> str:
    """``with a as (...), b as (...)`` for the named views; append more CTEs with a leading comma."""
    wanted = set(names) | {n for name in names for n in NEEDS.get(name, [])}
    body = ",\n".join(f"{n} as materialized ({sql})" for n, sql in SQL_VIEWS.items() if n in wanted)
    return f"with {'recursive ' if recursive else ''}{body}\n"


class Views:
    """Spark DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, **tables: DataFrame) -> DataFrame:
        for name, df in tables.items():
            text = text.replace(f"from {name}", f"from {{{name}}}")
        return self.spark.sql(text, **tables)

    @cached_property
    def boxes(self) -> DataFrame:
        return self._sql(BOXES, lineitem=self.table("lineitem"))

    @cached_property
    def contour_pts(self) -> DataFrame:
        return self._sql(CONTOUR_PTS, events=self.table("events"))

    @cached_property
    def cells(self) -> DataFrame:
        return self._sql(CELLS, events=self.table("events"))

    @cached_property
    def files(self) -> DataFrame:
        return self._sql(FILES, supplier=self.table("supplier"))

    @cached_property
    def px(self) -> DataFrame:
        """One row per pixel: rings drawn per image, darkened where line items fall.

        The pixels of an image lie together (hash partitioned by image_id), a bounded number per task.
        """
        item = F.col
        hits = (
            self.table("lineitem")
            .select(
                item("l_suppkey").alias("image_id"),
                ((item("l_partkey") * 13 + item("l_orderkey") * 3) % SIDE).alias("y"),
                ((item("l_orderkey") * 7 + item("l_linenumber") * 131) % SIDE).alias("x"),
            )
            .groupBy("image_id", "y", "x")
            .agg((F.count(F.lit(1)) % 10 * 3).alias("hit"))
        )
        images = self.table("supplier").select(item("s_suppkey").alias("image_id"))
        # Images and hits meet before images become pixels, so no pixel is shuffled; tasks grow with the images, not with their bytes.
        tasks = tasks_for(self.spark, images.count() * SIDE * SIDE)
        whole = images.selectExpr("image_id", "-1 as spot", "0 as hit")
        marks = hits.where("y >= 0 and x >= 0").selectExpr("image_id", f"cast(y * {SIDE} + x as int) as spot", "cast(hit as int) as hit")
        marked = (
            whole.unionByName(marks)
            .repartition(tasks, "image_id")
            .selectExpr("image_id", f"inline(case when spot < 0 then {_RING_MARKS} else array(named_struct('spot', spot, 'value', hit)) end)")
            .groupBy("image_id", "spot")
            .agg(F.bit_or("value").alias("value"))
        )
        # Only marked pixels are rows until here; each image is then laid out from its sorted list of them, in one pass.
        listed = marked.groupBy("image_id").agg(F.sort_array(F.collect_list(F.expr(f"spot * {MARK} + value"))).alias("m"))
        laid = (
            listed.where("m[0] < 0")  # marks without an image have no first entry
            .selectExpr("image_id", f"posexplode({_LAID_OUT}) as (pos, value)")
            .where("pos > 0")
            .selectExpr("image_id", "cast(pos - 1 as bigint) as spot", "value")
        )
        size = [f"{SIDE}L {n}" for n in ("width", "height")]
        return laid.selectExpr(
            "image_id", f"spot div {SIDE} as y", f"spot % {SIDE} as x",
            f"cast(value % {RING_MARK} as bigint) as hit", f"case when value >= {RING_MARK} then 1 else 0 end ring",
        ).selectExpr(
            "image_id", "y", "x", "hit", "ring", "150 + (x * 7 + y * 13 + image_id * 3) % 60 ground", "(x * y + image_id) % 20 dip",
        ).selectExpr(
            "image_id", *size, "y", "x",
            "case when ring = 1 then 220L else ground - hit end b",
            "case when ring = 1 then 220L else ground - 4 - hit end g",
            "case when ring = 1 then 40L + hit else ground - dip - hit end r",
            "ring",
        )

    @cached_property
    def px_cells(self) -> DataFrame:
        """Boxes of the rings drawn in ``px``."""
        rings = F.array(
            *[
                F.struct(
                    F.lit(k).cast("long").alias("k"),
                    *[F.expr(e).alias(n) for e, n in zip(_ring(k), ("cx", "cy", "r"))],
                )
                for k in range(RINGS)
            ]
        )
        cell = (
            self.table("supplier")
            .select(F.col("s_suppkey").alias("image_id"))
            .select("image_id", F.explode(rings).alias("c"))
            .select("image_id", (F.col("image_id") * 8 + F.col("c.k")).alias("cell_id"), "c.cx", "c.cy", "c.r")
        )
        return cell.selectExpr(
            "image_id",
            "cell_id",
            "greatest(0, cx - r - 1) x",
            "greatest(0, cy - r - 1) y",
            f"least({SIDE}, cx + r + 2) - greatest(0, cx - r - 1) w",
            f"least({SIDE}, cy + r + 2) - greatest(0, cy - r - 1) h",
            "cx",
            "cy",
            "r",
        )

