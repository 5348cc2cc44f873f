"""Registered neighbourhood, histogram and morphology queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoloom.catalog.registry import query
from cytoloom.functions import color as C
from cytoloom.functions import stencil as K
from cytoloom.operators import histograms as H
from cytoloom.operators import pixels as P
from cytoloom.operators import stencils as N
from cytoloom.sources.views import with_views

ONE = "image_id"
BASE = with_views("px") + f", s0 as materialized (select image_id, width, height, y, x, ring, {C.cyan()} v, {C.gray()} gray from px)\n"


def cte(name: str, source: str, **cols: str) -> str:
    return f", {name} as materialized (select *, {', '.join(f'{e} {n}' for n, e in cols.items())} from {source})\n"


def blur_sql(source: str, out: str, col: str, size: int, sigma: float) -> str:
    w = K.gaussian_weights(size, sigma)
    return cte(f"{out}_r", source, **{f"{out}_row": K.weighted(col, "x", w, scope=ONE)}) + cte(
        f"{out}_t", f"{out}_r", **{out: C.idiv(f"{K.weighted(f'{out}_row', 'y', w, scope=ONE)} + 32768", 65536)}
    )


def unsharp_sql(source: str, out: str, col: str, size: int = 5, sigma: float = 1.0, gain: int = 18) -> str:
    mixed = C.saturated(C.idiv(f"{gain} * {col} - {gain - 10} * soft_{out} + 5", 10))
    return blur_sql(source, f"soft_{out}", col, size, sigma) + cte(out, f"soft_{out}_t", **{f"{out}_v": mixed})


def grad_sql(source: str, col: str, side: int, centre: int, edge: str = "reflect", name: str = "grad") -> str:
    w = [side, centre, side]
    return cte(
        f"{name}_r",
        source,
        dx_=f"({K.shifted(col, 'x', 1, edge, ONE)}) - ({K.shifted(col, 'x', -1, edge, ONE)})",
        sx_=K.weighted(col, "x", w, edge, ONE),
    ) + cte(
        name,
        f"{name}_r",
        gx=K.weighted("dx_", "y", w, edge, ONE),
        gy=f"({K.shifted('sx_', 'y', 1, edge, ONE)}) - ({K.shifted('sx_', 'y', -1, edge, ONE)})",
    )


def close_sql(source: str, col: str, out: str, shape: str, times: int = 1) -> str:
    text, current, c = "", source, col
    for i, grow in enumerate([True] * times + [False] * times):
        first, result = N.morph_exprs(c, shape, grow, ONE)
        text += cte(f"{out}_{i}r", current, **{f"row_{out}_{i}": first["_row"]})
        text += cte(f"{out}_{i}", f"{out}_{i}r", **{f"m_{out}_{i}": result.replace("_row", f"row_{out}_{i}")})
        current, c = f"{out}_{i}", f"m_{out}_{i}"
    return text + f", {out} as materialized (select *, {c} {out}_v from {current})\n"


def show(source: str, *cols: str) -> str:
    return f"select image_id, y, x, {', '.join(cols)} from {source}"


def start(v):
    return P.add(v.px, v=C.cyan(), gray=C.gray()).drop("b", "g", "r")


def finish(df, *cols):
    return N.own_pixels(df).select("image_id", "y", "x", *cols)


@query(
    "gaussian_blur",
    BASE + blur_sql("s0", "b5", "gray", 5, 1.0) + blur_sql("b5_t", "b3", "gray", 3, 0.8) + blur_sql("b3_t", "b7", "gray", 7, 1.5)
    + show("b7_t", "b5", "b3", "b7"),
)
def _blur(v):
    t = N.halo_tiles(start(v), 3, together=True)
    for out, size, sigma in (("b5", 5, 1.0), ("b3", 3, 0.8), ("b7", 7, 1.5)):
        t = N.gaussian_blur(t, "gray", out, size, sigma)
    return finish(t, "b5", "b3", "b7")


@query("unsharp", BASE + unsharp_sql("s0", "u", "gray") + show("u", "u_v v"))
def _unsharp(v):
    return finish(N.unsharp(N.halo_tiles(start(v).drop("v"), 2, together=True), "gray", "v"), "v")


@query(
    "unsharp_two_scale",
    BASE + unsharp_sql("s0", "fine", "gray", 3, 0.8, 22) + unsharp_sql("fine", "mid", "fine_v", 7, 1.5, 18) + show("mid", "mid_v v"),
)
def _two_scale(v):
    return finish(N.unsharp_two_scale(N.halo_tiles(start(v).drop("v"), 4, together=True), "gray", "v"), "v")


def bilateral_sql(source: str, col: str = "v") -> str:
    first, neighbours, weights, mean = N.bilateral_terms(scope=ONE, col=col)
    return (
        cte("bil_a", source, **first) + cte("bil_b", "bil_a", **neighbours) + cte("bil_c", "bil_b", **weights)
        + f", bil as materialized (select image_id, width, height, y, x, {mean} bil_v from bil_c)\n"
    )


@query("bilateral", BASE + bilateral_sql("s0", "gray") + show("bil", "bil_v v"))
def _bilateral(v):
    return finish(N.bilateral(N.halo_tiles(start(v).drop("v"), 2, together=True), "gray", "v"), "v")


@query("scharr", BASE + grad_sql("s0", "gray", 3, 10) + show("grad", "gx", "gy"))
def _scharr(v):
    return finish(N.scharr(N.halo_tiles(start(v), 1, together=True), "gray"), "gx", "gy")


@query("gradient_magnitude", BASE + grad_sql("s0", "gray", 3, 10) + show("grad", f"round({N.MAGNITUDE}, 6) mag"))
def _magnitude(v):
    return finish(P.add(N.scharr(N.halo_tiles(start(v), 1, together=True), "gray"), mag=f"round({N.MAGNITUDE}, 6)"), "mag")


NORM_SQL = """, {out} as materialized (select * exclude (top_), case when top_ > 0 then cast(floor({col} / top_ * 255) as bigint) else 0 end {out}_v
  from (select *, max({col}) over (partition by image_id) top_ from {src}))\n"""


@query(
    "masked_gradient",
    BASE + grad_sql("s0", "gray", 3, 10) + cte("mag", "grad", mag=N.MAGNITUDE) + NORM_SQL.format(out="norm", col="mag", src="mag")
    + show("norm", "case when v > 35 then norm_v else 0 end g"),
)
def _masked(v):
    own = N.own_pixels(P.add(N.scharr(N.halo_tiles(start(v), 1, together=True), "gray"), mag=N.MAGNITUDE))
    norm = P.max_normalize(own, "mag", "norm")
    return P.add(norm, g="case when v > 35 then norm else 0 end").select("image_id", "y", "x", "g")


# ---- histograms ------------------------------------------------------------------------------------------

OTSU_SQL = """, {o}_h as (select image_id, {col} t, count(*) c from {src} group by all)
, {o}_s as (select *, cast(sum(c) over w as double) n0, cast(sum(c * t) over w as double) s0, cast(sum(c) over (partition by image_id) as double) n,
  cast(sum(c * t) over (partition by image_id) as double) s from {o}_h window w as (partition by image_id order by t))
, {o} as materialized (select image_id, t otsu from {o}_s
  qualify row_number() over (partition by image_id order by {var} desc, t) = 1)\n"""


def otsu_sql(src: str, col: str, name: str = "ot") -> str:
    return OTSU_SQL.format(o=name, src=src, col=col, var=H.OTSU_VARIANCE)


@query("otsu", BASE + otsu_sql("s0", "v") + "select image_id, otsu from ot")
def _otsu(v):
    return H.otsu(start(v), "v")


@query(
    "calibrated_threshold",
    BASE + otsu_sql("s0", "v") + f"select image_id, y, x, case when v > greatest(20, {H.CALIBRATED}) then 255 else 0 end mask from s0 join ot using (image_id)",
)
def _calibrated(v):
    s = start(v)
    return H.calibrated_mask(s, "v", "mask", H.otsu(s, "v")).select("image_id", "y", "x", "mask")


def clahe_sql(src: str, col: str, out: str, clip: float, grid: int = 8) -> str:
    """Dense 256-bin tables per tile; sizes need not divide by the grid: the image is mirrored to fit."""
    n = out
    return f""", {n}_z as (select *, cast(ceil(width / {grid}) as bigint) tw, cast(ceil(height / {grid}) as bigint) th from {src})
, {n}_xs as (select *, x px_ from {n}_z union all select *, 2 * (width - 1) - x from {n}_z where 2 * (width - 1) - x >= width and 2 * (width - 1) - x < {grid} * tw)
, {n}_ys as (select *, y py_ from {n}_xs union all select *, 2 * (height - 1) - y from {n}_xs where 2 * (height - 1) - y >= height and 2 * (height - 1) - y < {grid} * th)
, {n}_h as (select image_id, py_ // th ty, px_ // tw tx, {col} bin, count(*) c, any_value(tw * th) size from {n}_ys group by all)
, {n}_t as (select image_id, ty, tx, any_value(size) size, greatest(1, cast(floor({clip} * any_value(size) / 256) as bigint)) cap from {n}_h group by all)
, {n}_e as (select t.*, (select sum(greatest(0, h.c - t.cap)) from {n}_h h where h.image_id = t.image_id and h.ty = t.ty and h.tx = t.tx) excess from {n}_t t)
, {n}_d as (select e.*, i.range bin, least(coalesce(h.c, 0), cap) + excess // 256 +
   case when excess % 256 > 0 and i.range % greatest(256 // (excess % 256), 1) = 0 and i.range // greatest(256 // (excess % 256), 1) < excess % 256
   then 1 else 0 end c from {n}_e e cross join range(256) i left join {n}_h h on h.image_id = e.image_id and h.ty = e.ty and h.tx = e.tx and h.bin = i.range)
, {n}_l as materialized (select image_id, ty, tx, bin, least(255, round_even(sum(c) over (partition by image_id, ty, tx order by bin) * 255 / size, 0)) lut from {n}_d)
, {n}_p as (select *, y / th - cast(0.5 as double) fy, x / tw - cast(0.5 as double) fx from {n}_z)
, {n} as materialized (select p.* exclude (tw, th, fx, fy), cast(round_even((a.lut * (1 - (fx - floor(fx))) + b.lut * (fx - floor(fx))) * (1 - (fy - floor(fy)))
   + (c.lut * (1 - (fx - floor(fx))) + d.lut * (fx - floor(fx))) * (fy - floor(fy)), 0) as bigint) {out}_v from {n}_p p
 join {n}_l a on a.image_id = p.image_id and a.bin = p.{col} and a.ty = greatest(0, floor(fy)) and a.tx = greatest(0, floor(fx))
 join {n}_l b on b.image_id = p.image_id and b.bin = p.{col} and b.ty = greatest(0, floor(fy)) and b.tx = least({grid - 1}, floor(fx) + 1)
 join {n}_l c on c.image_id = p.image_id and c.bin = p.{col} and c.ty = least({grid - 1}, floor(fy) + 1) and c.tx = greatest(0, floor(fx))
 join {n}_l d on d.image_id = p.image_id and d.bin = p.{col} and d.ty = least({grid - 1}, floor(fy) + 1) and d.tx = least({grid - 1}, floor(fx) + 1))\n"""


@query("clahe", BASE + clahe_sql("s0", "gray", "cl", 3.5) + show("cl", "cl_v v"))
def _clahe(v):
    return H.clahe(start(v), "gray", "out", 3.5).selectExpr("image_id", "y", "x", "out as v")


@query(
    "clahe_scharr_fusion",
    BASE + clahe_sql("s0", "gray", "cl", 3.0) + grad_sql("cl", "cl_v", 3, 10) + cte("mag", "grad", mag=N.MAGNITUDE)
    + NORM_SQL.format(out="norm", col="mag", src="mag")
    + show("norm", "greatest(0, least(255, cast(round_even((7 * cl_v + 3 * norm_v) / 10, 0) as bigint))) v"),
)
def _clahe_scharr(v):
    lifted = H.clahe(start(v), "gray", "cl", 3.0)
    own = N.own_pixels(P.add(N.scharr(N.halo_tiles(lifted, 1, together=True), "cl"), mag=N.MAGNITUDE))
    norm = P.max_normalize(own, "mag", "norm").drop("v")
    return P.add(norm, v=C.saturated("cast(rint((7 * cl + 3 * norm) / 10) as bigint)")).select("image_id", "y", "x", "v")


# ---- morphology --------------------------------------------------------------------------------------------

MASKED = BASE + cte("m0", "s0", mask="case when v > 35 then 255 else 0 end")


@query(
    "morph_close",
    MASKED + close_sql("m0", "mask", "c3", "cross3") + close_sql("c3", "mask", "c5", "ellipse5") + close_sql("c5", "mask", "c5x3", "ellipse5", 3)
    + show("c5x3", "c3_v c3", "c5_v c5", "c5x3_v c5x3"),
)
def _close(v):
    t = N.halo_tiles(P.add(start(v), mask="case when v > 35 then 255 else 0 end"), N.close_halo("ellipse5", 3), together=True)
    t = N.morph_close(t, "mask", "c3", "cross3")
    t = N.morph_close(t, "mask", "c5", "ellipse5")
    return finish(N.morph_close(t, "mask", "c5x3", "ellipse5", 3), "c3", "c5", "c5x3")
