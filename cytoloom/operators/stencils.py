"""Neighbourhood filters on halo tiles.

``halo_tiles`` copies each pixel into the tiles whose halo needs it and shuffles once by (image_id, tile).
Every filter after that is a window inside a tile (ordered by x or by y), which that one shuffle already
serves, so a chain of filters costs one exchange and a tile's size bounds every task. ``own_pixels`` drops
the halo. A chain is exact when the halo is at least the sum of its radii.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.functions.color import idiv, saturated
from cytoloom.functions.stencil import TILED, gaussian_weights, over, shifted, weighted
from cytoloom.operators.pixels import add

TILE = 256


def halo_tiles(df: DataFrame, halo: int, tile: int = TILE, together: bool = False) -> DataFrame:
    """Pixels with their tiles and halo copies, shuffled once by tile.

    ``together``: images are no larger than a tile and each lies in one partition (hash partitioned by image_id); that partitioning already
    serves every window inside a tile, so nothing is shuffled.
    """
    def spread(axis: str, size: str) -> str:
        lo = f"greatest(0L, floor(({axis} - {halo}) / {tile}))"
        hi = f"least(floor(({size} - 1) / {tile}), floor(({axis} + {halo}) / {tile}))"
        return f"explode(sequence({lo}, {hi}))"

    tiled = df.selectExpr("*", f"{spread('y', 'height')} as ty").selectExpr("*", f"{spread('x', 'width')} as tx")
    return tiled if together else tiled.repartition("image_id", "ty", "tx")


def own_pixels(df: DataFrame, tile: int = TILE) -> DataFrame:
    return df.where(f"ty = floor(y / {tile}) and tx = floor(x / {tile})").drop("ty", "tx")


def _two_pass(df: DataFrame, first: dict[str, str], second: dict[str, str]) -> DataFrame:
    return add(add(df, **first), **second).drop(*first)


def gaussian_blur(df: DataFrame, col: str, out: str, size: int = 5, sigma: float = 1.0, scope: str = TILED) -> DataFrame:
    w = gaussian_weights(size, sigma)
    return _two_pass(
        df,
        {"_row": weighted(col, "x", w, scope=scope)},
        {out: idiv(f"{weighted('_row', 'y', w, scope=scope)} + 32768", 65536)},
    )


def unsharp(df: DataFrame, col: str, out: str, size: int = 5, sigma: float = 1.0, gain: int = 18) -> DataFrame:
    """gain/10 * v - (gain - 10)/10 * blur(v), rounded and cut to a byte."""
    soft = gaussian_blur(df, col, "_soft", size, sigma)
    return add(soft, **{out: saturated(idiv(f"{gain} * {col} - {gain - 10} * _soft + 5", 10))}).drop("_soft")


def unsharp_two_scale(df: DataFrame, col: str, out: str) -> DataFrame:
    fine = unsharp(df, col, "_fine", 3, 0.8, 22)
    return unsharp(fine, "_fine", out, 7, 1.5, 18).drop("_fine")


# The 13 offsets within distance 2.
DISC = [(dx, dy) for dy in range(-2, 3) for dx in range(-2, 3) if dx * dx + dy * dy <= 4]


def bilateral_terms(sigma_color: float = 35.0, sigma_space: float = 35.0, scope: str = TILED, col: str = "v"):
    """First-pass columns (neighbours along x) and the weighted mean over the disc."""
    sides = {dx: col if dx == 0 else f"_x{'m' if dx < 0 else 'p'}{abs(dx)}" for dx in range(-2, 3)}
    first = {name: shifted(col, "x", dx, scope=scope) for dx, name in sides.items() if dx}
    neighbours = {f"_n{i}": shifted(sides[dx], "y", dy, scope=scope) for i, (dx, dy) in enumerate(DISC)}
    weights = {
        f"_w{i}": f"exp(-((_n{i} - {col}) * (_n{i} - {col})) / cast({2 * sigma_color**2} as double)"
        f" - {dx * dx + dy * dy} / cast({2 * sigma_space**2} as double))"
        for i, (dx, dy) in enumerate(DISC)
    }
    top = " + ".join(f"_w{i} * _n{i}" for i in range(len(DISC)))
    bottom = " + ".join(f"_w{i}" for i in range(len(DISC)))
    return first, neighbours, weights, f"cast(floor(({top}) / ({bottom}) + cast(0.5 as double)) as bigint)"


def bilateral(df: DataFrame, col: str, out: str, sigma_color: float = 35.0, sigma_space: float = 35.0) -> DataFrame:
    first, neighbours, weights, mean = bilateral_terms(sigma_color, sigma_space, col=col)
    wide = add(add(add(df, **first), **neighbours), **weights)
    return add(wide, **{out: mean}).drop(*first, *neighbours, *weights)


def gradients(df: DataFrame, col: str, side: int, centre: int, edge: str = "reflect", scope: str = TILED) -> DataFrame:
    """gx and gy with smoothing (side, centre, side): Scharr is (3, 10), Sobel is (1, 2)."""
    smooth = [side, centre, side]
    return _two_pass(
        df,
        {
            "_dx": f"({shifted(col, 'x', 1, edge, scope)}) - ({shifted(col, 'x', -1, edge, scope)})",
            "_sx": weighted(col, "x", smooth, edge, scope),
        },
        {
            "gx": weighted("_dx", "y", smooth, edge, scope),
            "gy": f"({shifted('_sx', 'y', 1, edge, scope)}) - ({shifted('_sx', 'y', -1, edge, scope)})",
        },
    )


def scharr(df: DataFrame, col: str) -> DataFrame:
    return gradients(df, col, 3, 10)


MAGNITUDE = "sqrt(cast(gx * gx + gy * gy as double))"

# Non-maximum suppression: tangents of 22.5 and 67.5 degrees in 15-bit fixed point (fixed values).
_FLAT = "abs(gy) * 32768 < abs(gx) * 13573"
_STEEP = "abs(gy) * 32768 > abs(gx) * (13573 + 65536)"
THIN = f"""case when {_FLAT} then m > _l and m >= _r
  when {_STEEP} then m > _u and m >= _d
  when (gx < 0) <> (gy < 0) then m > _ur and m > _dl else m > _ul and m > _dr end"""


def canny_candidates(df: DataFrame, col: str, low: str, high: str, scope: str = TILED) -> DataFrame:
    """Thin edge pixels (column edge: 0 none, 1 weak, 2 strong); Sobel with repeated edges, L1 magnitude."""
    grad = add(gradients(df, col, 1, 2, "replicate", scope), m="abs(gx) + abs(gy)")
    rows = add(grad, _l=shifted("m", "x", -1, "0", scope), _r=shifted("m", "x", 1, "0", scope))
    square = add(
        rows,
        _u=shifted("m", "y", -1, "0", scope),
        _d=shifted("m", "y", 1, "0", scope),
        _ul=shifted("_l", "y", -1, "0", scope),
        _ur=shifted("_r", "y", -1, "0", scope),
        _dl=shifted("_l", "y", 1, "0", scope),
        _dr=shifted("_r", "y", 1, "0", scope),
    )
    edge = f"case when m > floor({low}) and ({THIN}) then case when m > floor({high}) then 2 else 1 end else 0 end"
    return add(square, edge=edge).drop("gx", "gy", "m", "_l", "_r", "_u", "_d", "_ul", "_ur", "_dl", "_dr")


def morph_exprs(col: str, shape: str, grow: bool, scope: str = TILED) -> tuple[dict[str, str], str]:
    """Row pass and result of one dilation or erosion; pixels outside the image do not count."""
    pick, both = ("max", "greatest") if grow else ("min", "least")

    def run(c: str, axis: str, k: int) -> str:
        return f"{pick}({c}) {over(axis, scope, f'rows between {k} preceding and {k} following')}"

    if shape == "cross3":  # 3 x 3 ellipse
        return {"_row": run(col, "x", 1)}, f"{both}(_row, {run(col, 'y', 1)})"
    if shape == "ellipse5":  # 5 x 5 ellipse: three full rows and the two tips
        return {"_row": run(col, "x", 2)}, f"{both}({run('_row', 'y', 1)}, {run(col, 'y', 2)})"
    raise ValueError(shape)


MORPH_RADIUS = {"cross3": 1, "ellipse5": 2}


def morph_close(df: DataFrame, col: str, out: str, shape: str = "cross3", times: int = 1) -> DataFrame:
    """``times`` dilations, then ``times`` erosions. Needs a halo of 2 * times * radius."""
    current = add(df, _m=col)
    for grow in [True] * times + [False] * times:
        first, result = morph_exprs("_m", shape, grow)
        current = add(add(current, **first), _next=result).drop("_m", *first).withColumnRenamed("_next", "_m")
    return current.withColumnRenamed("_m", out)


def close_halo(shape: str, times: int = 1) -> int:
    return 2 * times * MORPH_RADIUS[shape]
