"""Neighbour access along one axis as SQL text: windows ordered by x or y with explicit image edges."""

from __future__ import annotations

import math

TILED = "image_id, ty, tx"
AXES = {"x": ("y", "width"), "y": ("x", "height")}


def over(axis: str, scope: str = TILED, frame: str = "") -> str:
    return f"over (partition by {scope}, {AXES[axis][0]} order by {axis}{' ' + frame if frame else ''})"


def at(col: str, axis: str, offset: int, scope: str = TILED) -> str:
    if offset == 0:
        return col
    return f"{'lag' if offset < 0 else 'lead'}({col}, {abs(offset)}) {over(axis, scope)}"


def shifted(col: str, axis: str, d: int, edge: str = "reflect", scope: str = TILED) -> str:
    """Value at distance ``d``; beyond the image: ``reflect`` (edge pixel not repeated), ``replicate``, or a number."""
    if d == 0:
        return col
    k = abs(d)
    sign = 1 if d > 0 else -1
    to_edge = axis if d < 0 else f"{AXES[axis][1]} - 1 - {axis}"
    inside = at(col, axis, d, scope)
    cases = []
    for left in range(k):
        if edge == "reflect":
            value = at(col, axis, sign * (2 * left - k), scope)
        elif edge == "replicate":
            value = at(col, axis, sign * left, scope)
        else:
            value = edge
        cases.append(f"when {to_edge} = {left} then {value}")
    return f"case {' '.join(cases)} else {inside} end"


def weighted(col: str, axis: str, weights: list[int], edge: str = "reflect", scope: str = TILED) -> str:
    half = len(weights) // 2
    terms = [f"{w} * ({shifted(col, axis, i - half, edge, scope)})" for i, w in enumerate(weights) if w]
    return "(" + " + ".join(terms) + ")"


def gaussian_weights(size: int, sigma: float) -> list[int]:
    """8-bit fixed-point kernel: outer weights rounded with carried error, the centre takes the rest of 256."""
    half = size // 2
    raw = [math.exp(-((i - half) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    scale = 256 / sum(raw)
    side, carry = [], 0.0
    for value in raw[:half]:
        exact = value * scale + carry
        side.append(math.floor(exact + 0.5))
        carry = exact - side[-1]
    return [*side, 256 - 2 * sum(side), *reversed(side)]
