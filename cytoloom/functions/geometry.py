"""Box arithmetic as column expressions. A box is x, y, w, h; ``p`` and ``q`` are column prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_area(p: str = "") -> Column:
    return F.expr(f"({p}w * {p}h)")


def _inter(p: str, q: str) -> str:
    side = "greatest(0L, least({p}{a} + {p}{s}, {q}{a} + {q}{s}) - greatest({p}{a}, {q}{a}))"
    return "(" + " * ".join(side.format(p=p, q=q, a=a, s=s) for a, s in (("x", "w"), ("y", "h"))) + ")"


def intersection_area(p: str = "a_", q: str = "b_") -> Column:
    return F.expr(_inter(p, q))


def gap(p: str, q: str, pos: str, size: str) -> Column:
    """Empty pixels between two boxes on one axis, 0 when they meet."""
    return F.expr(f"greatest(0L, greatest({p}{pos}, {q}{pos}) - least({p}{pos} + {p}{size}, {q}{pos} + {q}{size}))")


def iou_above(p: str, q: str, limit: float) -> Column:
    i = _inter(p, q)
    return F.expr(f"{i} > {limit!r}D * ({p}w * {p}h + {q}w * {q}h - {i})")


def padded(pad: int, width, height) -> dict[str, Column]:
    """Corners x1, y1, x2, y2 of the box grown by ``pad`` and cut at the image frame."""
    zero = F.lit(0).cast("long")
    return {
        "x1": F.greatest(zero, F.col("x") - pad),
        "y1": F.greatest(zero, F.col("y") - pad),
        "x2": F.least(_as_col(width), F.col("x") + F.col("w") + pad),
        "y2": F.least(_as_col(height), F.col("y") + F.col("h") + pad),
    }


def touches_border(width, height, margin: int = 4) -> Column:
    return (
        (F.col("x") <= margin)
        | (F.col("y") <= margin)
        | (F.col("x") + F.col("w") >= _as_col(width) - margin)
        | (F.col("y") + F.col("h") >= _as_col(height) - margin)
    )


def passes_gate(width, height, min_area: int = 80) -> Column:
    """Large enough, and not a wrapper of the whole image."""
    w, h = _as_col(width), _as_col(height)
    wraps = (F.col("w") > 0.85 * w) & (F.col("h") > 0.85 * h)
    return (F.col("area") >= min_area) & ~((F.col("area") > 0.70 * w * h) | wraps)


def _as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else F.lit(value).cast("long")
