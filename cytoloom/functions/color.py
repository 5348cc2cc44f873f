"""Colour and intensity expressions as SQL text over byte channels b, g, r."""

from __future__ import annotations


def idiv(expr: str, by: int) -> str:
    return f"cast(floor(({expr}) / {by}) as bigint)"


def cyan() -> str:
    """Cyan excess (b + g) / 2 - r, cut at 0 and truncated."""
    return idiv("greatest(0, b + g - 2 * r)", 2)


def gray(b: str = "b", g: str = "g", r: str = "r") -> str:
    """Rounded .114 b + .587 g + .299 r in 15-bit fixed point."""
    # The weights times 32768.
    return idiv(f"{b} * 3735 + {g} * 19235 + {r} * 9798 + 16384", 32768)


def saturated(expr: str) -> str:
    return f"greatest(0, least(255, {expr}))"


# 8-bit HSV: value is the largest channel, saturation 0..255, hue in half degrees 0..180. Both ratios use
# 12-bit fixed-point reciprocals so that every engine rounds alike.
HSV_V = "greatest(b, g, r)"
HSV_SPAN = "(greatest(b, g, r) - least(b, g, r))"
HSV_S = (
    f"case when {HSV_V} = 0 then 0 else "
    f"cast(floor(({HSV_SPAN} * floor(1044480 / {HSV_V} + cast(0.5 as double)) + 2048) / 4096) as bigint) end"
)
_ARC = (
    f"case when {HSV_V} = r then g - b when {HSV_V} = g then b - r + 2 * {HSV_SPAN} else r - g + 4 * {HSV_SPAN} end"
)
_HUE = (
    f"case when {HSV_SPAN} = 0 then 0 else "
    f"cast(floor((({_ARC}) * floor(737280 / (6 * {HSV_SPAN}) + cast(0.5 as double)) + 2048) / 4096) as bigint) end"
)
HSV_H = f"((({_HUE}) + 180) % 180)"

# Hue, saturation and value limits of the hand-drawn cyan borders.
CYAN_LOW = (75, 40, 140)
CYAN_HIGH = (115, 255, 255)


def in_cyan_range(h: str = "h", s: str = "s", v: str = "v", low=CYAN_LOW, high=CYAN_HIGH) -> str:
    return " and ".join(f"{c} between {lo} and {hi}" for c, lo, hi in zip((h, s, v), low, high))


def optical_density(channel: str, white: int = 240) -> str:
    return f"-log10(greatest({channel}, 1) / cast({white} as double))"
