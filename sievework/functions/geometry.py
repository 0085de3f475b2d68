"""Column expressions for crops and placements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import names

#: Fixed value: the output's side.
SIDE = 320


def half(x: Column) -> Column:
    """The half of a whole number, rounded down."""
    return F.shiftright(x.cast("long"), 1)


def crop_box(w: Column, h: Column) -> list[Column]:
    """The largest centred square: x0, y0, x1, y1."""
    side = F.least(w, h)
    x, y = half(w - side), half(h - side)
    return [x.alias("x0"), y.alias("y0"), (x + side).alias("x1"), (y + side).alias("y1")]


def jitter(seed: int, key: Column, axis: str, most: int) -> Column:
    """A whole number from -most to most that the seed, the key and the axis determine."""
    digits = F.substring(names.seeded_key(seed, key, F.lit(axis)), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % (2 * most + 1) - most


def placed(extent: Column, shift: Column, side: int = SIDE) -> Column:
    """The first coordinate of something centred and then shifted, kept within the side."""
    room = F.lit(side).cast("long") - extent
    return F.greatest(F.lit(0).cast("long"), F.least(room, half(room) + shift))
