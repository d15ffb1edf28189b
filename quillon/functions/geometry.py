"""Column expressions over colours and rectangles of drawn lines and characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_red(r: Column, g: Column, b: Column) -> Column:
    return F.coalesce((r > 0.5) & (g < 0.4) & (b < 0.4), F.lit(False))


def is_blue(r: Column, g: Column, b: Column) -> Column:
    return F.coalesce((b > 0.5) & (r < 0.4) & (g < 0.6), F.lit(False))


def rgb(color: Column) -> tuple[Column, Column, Column]:
    """The parts of an array colour; nulls unless it has three."""
    three = F.when(F.size(color) == 3, color)
    return F.get(three, F.lit(0)), F.get(three, F.lit(1)), F.get(three, F.lit(2))


def unpacked(color: Column) -> tuple[Column, Column, Column]:
    """The parts, from 0 to 1, of a colour packed into an integer."""
    return tuple(F.shiftright(color, k).bitwiseAND(F.lit(255)) / 255.0 for k in (16, 8, 0))


def middle(low: Column, high: Column) -> Column:
    return (low + high) / 2


def intersects(a: str, b: str) -> Column:
    """Whether rectangles (columns a_x0 and so on) share more than an edge."""
    c = lambda side, k: F.col(f"{side}_{k}")
    return (c(a, "x0") < c(b, "x1")) & (c(b, "x0") < c(a, "x1")) & (c(a, "y0") < c(b, "y1")) & (c(b, "y0") < c(a, "y1"))
