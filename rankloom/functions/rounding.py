"""Rounding rules, each by its own name: half up, half to even, to a tenth, and snapping before ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """To the next whole number above at .5, for negative numbers too."""
    return F.floor(x + F.lit(0.5))


def half_even(x: Column) -> Column:
    return F.bround(x).cast("long")


def tenth(x: Column) -> Column:
    return F.floor(x * 10 + F.lit(0.5)) / 10


def places(x: Column, n: int) -> Column:
    return F.floor(x * 10.0**n + F.lit(0.5)) / 10.0**n


def snapped(x: Column) -> Column:
    """To nine decimals, so that ties stay ties whichever engine computed a logarithm."""
    return places(x, 9)


def truncated(x: Column) -> Column:
    return x.cast("int")


def log1p(x: Column) -> Column:
    """ln(1 + x) of a count, null as 0."""
    return F.ln(F.lit(1.0) + F.coalesce(x, F.lit(0)))
