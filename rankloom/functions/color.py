"""Scores to colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import half_up

RGB = tuple[int, int, int]
#: The diverging palette from far below to far above the middle.
DIVERGING: tuple[RGB, ...] = ((140, 41, 38), (179, 87, 78), (217, 201, 168), (106, 137, 153), (44, 74, 95))
#: Names of the palette's pigments by least or greatest deviation.
PIGMENTS = (("akane", -4), ("sango", -2), ("kon", 4), ("asagi", 2), ("kinari", 0))
#: Two stops per dimension.
DIMENSIONS: dict[str, tuple[RGB, RGB]] = {
    "transport": ((219, 234, 254), (29, 78, 216)),
    "rent": ((254, 249, 195), (202, 138, 4)),
    "daily_essentials": ((254, 240, 199), (180, 83, 9)),
    "safety": ((204, 251, 241), (15, 118, 110)),
    "food": ((254, 243, 199), (234, 88, 12)),
    "green": ((220, 252, 231), (21, 128, 61)),
    "gym_sports": ((254, 205, 211), (190, 18, 60)),
    "vibe": ((252, 231, 243), (190, 24, 93)),
    "nightlife": ((233, 213, 255), (126, 34, 206)),
    "crowd": ((226, 232, 240), (30, 41, 59)),
}


def unit(t: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def sampled(t: Column, stops: tuple[RGB, ...] = DIVERGING) -> Column:
    """rgb(r, g, b) at t in 0..1 between the stops."""
    n = len(stops) - 1
    place = unit(t) * n
    i = F.least(F.floor(place), F.lit(n - 1)).cast("int")
    channels = []
    for k in range(3):
        a = F.element_at(F.array(*(F.lit(s[k]) for s in stops[:-1])), i + 1)
        b = F.element_at(F.array(*(F.lit(s[k]) for s in stops[1:])), i + 1)
        channels.append(half_up(a + (b - a) * (place - i)).cast("string"))
    return F.concat(F.lit("rgb("), channels[0], F.lit(", "), channels[1], F.lit(", "), channels[2], F.lit(")"))


def on_anchors(score: Column, p5: Column, p50: Column, p95: Column) -> Column:
    """Where a score lies on the palette: the anchors are at 0, a half and 1."""
    return F.when(p5 >= p95, 0.5).when(score <= p5, 0.0).when(score >= p95, 1.0).when(score <= p50, 0.5 * ((score - p5) / (p50 - p5))).otherwise(0.5 + 0.5 * ((score - p50) / (p95 - p50)))


def composite_color(score: Column, p5: Column, p50: Column, p95: Column) -> Column:
    return sampled(on_anchors(score, p5, p50, p95))


def deviation_color(value: Column, median: Column) -> Column:
    return sampled((value - median + 5) / 10)


def dimension_color(score: Column, dimension: str) -> Column:
    return sampled((score - 1) / 9, DIMENSIONS[dimension])


def pigment(deviation: Column) -> Column:
    return F.when(deviation <= -4, "akane").when(deviation <= -2, "sango").when(deviation >= 4, "kon").when(deviation >= 2, "asagi").otherwise("kinari")


def darkened(rgb: Column, factor: float) -> Column:
    part = [half_up(F.regexp_extract(rgb, r"rgb\((\d+), (\d+), (\d+)\)", k).cast("int") * factor).cast("string") for k in (1, 2, 3)]
    return F.concat(F.lit("rgb("), part[0], F.lit(", "), part[1], F.lit(", "), part[2], F.lit(")"))
