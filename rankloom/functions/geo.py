"""Distances, areas, tiles and travel times as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import half_even, half_up

EARTH_KM = 6371.0
#: Fixed value: metres of a degree.
DEGREE_M = 111_000


def _half_chord(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    return F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(_half_chord(lat1, lng1, lat2, lng2), F.lit(1.0))))


def haversine_km_atan(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = _half_chord(lat1, lng1, lat2, lng2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return haversine_km(lat1, lng1, lat2, lng2) * 1000


def degrees_apart(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lng1 - lng2, 2))


@dataclass(frozen=True)
class Travel:
    """The model's fixed defaults: detour, speeds in km/h below 5, 15 and 35 km and beyond, minutes a transfer, least minutes."""

    circuity: float = 1.30
    speed_close: float = 25.0
    speed_mid: float = 32.0
    speed_far: float = 38.0
    speed_express: float = 48.0
    transfer_penalty: float = 8.0
    min_time: int = 3


def travel_minutes(km: Column, transfers: Column, circuity: Column, close: Column, mid: Column, far: Column, express: Column, penalty: Column, least: int = 3) -> Column:
    speed = F.when(km < 5, close).when(km < 15, mid).when(km < 35, far).otherwise(express)
    return F.greatest(F.lit(least).cast("long"), half_even(km * circuity / speed * 60 + transfers * penalty))


def default_travel_minutes(km: Column, transfers: Column, p: Travel = Travel()) -> Column:
    return travel_minutes(km, transfers, *(F.lit(v) for v in (p.circuity, p.speed_close, p.speed_mid, p.speed_far, p.speed_express, p.transfer_penalty)), least=p.min_time)


def crude_minutes(km: Column) -> Column:
    return F.greatest(F.lit(3), half_up(km * 3))


def bbox_area(min_lat: Column, min_lng: Column, max_lat: Column, max_lng: Column, shrink: Column | None = None) -> Column:
    """Square metres; longitudes are shrunk by the given factor, or by the cosine of the middle latitude."""
    factor = F.cos(F.radians((max_lat + min_lat) / 2)) if shrink is None else shrink
    return F.abs(max_lat - min_lat) * DEGREE_M * (F.abs(max_lng - min_lng) * DEGREE_M * factor)


def ring_area(ring: Column) -> Column:
    """Square metres inside a ring of (lat, lon) by the shoelace formula; 0 with fewer than three points."""
    flat = F.transform(ring, lambda p: F.struct((p["lon"] * DEGREE_M * F.cos(F.radians(p["lat"]))).alias("x"), (p["lat"] * DEGREE_M).alias("y")))
    turned = F.concat(F.slice(flat, 2, F.greatest(F.size(flat) - 1, F.lit(0))), F.slice(flat, 1, 1))
    cross = F.zip_with(flat, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(ring) >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2).otherwise(0.0)


def inside_edges(lat: Column, lng: Column, edges: Column) -> Column:
    """Whether an odd number of edges (from a to b, of lat and lon) are to a point's east."""
    east = lambda a, b: ((a["lat"] > lat) != (b["lat"] > lat)) & (lng < (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"])
    return F.size(F.filter(edges, lambda e: east(e["a"], e["b"]))) % 2 == 1


def inside_ring(lat: Column, lng: Column, ring: Column) -> Column:
    """Whether a point is inside a ring of (lat, lon): an odd number of edges to its east."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return inside_edges(lat, lng, F.zip_with(ring, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def tile_x(lng: Column, zoom: int = 14) -> Column:
    return F.floor((lng + 180) / 360 * 2.0**zoom)


def tile_y(lat: Column, zoom: int = 14) -> Column:
    r = F.radians(lat)
    return F.floor((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / F.pi()) / 2 * 2.0**zoom)
