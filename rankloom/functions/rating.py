"""The rating formulas: signals from counts, price to affordability, caps, weighted scores, tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import half_even, half_up, log1p, tenth

#: Prices at which affordability is 10 and 1.
RENT_FLOOR, RENT_CEILING = 80_000, 300_000
#: To rate so high, the raw value must reach so much.
CAPS = {
    "food": ((8, 100), (9, 400), (10, 1000)),
    "nightlife": ((8, 20), (9, 100), (10, 300)),
    "transport": ((8, 2), (9, 3), (10, 5)),
    "green": ((8, 25), (9, 50), (10, 80)),
    "gym_sports": ((8, 7), (9, 12), (10, 20)),
    "vibe": ((8, 8), (9, 20), (10, 50)),
    "rent": ((9, 1), (10, 2)),
}


def known(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def weighted_logs(*terms: tuple[Column, float]) -> Column:
    """The sum of weight * ln(1 + count)."""
    first, *rest = (log1p(c) * w for c, w in terms)
    for t in rest:
        first = first + t
    return first


def food(total: Column, mapped: Column) -> Column:
    return weighted_logs((total, 0.6), (mapped, 0.4))


def nightlife(midnight: Column, izakaya: Column, bar: Column, mapped: Column, club: Column, karaoke: Column, hostel: Column) -> Column:
    return weighted_logs((midnight, 0.25), (izakaya, 0.20), (known(bar) * 3, 0.15), (mapped, 0.15), (known(club) * 10, 0.10), (known(karaoke) * 5, 0.08), (known(hostel) * 10, 0.07))


def transport(lines: Column, passengers: Column) -> Column:
    return lines * 2 + log1p(passengers) * 0.5


def safety(weighted: Column, population: Column, ward_rate: Column, base: Column, km: Column) -> Column:
    """Crimes per 10,000: own score by population, its proxy where few or none live there, the ward's rate, or the prefecture's less up to 15 % with distance."""
    pop = known(population)
    own = F.when(pop >= 500, weighted / pop * 10000).when(pop > 0, weighted / 5000 * 10000).otherwise(weighted * 0.1)
    return F.when(weighted.isNotNull(), own).otherwise(F.coalesce(ward_rate, base * (1 - F.least(F.lit(0.15), km * 0.005))))


def green(area: Column, count: Column) -> Column:
    return F.when(known(area) > 0, log1p(area) * 0.55 + known(count) * 0.25).otherwise(known(count) * 1.0)


def gym(count: Column, activity: Column) -> Column:
    return F.when(known(count) > 0, count * 1.0).otherwise(F.least(F.lit(0.5), log1p(activity) / 20.0))


def vibe(cultural: Column, streets: Column, cafes: Column, shops: Column, parks: Column) -> Column:
    rich = weighted_logs((cultural, 0.60), (streets, 0.15), (cafes, 0.15)) + F.least(known(cultural), F.lit(20)) / 20.0 * 0.10
    plain = weighted_logs((cafes, 0.4), (shops, 0.3), (parks, 0.3))
    return F.when((known(cultural) > 0) | (known(streets) > 0), rich).otherwise(plain)


def crowd(passengers: Column, restaurants: Column, lines: Column) -> Column:
    return F.when(known(passengers) > 0, passengers).otherwise(known(restaurants) * 300 + lines * 10000) * 1.0


def essentials(found: Column, supermarket: Column, pharmacy: Column, clinics: Column, bank: Column, laundry: Column, post: Column, schools: Column, convenience: Column) -> Column:
    """`found`: whether the place is in the table of daily needs at all; else convenience stores stand for it."""
    own = weighted_logs((supermarket, 0.25), (pharmacy, 0.15), (clinics, 0.20), (bank, 0.10), (laundry, 0.10), (post, 0.05), (schools, 0.15))
    return F.when(found, own).otherwise(log1p(convenience) * 0.5)


def _affordability(rent: Column) -> Column:
    return 10 - 9 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rent - RENT_FLOOR) / float(RENT_CEILING - RENT_FLOOR)))


def affordability_batch(rent: Column) -> Column:
    """Half to even; null and what isn't above 0 have none."""
    return F.when(rent > 0, half_even(_affordability(rent)))


def affordability_live(rent: Column) -> Column:
    """Half up; only null has none."""
    return F.when(rent.isNotNull(), half_up(_affordability(rent)))


def capped(rating: Column, raw: Column, caps: tuple[tuple[int, int], ...]) -> Column:
    """The rating, lowered to one below the first level whose requirement the raw value misses; never raised. Missing: rating 5, raw 0."""
    most = F.lit(10)
    for level, required in sorted(caps, reverse=True):
        most = F.when(known(raw) < required, level - 1).otherwise(most)
    return F.least(F.coalesce(rating, F.lit(5)).cast("int"), most)


def weighted_score(ratings: dict[str, Column], weights: dict[str, float]) -> Column:
    """The weighted mean over weights above 0, to one decimal; 0 where there are none."""
    used = {k: w for k, w in weights.items() if w > 0}
    if not used:
        return F.lit(0.0)
    total = None
    for k, w in used.items():
        total = ratings[k] * float(w) if total is None else total + ratings[k] * float(w)
    return tenth(total / float(sum(used.values())))


def plain_composite(ratings: list[Column]) -> Column:
    """The unweighted mean with 5 for what is missing, to one decimal; 0 where all are."""
    total, any_known = F.lit(0.0), F.lit(False)
    for r in ratings:
        total, any_known = total + F.coalesce(r, F.lit(5)), any_known | r.isNotNull()
    return F.when(any_known, tenth(total / len(ratings))).otherwise(0.0)


def seismic_tier(p: Column) -> Column:
    return F.when(p.isNull(), "unknown").when(p >= 0.26, "very_high").when(p >= 0.06, "high").when(p >= 0.03, "moderate").otherwise("low")


def elevation_tier(m: Column) -> Column:
    return F.when(m.isNull(), "unknown").when(m < 5, "very_low").when(m < 10, "low").when(m < 30, "moderate").when(m < 100, "elevated").when(m < 300, "high").otherwise("mountain")


def per_10k(crimes: Column, population: Column) -> Column:
    return F.when(known(population) > 0, tenth(crimes / population * 10000)).otherwise(0.0)


def band_rating(km: Column, steps: tuple[tuple[float, int], ...], beyond: int) -> Column:
    """Rating by distance bands: the first step whose limit km is below."""
    out = F.lit(beyond)
    for limit, value in sorted(steps, reverse=True):
        out = F.when(km < limit, value).otherwise(out)
    return out


def confidence(*known_sources: Column, strong: int = 2) -> Column:
    """strong with enough sources, moderate with some, else estimate."""
    n = F.size(F.array_compact(F.array(*known_sources)))
    return F.when(n >= strong, "strong").when(n > 0, "moderate").otherwise("estimate")


def sources(**tests: Column) -> Column:
    """The names of the sources whose test holds, in order."""
    return F.array_compact(F.array(*(F.when(t, name) for name, t in tests.items())))


def clamped(v: Column, low: int = 1, high: int = 10) -> Column:
    """Into the range, then half up."""
    return F.floor(F.greatest(F.lit(low), F.least(F.lit(high), v)) + 0.5)


def _by_km(km: Column, steps: list[tuple[float, Column | int]], beyond: Column | int) -> Column:
    out = beyond if isinstance(beyond, Column) else F.lit(beyond)
    for limit, value in reversed(steps):
        out = F.when(km < limit, value).otherwise(out)
    return clamped(out)


def heuristic(km: Column, lines: Column, rent: Column) -> dict[str, Column]:
    """Ratings of a place about which nothing but distance, lines and perhaps the rent is known. The bands."""
    few = lambda n: F.least(lines, F.lit(n))
    fewer = lambda n: F.least(lines - 1, F.lit(n))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rent - 70_000) / 230_000.0))
    return {
        "transport": clamped(F.when(lines >= 5, 9).when(lines >= 3, 7).when(lines >= 2, 6).when(lines >= 1, 4).otherwise(3)),
        "food": _by_km(km, [(5, 7 + few(3)), (10, 5 + few(2)), (20, 4 + few(1))], 3),
        "nightlife": _by_km(km, [(3, 6 + few(3)), (7, 4 + few(2)), (15, 3 + few(1))], 2),
        "safety": _by_km(km, [(3, 6), (7, 7)], 8),
        "green": _by_km(km, [(3, 3), (7, 4), (15, 6)], 7),
        "rent": F.when(rent.isNotNull(), F.floor(10 - 9 * share + 0.5)).otherwise(_by_km(km, [(5, 3), (10, 5), (20, 7)], 8)),
        "gym_sports": _by_km(km, [(15, 5)], 4),
        "vibe": _by_km(km, [(3, 6 + fewer(2)), (7, 5 + fewer(1)), (15, 5)], 4),
        "crowd": _by_km(km, [(3, 3), (7, 5), (15, 7)], 8),
    }


def heuristic_rent(km: Column) -> Column:
    return F.when(km < 5, 130_000).when(km < 10, 95_000).when(km < 20, 75_000).otherwise(65_000)


def elevation_hint(m: Column) -> Column:
    return F.when(m.isNull(), "moderate").when(m < 0, "belowSea").when(m < 5, "veryLow").when(m < 20, "low").otherwise("moderate")


def seismic_hint(tier: Column) -> Column:
    return F.when(tier == "very_high", "veryHigh").when(tier.isin("high", "moderate"), tier).otherwise("low")


def marker(score: Column, rent_unknown: Column, selected: Column, hovered: Column, compared: Column, grown: float = 1.4) -> dict[str, Column]:
    """How a place is drawn: radius, stroke, weight and opacities. All of these."""
    lit_up, unknown = selected | hovered, F.coalesce(rent_unknown, F.lit(False))
    base = F.when(score.isNotNull(), 6 + score * 0.5).otherwise(5.0)
    return {
        "radius": F.when(lit_up, base * grown).otherwise(base),
        "stroke": F.when(selected, "#1d4ed8").when(hovered, "#2563eb").when(compared, "#7c3aed").otherwise("#374151"),
        "weight": F.when(selected, 3.5).when(hovered, 2.5).when(compared, 3.0).when(unknown, 0.5).otherwise(1.0),
        "opacity": F.when(unknown & ~lit_up & ~compared, 0.3).otherwise(0.9),
        "fill_opacity": F.when(lit_up, 1.0).when(unknown, 0.35).otherwise(0.85),
    }
