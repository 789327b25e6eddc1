"""The driver's tables read as places with signals: one mapping for all queries, in DataFrames and in SQL.

Places are customers, areas nations, prefectures regions, hubs the first five suppliers. Counts come from events by
type and user; the measured rent is a user's mean event value, so most places have none. Coordinates are a fixed
function of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, rating
from ..functions.rounding import snapped
from ..operators.normalize import percentile_ratings
from ..sources.tables import table
from .spec import CATEGORIES

EVENT_TYPES = ("view", "purchase", "click", "error", "signup")
#: The reference point for distances.
CENTER_LAT, CENTER_LNG = 35.6812, 139.7671


def lat(key: Column) -> Column:
    return 35.5 + (key % 97) * 0.005


def lng(key: Column) -> Column:
    return 139.4 + (key % 89) * 0.007


def activity(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, a count per event type, and cents and rows for the measured rent."""
    events = table(spark, sf, "events")
    counts = [F.count_if(F.col("event_type") == t).alias(t) for t in EVENT_TYPES]
    return events.groupBy("user_id").agg(*counts, F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.count("*").alias("n_events"))


def places(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("area"), F.col("c_mktsegment").alias("segment"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("area"), F.col("n_name").alias("area_name"), F.col("n_regionkey").alias("pref"))
    base = c.join(F.broadcast(n), "area").withColumns({"lat": lat(F.col("k")), "lng": lng(F.col("k")), "lines": (1 + F.col("k") % 6).cast("int")})
    joined = base.join(activity(spark, sf), F.col("k") == F.col("user_id"), "left")
    measured = F.when(F.col("n_events") > 0, F.floor(60000 + 25.0 * F.col("cents") / F.col("n_events")).cast("int"))
    return joined.withColumns({"rent_1k": measured, "elevation_m": F.when(F.col("k") % 7 != 0, (F.col("k") % 40) * 1.0), "prob_i60": F.when(F.col("k") % 5 != 0, (F.col("k") % 31) / 100.0), "has_camera": F.col("k") % 3 == 0, "km": geo.haversine_km(F.col("lat"), F.col("lng"), F.lit(CENTER_LAT), F.lit(CENTER_LNG))})


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """k and a signal per category, snapped; with the values that caps look at."""
    p = places(spark, sf)
    v, b, c, e, s = (F.col(t) for t in EVENT_TYPES)
    pax = rating.known(c) * 1000
    found = F.col("user_id").isNotNull()
    out = {
        "s_food": rating.food(v, b),
        "s_nightlife": rating.nightlife(c, v, b, e, s, s, e),
        "s_transport": rating.transport(F.col("lines"), pax),
        "s_safety": rating.safety(c * 1.0, e * 60, F.lit(None).cast("double"), F.when(F.col("pref") == 0, 120.0).when(F.col("pref") == 1, 65.0).when(F.col("pref") == 2, 60.0).when(F.col("pref") == 3, 55.0).otherwise(80.0), F.col("km")),
        "s_green": rating.green(rating.known(c) * 500, e),
        "s_gym_sports": rating.gym(F.when(F.col("k") % 2 == 0, s), rating.known(v) + rating.known(b)),
        "s_vibe": rating.vibe(F.when(F.col("k") % 3 == 0, s), F.when(F.col("k") % 3 == 0, e), v, b, e),
        "s_crowd": rating.crowd(pax, v, F.col("lines")),
        "s_daily_essentials": rating.essentials(found, v, b, rating.known(c) + rating.known(v), e, s, b, rating.known(c) + rating.known(e), F.col("k") % 4),
    }
    return p.withColumns({k: snapped(x) for k, x in out.items()})


#: Signal, whether low is good, caps' key and the value they look at.
RATED = {
    "food": (False, "coalesce(view, 0) + coalesce(purchase, 0)"),
    "nightlife": (False, "coalesce(click, 0)"),
    "transport": (False, "lines"),
    "safety": (True, None),
    "green": (False, "coalesce(error, 0)"),
    "gym_sports": (False, "coalesce(signup, 0)"),
    "vibe": (False, "coalesce(signup, 0)"),
    "crowd": (True, None),
    "daily_essentials": (False, None),
}


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Places with ten ratings: percentiles of the signals, prices to affordability, then caps."""
    df = percentile_ratings(signals(spark, sf), "k", {c: (f"s_{c}", invert) for c, (invert, _) in RATED.items()})
    df = df.withColumn("rent", F.coalesce(rating.affordability_batch(F.col("rent_1k")), F.lit(5)).cast("int"))
    capped = {c: rating.capped(F.col(c), F.expr(raw), rating.CAPS[c]) for c, (_, raw) in RATED.items() if raw}
    capped["rent"] = rating.capped(F.col("rent"), F.when(F.col("rent_1k").isNotNull(), 2).otherwise(0), rating.CAPS["rent"])
    out = df.withColumns(capped)
    minutes = geo.crude_minutes(F.col("km")).cast("int")
    return out.select("k", "name", "area", "area_name", "pref", "segment", "lat", "lng", "km", "lines", *CATEGORIES, "rent_1k", F.lit(None).cast("int").alias("rent_2ldk"), F.when(F.col("k") % 11 != 0, minutes).alias("min_transit"), "elevation_m", rating.seismic_tier(F.col("prob_i60")).alias("seismic_tier"), "has_camera")


# --- the same in SQL ------------------------------------------------------------------------------------------------

KM_SQL = "2 * 6371.0 * asin(sqrt(least(power(sin(radians({b_lat} - {a_lat}) / 2), 2) + cos(radians({a_lat})) * cos(radians({b_lat})) * power(sin(radians({b_lng} - {a_lng}) / 2), 2), 1.0)))"


def km_sql(a_lat: str, a_lng: str, b_lat: str, b_lng: str) -> str:
    return KM_SQL.format(a_lat=a_lat, a_lng=a_lng, b_lat=b_lat, b_lng=b_lng)


PLACES_SQL = f"""
act as (select user_id, {", ".join(f"count(*) filter (event_type = '{t}') as {t}" for t in EVENT_TYPES)}, sum(cast(round(value * 100) as bigint)) as cents, count(*) as n_events from events group by user_id),
places as (select c_custkey as k, c_name as name, c_nationkey as area, n_name as area_name, n_regionkey as pref, c_mktsegment as segment, 35.5::double + (c_custkey % 97) * 0.005::double as lat,
    139.4::double + (c_custkey % 89) * 0.007::double as lng, (1 + c_custkey % 6)::int as lines, act.*, case when n_events > 0 then floor(60000 + 25.0::double * cents / n_events)::int end as rent_1k,
    case when c_custkey % 7 <> 0 then (c_custkey % 40) * 1.0::double end as elevation_m, case when c_custkey % 5 <> 0 then (c_custkey % 31) / 100.0::double end as prob_i60, c_custkey % 3 = 0 as has_camera,
    {km_sql("(35.5::double + (c_custkey % 97) * 0.005::double)", "(139.4::double + (c_custkey % 89) * 0.007::double)", "35.6812::double", "139.7671::double")} as km
    from customer join nation on c_nationkey = n_nationkey left join act on c_custkey = user_id)"""


def _snap(x: str) -> str:
    return f"floor(({x}) * 1e9 + 0.5) / 1e9"


def _ln(x: str) -> str:
    return f"ln(1.0::double + coalesce({x}, 0))"


#: Fixed values in the SQL from here on: weights and limits of the rating formulas, as in functions/rating.py.
SIGNALS_SQL = f"""{PLACES_SQL},
signals as (select *,
    {_snap(f"{_ln('view')} * 0.6::double + {_ln('purchase')} * 0.4::double")} as s_food,
    {_snap(f"{_ln('click')} * 0.25::double + {_ln('view')} * 0.20::double + {_ln('coalesce(purchase, 0) * 3')} * 0.15::double + {_ln('error')} * 0.15::double + {_ln('coalesce(signup, 0) * 10')} * 0.10::double + {_ln('coalesce(signup, 0) * 5')} * 0.08::double + {_ln('coalesce(error, 0) * 10')} * 0.07::double")} as s_nightlife,
    {_snap(f"lines * 2 + {_ln('coalesce(click, 0) * 1000')} * 0.5::double")} as s_transport,
    {_snap("case when click is not null then case when error * 60 >= 500 then click * 1.0::double / (error * 60) * 10000 when error * 60 > 0 then click * 1.0::double / 5000 * 10000 else click * 0.1::double end else (case pref when 0 then 120.0 when 1 then 65.0 when 2 then 60.0 when 3 then 55.0 else 80.0 end)::double * (1 - least(0.15::double, km * 0.005::double)) end")} as s_safety,
    {_snap(f"case when coalesce(click, 0) * 500 > 0 then {_ln('click * 500')} * 0.55::double + coalesce(error, 0) * 0.25::double else coalesce(error, 0) * 1.0::double end")} as s_green,
    {_snap(f"case when k % 2 = 0 and coalesce(signup, 0) > 0 then signup * 1.0::double else least(0.5::double, {_ln('coalesce(view, 0) + coalesce(purchase, 0)')} / 20.0::double) end")} as s_gym_sports,
    {_snap(f"case when k % 3 = 0 and (coalesce(signup, 0) > 0 or coalesce(error, 0) > 0) then {_ln('signup')} * 0.60::double + {_ln('error')} * 0.15::double + {_ln('view')} * 0.15::double + least(coalesce(signup, 0), 20) / 20.0::double * 0.10::double else {_ln('view')} * 0.4::double + {_ln('purchase')} * 0.3::double + {_ln('error')} * 0.3::double end")} as s_vibe,
    {_snap("case when coalesce(click, 0) > 0 then click * 1000 else coalesce(view, 0) * 300 + lines * 10000 end * 1.0::double")} as s_crowd,
    {_snap(f"case when user_id is not null then {_ln('view')} * 0.25::double + {_ln('purchase')} * 0.15::double + {_ln('click + view')} * 0.20::double + {_ln('error')} * 0.10::double + {_ln('signup')} * 0.10::double + {_ln('purchase')} * 0.05::double + {_ln('click + error')} * 0.15::double else {_ln('k % 4')} * 0.5::double end")} as s_daily_essentials
    from places)"""


def percentile_sql(value: str, source: str, invert: bool = False) -> str:
    """The rating of a value among all of source's, as a scalar over windows."""
    share = f"((rank() over (order by {value}) - 1) + (count(*) over (partition by {value}) - 1) / 2.0::double) / greatest(count(*) over () - 1, 1)"
    share = f"(1 - {share})" if invert else share
    return f"greatest(1, least(10, round_even({share} * 9 + 1, 0)))::int"


def caps_sql(value: str, raw: str, caps: tuple[tuple[int, int], ...]) -> str:
    tests = " ".join(f"when coalesce({raw}, 0) < {need} then {level - 1}" for level, need in sorted(caps))
    return f"least(coalesce({value}, 5), case {tests} else 10 end)"


AFFORD_SQL = "(10 - 9 * greatest(0.0::double, least(1.0::double, (rent_1k - 80000) / 220000.0::double)))"
RATINGS_SQL = f"""{SIGNALS_SQL},
rated as (select *, {", ".join(f"{percentile_sql(f's_{c}', 'signals', inv)} as r_{c}" for c, (inv, _) in RATED.items())}, coalesce(case when rent_1k > 0 then round_even({AFFORD_SQL}, 0) end, 5)::int as r_rent from signals),
ratings as (select k, name, area, area_name, pref, segment, lat, lng, km, lines, {", ".join(f"{caps_sql(f'r_{c}', raw, rating.CAPS[c]) if raw else f'r_{c}'} as {c}" for c, (_, raw) in RATED.items())},
    {caps_sql("r_rent", "case when rent_1k is not null then 2 else 0 end", rating.CAPS["rent"])} as rent, rent_1k, null::int as rent_2ldk, case when k % 11 <> 0 then greatest(3, floor(km * 3 + 0.5))::int end as min_transit, elevation_m,
    case when prob_i60 is null then 'unknown' when prob_i60 >= 0.26 then 'very_high' when prob_i60 >= 0.06 then 'high' when prob_i60 >= 0.03 then 'moderate' else 'low' end as seismic_tier, has_camera from rated)"""


def score_sql(weights: dict[str, float]) -> str:
    used = {k: w for k, w in weights.items() if w > 0}
    if not used:
        return "0.0::double"
    return f"floor(({' + '.join(f'{k} * {float(w)}::double' for k, w in used.items())}) / {float(sum(used.values()))}::double * 10 + 0.5::double) / 10"
