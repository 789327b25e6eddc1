"""Queries on the other formulas for ratings, and on a small table that is given in the code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import variants
from ..sources.tables import table
from ..streaming import incremental
from . import standins
from .standins import EVENT_TYPES, PLACES_SQL, RATINGS_SQL

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: The types of events that stand for the kinds of crime, one after the other.
KINDS = {kind: EVENT_TYPES[i % len(EVENT_TYPES)] for i, kind in enumerate(variants.CRIME_WEIGHTS)}
CRIMES_SQL = " + ".join(f"coalesce({KINDS[kind]}, 0) * {w}::double" for kind, w in variants.CRIME_WEIGHTS.items())


@query("q_log_safety", f"""with {PLACES_SQL}, c as (select k, 0.0::double + {CRIMES_SQL} as crimes, 4000 + k % 9000 as pop, 20000 + k % 7 * 15000 as day, 30000::double as night, coalesce(error, 0) % 3 as boxes, coalesce(view, 0) % 8 as shops from places),
    p as (select *, case when day / night > 2.0 then day * (pop / night) when day / night > 1.5 then pop * (1 + day / night) / 2 else pop * 1.0::double end as people from c),
    r as (select *, greatest(1.0::double, least(10.0::double, 10 - (ln(1 + crimes / people * 10000) - 1.5) * (9 / 5.0::double))) as raw from p)
    select k, floor(crimes * 10 + 0.5) / 10 as crimes, greatest(1.0::double, least(10.0::double, round_even((raw + case when boxes >= 1 then 0.2 else 0.0 end::double + case when shops >= 5 then 0.15 when shops = 0 then -0.1 else 0.0 end::double) * 10, 0) / 10)) as safety from r""")
def log_safety(spark: SparkSession, sf: str) -> DataFrame:
    p = standins.places(spark, sf)
    crimes = variants.weighted_crimes({kind: F.col(t) for kind, t in KINDS.items()})
    people = variants.present(4_000 + F.col("k") % 9_000, 20_000 + F.col("k") % 7 * 15_000, F.lit(30_000.0))
    score = variants.log_safety(F.col("crimes"), people, F.coalesce("error", F.lit(0)) % 3, F.coalesce("view", F.lit(0)) % 8)
    return p.withColumn("crimes", crimes).select("k", (F.floor(F.col("crimes") * 10 + 0.5) / 10).alias("crimes"), score.alias("safety"))


@query("q_crowd_factors", f"""with {PLACES_SQL}, m as (select {", ".join(f"ln(1 + max(coalesce({t}, 0))) as m_{t}" for t in ("click", "view", "error", "signup"))} from places)
    select k, (10 - round_even((ln(1 + coalesce(click, 0)) / m_click * 0.45::double + ln(1 + coalesce(view, 0)) / m_view * 0.25::double + ln(1 + coalesce(error, 0)) / m_error * 0.20::double + ln(1 + coalesce(signup, 0)) / m_signup * 0.10::double) * 9, 0))::int as crowd from places, m""")
def crowd_factors(spark: SparkSession, sf: str) -> DataFrame:
    return variants.crowd_factors(standins.places(spark, sf).select("k", *EVENT_TYPES), "click", "view", "error", "signup", "crowd").select("k", "crowd")


NIGHT = {"midnight": "click", "izakaya": "view", "bar": "purchase", "mapped": "error", "karaoke": "signup", "club": "error", "hostel": "signup"}
_NIGHT_SQL = " + ".join(f"log2(coalesce({NIGHT[n]}, 0) + 1) * {w}::double" for n, w in variants.NIGHTLIFE_WEIGHTS.items())
_BUCKETS_SQL = " ".join(f"when (rank() over (order by s) - 1) / (count(*) over ())::double >= {limit} then {value}" for limit, value in reversed(variants.NIGHTLIFE_BUCKETS))


@query("q_nightlife_buckets", f"with {PLACES_SQL}, n as (select k, floor(({_NIGHT_SQL}) * 1e6 + 0.5) / 1e6 as s from places), r as (select k, case {_BUCKETS_SQL} end as nightlife from n where s > 0) select k, coalesce(nightlife, 1)::int as nightlife from n left join r using (k)")
def nightlife_buckets(spark: SparkSession, sf: str) -> DataFrame:
    score = F.floor(variants.nightlife_score({n: F.col(t) for n, t in NIGHT.items()}) * 1e6 + 0.5) / 1e6
    return variants.bucketed(standins.places(spark, sf).select("k", score.alias("s")), "s", "nightlife").select("k", "nightlife")


@query("q_text_hints", f"""with {RATINGS_SQL}, h as (select *, k * 977 % 190000 as pax, (1290 + k * 7 % 250) % 1440 as t from ratings), g as (select *, case when t < 180 then t + 1440 else t end as late from h)
    select k, array_to_string(list_filter([case when transport >= 7 and crowd <= 4 then 'Major hub, always busy' end, case when rent <= 4 and vibe >= 7 then 'Upscale residential, calm streets' end, case when rent >= 7 and food >= 7 then 'Budget-friendly with great eats' end,
        case when green >= 7 and crowd >= 7 then 'Peaceful green suburb' end, case when nightlife >= 7 and safety <= 4 then 'Lively but watch your belongings late at night' end, case when elevation_m < 5 then 'flood risk zone' end, case when seismic_tier = 'very_high' then 'soft ground / reclaimed land' end,
        case when lines >= 5 then 'Major junction with ' || lines || ' lines' end, case when pax > 100000 then 'One of the busiest stations' end, case when pax < 5000 then 'Quiet local station' end, case when late < 1380 then 'Trains stop early — plan your night' end, case when late > 1470 then 'Good late-night connectivity' end], lambda x: x is not null), '; ') as hints from g""")
def text_hints(spark: SparkSession, sf: str) -> DataFrame:
    r = standins.ratings(spark, sf)
    ratings = {c: F.col(c) for c in ("transport", "crowd", "rent", "vibe", "food", "green", "nightlife", "safety")}
    found = variants.hints(ratings, F.col("elevation_m"), F.col("seismic_tier"), F.col("lines"), F.col("k") * 977 % 190_000, (1_290 + F.col("k") * 7 % 250) % 1_440)
    return r.select("k", F.array_join(found, "; ").alias("hints"))


#: Passengers a day of places for which nobody else has a figure.
GIVEN = [(1, 775_000, "east"), (4, 558_000, "east"), (9, 462_000, "metro"), (16, 421_000, "east"), (25, 387_000, "east"), (36, 28_000, "metro"), (1_000_000, 15_000, "metro")]


@query("q_given_passengers", f"""with g(k, daily, source) as (values {", ".join(map(str, GIVEN))}), have as (select o_custkey as k, count(*) * 1000 as daily, 'counted' as source from orders where o_custkey % 4 = 0 group by 1)
    select * from have union all select k, daily, source from g where k not in (select k from have)""")
def given_passengers(spark: SparkSession, sf: str) -> DataFrame:
    """A table given in the code, added to what there is where that has no row of the key."""
    have = table(spark, sf, "orders").where("o_custkey % 4 = 0").groupBy(F.col("o_custkey").alias("k")).agg((F.count("*") * 1_000).alias("daily")).withColumn("source", F.lit("counted"))
    given = spark.createDataFrame(GIVEN, "k long, daily long, source string")
    return have.unionByName(incremental.remaining(given, have, "k"))
