"""Queries on signals, ratings, scores and the ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, rating
from ..functions.rounding import places as to_places
from ..operators import normalize, ranking
from ..sources.stages import kept
from . import standins
from .spec import CATEGORIES, DEFAULT_WEIGHTS, PRESETS, Filters
from .standins import RATINGS_SQL, SIGNALS_SQL, score_sql

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


SIGNAL_COLUMNS = [f"s_{c}" for c in standins.RATED]


def rounded_sql(c: str, n: int = 6) -> str:
    return f"floor({c} * 1e{n} + 0.5) / 1e{n} as {c}"


@query("q_signal_scores", f"with {SIGNALS_SQL} select k, {', '.join(rounded_sql(c) for c in SIGNAL_COLUMNS)} from signals")
def signal_scores(spark: SparkSession, sf: str) -> DataFrame:
    return standins.signals(spark, sf).select("k", *(to_places(F.col(c), 6).alias(c) for c in SIGNAL_COLUMNS))


@query("q_percentile_rating", f"with {SIGNALS_SQL} select k, {standins.percentile_sql('s_food', 'signals')} as rating from signals")
def percentile_rating(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.percentile_rating(standins.signals(spark, sf), "s_food", "rating").select("k", "rating")


@query("q_percentile_rating_inverted", f"with {SIGNALS_SQL} select k, {standins.percentile_sql('s_crowd', 'signals', True)} as rating from signals")
def percentile_rating_inverted(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.percentile_rating(standins.signals(spark, sf), "s_crowd", "rating", invert=True).select("k", "rating")


@query("q_absolute_caps", f"with {RATINGS_SQL} select k, {', '.join(CATEGORIES)} from ratings")
def absolute_caps(spark: SparkSession, sf: str) -> DataFrame:
    return standins.ratings(spark, sf).select("k", *CATEGORIES)


@query("q_weighted_score", f"with {RATINGS_SQL} select k, {score_sql(DEFAULT_WEIGHTS)} as score from ratings")
def weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.scored(standins.ratings(spark, sf), DEFAULT_WEIGHTS).select("k", "score")


@query("q_preset_family", f"with {RATINGS_SQL} select k, {score_sql(PRESETS['family'][0])} as score from ratings where (min_transit is null or min_transit <= 40) and safety >= 7")
def preset_family(spark: SparkSession, sf: str) -> DataFrame:
    weights, changes = PRESETS["family"]
    return ranking.dealbreakers(ranking.scored(standins.ratings(spark, sf), weights), Filters(**changes)).select("k", "score")


BREAKERS = Filters(max_rent=190_000, min_rent=90_000, max_commute=55, minimums={"food": 3}, camera=False)
BREAKERS_SQL = "(rent_1k is null or (rent_1k <= 190000 and rent_1k >= 90000)) and (min_transit is null or min_transit <= 55) and (food is null or food >= 3) and (elevation_m is null or elevation_m >= 5) and seismic_tier is distinct from 'very_high'"


@query("q_dealbreakers", f"with {RATINGS_SQL} select k, rent_1k is null as rent_unknown from ratings where {BREAKERS_SQL}")
def dealbreakers(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.dealbreakers(standins.ratings(spark, sf), BREAKERS, hide_flood=True, hide_seismic=True).select("k", "rent_unknown")


@query("q_camera_required", f"with {RATINGS_SQL} select k from ratings where has_camera")
def camera_required(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.dealbreakers(standins.ratings(spark, sf), Filters(camera=True)).select("k")


@query("q_filter_ranked", f"with {RATINGS_SQL}, s as (select *, {score_sql(DEFAULT_WEIGHTS)} as score from ratings) select k, score from s where score >= 5 and (rent_1k is null or rent_1k = 0 or rent_1k <= 185000) and (min_transit is null or (min_transit > 0 and min_transit <= 60))")
def filter_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.filter_ranked(standins.ratings(spark, sf), DEFAULT_WEIGHTS, "k", min_score=5, max_rent=185_000, max_commute=60, hubs=["min_transit"]).select("k", "score")


@query("q_topk_ranked", f"with {RATINGS_SQL}, s as (select k, {score_sql(DEFAULT_WEIGHTS)} as score from ratings) select k, score, (row_number() over (order by score desc, k))::int as place from s qualify place <= 15")
def topk_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top(ranking.scored(standins.ratings(spark, sf), DEFAULT_WEIGHTS).select("k", "score"), 15, F.desc("score"), "k")


@query("q_top5_bottom5", f"with {RATINGS_SQL}, s as (select k, {score_sql(DEFAULT_WEIGHTS)} as score from ratings) (select 'top' as side, k, score from s order by score desc, k limit 5) union all (select 'bottom', k, score from s order by score, k limit 5)")
def top5_bottom5(spark: SparkSession, sf: str) -> DataFrame:
    s = ranking.scored(standins.ratings(spark, sf), DEFAULT_WEIGHTS).select("k", "score")
    side = lambda name, order: s.orderBy(order, "k").limit(5).select(F.lit(name).alias("side"), "k", "score")
    return side("top", F.desc("score")).unionByName(side("bottom", F.asc("score")))


ANCHORS_SQL = f"""{RATINGS_SQL}, s as (select k, {score_sql(DEFAULT_WEIGHTS)} as score from ratings),
o as (select score, row_number() over (order by score) - 1 as pos, count(*) over () as n from s),
a as (select max(score) filter (pos = least(n - 1, floor(n * 0.05::double))) as p5, max(score) filter (pos = least(n - 1, floor(n * 0.5::double))) as p50, max(score) filter (pos = least(n - 1, floor(n * 0.95::double))) as p95 from o)"""
EMPTY = {"p5": 1.0, "p50": 5.5, "p95": 10.0}
SHARES = {"p5": 0.05, "p50": 0.5, "p95": 0.95}


@query("q_anchors", f"with {ANCHORS_SQL} select p5, p50, p95 from a")
def anchors(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.at_share(ranking.scored(standins.ratings(spark, sf), DEFAULT_WEIGHTS), "score", SHARES, EMPTY)


def _channel_sql(t: str, stops: tuple, i: int) -> str:
    lo, hi = (", ".join(str(s[i]) for s in stops[:-1])), (", ".join(str(s[i]) for s in stops[1:]))
    n = len(stops) - 1
    seg = f"least(floor({t} * {n}), {n - 1})"
    a, b = f"([{lo}])[({seg})::int + 1]", f"([{hi}])[({seg})::int + 1]"
    return f"floor({a} + ({b} - {a}) * ({t} * {n} - {seg}) + 0.5)::int"


def rgb_sql(t: str, stops: tuple) -> str:
    return "'rgb(' || " + " || ', ' || ".join(_channel_sql(t, stops, i) for i in range(3)) + " || ')'"


@query("q_composite_color", f"with {ANCHORS_SQL}, t as (select k, case when p5 >= p95 then 0.5 when score <= p5 then 0 when score >= p95 then 1 when score <= p50 then 0.5 * ((score - p5) / (p50 - p5)) else 0.5 + 0.5 * ((score - p50) / (p95 - p50)) end::double as t from s, a) select k, {rgb_sql('t', color.DIVERGING)} as color from t")
def composite_color(spark: SparkSession, sf: str) -> DataFrame:
    s = kept(ranking.scored(standins.ratings(spark, sf), DEFAULT_WEIGHTS).select("k", "score"), "scores")
    a = normalize.at_share(s, "score", SHARES, EMPTY)
    return s.crossJoin(F.broadcast(a)).select("k", color.composite_color(F.col("score"), F.col("p5"), F.col("p50"), F.col("p95")).alias("color"))


@query("q_dimension_color", f"with {RATINGS_SQL}, t as (select k, greatest(0, least(1, (food - 1) / 9.0::double)) as t from ratings) select k, {rgb_sql('t', color.DIMENSIONS['food'])} as color from t")
def dimension_color(spark: SparkSession, sf: str) -> DataFrame:
    return standins.ratings(spark, sf).select("k", color.dimension_color(F.col("food"), "food").alias("color"))


@query("q_city_medians", f"with {RATINGS_SQL}, u as (unpivot (select {', '.join(CATEGORIES)} from ratings) on {', '.join(CATEGORIES)} into name category value rating) select category, (floor(median(rating) + 0.5))::bigint as median from u group by category")
def city_medians(spark: SparkSession, sf: str) -> DataFrame:
    long = standins.ratings(spark, sf).unpivot(["k"], list(CATEGORIES), "category", "rating")
    return long.groupBy("category").agg(F.floor(F.median("rating") + 0.5).alias("median"))


@query("q_deviation_pigment", f"with {RATINGS_SQL}, m as (select floor(median(food) + 0.5) as m from ratings) select k, case when food - m <= -4 then 'akane' when food - m <= -2 then 'sango' when food - m >= 4 then 'kon' when food - m >= 2 then 'asagi' else 'kinari' end as pigment, {rgb_sql('greatest(0, least(1, (food - m + 5) / 10.0::double))', color.DIVERGING)} as color from ratings, m")
def deviation_pigment(spark: SparkSession, sf: str) -> DataFrame:
    r = standins.ratings(spark, sf).select("k", "food")
    m = r.agg(F.floor(F.median("food") + 0.5).alias("m"))
    return r.crossJoin(F.broadcast(m)).select("k", color.pigment(F.col("food") - F.col("m")).alias("pigment"), color.deviation_color(F.col("food"), F.col("m")).alias("color"))


@query("q_affordability_js", f"with {SIGNALS_SQL} select k, case when rent_1k is not null then floor({standins.AFFORD_SQL} + 0.5)::bigint end as rating from places")
def affordability_js(spark: SparkSession, sf: str) -> DataFrame:
    return standins.places(spark, sf).select("k", rating.affordability_live(F.col("rent_1k")).alias("rating"))


@query("q_affordability_py", f"with {SIGNALS_SQL} select k, case when rent_1k > 0 then round_even({standins.AFFORD_SQL}, 0)::bigint end as rating from places")
def affordability_py(spark: SparkSession, sf: str) -> DataFrame:
    return standins.places(spark, sf).select("k", rating.affordability_batch(F.col("rent_1k")).alias("rating"))


@query("q_safety_bands", f"with {SIGNALS_SQL} select k, {rounded_sql('s_safety')} from signals")
def safety_bands(spark: SparkSession, sf: str) -> DataFrame:
    return standins.signals(spark, sf).select("k", to_places(F.col("s_safety"), 6).alias("s_safety"))


@query("q_vibe_fallback", f"with {SIGNALS_SQL} select k, {rounded_sql('s_vibe')}, k % 3 = 0 and (coalesce(signup, 0) > 0 or coalesce(error, 0) > 0) as rich from signals")
def vibe_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rich = (F.col("k") % 3 == 0) & ((rating.known(F.col("signup")) > 0) | (rating.known(F.col("error")) > 0))
    return standins.signals(spark, sf).select("k", to_places(F.col("s_vibe"), 6).alias("s_vibe"), rich.alias("rich"))


@query("q_tiers", f"with {RATINGS_SQL} select k, seismic_tier, case when elevation_m is null then 'unknown' when elevation_m < 5 then 'very_low' when elevation_m < 10 then 'low' when elevation_m < 30 then 'moderate' when elevation_m < 100 then 'elevated' when elevation_m < 300 then 'high' else 'mountain' end as elevation_tier from ratings")
def tiers(spark: SparkSession, sf: str) -> DataFrame:
    p = standins.places(spark, sf)
    return p.select("k", rating.seismic_tier(F.col("prob_i60")).alias("seismic_tier"), rating.elevation_tier(F.col("elevation_m")).alias("elevation_tier"))


@query("q_confidence_counts", """with act as (select user_id, count(*) filter (event_type = 'view') as v, count(*) filter (event_type = 'purchase') as p, count(*) filter (event_type = 'error') as e from events group by 1),
    c as (select case when coalesce(v, 0) > 15 and coalesce(p, 0) > 10 then 'strong' when coalesce(v, 0) > 15 or coalesce(p, 0) > 10 then 'moderate' else 'estimate' end as level from customer left join act on c_custkey = user_id)
    select level, count(*) as n from c group by level""")
def confidence_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = standins.places(spark, sf)
    named = rating.sources(view=rating.known(F.col("view")) > 15, purchase=rating.known(F.col("purchase")) > 10)
    level = F.when(F.size(named) >= 2, "strong").when(F.size(named) == 1, "moderate").otherwise("estimate")
    return p.select(level.alias("level")).groupBy("level").agg(F.count("*").alias("n"))


@query("q_rating_histogram", f"with {RATINGS_SQL}, u as (unpivot (select {', '.join(CATEGORIES)} from ratings) on {', '.join(CATEGORIES)} into name category value rating) select category, rating, count(*) as n from u group by all")
def rating_histogram(spark: SparkSession, sf: str) -> DataFrame:
    long = standins.ratings(spark, sf).unpivot(["k"], list(CATEGORIES), "category", "rating")
    return long.groupBy("category", "rating").agg(F.count("*").alias("n"))


@query("q_plain_composite", f"with {RATINGS_SQL} select k, floor(({' + '.join(c for c in CATEGORIES if c != 'daily_essentials')}) / 9.0::double * 10 + 0.5) / 10 as composite from ratings")
def plain_composite(spark: SparkSession, sf: str) -> DataFrame:
    return standins.ratings(spark, sf).select("k", rating.plain_composite([F.col(c) for c in CATEGORIES if c != "daily_essentials"]).alias("composite"))


@query("q_compare_pivot", f"with {RATINGS_SQL}, u as (unpivot (select k, {', '.join(CATEGORIES)} from ratings where k in (3, 1, 2)) on {', '.join(CATEGORIES)} into name category value rating) select category, max(rating) filter (k = 3) as p1, max(rating) filter (k = 1) as p2, max(rating) filter (k = 2) as p3, max(rating) as best from u group by category")
def compare_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.compare(standins.ratings(spark, sf), [3, 1, 2], "k", list(CATEGORIES))


@query("q_scatter", f"with {RATINGS_SQL} select k, rent_1k as x, food as y from ratings where rent_1k is not null and food is not null")
def scatter(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.scatter(standins.ratings(spark, sf), "rent_1k", "food", "k")


@query("q_search", "select c_custkey as k, c_name as name from customer where lower(c_name) like '%000012%' order by c_custkey limit 8")
def search(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.search(standins.places(spark, sf).select("k", "name"), "000012", ["name"], [], ["k"])


@query("q_min_positive", f"with {SIGNALS_SQL} select k, list_min(list_filter([view, purchase, click], lambda x: x > 0)) as best from places")
def min_positive(spark: SparkSession, sf: str) -> DataFrame:
    return standins.places(spark, sf).select("k", ranking.min_positive([F.col("view"), F.col("purchase"), F.col("click")]).alias("best"))
