"""Ratings by the other formulas that are described for them: crimes by weight, log-linear safety, crowds from four factors, nightlife in buckets, hints for a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rating import known
from ..functions.rounding import half_even
from ..sources.stages import kept
from .normalize import counted, level, levels

#: How much a crime of each kind counts.
CRIME_WEIGHTS = {
    "felony": 3.0,
    "violent": 2.0,
    "burglary": 2.0,
    "bag_snatching": 2.0,
    "pickpocketing": 1.5,
    "bicycle_theft": 0.3,
    "theft_from_cars": 0.5,
    "car_theft": 0.5,
    "motorcycle_theft": 0.5,
    "shoplifting": 0.8,
    "unattended_luggage": 0.8,
    "other_theft": 0.5,
    "fraud": 0.2,
    "other_intellectual": 0.1,
    "gambling": 0.0,
    "other": 0.3,
}
#: Weights of the four parts of a crowd.
CROWD_WEIGHTS = {"passengers": 0.45, "commercial": 0.25, "tourist": 0.20, "congestion": 0.10}
#: Weights of the nightlife counts, and the ratings from each percentile of those above 0 on.
NIGHTLIFE_WEIGHTS = {"midnight": 0.30, "izakaya": 0.15, "bar": 0.10, "mapped": 0.20, "karaoke": 0.10, "club": 0.10, "hostel": 0.05}
NIGHTLIFE_BUCKETS = ((0.0, 2), (0.20, 3), (0.40, 4), (0.55, 5), (0.70, 6), (0.80, 7), (0.88, 8), (0.94, 9), (0.98, 10))
#: What counts as high and low where hints speak of it.
HIGH, LOW = 7, 4


def weighted_crimes(counts: dict[str, Column]) -> Column:
    """The sum of counts by kind, each by its weight; missing ones are 0."""
    total = F.lit(0.0)
    for kind, weight in CRIME_WEIGHTS.items():
        total = total + known(counts.get(kind, F.lit(0))) * weight
    return total


def present(population: Column, by_day: Column, by_night: Column) -> Column:
    """How many people there are: residents, or in wards with far more people by day than by night these as well."""
    factor = by_day / F.nullif(by_night, F.lit(0))
    return F.when(factor > 2.0, by_day * (population / by_night)).when(factor > 1.5, population * (1 + factor) / 2).otherwise(population * 1.0)


def log_safety(crimes: Column, people: Column, police_boxes: Column, shops: Column) -> Column:
    """1 to 10, one decimal: crimes per 10,000 on a log scale, more with a police box near, more with many shops and less with none."""
    rate = F.when(known(people) > 0, crimes / people * 10_000).otherwise(0.0)
    within = lambda v: F.greatest(F.lit(1.0), F.least(F.lit(10.0), v))
    raw = within(10 - (F.log1p(rate) - 1.5) * (9 / 5.0))
    police = F.when(known(police_boxes) >= 1, 0.2).otherwise(0.0)
    shop = F.when(known(shops) >= 5, 0.15).when(known(shops) == 0, -0.1).otherwise(0.0)
    return within(half_even((raw + police + shop) * 10) / 10)


def crowd_factors(df: DataFrame, passengers: str, commercial: str, tourist: str, congestion: str, out: str) -> DataFrame:
    """df with out, 1 (most crowded) to 10: the four counts on a log scale, each as a share of the greatest there is. df is computed once."""
    rows, names = kept(df, "crowd-rows"), dict(zip(CROWD_WEIGHTS, (passengers, commercial, tourist, congestion)))
    most = rows.agg(*(F.log1p(F.max(known(F.col(c)))).alias(f"_{n}") for n, c in names.items()))
    share = lambda n, c: F.coalesce(F.log1p(known(F.col(c))) / F.nullif(F.col(f"_{n}"), F.lit(0.0)), F.lit(0.0))
    total = None
    for n, c in names.items():
        part = share(n, c) * CROWD_WEIGHTS[n]
        total = part if total is None else total + part
    both = rows.crossJoin(F.broadcast(most))  # one row
    return both.withColumn(out, (10 - half_even(total * 9)).cast("int")).drop(*(f"_{n}" for n in names))


def nightlife_score(counts: dict[str, Column]) -> Column:
    total = None
    for name, weight in NIGHTLIFE_WEIGHTS.items():
        part = F.log2(known(counts.get(name, F.lit(0))) + 1) * weight
        total = part if total is None else total + part
    return total


def bucketed(df: DataFrame, score: str, out: str) -> DataFrame:
    """df with out: 1 where the score is 0 or missing, else the rating of the bucket that its percentile is in: the share of scores above 0 that are smaller. df is computed once."""
    rows = kept(df, "bucket-rows")
    share = F.col("before") / F.col("total")
    rating = F.lit(NIGHTLIFE_BUCKETS[0][1])
    for limit, value in NIGHTLIFE_BUCKETS[1:]:
        rating = F.when(share >= limit, value).otherwise(rating)
    rated = counted(rows.where(F.col(score) > 0), score).select(F.lit("score").alias("name"), "v", rating.alias("rating"))
    found = F.coalesce(level("score", F.col(score)), F.lit(1))
    return rows.crossJoin(F.broadcast(levels(rated, ["score"]))).withColumn(out, found).drop("_levels_score")  # with one row


def hints(ratings: dict[str, Column], elevation: Column, tier: Column, lines: Column, passengers: Column, last_train: Column) -> Column:
    """What a text on a place should speak of, in order. Limits and words. last_train: minutes, those before three in the morning are of the day before."""
    high, low = lambda c: ratings[c] >= HIGH, lambda c: ratings[c] <= LOW
    late = F.when(last_train < 180, last_train + 1440).otherwise(last_train)
    return F.array_compact(F.array(
        F.when(high("transport") & low("crowd"), "Major hub, always busy"),
        F.when(low("rent") & high("vibe"), "Upscale residential, calm streets"),
        F.when(high("rent") & high("food"), "Budget-friendly with great eats"),
        F.when(high("green") & high("crowd"), "Peaceful green suburb"),
        F.when(high("nightlife") & low("safety"), "Lively but watch your belongings late at night"),
        F.when(elevation < 5, "flood risk zone"),
        F.when(tier == "very_high", "soft ground / reclaimed land"),
        F.when(lines >= 5, F.concat(F.lit("Major junction with "), lines.cast("string"), F.lit(" lines"))),
        F.when(passengers > 100_000, "One of the busiest stations"),
        F.when(passengers < 5_000, "Quiet local station"),
        F.when(late < 23 * 60, "Trains stop early — plan your night"),
        F.when(late > 24 * 60 + 30, "Good late-night connectivity"),
    ))
