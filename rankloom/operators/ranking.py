"""The interactive query: score, hard filters, order, top k, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rating import weighted_score
from ..plans.spec import CATEGORIES, COMMUTE_RANGE, RENT_RANGE, Filters


def scored(df: DataFrame, weights: dict[str, float], out: str = "score") -> DataFrame:
    """df with the weighted score; null where the place isn't rated."""
    score = weighted_score({c: F.col(c) for c in CATEGORIES}, weights)
    return df.withColumn(out, F.when(F.col(CATEGORIES[0]).isNotNull(), score))


def unless_known(c: Column, holds: Column) -> Column:
    """The test for what is known; what isn't passes."""
    return c.isNull() | holds


def dealbreakers(df: DataFrame, f: Filters, hide_flood: bool = False, hide_seismic: bool = False, rent: str = "rent_1k", commute: str = "min_transit") -> DataFrame:
    """df less what is known to be out of range; adds rent_unknown. Filters at their defaults are no node of the plan."""
    tests: list[Column] = []
    rent_max, rent_min = f.max_rent < RENT_RANGE[1], f.min_rent > RENT_RANGE[0]
    if rent_max:
        tests.append(unless_known(F.col(rent), F.col(rent) <= f.max_rent))
    if rent_min:
        tests.append(unless_known(F.col(rent), F.col(rent) >= f.min_rent))
    if f.max_commute < COMMUTE_RANGE[1]:
        tests.append(unless_known(F.col(commute), F.col(commute) <= f.max_commute))
    if f.min_commute > COMMUTE_RANGE[0]:
        tests.append(unless_known(F.col(commute), F.col(commute) >= f.min_commute))
    tests += [unless_known(F.col(c), F.col(c) >= v) for c, v in f.minimums.items()]
    if hide_flood:
        tests.append(unless_known(F.col("elevation_m"), F.col("elevation_m") >= 5))
    if hide_seismic:
        tests.append(~F.col("seismic_tier").eqNullSafe("very_high"))
    if f.camera:
        tests.append(F.coalesce(F.col("has_camera"), F.lit(False)))
    for t in tests:
        df = df.where(t)
    return df.withColumn("rent_unknown", F.col(rent).isNull() if rent_max or rent_min else F.lit(False))


def filter_ranked(df: DataFrame, weights: dict[str, float], key: str, min_score: float = 0, max_rent: float = 0, max_commute: float = 0, hubs: list[str] | None = None) -> DataFrame:
    """Rated places with their score, best first; a limit of 0 is none. With a commute limit, a place with hub times of which none is above 0 fails."""
    out = scored(df, weights).where(F.col("score").isNotNull())
    if min_score:
        out = out.where(F.col("score") >= min_score)
    if max_rent:
        rent = F.coalesce("rent_1k", "rent_2ldk")
        out = out.where(rent.isNull() | (rent == 0) | (rent <= max_rent))
    if max_commute and hubs:
        best = min_positive([F.col(h) for h in hubs])
        nothing = F.lit(True)
        for h in hubs:
            nothing = nothing & F.col(h).isNull()
        out = out.where(nothing | F.coalesce(best <= max_commute, F.lit(False)))
    return out.orderBy(F.desc("score"), key)


def min_positive(columns: list[Column]) -> Column:
    return F.array_min(F.filter(F.array(*columns), lambda x: x > 0))


def top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k with their place in the list."""
    ordered = df.orderBy(*order).limit(k)
    return ordered.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def best_of_each(df: DataFrame, keys: list[str], order: list[Column | str], k: int = 1) -> DataFrame:
    """The first k rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def fill_to_target(have: DataFrame, candidates: DataFrame, key: str, order: list[Column | str], target: int) -> DataFrame:
    """As many candidates of each key, in order, as it lacks to the target; `have` is (key, have)."""
    w = Window.partitionBy(key).orderBy(*order)
    return candidates.join(have, key, "left").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= target - F.coalesce("have", F.lit(0))).drop("_rn", "have")


def compare(df: DataFrame, keys: list, key: str, columns: list[str]) -> DataFrame:
    """A row per column and a column p1, p2, ... per key in the order given, with the greatest of the row."""
    spark = df.sparkSession
    chosen = spark.createDataFrame([(k, i + 1) for i, k in enumerate(keys)], f"{key} {df.schema[key].dataType.simpleString()}, pos int")
    long = df.join(F.broadcast(chosen), key).unpivot(["pos"], columns, "category", "rating")
    wide = long.groupBy("category").pivot("pos", list(range(1, len(keys) + 1))).agg(F.first("rating"))
    named = wide.select("category", *(F.col(str(i)).alias(f"p{i}") for i in range(1, len(keys) + 1)))
    return named.withColumn("best", F.greatest(*(F.col(f"p{i}") for i in range(1, len(keys) + 1))) if len(keys) > 1 else F.col("p1"))


def scatter(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    return df.select(key, F.col(x).alias("x"), F.col(y).alias("y")).dropna(subset=["x", "y"])


def search(df: DataFrame, query: str, any_case: list[str], exact_case: list[str], order: list[Column | str], most: int = 8) -> DataFrame:
    """Rows that have the query in a name; nothing for queries of fewer than two characters."""
    if len(query) < 2:
        return df.limit(0)
    hit = F.lit(False)
    for c in any_case:
        hit = hit | F.lower(c).contains(query.lower())
    for c in exact_case:
        hit = hit | F.col(c).contains(query)
    return df.where(hit).orderBy(*order).limit(most)
