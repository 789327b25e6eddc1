"""Tie-aware percentile ratings, percentile anchors and other order statistics, without a global single-task window.

Values are first counted, so what is ordered is the distinct values with their counts. Those are dealt out in ranges, as
many as Spark makes of their bytes, and kept as a table; they are summed up inside ranges and over the ranges. No task sees
more than its own range, whether there is one group or there are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import half_even
from ..sources.stages import kept


def running(df: DataFrame, keys: list[str], order: list[str | Column], amount: Column, out: str) -> DataFrame:
    """df with out and total: per key the sum of amount over all rows before in the order, and over all rows."""
    ordered = df.repartitionByRange(*map(F.col, keys), *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id())
    ranged = kept(ordered, "ranges")  # a range's number must not change from here on
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part", *keys).agg(F.sum(amount).alias("_size"))  # a row for each range, and one more for each key
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_size").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", *keys, before.alias("_offset"), F.sum("_size").over(group).alias("total"))
    summed = ranged.withColumn(out, F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(offsets, ["_part", *keys])
    return summed.withColumn(out, F.col(out) + F.col("_offset")).drop("_part", "_offset")


def counted(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Per key v, n, before and total: each value, how many rows have it, how many a smaller one, and how many there are. Null values are left out."""
    keys = keys or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    return running(counts, keys, ["v"], F.col("n"), "before")


def _rated(share_low: Column, invert: Column) -> Column:
    share = F.when(invert, 1 - share_low).otherwise(share_low)
    return F.greatest(F.lit(1), F.least(F.lit(10), half_even(share * 9 + 1))).cast("int")


def levels(rated: DataFrame, names: list[str]) -> DataFrame:
    """One row with an array for each name: the smallest value of each rating that occurs, with the rating. rated has name, v and rating.

    A greater value never has a smaller share, after rounding as well, so that a rating's values are a range: these, ten at
    most for each name, say all that the table of distinct values says.
    """
    lows = rated.groupBy("name", "rating").agg(F.min("v").alias("low"))
    return lows.agg(*(F.collect_list(F.when(F.col("name") == n, F.struct("low", "rating"))).alias(f"_levels_{n}") for n in names))


def level(name: str, value: Column) -> Column:
    """The rating that levels has for a value; null for null, and for one below all."""
    return F.array_max(F.filter(f"_levels_{name}", lambda s: s["low"] <= value))["rating"]


def _rated_rows(rows: DataFrame, values: dict[str, tuple[Column, bool]]) -> DataFrame:
    """rows, a table, with a rating for each name, of (value, whether low is good).

    Rows aren't joined with the distinct values, of which one may be on most rows, and there may be as many as rows: they
    are looked up in the ratings' ranges, which all tasks get.
    """
    names = list(values)
    entries = F.array(*(F.struct(F.lit(n).alias("name"), v.alias("v")) for n, (v, _) in values.items()))
    share = (F.col("before") + (F.col("n") - 1) / 2.0) / F.greatest(F.col("total") - 1, F.lit(1))
    inverted = F.col("name").isin([n for n, (_, low) in values.items() if low])
    ranked = counted(rows.select(F.explode(entries).alias("e")).select("e.name", "e.v"), "v", ["name"])
    sent = levels(ranked.select("name", "v", _rated(share, inverted).alias("rating")), names)
    return rows.crossJoin(F.broadcast(sent)).select(*rows.columns, *(level(n, v).alias(n) for n, (v, _) in values.items()))  # with one row


def percentile_rating(df: DataFrame, value: str, out: str, invert: bool = False) -> DataFrame:
    """df with out: 1 to 10 by the middle rank of a value's ties; null for null. df is computed once."""
    return _rated_rows(kept(df, "rated-rows"), {out: (F.col(value), invert)})


def percentile_ratings(df: DataFrame, key: str, of: dict[str, tuple[str, bool]]) -> DataFrame:
    """df, whose rows have the key, with a rating for each name, of (value column, whether low is good), all in one pass: values in long form, counted and ranked per name and range. df is computed once."""
    return _rated_rows(kept(df, "rated-rows"), {n: (F.col(c).cast("double"), invert) for n, (c, invert) in of.items()})


def at_share(df: DataFrame, value: str, shares: dict[str, float], empty: dict[str, float]) -> DataFrame:
    """One row: for each name the value at place floor(n * share), counted from 0 and at most the last; the given one where there are no rows."""
    picks: list[Column] = []
    for name, p in shares.items():
        at = F.least(F.col("total") - 1, F.floor(F.col("total") * p))
        picks.append(F.coalesce(F.max(F.when((at >= F.col("before")) & (at < F.col("before") + F.col("n")), F.col("v"))), F.lit(empty[name])).alias(name))
    return counted(df, value).agg(*picks)


def upper_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Per key the value at place n div 2 of its sorted values."""
    at = F.floor(F.col("total") / 2)
    return counted(df, value, keys).where((F.col("before") <= at) & (at < F.col("before") + F.col("n"))).select(*keys, F.col("v").alias(out))


def spearman(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """One row: rho = 1 - 6 * sum d^2 / (n (n^2 - 1)), ranks by value and key, without correction for ties. df is computed once."""
    both = kept(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), "spearman-rows")

    def ranks(c: str) -> DataFrame:
        return running(both.select(key, c), [], [c, key], F.lit(1), f"rank_{c}").select(key, f"rank_{c}")

    d = ranks(x).join(ranks(y), key).select((F.col(f"rank_{x}") - F.col(f"rank_{y}")).cast("double").alias("d"))
    n = F.count("*").cast("double")
    return d.agg(F.count("*").alias("n"), (1 - 6 * F.sum(F.col("d") * F.col("d")) / (n * (n * n - 1))).alias("rho"))
