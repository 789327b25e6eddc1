"""Equi-joins whose keys may be very common on the left."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stages import kept

#: Keys on more than a SHARE-th of the left rows, and more than LEAST rows, are dealt to several tasks; there are SHARE of them at most.
SHARE, LEAST = 2_000, 1_000
#: Pairs that a task of a join of known sizes gives out, until there are MOST_TASKS.
TASK_PAIRS, MOST_TASKS = 4_000_000, 20_000
#: Copies of right rows that a task of such a join makes, until there are as many tasks as a shuffle has.
TASK_COPIES = 100_000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", total: int | None = None, least: int = LEAST, share: int = SHARE, *, sizes: tuple[Column, Column] | None = None) -> DataFrame:
    """left joined with right on the keys, left or inner, so that no task has all rows of a common key.

    A common key's left rows are dealt by a hash of the row into parts of about a SHARE-th of all rows, and its right rows go
    to each of these. What is broadcast are the common keys, `share` of them at most. left is read twice: have it as a table.

    With sizes, how many rows each row of left and of right stands for, an inner join has tasks by the pairs that come out,
    not by the bytes that go in, and a key with more pairs than a task should have is dealt out too, MOST_TASKS keys more at
    most; right is read twice as well.
    """
    if how not in ("inner", "left") or sizes and how != "inner":
        raise ValueError(how)
    limit = max(least, -(-(left.count() if total is None else total) // share))
    counts, tasks = left.groupBy(*keys).agg(F.count("*").alias("_n"), *([F.sum(sizes[0]).cast("double").alias("_l")] if sizes else [])), None
    if sizes:
        each = kept(counts.join(right.groupBy(*keys).agg(F.count("*").alias("_m"), F.sum(sizes[1]).cast("double").alias("_r")), keys).select(*keys, "_n", "_m", (F.col("_l") * F.col("_r")).alias("_pairs")), "join-sizes")
        pairs = each.agg(F.sum("_pairs")).first()[0] or 0.0
        most = max(TASK_PAIRS, pairs / MOST_TASKS)
        shuffled = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(math.ceil(pairs / most), shuffled) if pairs > most else None
        parts = F.least(F.col("_n"), F.greatest(F.ceil(F.col("_n") / limit), F.ceil(F.col("_pairs") / most)))
        common = each.where((F.col("_n") > limit) | (F.col("_pairs") > most)).select(*keys, parts.alias("_parts"))
    else:
        common = counts.where(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).alias("_parts"))
    common = F.broadcast(common)
    salted = left.join(common, keys, "left").withColumn("_salt", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.col("_parts"))).otherwise(F.pmod(F.xxhash64(*keys), F.lit(1)))).drop("_parts")
    copiers = math.ceil((each.agg(F.sum(F.col("_m") * F.greatest(parts, F.lit(1)))).first()[0] or 0) / TASK_COPIES) if tasks else 0
    if copiers > 1:
        right = right.repartition(min(copiers, shuffled))  # few bytes go in, so that Spark would have one task
    copies = right.join(common, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    if tasks:
        salted, copies = (df.repartition(tasks, *keys, "_salt") for df in (salted, copies))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
