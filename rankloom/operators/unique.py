"""Each choice is given once: places in order take their first free choices, in rounds instead of one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import kept
from .skew import spread_join


def greedy_unique(places: DataFrame, key: str, order: list[str], choices: str, most: int, spare: str | None = None, used: DataFrame | None = None) -> DataFrame:
    """key, choice and slot (from 0): what a loop over places by `order` and key gives, in which each takes the first `most` of its choices that no place before took.

    places have an array of choices, the best first, and may have another, `spare`, that counts only for places that get
    nothing from the first. used (one column) are choices that are taken from the start.

    A round looks at all places that are not settled. A choice belongs to the first place that still may want it, and no
    place before can contest that. A place takes those that belong to it as far as they are among its first free ones, so
    that it takes them however the others turn out; it gives up what comes after `most` of its own; what is taken is struck
    from all lists. The first place of all is settled in each round, so it ends, and the result is the loop's. There are
    as many rounds as the longest chain of places of which each waits for the one before: a few, unless choices are made
    so. Each round is written to the shared folder. A choice on very many lists is dealt to several tasks. Null choices
    are none, repeated ones count once; a place's list is one row.
    """
    kind = places.schema[choices].dataType.elementType.simpleString()
    none = F.expr(f"cast(array() as array<{kind}>)")
    listed = lambda c: F.coalesce(F.array_distinct(F.array_compact(c)), none)
    first, other = listed(F.col(choices)), listed(F.col(spare)) if spare else none
    state = places.select(F.struct(*order, key).alias("rank"), first.alias("open"), F.array_except(other, first).alias("spare"), F.concat(first, F.array_except(other, first)).alias("all"), F.lit(0).alias("got"))
    if used is not None:
        gone = used.select(F.col(used.columns[0]).cast(kind).alias("choice")).where("choice is not null").distinct()
        state = _struck(kept(state, "unique-places"), gone)
    state, found = kept(_next_list(state), "unique-state"), None
    while not state.isEmpty():
        claims = kept(state.select("rank", F.explode(F.concat("open", "spare")).alias("choice")), "unique-claims")
        own = claims.groupBy("choice").agg(F.min("rank").alias("rank")).groupBy("rank").agg(F.collect_set("choice").alias("own"))  # of one list
        here = state.join(own, "rank", "left").withColumn("own", F.coalesce("own", none))
        left = most - F.col("got")
        taken = F.filter(F.slice("open", 1, left), lambda c: F.array_contains("own", c))
        mine = F.filter("open", lambda c: F.array_contains("own", c))
        full = F.when(F.size(mine) >= left, F.array_position("open", F.get(mine, left - 1))).otherwise(F.size("open"))  # what is after that one is out of reach
        stepped = kept(here.withColumn("taken", taken).withColumn("open", F.array_except(F.slice("open", 1, full.cast("int")), "taken")), "unique-step")
        each = stepped.select("rank", "all", F.explode("taken").alias("choice"))
        part = each.select(F.col(f"rank.{key}").alias(key), "choice", F.array_position("all", F.col("choice")).alias("place"))
        found = part if found is None else found.unionByName(part)
        after = stepped.withColumn("got", F.col("got") + F.size("taken")).withColumn("spare", F.when(F.col("got") > 0, none).otherwise(F.col("spare")))
        state = kept(_next_list(_struck(after.drop("own", "taken"), each.select("choice"), claims)), "unique-state")
    if found is None:
        return places.select(key, F.lit(None).cast(kind).alias("choice"), F.lit(0).alias("slot")).limit(0)
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "choice"))).alias("l"))
    return lists.select(key, F.posexplode("l").alias("slot", "c")).select(key, "c.choice", "slot")


def _struck(state: DataFrame, gone: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """state without the choices in gone (each is there once) in any list."""
    if claims is None:
        claims = kept(state.select("rank", F.explode(F.concat("open", "spare")).alias("choice")), "unique-claims")
    lost = spread_join(claims, gone, ["choice"]).groupBy("rank").agg(F.collect_set("choice").alias("lost"))  # of one list
    without = lambda c: F.when(F.col("lost").isNull(), F.col(c)).otherwise(F.array_except(c, "lost"))
    return state.join(lost, "rank", "left").withColumns({"open": without("open"), "spare": without("spare")}).drop("lost")


def _next_list(state: DataFrame) -> DataFrame:
    """Places that have nothing and nothing left to choose go on with their spare list; those that are settled are left out."""
    turn = (F.size("open") == 0) & (F.col("got") == 0)
    now = state.withColumns({"open": F.when(turn, F.col("spare")).otherwise(F.col("open")), "spare": F.when(turn, F.slice("spare", 1, 0)).otherwise(F.col("spare"))})
    return now.where(F.size("open") > 0)
