"""Lines that meet at a place, and how many changes a trip takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import kept
from .skew import spread_join


def adjacency(members: DataFrame, place: str, line: str) -> DataFrame:
    """Pairs of lines with a place in common, both ways round. Places with the same lines count as one, and a place with very many is dealt to several tasks."""
    sets = members.select(place, line).distinct().groupBy(place).agg(F.sum(F.xxhash64(line).cast("decimal(20)")).alias("_a"), F.bit_xor(F.xxhash64(F.struct(line))).alias("_b"), F.count("*").alias("_n"))
    first = sets.where("_n > 1").groupBy("_a", "_b", "_n").agg(F.min(place).alias(place))
    rows = kept(members.select(place, F.col(line).alias("line_a")).distinct().join(first.select(place), place), "adjacent-members")
    one = F.lit(1)
    return spread_join(rows, rows.withColumnRenamed("line_a", "line_b"), [place], sizes=(one, one)).where("line_a <> line_b").select("line_a", "line_b").distinct()


def transfers(members: DataFrame, hubs: DataFrame, place: str, line: str) -> DataFrame:
    """place, hub, transfers: 0 with a line in common, 1 if a line of one meets a line of the other, else 2. Hubs are a handful; members are computed once.

    From hubs to their lines, to places on these, to lines there, to places on those: no pairs of lines are formed.
    """
    rows = kept(members.select(place, line), "members")
    hub_lines = rows.join(F.broadcast(hubs.select(place)), place).select(line, F.col(place).alias("hub")).distinct()
    direct = rows.join(hub_lines, line).select(place, "hub").distinct()
    reach = rows.join(direct, place).select(line, "hub").distinct()
    once = rows.join(reach, line).select(place, "hub").distinct()
    every = rows.select(place).distinct().crossJoin(F.broadcast(hubs.select(F.col(place).alias("hub"))))
    best = direct.withColumn("t", F.lit(0)).unionByName(once.withColumn("t", F.lit(1))).groupBy(place, "hub").agg(F.min("t").alias("t"))
    return every.join(best, [place, "hub"], "left").select(place, "hub", F.coalesce("t", F.lit(2)).alias("transfers"))


def changes(members: DataFrame, hubs: DataFrame, place: str, line: str, deepest: int | None = None) -> DataFrame:
    """place, hub, changes: the fewest changes of line between a place and a hub, 0 on a line of the hub's; no row where there is no way, or none with `deepest` changes. Hubs are a handful.

    A search in rounds from the hubs over lines and places in turn: a round's lines are those at places that the last one
    reached, less those reached before. No pairs of lines are formed. There are as many rounds as changes on the longest
    of the shortest ways; members are written once, and lines with very many places, and places with very many lines, are
    dealt to several tasks.
    """
    rows = kept(members.select(place, line).distinct(), "members")
    total = rows.count()
    at_hubs = rows.join(F.broadcast(hubs.select(place)), place)
    lines = kept(at_hubs.select(line, F.col(place).alias("hub")).distinct(), "reached-lines")
    seen_lines, found, depth = lines, None, 0
    seen = rows.select(place, F.lit(None).cast(hubs.schema[place].dataType).alias("hub")).limit(0)
    while True:
        met = spread_join(rows, lines, [line], total=total).select(place, "hub").distinct()
        new = kept(met.join(seen, [place, "hub"], "left_anti"), "reached-places")
        part = new.withColumn("changes", F.lit(depth))
        found = part if found is None else found.unionByName(part)
        depth += 1
        if new.isEmpty() or deepest is not None and depth > deepest:
            return found
        seen = found.select(place, "hub")
        on = spread_join(rows, new, [place], total=total).select(line, "hub").distinct()
        lines = kept(on.join(seen_lines, [line, "hub"], "left_anti"), "reached-lines")
        if lines.isEmpty():
            return found
        seen_lines = seen_lines.unionByName(lines)
