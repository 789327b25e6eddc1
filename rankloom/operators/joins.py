"""Joins with precedence: fallback chains, cascades, first matches, overlays, explode and regroup."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import kept
from .skew import spread_join

#: Sides that a stage joins: each holds the memory of a group table, and of up to two sorts.
SIDES_AT_ONCE = 2


def fallback(df: DataFrame, out: str, steps: list[tuple[str, Column, int]]) -> DataFrame:
    """df with out, out_source and out_quality: the first step (name, value, quality) whose value isn't null."""
    value, source, quality = F.coalesce(*(v for _, v, _ in steps)), F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, v, q in reversed(steps):
        source, quality = F.when(v.isNotNull(), name).otherwise(source), F.when(v.isNotNull(), q).otherwise(quality)
    return df.withColumns({out: value, f"{out}_source": source, f"{out}_quality": quality})


def first_match(left: DataFrame, right: DataFrame, on: str, order: list[Column | str]) -> DataFrame:
    """Left join with only the first row of right for each key."""
    w = Window.partitionBy(on).orderBy(*order)
    return left.join(right.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"), on, "left")


def cascade(left: DataFrame, key: str, tiers: list[tuple[DataFrame, Column]], out: list[str]) -> DataFrame:
    """Left join with the best of several joins' matches: tier by tier, in a tier by its order column.

    Each tier is (matches, order): matches has key and the out columns.
    """
    found = None
    for i, (matches, order) in enumerate(tiers):
        part = matches.select(key, *out, F.lit(i + 1).alias("tier"), order.cast("string").alias("_order"))
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy(key).orderBy("tier", "_order")
    best = found.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_order")
    return left.join(best, key, "left")


def lookup_list(df: DataFrame, key: str, items: str, lookup: DataFrame, item_key: str, value: str, out: str) -> DataFrame:
    """df's key with the values of its items in their order; items without a match are left out, and a key with none has an empty list."""
    exploded = df.select(key, F.posexplode(items).alias("_pos", item_key)).join(lookup.select(item_key, value), item_key)
    lists = exploded.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", value))), lambda s: s[value]).alias(out))
    none = F.array().cast(lists.schema[out].dataType)
    return df.select(key).join(lists, key, "left").withColumn(out, F.coalesce(out, none))


def overlay(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """base, and of more what base lacks."""
    return base.unionByName(more.join(base.select(key).distinct(), key, "left_anti"))


def updated(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the given columns replaced where changes has a value for them."""
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = base.join(new, key, "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def priority_union(sources: list[DataFrame], keys: list[str], dedup: list[str], order: list[Column | str], most: int) -> DataFrame:
    """The sources one after the other; of what repeats within a key the first stays, then at most `most` of each key."""
    every = None
    for i, s in enumerate(sources):
        part = s.withColumn("priority", F.lit(i))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    first = Window.partitionBy(*keys, *dedup).orderBy("priority", *order)
    capped = Window.partitionBy(*keys).orderBy("priority", *order)
    unique = every.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    return unique.withColumn("idx", F.row_number().over(capped) - 1).where(F.col("idx") < most)


def redirected(df: DataFrame, renames: DataFrame, key: str) -> DataFrame:
    """Keys through a map (old, new); keys that aren't in it stay."""
    return df.join(renames, F.col(key) == F.col("old"), "left").withColumn(key, F.coalesce("new", key)).drop("old", "new")


def chains(renames: DataFrame) -> DataFrame:
    """old, new, hops, cycle: where each old key ends after all renames (old, new) in a row, in how many; a key that leads into a cycle has no end.

    Each round joins what still goes on with the map, so that ways are twice as long: as many rounds as the logarithm of
    the longest chain, unless keys go round in ways of which no round sees the end. Of several renames of a key the greatest new key counts; a key renamed to itself isn't renamed; nulls are left
    out. A new key that very many old ones have is dealt to several tasks.
    """
    once = renames.where("old is not null and new is not null").groupBy("old").agg(F.max("new").alias("new")).where("old <> new")
    ways = kept(once.select("old", "new", F.lit(1).cast("long").alias("hops"), F.lit(False).alias("cycle"), F.lit(True).alias("going")), "rename-ways")
    total = going = ways.count()
    for _ in range(math.ceil(math.log2(total + 1)) + 1 if total else 0):
        on = ways.select(F.col("old").alias("new"), F.col("new").alias("_end"), F.col("hops").alias("_more"), F.col("cycle").alias("_cycle"))
        longer = spread_join(ways.where("going"), on, ["new"], "left", total=going)
        end = F.coalesce("_end", "new")
        round_ = F.coalesce("_cycle", F.lit(False)) | (end == F.col("old"))  # it leads to a key that goes round, or back to itself
        stepped = longer.select("old", end.alias("new"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"), round_.alias("cycle"), (F.col("_end").isNotNull() & ~round_).alias("going"))
        ways = kept(ways.where("not going").unionByName(stepped), "rename-ways")
        going = ways.where("going").count()
        if not going:
            break
    # what still goes on after so many rounds goes round
    ends = ways.withColumn("cycle", F.col("cycle") | F.col("going"))
    return ends.select("old", F.when(~F.col("cycle"), F.col("new")).alias("new"), F.when(~F.col("cycle"), F.col("hops")).alias("hops"), "cycle")


def datamart(base: DataFrame, key: str, sides: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """base with the columns of many sides, each called side_column, and `found`, the names of the sides that have the key.

    sides: per name a frame and its order columns; of several rows of a key the last in this order counts. All sides have
    the same key. What is joined so far becomes a table after every SIDES_AT_ONCE sides: in one stage, a task would hold
    the groups and sorted rows of all sides at a time, however many there are. Sides that Spark knows, or sees on the way,
    to be below spark.sql.autoBroadcastJoinThreshold are broadcast instead.
    """
    out, names = base, []
    for i, (name, (side, order)) in enumerate(sides.items()):
        if i and i % SIDES_AT_ONCE == 0:
            out = kept(out, "mart")
        w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
        last = side.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1") if order else side.where(F.col(key).isNotNull())
        columns = [c for c in side.columns if c != key and c not in order]
        out = out.join(last.select(key, *(F.col(c).alias(f"{name}_{c}") for c in columns), F.lit(name).alias(f"_{name}")), key, "left")
        names.append(f"_{name}")
    return out.withColumn("found", F.array_compact(F.array(*names))).drop(*names)


def transliterated(names: DataFrame, name: str, dictionary: DataFrame, known: DataFrame | None = None, longest: int = 12) -> DataFrame:
    """name and romaji for each distinct name: the one that known (name, romaji) has, else the readings of the longest dictionary entries (written, reading), from left to right.

    A reading begins with a capital and goes on in small letters; readings, and runs of characters that no entry begins
    with, are joined by hyphens, of which runs become one and those at the ends go. All stretches of a name up to `longest`
    characters are looked up at once, by a join; the way from left to right is then chosen inside each name. Of several
    readings of an entry, or of a name in known, the smallest counts. Entries longer than `longest` aren't found. An entry
    that very many names have is dealt to several tasks.
    """
    distinct = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    done = known.where("romaji is not null").groupBy("name").agg(F.min("romaji").alias("romaji")) if known is not None else None
    rows = kept(distinct.join(done, "name", "left") if done is not None else distinct.withColumn("romaji", F.lit(None).cast("string")), "names")
    open_rows = rows.where(F.col("romaji").isNull()).select("name")
    starts = open_rows.where(F.length("name") > 0).select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at"))
    parts = starts.select("name", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("name") - F.col("at") + 1))).alias("size")).withColumn("written", F.expr("substring(name, at, size)"))
    entries = dictionary.where("written is not null and written <> '' and reading is not null").groupBy("written").agg(F.min("reading").alias("reading"))
    met = spread_join(kept(parts, "name-parts"), entries, ["written"])
    best = met.groupBy("name", "at").agg(F.max(F.struct("size", "reading")).alias("m"))
    ways = best.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("at", "m"))).alias("ways"))  # one a character of a name
    first = F.struct(F.lit(1).alias("next"), F.lit("").alias("text"), F.lit(False).alias("plain"))

    def step(s: Column, at: Column) -> Column:
        hit = F.try_element_at("ways", at)
        after = F.concat(s["text"], F.lit("-"), F.upper(F.substring(hit["reading"], 1, 1)), F.lower(F.substr(hit["reading"], F.lit(2))))
        taken = F.struct((at + hit["size"]).alias("next"), after.alias("text"), F.lit(False).alias("plain"))
        left = F.struct((at + 1).alias("next"), F.concat(s["text"], F.when(s["plain"], "").otherwise("-"), F.substr(F.col("name"), at, F.lit(1))).alias("text"), F.lit(True).alias("plain"))
        return F.when(at < s["next"], s).when(hit.isNotNull(), taken).otherwise(left)

    places = F.when(F.length("name") > 0, F.sequence(F.lit(1), F.length("name"))).otherwise(F.array().cast("array<int>"))
    walked = F.trim(F.regexp_replace(F.aggregate(places, first, step)["text"], "-+", "-"), F.lit("-"))
    made = open_rows.join(ways, "name", "left").withColumn("ways", F.coalesce("ways", F.expr("cast(map() as map<int, struct<size: int, reading: string>>)"))).select("name", walked.alias("romaji"))
    return rows.where(F.col("romaji").isNotNull()).unionByName(made)
