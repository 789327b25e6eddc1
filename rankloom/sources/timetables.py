"""Nested timetables from many files, of which only new and changed ones are read again.

The cache has two tables in versions: the trips of each file, and the files with their time and length. A run lists the
folder, reads what the second table doesn't have in the same form, takes out the trips of files that are gone or changed,
and adds the new ones. Trips are written before files, so a run that is killed in between reads some files again and no
more. What is listed is the names of files, as any scan of a folder does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import day_type, minutes_of
from . import versions
from .stages import kept

TRIP = "id string, tt array<struct<s: string, a: string, d: string>>"
LATE, EARLY = 22 * 60, 3 * 60


def _plain(path: str) -> Column:
    """A path with its scheme written in one way."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def scanned(spark: SparkSession, folder: str, cache: str, schema: str = TRIP, lines: bool = False, buckets: int = 16) -> tuple[DataFrame, int, int]:
    """The rows of all JSON files below a folder (one array each, or with `lines` a row a line), with `file`; how many files were read for it, and how many are gone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder)
    listed = kept(found.select(_plain("path").alias("file"), F.unix_micros("modificationTime").alias("modified"), F.col("length").alias("bytes")), "files-listed")
    if not versions.versions(spark, f"{cache}/files"):
        versions.refresh(spark.createDataFrame([], f"file string, {schema}"), f"{cache}/rows", "file", buckets)
        versions.refresh(listed.limit(0), f"{cache}/files", "file", buckets)
    known = versions.current(spark, f"{cache}/files")
    new = kept(listed.join(known, ["file", "modified", "bytes"], "left_anti"), "files-new")
    gone = kept(known.select("file").join(listed, "file", "left_anti"), "files-gone")
    names, n_gone = [r["file"] for r in new.select("file").toLocalIterator()], gone.count()
    if names or n_gone:
        read = spark.read.schema(schema).option("multiLine", not lines).json(names).select(_plain("_metadata.file_path").alias("file"), "*") if names else versions.current(spark, f"{cache}/rows").limit(0)
        stale = gone.unionByName(new.select("file"))
        versions.replace(read, stale, f"{cache}/rows")
        versions.replace(new, stale, f"{cache}/files")
    return versions.current(spark, f"{cache}/rows"), len(names), n_gone


def departures(trips: DataFrame) -> DataFrame:
    """station, day_type, minute and whether the departure is late: each stop of a trip (id, tt) with a departure. A stop before three in the morning is late if its trip has a stop at ten in the evening or later."""
    clock = lambda t: F.when(t.rlike("^[0-9]{2}:[0-9]{2}$"), minutes_of(t))
    any_time = lambda s: clock(F.coalesce(F.nullif(s["d"], F.lit("")), s["a"]))
    late = F.coalesce(F.exists("tt", lambda s: F.coalesce(any_time(s) >= LATE, F.lit(False))), F.lit(False))
    stops = trips.select(day_type(F.col("id")).alias("day_type"), late.alias("late_trip"), F.explode("tt").alias("s")).select("s.s", "day_type", clock(F.col("s.d")).alias("minute"), "late_trip")
    boarded = stops.where(F.col("minute").isNotNull() & (F.coalesce("s", F.lit("")) != ""))
    return boarded.select(F.col("s").alias("station"), "day_type", "minute", ((F.col("minute") >= EARLY) | F.col("late_trip")).alias("late"))


def last_trains(stops: DataFrame) -> DataFrame:
    """station, weekday and holiday: the minute of the last departure of those that are late; after midnight is later than before."""
    order = F.when(F.col("minute") < EARLY, F.col("minute") + 24 * 60).otherwise(F.col("minute"))
    of = lambda day: F.max_by("minute", F.when(F.col("day_type") == day, order)).alias(day)
    return stops.where("late").groupBy("station").agg(of("weekday"), of("holiday"))
