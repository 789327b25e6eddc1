"""Work that resumes: only what isn't done yet, files as they come, the last state of a burst."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stages import shared_folder


def remaining(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key), key, "left_anti")


def next_batch(wanted: DataFrame, done: DataFrame, key: str, order: list[Column | str], n: int) -> DataFrame:
    return remaining(wanted, done, key).orderBy(*order).limit(n)


def append_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_per_batch: int | None = None) -> None:
    """Appends rows of files that earlier runs haven't seen, then ends; a run that was killed goes on where it was."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    reader.parquet(source).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_valid(spark: SparkSession, source: str, parse: Callable[[DataFrame], DataFrame], issues: Column, folder: str | None = None) -> DataFrame:
    """Streams the files of a parquet table, appends the parsed rows that have no issues, and returns the table of them. With a folder of the caller's, later runs read only what is new."""
    at = folder or f"{shared_folder(spark)}/append-{uuid.uuid4().hex}"
    # as a pattern, since a path that is a single file isn't accepted by streams
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source[:-1]}[{source[-1]}]")
    good = parse(stream).where(F.size(issues) == 0)
    good.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(good.schema).parquet(f"{at}/rows")


def debounced(rows: DataFrame, key: str, time: str, gap: str, value: str) -> DataFrame:
    """Per key and session (rows less than gap apart): its bounds, how many rows it had and its last value."""
    s = rows.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.max_by(value, F.struct(time, value)).alias("last"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "last")


def latest(rows: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The last row of each key: what a keyed map holds after all rows were put into it."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
