"""Sinks: appends, refreshes, ordered JSON, documents, valid and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import kept


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def refresh(df: DataFrame, path: str) -> None:
    """Replaces the table's files; readers meanwhile may miss some. For tables that are read while they are replaced there is versions.refresh."""
    df.write.mode("overwrite").parquet(path)


def ordered_json(df: DataFrame, path: str, key: str) -> None:
    """JSON lines in order of the key over the part files; no single task writes everything."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").json(path)


def documents(df: DataFrame, path: str, text: Column, by: str) -> None:
    """A text file's lines per row, in a folder per value of `by`."""
    df.select(text.alias("value"), F.col(by)).write.mode("overwrite").partitionBy(by).text(path)


def split_valid(df: DataFrame, issues: Column, good: str, bad: str) -> None:
    """Rows without issues to one table and the others, with theirs, to another; df is computed once."""
    marked = kept(df.withColumn("issues", issues), "marked")
    marked.where(F.size("issues") == 0).drop("issues").write.mode("overwrite").parquet(good)
    marked.where(F.size("issues") > 0).write.mode("overwrite").parquet(bad)


def with_counts(df: DataFrame, valid: Column) -> DataFrame:
    """One row: how many are valid, how many not, and in all."""
    return df.agg(F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"), F.count("*").alias("total"))


def create_table(df: DataFrame, name: str) -> None:
    """CREATE TABLE IF NOT EXISTS with the frame's columns, then append."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    df.sparkSession.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
    df.write.mode("append").insertInto(name)
