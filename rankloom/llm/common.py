"""What the corpus operators share: scans, the cluster's scratch folder, written tables, ASCII case."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case; all other characters stay, which lower() doesn't promise."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often and in whatever lambdas body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes for df to have no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one where that's unset and all tasks run in this process, as in tests. On a cluster it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        sc = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: the tables between steps need a folder that the driver and all executors share")
        found = sc._rankloom_dir = getattr(sc, "_rankloom_dir", None) or tempfile.mkdtemp(prefix="rankloom-")
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, for clusters on which it isn't installed."""
    sc = spark.sparkContext
    if not getattr(sc, "_rankloom_shipped", False):
        top = Path(__file__).parents[1]
        made = Path(tempfile.mkdtemp(prefix="rankloom-")) / "rankloom_shipped.zip"
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(str(made))
        sc._rankloom_shipped = True


def in_batches(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInPandas with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInPandas(f, schema)


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/rankloom-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{own_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, read back: cuts the lineage and survives the loss of executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._rankloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for t in tables:
        remove(t.sparkSession, t._rankloom_path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application wrote to the shared folder; results that haven't been read yet are lost with it."""
    remove(spark, own_dir(spark))


def matched(rows: DataFrame, side: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows with `of`: side's row for the key as a struct, null where there is none; side has one row a key.

    Keys that side's column n says to be on a 2,000th of the `total` rows or more, so at most 2,000 keys, are broadcast,
    and their rows are spread over all tasks of the join, so that no task has such a key's rows to itself.
    """
    many = max(1_000, total // 2_000)
    large, small, salt = unused(rows, "_large", "_small", "_salt")
    values = F.struct(*[c for c in side.columns if c != key])
    spread = rows.join(F.broadcast(side.where(F.col(n) >= many).select(key, values.alias(large))), key, "left")
    spread = spread.withColumn(salt, F.when(F.col(large).isNull(), F.lit(0)).otherwise(F.xxhash64(*rows.columns)))
    # 0 by way of the key, as the optimizer takes constants out of the join's keys
    rest = side.where(F.col(n) < many).select(key, values.alias(small), F.pmod(F.xxhash64(key), F.lit(1)).alias(salt))
    return spread.join(rest, [key, salt], "left").withColumn("of", F.coalesce(large, small)).drop(large, small, salt)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path below the shared folder, on whatever file system that is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; such rows are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
