"""Tables between the steps of a query, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, with a folder of this application's in it; a temporary one where that's unset and all tasks run in this process, as in tests. On a cluster it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        sc = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: the tables between steps need a folder that the driver and all executors share")
        found = sc._rankloom_steps = getattr(sc, "_rankloom_steps", None) or tempfile.mkdtemp(prefix="rankloom-")
    return f"{found.rstrip('/')}/rankloom-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """df computed once: written as Parquet and read back, so that it survives lost executors and isn't computed again by what reads it."""
    path = fresh(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes this application's tables; results that haven't been read yet are lost with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
