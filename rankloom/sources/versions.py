"""Tables in versions: replaced at once for all readers, and updated by rewriting only the buckets that hold what changes.

A table is a folder of data folders and of manifests, one a version, which name the folder of each bucket of keys. A writer
writes new data folders first and its manifest last, by a rename that fails if another writer has made that version. Readers
take the newest manifest and read its folders, which nobody writes to again: they see all of a version or nothing of it,
also while the next is written and after. Old versions go when `vacuum` is called.

Where keys are unique, buckets are even, as they are dealt by a hash; choose as many as make buckets of a size that is worth
rewriting for one row. A manifest has one entry a bucket, whatever the number of rows.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .stages import kept

BUCKET = "_bucket"


class Conflict(Exception):
    """Another writer has made this version; what was to be written isn't part of the table."""


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that there are, oldest first."""
    p, fs = _at(spark, f"{path}/_versions")
    found = fs.listStatus(p) if fs.exists(p) else []
    return sorted(int(n[:-5]) for n in (f.getPath().getName() for f in found) if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """key, buckets, schema and the folder of each bucket of a version, of the newest if none is named."""
    found = versions(spark, path)
    if not found or version is not None and version not in found:
        raise FileNotFoundError(f"no version {'' if version is None else version} of {path}")
    p, fs = _at(spark, f"{path}/_versions/{found[-1] if version is None else version:020d}.json")
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, made: dict) -> int:
    jvm = spark._jvm
    temporary, fs = _at(spark, f"{path}/_versions/.{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    out.write(bytearray(json.dumps(made).encode()))
    out.close()
    final, _ = _at(spark, f"{path}/_versions/{made['version']:020d}.json")
    qualified = fs.makeQualified(final)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration())
    try:  # fails if the version is there
        context.rename(fs.makeQualified(temporary), qualified, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Py4JJavaError as e:
        fs.delete(temporary, False)
        if versions(spark, path)[-1:] >= [made["version"]]:
            raise Conflict(f"version {made['version']} of {path}") from e
        raise
    return made["version"]


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _written(df: DataFrame, path: str, key: str, buckets: int, files: int) -> dict[str, str]:
    """Writes df to a new data folder; the folder of each bucket that has rows."""
    folder = f"data/{uuid.uuid4().hex}"
    # a bucket is dealt to several tasks where it has more than spark.sql.adaptive.advisoryPartitionSizeInBytes
    dealt = df.withColumns({BUCKET: _bucket(key, buckets), "_file": F.pmod(F.xxhash64(*df.columns), F.lit(files))}).hint("rebalance", BUCKET, "_file").drop("_file")
    dealt.write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
    p, fs = _at(df.sparkSession, f"{path}/{folder}")
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith(f"{BUCKET}=")}


def refresh(df: DataFrame, path: str, key: str, buckets: int = 64, files: int = 1) -> int:
    """Makes df the whole table; the new version's number. files: into how many parts each bucket is dealt at least; large buckets have more."""
    spark = df.sparkSession
    found = versions(spark, path)
    parts = _written(df, path, key, buckets, files)
    return _commit(spark, path, {"version": found[-1] + 1 if found else 0, "key": key, "buckets": buckets, "files": files, "schema": df.schema.jsonValue(), "parts": parts})


def _rows(spark: SparkSession, path: str, of: dict, buckets: list[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(of["schema"])
    folders = [f"{path}/{f}" for b, f in of["parts"].items() if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as it is now, or was at a version; later versions don't change the frame."""
    return _rows(spark, path, manifest(spark, path, version))


def _rewritten(spark: SparkSession, path: str, of: dict, rows: DataFrame, touched: list[str]) -> int:
    parts = {b: f for b, f in of["parts"].items() if b not in touched}
    if touched:
        parts |= _written(rows, path, of["key"], of["buckets"], of["files"])
    return _commit(spark, path, {**of, "version": of["version"] + 1, "parts": parts})


def _touched(keys: DataFrame, key: str, buckets: int) -> list[str]:
    return [str(r[0]) for r in keys.select(_bucket(key, buckets)).distinct().toLocalIterator()]  # one a bucket at most


def update(changes: DataFrame, path: str, order: str | None = None, insert: bool = False) -> int:
    """Sets, in the rows with the changes' keys, the columns that a change has a value for; the new version's number.

    Of several changes of one key the last by `order` counts, or the greatest. Keys that the table lacks are left out, or
    with `insert` added. Only buckets with such rows are read whole and written again.
    """
    spark = changes.sparkSession
    of = manifest(spark, path)
    key, names = of["key"], StructType.fromJson(of["schema"]).fieldNames()
    last = Window.partitionBy(key).orderBy(*(F.desc(c) for c in ([order] if order else changes.columns)))
    known = kept(changes.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(last)).where("_rn = 1").select(*[c for c in changes.columns if c in names]), "version-changes")
    there = _rows(spark, path, of, _touched(known, key, of["buckets"]))
    met = known if insert else there.select(key).join(known.select(key), key, "left_semi")
    touched = _touched(met, key, of["buckets"])
    rows = _rows(spark, path, of, touched)
    new = known.select(key, *(F.col(c).alias(f"_new_{c}") for c in known.columns if c != key))
    both = rows.join(new, key, "full" if insert else "left")
    value = lambda c: F.coalesce(f"_new_{c}", c).alias(c) if c in known.columns and c != key else F.col(c)
    return _rewritten(spark, path, of, both.select(*map(value, names)), touched)


def replace(rows: DataFrame, gone: DataFrame, path: str) -> int:
    """Takes out all rows whose keys are in gone (one column), then adds rows; for tables in which a key has several rows."""
    spark = rows.sparkSession
    of = manifest(spark, path)
    key = of["key"]
    lost = kept(gone.select(F.col(gone.columns[0]).alias(key)).distinct(), "version-gone")
    rows = kept(rows.select(*StructType.fromJson(of["schema"]).fieldNames()), "version-new")
    touched = _touched(lost.unionByName(rows.select(key)), key, of["buckets"])
    stay = _rows(spark, path, of, touched).join(lost, key, "left_anti")
    return _rewritten(spark, path, of, stay.unionByName(rows), touched)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes all but the newest `keep` versions, and the data folders that only these had; how many versions went. Readers of those fail."""
    found = versions(spark, path)
    used = {f.rsplit("/", 1)[0] for v in found[-keep:] for f in manifest(spark, path, v)["parts"].values()}
    old = {f.rsplit("/", 1)[0] for v in found[:-keep] for f in manifest(spark, path, v)["parts"].values()}
    for v in found[:-keep]:
        p, fs = _at(spark, f"{path}/_versions/{v:020d}.json")
        fs.delete(p, False)
    for folder in sorted(old - used):
        p, fs = _at(spark, f"{path}/{folder}")
        fs.delete(p, True)
    return len(found[:-keep])
