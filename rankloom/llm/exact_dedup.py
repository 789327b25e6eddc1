"""Exact dedup as a stream: keyed state on disk, never expired, and a check of full bytes on every hit.

Texts are the same when they're the same without ASCII white space. A first stream reads the table's files as they come,
hashes each text once and appends the digest, the id, the length and the content locator (file and row in the file) to a
narrow log. A second one reads that and keeps one state row per digest: how many rows had it, and of the row that stays
so far the length, the id and the locator. The state lies in RocksDB on the executors' disks, its change log in the
shared folder; it has no watermark, so no digest is ever forgotten. Each batch hands on the state rows that it changed,
in a folder by batch, so that a batch that is run again replaces its own rows. With a folder of the caller's, all this
stays there, and a later run reads only files that are new and goes on from the state.

A hit is a row whose digest has another row in the state. The texts of hits are fetched once by their locators, and those
of a digest are the same bytes if the least and the greatest are; both are taken in part before anything is shuffled, so a
digest on very many rows is no burden to any task. Rows whose bytes differ in spite of the digest are grouped by the text.

Defined results: a null text counts as empty; of equal texts the one with the most code points stays, then the
smallest id, null last; repeated rows are each returned, one of them as the one that stays where ids differ, and all
with the kept id otherwise; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, matched, scratch, written

#: For the stream's own session: state on disk, only changes written at each batch, and native memory with a bound.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's store takes megabytes before it has rows
    "spark.sql.streaming.metricsEnabled": "false",
}


def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normal(text), 256))


def hashed(stream: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chars, file, row and digest of each row of a scan."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return stream.select(F.col(id_col).alias("doc_id"), F.length(text).alias("chars"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), digest_of(F.col(text_col)).alias("digest"))


def track(rows: DataFrame) -> DataFrame:
    """The state by digest: group_size and the row that stays (chars, neg_id, file, row)."""
    place = F.struct("chars", (-F.col("doc_id")).alias("neg_id"), "file", "row")
    return rows.groupBy("digest").agg(F.max(place).alias("keeper"), F.count("*").alias("group_size"))


def pattern_of(path: str) -> str:
    """The path as a pattern, since a path that is a single file isn't accepted by streams."""
    return f"{path[:-1]}[{path[-1]}]"


def catch_up(spark: SparkSession, path: str, at: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 30) -> tuple[DataFrame, DataFrame]:
    """Runs both streams over the files of the parquet table at path that the folder `at` hasn't seen; all hashed rows, and the state by digest."""
    schema = spark.read.parquet(path).select(id_col, text_col).schema
    log, changes = f"{at}/rows", f"{at}/changes"
    own = spark.newSession()  # the streams' own session, so that the caller's settings stay as they are
    for k, v in {**STATE, "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}.items():
        own.conf.set(k, v)
    stream = own.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(pattern_of(path))
    rows = hashed(stream, id_col, text_col)
    rows.writeStream.format("parquet").option("path", log).option("checkpointLocation", f"{at}/rows-log").trigger(availableNow=True).start().awaitTermination()
    keep = lambda changed, batch: changed.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{changes}/run={batch}")
    narrow = own.readStream.schema(rows.schema).option("maxBytesPerTrigger", batch_bytes).parquet(log)
    track(narrow).writeStream.outputMode("update").option("checkpointLocation", f"{at}/state-log").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    row = f"struct<chars: int, neg_id: {rows.schema['doc_id'].dataType.simpleString()}, file: string, row: bigint>"
    changed = spark.read.schema(f"digest binary, keeper {row}, group_size bigint, batch bigint").option("recursiveFileLookup", "true").parquet(changes)
    state = changed.groupBy("digest").agg(F.max_by(F.struct("keeper", "group_size"), "batch").alias("s")).select("digest", "s.keeper", "s.group_size")
    return spark.read.schema(rows.schema).parquet(log), state


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", at: str | None = None) -> DataFrame:
    """A row per row of the table: doc_id, keep_id, group_size, kept, text_sha256. A folder `at` keeps log and state for later runs."""
    rows, found = catch_up(spark, path, at or scratch(spark, "exact-dedup"), id_col, text_col)
    several = found.where("group_size > 1").select("digest", (-F.col("keeper.neg_id")).alias("keep_id"), F.col("keeper.file").alias("keep_file"), F.col("keeper.row").alias("keep_row"), "group_size")
    several = written(several, "exact-dedup-keepers")
    told = written(matched(rows, several, "digest", "group_size", rows.count()).select("doc_id", "file", "row", "digest", "of"), "exact-dedup-rows")
    texts = spark.read.parquet(path).select(F.col(text_col).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    hits = told.where(F.col("of").isNotNull()).select("file", "row", "doc_id", "digest")
    fetched = texts.join(hits, ["file", "row"]).withColumn("bytes", normal(F.col("text")))
    ends = fetched.groupBy("digest").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most"))
    clash = written(ends.where(F.col("least") != F.col("most")).select("digest"), "exact-dedup-clash")
    own = F.col("of").isNull()
    is_keeper = own | ((F.col("row") == F.col("of.keep_row")) & (F.col("file") == F.col("of.keep_file")))
    clear = told if clash.isEmpty() else told.join(clash, "digest", "left_anti")
    plain = clear.select("doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("of.keep_id")).alias("keep_id"), F.coalesce("of.group_size", F.lit(1)).cast("long").alias("group_size"), is_keeper.alias("kept"), "digest")
    if not clash.isEmpty():
        plain = plain.unionByName(_by_text(texts.join(hits.join(clash, "digest", "left_semi"), ["file", "row"])))
    return plain.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _by_text(rows: DataFrame) -> DataFrame:
    """Rows grouped by their own bytes, for digests that stand for more than one text."""
    rows = rows.withColumn("bytes", normal(F.col("text"))).withColumn("place", F.struct(F.length("text").alias("chars"), (-F.col("doc_id")).alias("neg_id"), "file", "row"))
    kept = rows.groupBy("bytes").agg(F.max("place").alias("keeper"), F.count("*").alias("group_size"))
    return rows.join(kept, "bytes").select("doc_id", (-F.col("keeper.neg_id")).alias("keep_id"), "group_size", (F.col("place") == F.col("keeper")).alias("kept"), "digest")
