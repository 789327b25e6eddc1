"""Line dedup: ranges of line hashes, each sorted by document and position; the result is a keep bitmap per document.

Lines are keyed by 128 bits of hash. Their occurrences are dealt out by ranges of the hash and each range is sorted by
document and position, so the first holder of a line is the one at which its run begins, and is carried along the run as
it streams by: what comes after it, in other documents, goes. A line that is on so many rows that its run would be a
task of its own is found by counting buckets of hashes, then lines of the few full buckets; the first holders of such lines,
of which there are at most a few thousand, are aggregated in part by every task and sent to all rows instead. What goes
back to a document is not text but a bitmap of the lines to keep, packed as its runs.

Defined results: a null or empty text is one empty line; a null id holds no lines and loses none; rows with the same
id and the same text are one document, and those with the same id and other texts are told apart by the text; lines
that repeat only in the document that is first to hold them all stay; an empty table gives an empty result; columns
other than the two that are named pass through in `cleaned` and are ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, let, lower_ascii, unused, written

#: A line on at least this share of all rows, and on no fewer rows than COMMON, isn't left to one task.
SHARE, COMMON = 2_000, 1_000
#: Lines are first counted by so many buckets of their hash.
BUCKETS = 1 << 16


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(BLANKS)))


def packed(gone: Column, n: Column) -> Column:
    """The bitmap of n lines less the sorted positions `gone`, compressed to its runs of ones: (start, len) of each kept run."""

    def runs(gone: Column) -> Column:
        starts = F.filter(gone, lambda x, i: (i == 0) | (F.get(gone, i - 1) != x - 1))
        ends = F.filter(gone, lambda x, i: (i == F.size(gone) - 1) | (F.get(gone, i + 1) != x + 1))
        return let(starts, lambda s: let(ends, lambda e: F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: between(s, e, i))))

    def between(starts: Column, ends: Column, i: Column) -> Column:
        start = F.coalesce(F.get(ends, i - 1) + 1, F.lit(0))
        return F.struct(start.alias("start"), (F.coalesce(F.get(starts, i), n) - start).alias("len"))

    return F.filter(let(gone, runs), lambda r: r["len"] > 0)


def kept_lines(lines: Column, bitmap: Column) -> Column:
    """The lines that a bitmap of runs keeps: a slice for each run."""
    return let(lines, lambda all_lines: F.flatten(F.transform(bitmap, lambda r: F.slice(all_lines, r["start"] + 1, r["len"]))))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Documents that lose lines: doc_id, doc_hash, n_lines, n_dropped, bitmap (see packed)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("doc_hash"), lines_of(F.col(text_col)).alias("lines"))
    key = line_key(F.col("line"))
    found = (
        split.select("doc_id", "doc_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
        .where(F.length(key) >= min_chars)
        .select("doc_id", "doc_hash", "n_lines", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))
    )
    found = written(found, "line-hashes")  # narrow rows, read several times below
    firsts = common_lines(found)
    run = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = found.join(F.broadcast(firsts), ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    # the ranges hold whole runs in their order, so this pass needs neither another exchange nor another sort
    streamed = ranged.withColumn("first", F.first("doc_id").over(run))
    lost = streamed.unionByName(found.join(F.broadcast(firsts), ["h1", "h2"])).where(F.col("doc_id") > F.col("first"))
    gone = lost.groupBy("doc_id", "doc_hash").agg(F.max("n_lines").alias("n_lines"), F.array_sort(F.collect_set("pos")).alias("gone"))
    return gone.select("doc_id", "doc_hash", "n_lines", F.size("gone").alias("n_dropped"), packed(F.col("gone"), F.col("n_lines")).alias("bitmap"))


def common_lines(found: DataFrame) -> DataFrame:
    """h1, h2 and first, the least document, of lines on a SHARE-th of all rows or more: at most SHARE lines."""
    least = max(COMMON, found.count() // SHARE)
    bucket = F.pmod("h1", F.lit(BUCKETS)).alias("bucket")
    full = found.groupBy(bucket).agg(F.count("*").alias("n")).where(F.col("n") >= least).select("bucket")  # at most SHARE rows
    inside = found.withColumn("bucket", F.pmod("h1", F.lit(BUCKETS))).join(F.broadcast(full), "bucket", "left_semi")
    counted = inside.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return written(counted.where(F.col("n") >= least).select("h1", "h2", "first"), "line-common")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """docs with text_col less the dropped lines; sets n_lines and n_dropped. A document that loses nothing keeps its text as it is."""
    own, key, mark, lost, bitmap = unused(docs, "_own", "_key", "_mark", "_lost", "_bitmap")
    maps = keep_bitmaps(docs, id_col, text_col, min_chars).select(F.col("doc_id").alias(key), F.col("doc_hash").alias(mark), F.col("n_dropped").alias(lost), F.col("bitmap").alias(bitmap))
    rows = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).join(maps, (F.col(id_col) == F.col(key)) & (F.col(own) == F.col(mark)), "left")
    kept = F.when(F.col(bitmap).isNull(), F.col(text_col)).otherwise(F.array_join(kept_lines(lines_of(F.col(text_col)), F.col(bitmap)), "\n"))
    out = rows.withColumns({"n_lines": F.size(lines_of(F.col(text_col))).cast("long"), "n_dropped": F.coalesce(lost, F.lit(0)).cast("long"), text_col: kept})
    return out.drop(own, key, mark, lost, bitmap)
