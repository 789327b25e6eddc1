"""Scans of files in other shapes: JSON tables and folders, CSV with stray rows, statistical cubes, listings in HTML."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from .stages import kept


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file, or folder of files, that is one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_folder(spark: SparkSession, path: str, schema: str, key: str = "slug") -> DataFrame:
    """A record per file with the file's name, without its ending, as key; files that don't parse have broken set."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias(key), "*").withColumn("broken", F.col("_corrupt").isNotNull()).drop("_corrupt")


def csv_rows(spark: SparkSession, path: str, schema: str, needed: list[str], escape: str = "\\") -> DataFrame:
    """CSV with a header; rows that don't fit the schema or lack a needed value are left out."""
    return spark.read.schema(schema).option("header", True).option("escape", escape).option("mode", "DROPMALFORMED").csv(path).dropna(subset=needed)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that there is, on whatever file system."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return p
    return None


def positional_cells(lines: DataFrame, line: str, low: float = 10_000, high: float | Column = 500_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of unknown layout: the first cell of five digits is the code, the next one the name, numbers between low and high after it the prices. Codes may repeat; `keep` are columns that go along."""
    cells = F.transform(F.split(line, ","), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))
    at = F.array_position(F.transform("cells", lambda c: c.rlike(r"^[0-9]{5}$")), True)
    prices = F.filter(F.transform(F.slice("cells", F.col("at") + 2, F.size("cells")), lambda c: F.regexp_replace(c, "[^0-9.]", "").try_cast("double")), lambda p: p.between(low, high))
    coded = lines.withColumn("cells", cells).withColumn("at", at.cast("int")).where("at > 0")
    return coded.select(*keep, F.get("cells", F.col("at") - 1).alias("code"), F.get("cells", F.col("at")).alias("name"), prices.alias("prices"))


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, pos (in the order of a file's lines) and line, as bytes, of all files at a path; line feeds are in no character of the encodings that `decoded` knows."""
    rows = spark.read.text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))  # a task reads its blocks in order
    return rows.select(F.col("_metadata.file_path").alias("file"), at.alias("pos"), F.col("value").cast("binary").alias("line"))


def decoded(lines: DataFrame) -> DataFrame:
    """file, pos, text and encoding of lines (file, pos, line as bytes), each file in the first encoding that all its lines are valid in: UTF-8, with or without a mark, Shift-JIS, its extension 932; lines of files that are none of these have no text.

    Files are looked at line by line, so that a large one is read by many tasks; what is valid UTF-8 never gets to Python.
    """
    rows = kept(lines.select("file", "pos", "line"), "lines")
    total = rows.count()
    files = rows.groupBy("file").agg(F.bool_and(F.is_valid_utf8(F.col("line").cast("string"))).alias("utf8"), F.min("pos").alias("first"))
    told = kept(spread_join(rows, files, ["file"], total=total), "lines-told")
    marked = F.when(F.col("pos") == F.col("first"), F.regexp_replace(F.col("line").cast("string"), "^\ufeff", "")).otherwise(F.col("line").cast("string"))
    good = told.where("utf8").select("file", "pos", marked.alias("text"), F.lit("utf-8").alias("encoding"))

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def read(line: bytes | None, encoding: str) -> str | None:
            try:
                return None if line is None else bytes(line).decode(encoding)
            except UnicodeDecodeError:
                return None

        for b in batches:
            yield b[["file", "pos"]].assign(**{e: [read(x, e) for x in b["line"]] for e in ("shift_jis", "cp932")})

    pos = rows.schema["pos"].dataType.simpleString()
    number = F.struct("pos").alias("pos") if not pos.startswith("struct") else F.col("pos")
    other = told.where("not utf8").select("file", number, "line")
    kind = other.schema["pos"].dataType.simpleString()
    both = kept(other.mapInPandas(tried, f"file {rows.schema['file'].dataType.simpleString()}, pos {kind}, shift_jis string, cp932 string"), "lines-tried")
    which = both.groupBy("file").agg(F.when(F.bool_and(F.col("shift_jis").isNotNull()), "shift_jis").when(F.bool_and(F.col("cp932").isNotNull()), "cp932").alias("encoding"))
    named = spread_join(both, which, ["file"])
    text = F.when(F.col("encoding") == "shift_jis", F.col("shift_jis")).when(F.col("encoding") == "cp932", F.col("cp932"))
    back = F.col("pos") if pos.startswith("struct") else F.col("pos.pos").alias("pos")
    return good.unionByName(named.select("file", back, text.alias("text"), "encoding"))


def csv_cells(line: Column) -> Column:
    """A line's cells, trimmed; quoted ones may have commas, and quotes in pairs; a quote that nothing closes is a character like others."""
    cells = F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    quoted = lambda c: F.replace(F.regexp_extract(c, '(?s)^\\s*"(.*)"\\s*$', 1), F.lit('""'), F.lit('"'))
    return F.transform(cells, lambda c: F.trim(F.when(c.rlike('(?s)^\\s*".*"\\s*$'), quoted(c)).otherwise(c)))


def area_prices(lines: DataFrame, prefectures: tuple[str, ...], low: int = 10_000, high: int = 500_000) -> DataFrame:
    """code, name, prefecture, total, one_room, two_rooms of lines (file, pos, text) of unknown layout: the first cell of five digits in one of the prefectures is the code, the next one the name, the first three whole numbers between low and high after it the prices. Lines of fewer than three cells, or without a price, don't count; of several lines of a code the last does."""
    cells = lines.select("file", "pos", csv_cells(F.coalesce("text", F.lit(""))).alias("cells")).where(F.size("cells") >= 3)
    at = F.array_position(F.transform("cells", lambda c: c.rlike("^[0-9]{5}$") & F.left(c, F.lit(2)).isin(*prefectures)), True).cast("int")
    number = lambda c: F.when(~F.replace(c, F.lit(","), F.lit("")).isin("", "-", "***", "…"), F.replace(c, F.lit(","), F.lit("")).try_cast("double").cast("long"))
    coded = cells.withColumn("at", at).where("at > 0").select("file", "pos", F.get("cells", F.col("at") - 1).alias("code"), F.coalesce(F.get("cells", F.col("at")), F.lit("")).alias("name"), F.filter(F.transform(F.slice("cells", F.col("at") + 2, F.size("cells")), number), lambda p: p.between(low, high)).alias("prices"))
    last = Window.partitionBy("code").orderBy(F.desc("file"), F.desc("pos"))
    once = coded.where(F.size("prices") > 0).withColumn("_rn", F.row_number().over(last)).where("_rn = 1")
    price = lambda i, n: F.get("prices", F.lit(i)).alias(n)
    return once.select("code", "name", F.left("code", F.lit(2)).alias("prefecture"), price(0, "total"), price(1, "one_room"), price(2, "two_rooms"))


def sane_number(cell: Column, least: float = 10_000) -> Column:
    """A cell as a number; null for the usual marks of nothing and for what isn't above least."""
    n = F.replace(F.trim(cell), F.lit(","), F.lit("")).try_cast("double")
    return F.when(~F.trim(cell).isin("-", "***", "…", "x", "") & (n > least), n)


def cube(rows: DataFrame, keys: list[str], category: str, value: str, names: dict[str, str]) -> DataFrame:
    """Rows of a statistical cube to a column per category."""
    wide = rows.groupBy(*keys).pivot(category, list(names)).agg(F.first(sane_number(F.col(value)), ignorenulls=True))
    return wide.select(*keys, *(F.col(c).alias(n) for c, n in names.items()))


def html_items(pages: DataFrame, key: str, html: str, item: str, fields: dict[str, str]) -> DataFrame:
    """A row per match of the item pattern, with a column per field pattern's first group; null where a field has no match."""
    items = pages.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(item), F.lit(0))).alias("pos", "item"))
    return items.select(key, "pos", *(F.when(F.col("item").rlike(p), F.regexp_extract("item", p, 1)).alias(n) for n, p in fields.items()))
