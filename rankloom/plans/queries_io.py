"""Queries that write tables and files in the shared folder and read them back: CSV, JSON, appends, resumed files, rejects; and on links, presets, distances and colours."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color, geo, rating
from ..functions.rounding import places as to_places
from ..operators import ranking
from ..sources import readers, sinks
from ..sources.stages import fresh, kept
from ..sources.tables import table
from ..streaming import incremental
from . import spec, standins
from .spec import CATEGORIES, DEFAULT_WEIGHTS, LEGACY_ORDER, PRESETS, Filters
from .standins import CENTER_LAT, CENTER_LNG, PLACES_SQL, RATINGS_SQL, km_sql, score_sql

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("area"))


# --- files ----------------------------------------------------------------------------------------------------------


@query("q_csv_scan", "select c_custkey as k, c_nationkey as area, c_name || ', \"' || c_nationkey || '\"' as name from customer where c_custkey % 7 > 0 and c_custkey % 11 > 0")
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Files with quotes, commas, numbers that aren't any, and missing values; the first of two paths doesn't exist."""
    path, k = fresh(spark, "csv"), F.col("k")
    area = F.when(k % 7 == 0, "not a number").when(k % 11 == 0, "").otherwise(F.col("area").cast("string"))
    rows = customers(spark, sf).select(k.cast("string").alias("k"), area.alias("area"), F.concat("name", F.lit(', "'), F.col("area").cast("string"), F.lit('"')).alias("name"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    found = readers.first_existing(spark, [f"{path}-none", path])
    return readers.csv_rows(spark, found, "k long, area int, name string", ["area"], escape='"')


@query("q_json_arrays", "select c_custkey as k, c_name as name from customer where c_custkey % 9 > 0")
def json_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Files that are one JSON array each, of five hundred keys at most."""
    path = fresh(spark, "arrays")
    block = F.floor(F.col("k") / 500)
    rows = customers(spark, sf).where("k % 9 > 0").withColumn("block", block).groupBy("block").agg(F.collect_list(F.struct("k", "name")).alias("rows"))
    sinks.documents(rows, path, F.to_json("rows"), "block")
    return readers.json_table(spark, path, "k long, name string").select("k", "name")


@query("q_ordered_json", "select c_nationkey as area, count(*) as n, min(c_custkey) as first, true as ordered from customer group by 1")
def ordered_json(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines in order of the key: no line of a file is before the one above it."""
    path = fresh(spark, "ordered")
    sinks.ordered_json(customers(spark, sf), path, "k")
    lines = spark.read.schema("k long, area int").json(path).select("k", "area", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("k").over(Window.partitionBy("file").orderBy("at"))
    return lines.withColumn("ok", F.coalesce(F.col("k") > before, F.lit(True))).groupBy("area").agg(F.count("*").alias("n"), F.min("k").alias("first"), F.bool_and("ok").alias("ordered"))


@query("q_appended_rows", "select c_nationkey as area, count(*) + count(*) filter (c_custkey % 10 = 0) as n from customer group by 1")
def appended_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Inserts in two parts; what is inserted again is there twice."""
    path, rows = fresh(spark, "appended"), customers(spark, sf)
    for part in ("k % 2 = 0", "k % 2 = 1", "k % 10 = 0"):
        sinks.append(rows.where(part), path)
    return spark.read.schema(rows.schema).parquet(path).groupBy("area").agg(F.count("*").alias("n"))


@query("q_resumed_files", "select c_nationkey as area, count(*) as n, sum(c_custkey) as keys from customer group by 1")
def resumed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files come in two steps and are taken over in three runs: each once."""
    source, target, rows = fresh(spark, "files"), fresh(spark, "taken"), customers(spark, sf)
    for part in ("k % 3 = 0", "k % 3 > 0", None):
        if part:
            rows.where(part).write.mode("append").parquet(source)
        incremental.append_new_files(spark, source, "k long, name string, area int", target, f"{target}-log")
    return spark.read.schema(rows.schema).parquet(target).groupBy("area").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@query("q_valid_and_rejected", """with d as (select doc_id as k, case when trim(coalesce(text, '')) = '' then 'empty' end as a, case when length(text) > 2000 then 'long' end as b, case when lang = 'fr' then 'lang' end as c from documents)
    select case when coalesce(a, b, c) is null then 'good' else 'bad' end as kind, k, array_to_string(list_filter([a, b, c], lambda x: x is not null), ',') as issues from d
    union all select 'counts', count(*) filter (coalesce(a, b, c) is null), count(*) filter (coalesce(a, b, c) is not null) || ' of ' || count(*) from d""")
def valid_and_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without issues, those with some and what these are, and how many there are of both."""
    path = fresh(spark, "checked")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), "text", "lang")
    issues = F.array_compact(F.array(F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty"), F.when(F.length("text") > 2_000, "long"), F.when(F.col("lang") == "fr", "lang")))
    sinks.split_valid(docs, issues, f"{path}/good", f"{path}/bad")
    good, bad = (spark.read.parquet(f"{path}/{kind}") for kind in ("good", "bad"))
    rows = good.select(F.lit("good").alias("kind"), "k", F.lit("").alias("issues")).unionByName(bad.select(F.lit("bad").alias("kind"), "k", F.array_join("issues", ",").alias("issues")))
    n = sinks.with_counts(rows, F.col("kind") == "good")
    return rows.unionByName(n.select(F.lit("counts").alias("kind"), F.col("valid").alias("k"), F.concat(F.col("invalid").cast("string"), F.lit(" of "), F.col("total").cast("string")).alias("issues")))


# --- links, presets, distances, colours -----------------------------------------------------------------------------


def _ordered_sql(order: tuple[str, ...], n: int) -> str:
    return "[" + ", ".join(f"ws[{order.index(c) + 1}]" if c in order[:n] else str(DEFAULT_WEIGHTS[c]) for c in CATEGORIES) + "]"


@query("q_shared_links", f"""with b as (select c_custkey as k, list_transform(range(10), lambda i: (c_custkey + i * 7) % 23) as ws, 60000 + c_custkey % 30 * 10000 as mr, c_custkey % 13 as cm from customer),
    w as (select k, mr, cm, case when k % 7 = 0 then null when k % 3 = 0 then {_ordered_sql(LEGACY_ORDER, 9)} when k % 3 = 1 then ws end as w from b)
    select k, array_to_string(list_filter([case when w is not null and w <> {[DEFAULT_WEIGHTS[c] for c in CATEGORIES]} then 'w=' || array_to_string(w, '%2C') end, case when mr between 80000 and 290000 then 'mr=' || mr end, case when cm between 1 and 10 then 'cm=food%3A' || cm end,
        case when k % 5 = 0 then 'c=a%2Cb' end, case when k % 6 = 0 then 'hm=1' end], lambda x: x is not null), '&') as link from w""")
def shared_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links as they come, old and broken ones too, to what they mean, written anew."""
    k = F.col("k")
    weight = lambda i: ((k + i * 7) % 23).cast("string")
    nine = F.array_join(F.array(*(weight(i) for i in range(9))), ",")
    weights = F.when(k % 7 == 0, F.concat(nine, F.lit(",x"))).when(k % 3 == 0, nine).when(k % 3 == 1, F.concat_ws(",", nine, weight(9))).otherwise(F.array_join(F.array(*(weight(i) for i in range(8))), ","))
    link = F.concat(F.lit("?w="), weights, F.lit("&mr="), (60_000 + k % 30 * 10_000).cast("string"), F.lit("&cm=food:"), (k % 13).cast("string"), F.lit(",zzz:5"), F.when(k % 5 == 0, "&c=a,,b").otherwise(""), F.when(k % 6 == 0, "&hm=1").otherwise("&hm=0"))
    cloudpickle.register_pickle_by_value(spec)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["k"]].assign(link=[spec.encode(spec.QuerySpec().hydrated(spec.decode(x))) for x in b["link"]])

    return customers(spark, sf).select("k", link.alias("link")).mapInPandas(read, "k long, link string")


def _preset_sql(name: str) -> str:
    weights, f = PRESETS[name]
    tests = [f"(rent_1k is null or rent_1k <= {f['max_rent']})"] if "max_rent" in f else []
    tests += [f"(min_transit is null or min_transit <= {f['max_commute']})"] if "max_commute" in f else []
    tests += [f"({c} is null or {c} >= {v})" for c, v in f.get("minimums", {}).items()]
    return f"select '{name}' as preset, k, {score_sql(weights)} as score from ratings where {' and '.join(tests)}"


@query("q_presets", f"with {RATINGS_SQL} " + " union all ".join(_preset_sql(n) for n in PRESETS))
def presets(spark: SparkSession, sf: str) -> DataFrame:
    """What passes each preset, set after another one whose weights and filters must not stay, with its score."""
    rows, out = kept(standins.ratings(spark, sf), "ratings"), None
    for name in PRESETS:
        q = spec.reduced(spec.reduced(spec.QuerySpec(filters=Filters(camera=True)), "preset", "family"), "preset", name)
        score = rating.weighted_score({c: F.col(c) for c in CATEGORIES}, q.weights)
        part = ranking.dealbreakers(rows, q.filters).select(F.lit(name).alias("preset"), "k", score.alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


@query("q_distances", f"with {PLACES_SQL} select k, floor(({km_sql('lat', 'lng', '35.6812::double', '139.7671::double')}) * 1e6 + 0.5) / 1e6 as km, floor(({km_sql('lat', 'lng', '35.6812::double', '139.7671::double')}) * 1000 * 1000 + 0.5) / 1000 as metres from places")
def distances(spark: SparkSession, sf: str) -> DataFrame:
    """Kilometres by the arc tangent, metres by the arc sine."""
    here = (F.col("lat"), F.col("lng"), F.lit(CENTER_LAT), F.lit(CENTER_LNG))
    return standins.places(spark, sf).select("k", to_places(geo.haversine_km_atan(*here), 6).alias("km"), to_places(geo.haversine_m(*here), 3).alias("metres"))


@query("q_darkened", "select c_custkey as k, 'rgb(' || floor(c_custkey % 256 * 0.7::double + 0.5)::int || ', ' || floor(c_custkey * 7 % 256 * 0.7::double + 0.5)::int || ', ' || floor(c_nationkey * 0.7::double + 0.5)::int || ')' as dark from customer")
def darkened(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda c: c.cast("string")
    rgb = F.concat(F.lit("rgb("), part(F.col("k") % 256), F.lit(", "), part(F.col("k") * 7 % 256), F.lit(", "), part(F.col("area")), F.lit(")"))
    return customers(spark, sf).select("k", color.darkened(rgb, 0.7).alias("dark"))
