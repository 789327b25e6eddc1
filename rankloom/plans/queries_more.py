"""Queries on the smaller operators: parsing, choices, lists, orders, nested values, shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, rating
from ..functions import text as tx
from ..functions.rounding import tenth
from ..operators import documents, normalize, ranking
from ..sources.tables import table
from . import standins
from .standins import PLACES_SQL

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("q_regex_map", "select event_type, sum(regexp_extract(props, '\"(\\w+)\": (\\d+)', 2)::int)::bigint as total, min(regexp_extract(props, '\"(\\w+)\": (\\d+)', 1)) as name from events group by 1")
def regex_map(spark: SparkSession, sf: str) -> DataFrame:
    pair = F.lit(r'"(\w+)": (\d+)')
    pairs = F.map_from_arrays(F.regexp_extract_all("props", pair, F.lit(1)), F.transform(F.regexp_extract_all("props", pair, F.lit(2)), lambda v: v.cast("int")))
    rows = table(spark, sf, "events").select("event_type", F.explode(pairs).alias("name", "value"))
    return rows.groupBy("event_type").agg(F.sum("value").alias("total"), F.min("name").alias("name"))


@query("q_slug_harvest", "with w as (select page_id, unnest(regexp_extract_all(html, 'href=\"/([a-zA-Z]+)\"', 1)) as slug from pages) select page_id, count(distinct slug) as n, min(slug) as first from w where slug not in ('The', 'and') group by 1")
def slug_harvest(spark: SparkSession, sf: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="/([a-zA-Z]+)"'), F.lit(1)))
    kept = table(spark, sf, "pages").select("page_id", F.array_except(found, F.array(F.lit("The"), F.lit("and"))).alias("slugs"))
    return kept.where(F.size("slugs") > 0).select("page_id", F.size("slugs").cast("long").alias("n"), F.array_min("slugs").alias("first"))


@query("q_raster_lookup", f"with {PLACES_SQL}, r as (select s_suppkey, floor(35.5::double * 100 + (s_suppkey % 97) * 0.5::double)::int as cy, s_acctbal from supplier), c as (select cy, max(floor(s_acctbal + 0.5)) as v from r group by 1) select k, v as value from places left join c on floor(35.5::double * 100 + (k % 97) * 0.5::double)::int = cy")
def raster_lookup(spark: SparkSession, sf: str) -> DataFrame:
    cell = lambda k: F.floor(3550.0 + (k % 97) * 0.5).cast("int")
    cells = table(spark, sf, "supplier").groupBy(cell(F.col("s_suppkey")).alias("cell")).agg(F.max(F.floor(F.col("s_acctbal") + 0.5)).cast("double").alias("value"))
    return standins.places(spark, sf).select("k", cell(F.col("k")).alias("cell")).join(cells, "cell", "left").select("k", "value")


@query("q_license_ok", "select p_partkey from part where p_type = '' or contains(lower(p_type), 'eco') or contains(lower(p_type), 'small')")
def license_ok(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(documents.license_ok(F.col("p_type"), ["eco", "small"])).select("p_partkey")


@query("q_face_flag", "select l_orderkey as k, bool_or(l_discount >= 0.09 or l_tax >= 0.07) as flagged, max(floor(l_tax * 100 + 0.5)::int) as most, count(*) as n from lineitem group by 1")
def face_flag(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct(F.col("l_discount").alias("area_ratio"), F.col("l_tax").alias("confidence")).alias("face"))
    lists = rows.groupBy("k").agg(F.collect_list("face").alias("faces"))
    most = F.array_max(F.transform("faces", lambda f: F.floor(f["confidence"] * 100 + 0.5))).cast("int")
    return lists.select("k", documents.face_flag(F.col("faces"), 0.09, 0.07).alias("flagged"), most.alias("most"), F.size("faces").cast("long").alias("n"))


@query("q_key_prefix", "select c_custkey as k from customer where c_name not like 'Customer#00000000%'")
def key_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where(~F.col("c_name").startswith("Customer#00000000")).select(F.col("c_custkey").alias("k"))


@query("q_point_lookup", "select c_custkey as k, c_name as name from customer where c_custkey = 42")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where("c_custkey = 42").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))


@query("q_inclusion_rule", f"with {PLACES_SQL} select k from places where pref in (0, 1, 2) and ((pref = 0 and lines >= 2) or lines >= 3 or segment = 'MACHINERY')")
def inclusion_rule(spark: SparkSession, sf: str) -> DataFrame:
    enough = ((F.col("pref") == 0) & (F.col("lines") >= 2)) | (F.col("lines") >= 3) | (F.col("segment") == "MACHINERY")
    return standins.places(spark, sf).where(F.col("pref").isin(0, 1, 2) & enough).select("k")


@query("q_static_params", "select c_custkey as k, locale from customer, (select unnest(['en', 'ja', 'ru']) as locale)")
def static_params(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.array(*map(F.lit, ("en", "ja", "ru")))).alias("locale"))


@query("q_provenance", f"with {PLACES_SQL} select k, array_to_string(list_filter([case when coalesce(view, 0) > 0 then 'guide' end, case when coalesce(purchase, 0) > 0 then 'map' end, case when rent_1k is not null then 'rents' end], lambda x: x is not null), ',') as sources from places")
def provenance(spark: SparkSession, sf: str) -> DataFrame:
    named = rating.sources(guide=rating.known(F.col("view")) > 0, map=rating.known(F.col("purchase")) > 0, rents=F.col("rent_1k").isNotNull())
    return standins.places(spark, sf).select("k", F.array_join(named, ",").alias("sources"))


@query("q_distance_bands", f"with {PLACES_SQL} select k, case when km < 5 then 9 when km < 10 then 7 when km < 20 then 5 when km < 35 then 4 else 2 end as rating, greatest(3, floor(km * 3 + 0.5))::bigint as minutes from places")
def distance_bands(spark: SparkSession, sf: str) -> DataFrame:
    bands = rating.band_rating(F.col("km"), ((5.0, 9), (10.0, 7), (20.0, 5), (35.0, 4)), 2)
    return standins.places(spark, sf).select("k", bands.alias("rating"), geo.crude_minutes(F.col("km")).alias("minutes"))


@query("q_area_sum", "with e as (select distinct l_orderkey as k, l_partkey as id, l_linenumber % 3 as a, l_linenumber % 2 as b from lineitem), d as (select * from e qualify row_number() over (partition by k, id order by a, b) = 1) select k, sum(floor(0.001::double * (a + 1) * 111000 * (0.002::double * (b + 1) * 111000 * 0.82::double) + 0.5)::bigint)::bigint as area, count(*) filter (a >= 1) as large from d group by 1")
def area_sum(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("id"), (F.col("l_linenumber") % 3).alias("a"), (F.col("l_linenumber") % 2).alias("b"))
    once = ranking.best_of_each(e, ["k", "id"], ["a", "b"])
    zero = F.lit(0.0)
    area = F.floor(geo.bbox_area(zero, zero, 0.001 * (F.col("a") + 1), 0.002 * (F.col("b") + 1), F.lit(0.82)) + 0.5)
    return once.groupBy("k").agg(F.sum(area).alias("area"), F.count_if(F.col("a") >= 1).alias("large"))


@query("q_composed_order", "select p_partkey, (row_number() over (partition by p_brand order by case p_type when 'SMALL' then 0 when 'ECONOMY' then 1 else 2 end, p_name, p_partkey))::int as place from part")
def composed_order(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("p_type") == "SMALL", 0).when(F.col("p_type") == "ECONOMY", 1).otherwise(2)
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", kind.alias("kind"))
    placed = normalize.running(rows, ["p_brand"], ["kind", "p_name", "p_partkey"], F.lit(1), "before")
    return placed.select("p_partkey", (F.col("before") + 1).cast("int").alias("place"))


@query("q_collapsed_list", "with l as (select l_orderkey as k, list(l_partkey order by l_linenumber, l_partkey) as parts from lineitem group by 1) select k, array_to_string(case when len(parts) >= 6 then parts[1:4] else parts end, ',') as shown from l")
def collapsed_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("parts"))
    shown = F.when(F.size("parts") >= 6, F.slice("parts", 1, 4)).otherwise(F.col("parts"))
    return rows.select("k", F.array_join(F.transform(shown, lambda p: p.cast("string")), ",").alias("shown"))


@query("q_alternative_key", "with c as (select c_custkey as k, unnest([c_custkey * 7 + 1, c_custkey * 3, c_custkey]) as key, generate_subscripts([1, 2, 3], 1) as ord from customer), m as (select k, ord, s_suppkey from c join supplier on key = s_suppkey qualify row_number() over (partition by k order by ord) = 1) select k, ord::int as ord, s_suppkey from m")
def alternative_key(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    keys = table(spark, sf, "customer").select(k.alias("k"), F.posexplode(F.array(k * 7 + 1, k * 3, k)).alias("pos", "s_suppkey"))
    hits = keys.join(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey").withColumn("ord", F.col("pos") + 1)
    return ranking.best_of_each(hits, ["k"], ["ord"]).select("k", "ord", "s_suppkey")


@query("q_point_in_polygon", f"with {PLACES_SQL} select k from places where lat > 35.6 and lat < 35.8 and lng > 139.5 and lng < 139.8 and (lat - 35.6) / 0.2::double < (lng - 139.5) / 0.3::double")
def point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    ring = F.array(*(F.struct(F.lit(y).alias("lat"), F.lit(x).alias("lon")) for y, x in ((35.6, 139.5), (35.6, 139.8), (35.8, 139.8))))
    near = standins.places(spark, sf).where("lat > 35.6 and lat < 35.8 and lng > 139.5 and lng < 139.8")
    return near.where(geo.inside_ring(F.col("lat"), F.col("lng"), ring)).select("k")


@query("q_compact_json", "select c_custkey as k, case when c_custkey % 4 = 0 and c_custkey % 3 = 0 then '{}' when c_custkey % 4 = 0 then '{\"b\":' || c_custkey % 3 || '}' when c_custkey % 3 = 0 then '{\"a\":' || c_custkey % 4 || '}' else '{\"a\":' || c_custkey % 4 || ',\"b\":' || c_custkey % 3 || '}' end as doc from customer")
def compact_json(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("k"), documents.compact_json(a=k % 4, b=k % 3).alias("doc"))


@query("q_widest_image", "select l_orderkey as k, 'https://i/' || max_by(l_partkey, l_quantity * 1000000 + l_partkey) as url from lineitem group by 1")
def widest_image(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct((F.col("l_quantity") * 1_000_000 + F.col("l_partkey")).alias("width"), F.concat(F.lit("//i/"), F.col("l_partkey").cast("string")).alias("url")).alias("image"))
    return rows.groupBy("k").agg(F.collect_list("image").alias("images")).select("k", documents.widest(F.col("images")).alias("url"))


@query("q_id_from_url", "select page_id, coalesce(nullif(regexp_extract(url, '/(\\d+)\\?', 1), ''), nullif(regexp_extract(url, '/(\\d+)', 1), '')) as id from pages")
def id_from_url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.first_of(F.regexp_extract("url", r"/(\d+)\?", 1), F.regexp_extract("url", r"/(\d+)", 1)).alias("id"))


@query("q_joined_parts", "select c_custkey as k, concat_ws(' ', nullif(case when c_custkey % 2 = 0 then '' else n_name end, ''), c_mktsegment) as label from customer join nation on c_nationkey = n_nationkey")
def joined_parts(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    df = table(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    first = F.nullif(F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("n_name")), F.lit(""))
    return df.select(F.col("c_custkey").alias("k"), F.concat_ws(" ", first, "c_mktsegment").alias("label"))


@query("q_group_fan_back", "with a as (select p_brand, trunc(median(p_retailprice))::int as price from part group by 1) select p_partkey, price from part join a using (p_brand)")
def group_fan_back(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    return p.join(p.groupBy("p_brand").agg(F.median("p_retailprice").cast("int").alias("price")), "p_brand").select("p_partkey", "price")


@query("q_precedence", f"with {PLACES_SQL} select k, coalesce(rent_1k, 90000 + (k % 9)::int * 1000, 0)::int as rent, case when rent_1k is not null then 'measured' else 'estate' end as origin from places")
def precedence(spark: SparkSession, sf: str) -> DataFrame:
    other = (90_000 + (F.col("k") % 9) * 1000).cast("int")
    return standins.places(spark, sf).select("k", F.coalesce("rent_1k", other, F.lit(0)).alias("rent"), F.when(F.col("rent_1k").isNotNull(), "measured").otherwise("estate").alias("origin"))


@query("q_truth_join", "with t as (select c_custkey as k, unnest(['a', 'b']) as hub, unnest([c_custkey % 5, c_custkey % 7]) as truth from customer), e as (select user_id as k, case when event_type = 'view' then 'a' else 'b' end as hub, count(*) as est from events where event_type in ('view', 'click') group by 1, 2) select k, hub, truth, est from t join e using (k, hub) where truth > 0")
def truth_join(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    truth = table(spark, sf, "customer").select(k.alias("k"), (k % 5).alias("a"), (k % 7).alias("b")).unpivot(["k"], ["a", "b"], "hub", "truth").where("truth > 0")
    e = table(spark, sf, "events").where(F.col("event_type").isin("view", "click"))
    est = e.groupBy(F.col("user_id").alias("k"), F.when(F.col("event_type") == "view", "a").otherwise("b").alias("hub")).agg(F.count("*").alias("est"))
    return truth.join(est, ["k", "hub"])


@query("q_document_template", "select doc_id, '# ' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || text as body from documents")
def document_template(spark: SparkSession, sf: str) -> DataFrame:
    body = F.format_string("# %d\nlang: %s\n%s", F.col("doc_id"), F.col("lang"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", body.alias("body"))


@query("q_mean_positive", f"with {PLACES_SQL} select k, floor(list_avg(list_filter([view, purchase, click], lambda x: x > 0)) + 0.5)::bigint as mean from places")
def mean_positive(spark: SparkSession, sf: str) -> DataFrame:
    some = F.filter(F.array("view", "purchase", "click"), lambda x: x > 0)
    mean = F.when(F.size(some) > 0, F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(some))
    return standins.places(spark, sf).select("k", F.floor(mean + 0.5).alias("mean"))


@query("q_crime_rate", "select s_suppkey as k, case when s_suppkey % 6 > 0 then floor((s_nationkey * 3)::double / ((s_suppkey % 6) * 1000) * 10000 * 10 + 0.5) / 10 else 0.0 end::double as rate from supplier")
def crime_rate(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("k"), rating.per_10k(F.col("s_nationkey") * 3, (k % 6) * 1000).alias("rate"))


@query("q_rollup", "select c_nationkey as area, c_mktsegment as segment, count(*) as n from customer group by rollup (c_nationkey, c_mktsegment)")
def rollup(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("area"), F.col("c_mktsegment").alias("segment"))
    return c.rollup("area", "segment").agg(F.count("*").alias("n"))


@query("q_outlier_tags", "select p_partkey, floor((p_retailprice - 900) / 10.0::double * 10 + 0.5) / 10 as score from part where p_size between 35 and 55 or p_type = 'SMALL'")
def outlier_tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.col("p_size").between(35, 55) | (F.col("p_type") == "SMALL")).select("p_partkey", tenth((F.col("p_retailprice") - 900) / 10).alias("score"))
