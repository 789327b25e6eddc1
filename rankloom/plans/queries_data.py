"""Queries on joins, aggregates, space, graphs, lists and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as tx
from ..functions.rounding import places as to_places
from ..functions.rounding import tenth
from ..operators import graph, joins, normalize, ranking, spatial
from ..sources.stages import kept
from ..sources.tables import table
from . import standins
from .standins import PLACES_SQL, km_sql

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def own_rent(spark: SparkSession, sf: str) -> DataFrame:
    return standins.places(spark, sf).select("k", "area", "segment", "km", "rent_1k")


# --- the fallback chain ---------------------------------------------------------------------------------------------

FIT_SQL = "fit as (select case when count(*) < 10 then ln(230000.0::double) when coalesce(var_pop(km), 0) = 0 then avg(ln(rent_1k)) else regr_intercept(ln(rent_1k), km) end as a, case when count(*) < 10 then -0.025 when coalesce(var_pop(km), 0) = 0 then 0.0 else regr_slope(ln(rent_1k), km) end::double as b, count(*) as n from places where rent_1k > 0)"


def fitted(rents: DataFrame) -> DataFrame:
    """One row a, b, n: ln(rent) = a + b km; defaults with fewer than ten rows, no slope without spread."""
    y, x = F.ln("rent_1k"), F.col("km")
    few, flat = F.count("*") < 10, F.coalesce(F.var_pop(x), F.lit(0.0)) == 0
    a = F.when(few, F.ln(F.lit(230_000.0))).when(flat, F.avg(y)).otherwise(F.regr_intercept(y, x))
    b = F.when(few, F.lit(-0.025)).when(flat, F.lit(0.0)).otherwise(F.regr_slope(y, x))
    return rents.where("rent_1k > 0").agg(a.alias("a"), b.alias("b"), F.count("*").alias("n"))


@query("q_rent_regression", f"with {PLACES_SQL}, {FIT_SQL} select floor(a * 1e6 + 0.5) / 1e6 as a, floor(b * 1e6 + 0.5) / 1e6 as b, n from fit")
def rent_regression(spark: SparkSession, sf: str) -> DataFrame:
    return fitted(own_rent(spark, sf)).select(to_places(F.col("a"), 6).alias("a"), to_places(F.col("b"), 6).alias("b"), "n")


@query("q_ward_average", f"with {PLACES_SQL} select area, segment, trunc(avg(rent_1k))::int as average from places where rent_1k > 0 group by area, segment")
def ward_average(spark: SparkSession, sf: str) -> DataFrame:
    return averages(own_rent(spark, sf))


def averages(rents: DataFrame) -> DataFrame:
    return rents.where("rent_1k > 0").groupBy("area", "segment").agg(F.avg("rent_1k").cast("int").alias("average"))


@query("q_fallback_chain", f"""with {PLACES_SQL}, {FIT_SQL}, w as (select area, segment, trunc(avg(rent_1k))::int as average from places where rent_1k > 0 group by 1, 2)
    select k, floor(coalesce(rent_1k, average, exp(a + b * km)) + 0.5)::bigint as price, case when rent_1k is not null then 'measured' when average is not null then 'ward_average' else 'distance_regression' end as price_source,
        case when rent_1k is not null then 2 when average is not null then 1 else 0 end as price_quality from places left join w using (area, segment), fit""")
def fallback_chain(spark: SparkSession, sf: str) -> DataFrame:
    rents = own_rent(spark, sf)
    df = rents.join(averages(rents), ["area", "segment"], "left").crossJoin(F.broadcast(fitted(rents)))
    steps = [("measured", F.col("rent_1k").cast("double"), 2), ("ward_average", F.col("average").cast("double"), 1), ("distance_regression", F.exp(F.col("a") + F.col("b") * F.col("km")), 0)]
    return joins.fallback(df, "price", steps).select("k", F.floor(F.col("price") + 0.5).alias("price"), "price_source", "price_quality")


# --- joins ----------------------------------------------------------------------------------------------------------


@query("q_left_multiway", """with act as (select user_id, count(*) as n from events group by 1), o as (select o_custkey, count(*) as orders from orders group by 1)
    select c_custkey as k, n_name as area_name, coalesce(n, 0) as events, coalesce(orders, 0) as orders from customer left join nation on c_nationkey = n_nationkey left join act on c_custkey = user_id left join o on c_custkey = o_custkey""")
def left_multiway(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer").select("c_custkey", "c_nationkey"), table(spark, sf, "nation").select("n_nationkey", "n_name")
    act = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("events"))
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    df = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(act, c.c_custkey == act.user_id, "left").join(o, c.c_custkey == o.o_custkey, "left")
    return df.select(F.col("c_custkey").alias("k"), F.col("n_name").alias("area_name"), F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("orders", F.lit(0)).alias("orders"))


@query("q_full_outer_env", "with a as (select c_custkey as k, (c_custkey % 40) * 1.0::double as elevation from customer where c_acctbal > 0), b as (select user_id as k, count(*) as n from events where event_type = 'error' group by 1) select coalesce(a.k, b.k) as k, elevation, n from a full join b on a.k = b.k")
def full_outer_env(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), ((F.col("c_custkey") % 40) * 1.0).alias("elevation"))
    b = table(spark, sf, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("n"))
    return a.join(b, "k", "full").where("elevation is not null or n is not null").select("k", "elevation", "n")


@query("q_semi_known", "select doc_id, lang from documents where doc_id in (select doc_id from labels)")
def semi_known(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query("q_anti_incremental", "select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def anti_incremental(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("q_anti_composite", "select l_orderkey, l_linenumber from lineitem l where not exists (select 1 from lineitem r where r.l_returnflag = 'R' and r.l_orderkey = l.l_orderkey and r.l_linenumber = l.l_linenumber)")
def anti_composite(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    flagged = rows.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    return rows.select("l_orderkey", "l_linenumber").join(flagged, ["l_orderkey", "l_linenumber"], "left_anti")


@query("q_explode_lookup_regroup", """with l as (select l_orderkey as k, l_linenumber as pos, l_suppkey from lineitem), j as (select k, pos, s_name from l join supplier on l_suppkey = s_suppkey where s_acctbal > 3000)
    select b.k, coalesce(array_to_string(list(s_name order by pos, s_name) filter (s_name is not null), ','), '') as names from (select distinct k from l) b left join j on b.k = j.k group by b.k""")
def explode_lookup_regroup(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.col("l_suppkey").alias("s_suppkey"))
    lists = items.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "s_suppkey"))), lambda s: s["s_suppkey"]).alias("items"))
    lookup = table(spark, sf, "supplier").where("s_acctbal > 3000").select("s_suppkey", "s_name")
    return joins.lookup_list(lists, "k", "items", lookup, "s_suppkey", "s_name", "names").select("k", F.array_join("names", ",").alias("names"))


@query("q_first_match", "select c_custkey as k, o_orderkey from customer left join (select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1) on c_custkey = o_custkey")
def first_match(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return joins.first_match(c, o, "k", ["o_orderkey"])


CASCADE_SQL = """with p as (select p_partkey as k, p_name as name, split_part(p_name, ' ', 1) as city, split_part(p_name, ' ', 2) as ward from part),
    a as (select min(p_partkey) as code, p_name as area_name from part where p_size <= 7 group by p_name union all select 1000000 + min(p_partkey), split_part(p_name, ' ', 2) from part where p_size between 8 and 11 group by 2 union all select 2000000 + min(p_partkey), left(p_name, 3) from part where p_size > 45 group by 2),
    m as (select k, code, 1 as tier, code as ord from p join a on name = area_name union all select k, code, 2, -code from p join a on ward = area_name union all select k, code, 3, code from p join a on length(area_name) >= 2 and contains(name, area_name)),
    b as (select k, code, tier from m qualify row_number() over (partition by k order by tier, ord) = 1) select p.k, code, tier from p left join b using (k)"""


@query("q_cascade_match", CASCADE_SQL)
def cascade_match(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    word = lambda i: F.get(F.split("p_name", " "), F.lit(i))
    # names are matched once each, and in tasks of so many that their pieces stay few
    names = kept(part.select(F.col("p_name").alias("name"), word(1).alias("ward")).distinct(), "names")
    p = names.repartition(max(names.count() // 50_000, int(spark.conf.get("spark.sql.shuffle.partitions"))), "name")
    area = lambda test, name, add: part.where(test).groupBy(name.alias("area_name")).agg((F.min("p_partkey") + add).alias("code"))
    areas = area("p_size <= 7", F.col("p_name"), 0).unionByName(area("p_size between 8 and 11", word(1), 1_000_000)).unionByName(area("p_size > 45", F.left("p_name", F.lit(3)), 2_000_000))
    exact = p.join(areas, F.col("name") == F.col("area_name")).select("name", "code")
    ward = p.join(areas, F.col("ward") == F.col("area_name")).select("name", "code")
    # containment without a product of the tables: the stretches of a name that are as long as some area's, then an equi-join
    lengths = areas.where(F.length("area_name") >= 2).agg(F.collect_set(F.length("area_name")).alias("lengths"))  # one row
    sized = p.select("name").crossJoin(F.broadcast(lengths)).select("name", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("name"))
    pieces = sized.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("name") - F.col("n") + 1), lambda i: F.substring("name", i, F.col("n")))).alias("area_name")).distinct()
    within = pieces.join(areas, "area_name").select("name", "code")
    # orders are text that sorts like the number
    up, down = F.lpad(F.col("code").cast("string"), 12, "0"), F.lpad((10**11 - F.col("code")).cast("string"), 12, "0")
    best = joins.cascade(p.select("name"), "name", [(exact, up), (ward, down), (within, up)], ["code"])
    return part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")).join(best, "name", "left").select("k", "code", "tier")


@query("q_overlay_merge", "select doc_id, quality::int as value, 'own' as origin from labels union all select doc_id, 1, 'filled' from documents where doc_id not in (select doc_id from labels)")
def overlay_merge(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("value"), F.lit("own").alias("origin"))
    more = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("value"), F.lit("filled").alias("origin"))
    return joins.overlay(own, more, "doc_id")


@query("q_editorial_merge", """with a as (select doc_id, quality as ai from labels), c as (select doc_id, (doc_id % 2)::int as comp, case when doc_id % 3 = 0 then 'strong' else 'moderate' end as conf from documents)
    select c.doc_id, coalesce(ai, comp) as rating, case when ai is null or ai = comp then conf else 'editorial' end as confidence from c left join a using (doc_id)""")
def editorial_merge(spark: SparkSession, sf: str) -> DataFrame:
    ai = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("ai"))
    computed = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("comp"), F.when(F.col("doc_id") % 3 == 0, "strong").otherwise("moderate").alias("conf"))
    df = computed.join(ai, "doc_id", "left")
    return df.select("doc_id", F.coalesce("ai", "comp").alias("rating"), F.when(F.col("ai").isNull() | (F.col("ai") == F.col("comp")), F.col("conf")).otherwise("editorial").alias("confidence"))


@query("q_key_redirect", "select c_custkey as k, coalesce(m.new, c_custkey) as now from customer left join (select s_suppkey as old, s_suppkey + 1000000 as new from supplier) m on c_custkey = m.old")
def key_redirect(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("now"))
    renames = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") + 1_000_000).alias("new"))
    return joins.redirected(c, renames, "now")


# --- space and graphs -----------------------------------------------------------------------------------------------

S_LAT, S_LNG = "(35.5::double + (s_suppkey % 97) * 0.005::double)", "(139.4::double + (s_suppkey % 89) * 0.007::double)"


def points(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("p"), standins.lat(F.col("s_suppkey")).alias("r_lat"), standins.lng(F.col("s_suppkey")).alias("r_lng"), F.col("s_nationkey").alias("p_area"))


@query("q_radius_join", f"with {PLACES_SQL}, j as (select k, s_suppkey as p, {km_sql('lat', 'lng', S_LAT, S_LNG)} as d from places, supplier) select k, p, floor(d * 1e6 + 0.5) / 1e6 as km from j where d <= 1.0")
def radius_join(spark: SparkSession, sf: str) -> DataFrame:
    left = standins.places(spark, sf).select("k", "lat", "lng")
    return spatial.radius_join(left, points(spark, sf), 1.0).select("k", "p", to_places(F.col("km"), 6).alias("km"))


@query("q_count_near", f"with {PLACES_SQL}, j as (select k, s_suppkey as p, {km_sql('lat', 'lng', S_LAT, S_LNG)} as d from places, supplier) select b.k, count(p) as near, count(p) filter (p % 2 = 0) as near_even from places b left join (select * from j where d <= 1.5) j on b.k = j.k group by b.k")
def count_near(spark: SparkSession, sf: str) -> DataFrame:
    left = standins.places(spark, sf).select("k", "lat", "lng")
    return spatial.count_near(left, points(spark, sf), 1.5, near=F.lit(True), near_even=F.col("p") % 2 == 0).select("k", "near", "near_even")


@query("q_nearest_area", f"with {PLACES_SQL}, j as (select k, s_suppkey as p, sqrt(power(lat - {S_LAT}, 2) + power(lng - {S_LNG}, 2)) as d from places join supplier on area = s_nationkey) select k, p, floor(d * 1e6 + 0.5) / 1e6 as degrees from j qualify row_number() over (partition by k order by d, p) = 1")
def nearest_area(spark: SparkSession, sf: str) -> DataFrame:
    left = standins.places(spark, sf).select("k", "area", "lat", "lng")
    areas = points(spark, sf).select("p", F.col("r_lat").alias("a_lat"), F.col("r_lng").alias("a_lng"), F.col("p_area").alias("area"))
    return spatial.nearest_in(left, areas, "area", "k", "p").select("k", "p", to_places(F.col("degrees"), 6).alias("degrees"))


SPEED_SQL = "case when km < 5 then 25.0 when km < 15 then 32.0 when km < 35 then 38.0 else 48.0 end::double"


@query("q_hub_times", f"with {PLACES_SQL}, h as (select k, s_suppkey as hub, {km_sql('lat', 'lng', S_LAT, S_LNG)} as km, (k + s_suppkey) % 3 as t from places, supplier where s_suppkey < 5) select k, hub, greatest(3, round_even(km * 1.30::double / {SPEED_SQL} * 60 + t * 8.0::double, 0)::bigint) as minutes from h")
def hub_times(spark: SparkSession, sf: str) -> DataFrame:
    p = standins.places(spark, sf).select("k", "lat", "lng")
    hubs = points(spark, sf).where("p < 5").withColumnRenamed("p", "hub")
    km = geo.haversine_km(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"))
    df = p.crossJoin(F.broadcast(hubs)).withColumn("km", km)  # five hubs
    return df.select("k", "hub", geo.default_travel_minutes(F.col("km"), (F.col("k") + F.col("hub")) % 3).alias("minutes"))


MEMBERS_SQL = "m as (select distinct l_orderkey as place, l_suppkey as line from lineitem)"


def members(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("place"), F.col("l_suppkey").alias("line")).distinct()


@query("q_line_adjacency", f"with {MEMBERS_SQL} select distinct a.line as line_a, b.line as line_b from m a join m b using (place) where a.line <> b.line")
def line_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return graph.adjacency(members(spark, sf), "place", "line")


@query("q_transfers", f"""with {MEMBERS_SQL}, h as (select distinct place as hub from m order by 1 limit 5), hl as (select hub, line from h join m on hub = place), adj as (select distinct a.line as a, b.line as b from m a join m b using (place) where a.line <> b.line),
    d as (select distinct m.place, hub from m join hl using (line)), reach as (select distinct a as line, hub from adj join hl on hl.line = b), o as (select distinct m.place, hub from m join reach using (line))
    select p.place, h.hub, case when d.place is not null then 0 when o.place is not null then 1 else 2 end as transfers from (select distinct place from m) p cross join h left join d on d.place = p.place and d.hub = h.hub left join o on o.place = p.place and o.hub = h.hub""")
def transfers(spark: SparkSession, sf: str) -> DataFrame:
    m = members(spark, sf)
    return graph.transfers(m, m.select("place").distinct().orderBy("place").limit(5), "place", "line")


@query("q_grid_search", f"""with {PLACES_SQL}, t as (select {km_sql('lat', 'lng', S_LAT, S_LNG)} as km, (k + s_suppkey) % 3 as tr, (10 + (k + 7 * s_suppkey) % 50)::double as truth from places, supplier where s_suppkey < 5),
    g as (select row_number() over (order by c, a, b, f, x, p) - 1 as pid, * from (select unnest([1.20, 1.25, 1.30, 1.35, 1.40])::double as c), (select unnest([22, 25, 28])::double as a), (select unnest([30, 33, 36])::double as b), (select unnest([36, 40, 44])::double as f), (select unnest([44, 48, 52, 56])::double as x), (select unnest([6, 8, 10])::double as p)),
    e as (select pid, c, a, b, f, x, p, avg(abs(greatest(3, round_even(km * c / case when km < 5 then a when km < 15 then b when km < 35 then f else x end * 60 + tr * p, 0)) - truth)) as mae from t, g group by all)
    select pid, c as circuity, a as close, b as mid, f as far, x as express, p as penalty, floor(mae * 1e6 + 0.5) / 1e6 as mae from e order by mae, pid limit 1""")
def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    """The whole search: 1,620 sets, five hubs."""
    hubs = points(spark, sf).where("p < 5").withColumnRenamed("p", "hub")
    p = standins.places(spark, sf).select("k", "lat", "lng").crossJoin(F.broadcast(hubs))  # five hubs
    km = geo.haversine_km(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"))
    truth = p.select(km.alias("km"), ((F.col("k") + F.col("hub")) % 3).alias("transfers"), (10 + (F.col("k") + 7 * F.col("hub")) % 50).alias("truth"))
    return spatial.calibrated(truth).withColumn("mae", to_places(F.col("mae"), 6))


#: The name that the whole search had beside a smaller one.
QUERIES["q_grid_search_all"], SQL["q_grid_search_all"] = grid_search, SQL["q_grid_search"]


@query("q_tile_xy", f"with {PLACES_SQL} select k, floor((lng + 180) / 360 * 16384.0::double)::bigint as x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384.0::double)::bigint as y from places")
def tile_xy(spark: SparkSession, sf: str) -> DataFrame:
    return standins.places(spark, sf).select("k", geo.tile_x(F.col("lng")).alias("x"), geo.tile_y(F.col("lat")).alias("y"))


@query("q_bbox_area", f"with {PLACES_SQL} select k, floor(0.01::double * (k % 7) * 111000 * (0.02::double * (k % 5) * 111000 * 0.82::double) + 0.5)::bigint as rough, floor(0.01::double * (k % 7) * 111000 * (0.02::double * (k % 5) * 111000 * cos(radians((lat + 0.01::double * (k % 7) + lat) / 2))) + 0.5)::bigint as fine from places")
def bbox_area(spark: SparkSession, sf: str) -> DataFrame:
    tall, wide = 0.01 * (F.col("k") % 7), 0.02 * (F.col("k") % 5)
    zero = F.lit(0.0)
    rough = geo.bbox_area(zero, zero, tall, wide, F.lit(0.82))
    fine = tall * geo.DEGREE_M * (wide * geo.DEGREE_M * F.cos(F.radians((F.col("lat") + tall + F.col("lat")) / 2)))
    return standins.places(spark, sf).select("k", F.floor(rough + 0.5).alias("rough"), F.floor(fine + 0.5).alias("fine"))


# --- statistics -----------------------------------------------------------------------------------------------------


def truth_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Per order its price and its lines' value, in cents."""
    cents = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) * 100 + 0.5).cast("long")
    est = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(cents).alias("est"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("truth"))
    return o.join(est, "k")


TRUTH_SQL = "e as (select l_orderkey as k, sum(floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100 + 0.5)::bigint)::bigint as est from lineitem group by 1), t as (select o_orderkey as k, floor(o_totalprice * 100 + 0.5)::bigint as truth, est from orders join e on o_orderkey = e.k)"


@query("q_error_metrics", f"with {TRUTH_SQL} select count(*) as n, floor(avg(abs(est - truth)) / 100 + 0.5) as mae, floor(avg(est / truth::double) * 1e6 + 0.5) / 1e6 as mean_ratio, floor(avg(abs(est - truth) / truth::double) * 1e6 + 0.5) / 1e6 as mape, floor(1000.0::double * count(*) filter (abs(est - truth) <= truth * 0.1::double) / count(*) + 0.5) / 10 as within_tenth from t where truth > 0")
def error_metrics(spark: SparkSession, sf: str) -> DataFrame:
    t = truth_pairs(spark, sf).where("truth > 0")
    gap = F.abs(F.col("est") - F.col("truth"))
    return t.agg(
        F.count("*").alias("n"), F.floor(F.avg(gap) / 100 + 0.5).cast("double").alias("mae"), to_places(F.avg(F.col("est") / F.col("truth")), 6).alias("mean_ratio"),
        to_places(F.avg(gap / F.col("truth")), 6).alias("mape"), tenth(100.0 * F.count_if(gap <= F.col("truth") * 0.1) / F.count("*")).alias("within_tenth"),
    )


@query("q_top_errors", f"with {TRUTH_SQL} select k, abs(est - truth) as gap from t order by gap desc, k limit 5")
def top_errors(spark: SparkSession, sf: str) -> DataFrame:
    return truth_pairs(spark, sf).select("k", F.abs(F.col("est") - F.col("truth")).alias("gap")).orderBy(F.desc("gap"), "k").limit(5)


@query("q_spearman", f"with {TRUTH_SQL}, r as (select row_number() over (order by est, k) - row_number() over (order by truth, k) as d from t) select count(*) as n, floor((1 - 6 * sum((d * d)::double) / (count(*)::double * (count(*)::double * count(*) - 1))) * 1e6 + 0.5) / 1e6 as rho from r")
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.spearman(truth_pairs(spark, sf), "est", "truth", "k").select("n", to_places(F.col("rho"), 6).alias("rho"))


@query("q_upper_median", "select p_brand, p_retailprice as price from (select p_brand, p_retailprice, row_number() over (partition by p_brand order by p_retailprice) as i, count(*) over (partition by p_brand) as n from part) where i = n // 2 + 1")
def upper_median(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.upper_median(table(spark, sf, "part").select("p_brand", "p_retailprice"), ["p_brand"], "p_retailprice", "price")


@query("q_listing_median", "select p_brand, trunc(median(p_retailprice))::int as price from part where p_size between 10 and 40 group by p_brand")
def listing_median(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.col("p_size").between(10, 40)).groupBy("p_brand").agg(F.median("p_retailprice").cast("int").alias("price"))


@query("q_cube_pivot", "select o_custkey % 50 as area, max(cents) filter (p = '1-URGENT') as urgent, max(cents) filter (p = '2-HIGH') as high, max(cents) filter (p = '5-LOW') as low from (select o_custkey, o_orderpriority as p, o_custkey % 50 as a, floor(o_totalprice * 100 + 0.5)::bigint as cents from orders where o_totalprice > 1000) group by 1")
def cube_pivot(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_totalprice > 1000").select((F.col("o_custkey") % 50).alias("area"), "o_orderpriority", F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("cents"))
    wide = o.groupBy("area").pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.max("cents"))
    return wide.select("area", F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high"), F.col("5-LOW").alias("low"))


@query("q_coverage", f"with {PLACES_SQL} select count(*) as n, count(*) filter (rent_1k is not null and elevation_m is not null) as both_known, count(*) filter (rent_1k is not null and elevation_m is null) as only_rent, count(*) filter (rent_1k is null and elevation_m is not null) as only_elevation from places")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    r, e = F.col("rent_1k").isNotNull(), F.col("elevation_m").isNotNull()
    return standins.places(spark, sf).agg(F.count("*").alias("n"), F.count_if(r & e).alias("both_known"), F.count_if(r & ~e).alias("only_rent"), F.count_if(~r & e).alias("only_elevation"))


@query("q_prefix_average", "select left(p_brand, 7) as prefix, trunc(avg(p_size))::int as size, count(*) as n from part group by 1")
def prefix_average(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.left("p_brand", F.lit(7)).alias("prefix")).agg(F.avg("p_size").cast("int").alias("size"), F.count("*").alias("n"))


@query("q_count_histogram", "with c as (select o_custkey, count(*) as orders from orders group by 1) select orders, count(*) as customers from c group by 1")
def count_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders")).groupBy("orders").agg(F.count("*").alias("customers"))


@query("q_progress", "select count(*) filter (quality = 1) as valid, count(*) filter (quality = 0) as invalid, count(*) filter (quality is null) as remaining from documents left join labels using (doc_id)")
def progress(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return df.agg(F.count_if(F.col("quality") == 1).alias("valid"), F.count_if(F.col("quality") == 0).alias("invalid"), F.count_if(F.col("quality").isNull()).alias("remaining"))


# --- windows and lists ----------------------------------------------------------------------------------------------


@query("q_last_event_clock", """with e as (select user_id, case when dayofweek(ts) in (0, 6) then 'holiday' else 'weekday' end as day, hour(ts) * 60 + minute(ts) as m, ts::date as d from events),
    f as (select *, max(m >= 1320) over (partition by user_id, d) as late from e), s as (select user_id, day, max(case when m < 180 then m + 1440 else m end) as last from f where late group by 1, 2)
    select user_id, day, lpad(((last % 1440) // 60)::varchar, 2, '0') || ':' || lpad((last % 60)::varchar, 2, '0') as clock from s""")
def last_event_clock(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    m = (F.hour("ts") * 60 + F.minute("ts")).alias("m")
    rows = e.select("user_id", F.when(F.dayofweek("ts").isin(1, 7), "holiday").otherwise("weekday").alias("day"), m, F.to_date("ts").alias("d"))
    late = rows.withColumn("late", F.max(F.col("m") >= 1320).over(Window.partitionBy("user_id", "d"))).where("late")
    shifted = F.when(F.col("m") < 180, F.col("m") + 1440).otherwise(F.col("m"))
    return late.groupBy("user_id", "day").agg(F.max_by("m", shifted).alias("m")).select("user_id", "day", tx.clock_of(F.col("m")).alias("clock"))


@query("q_dedup_first", "select event_type, user_id, event_id from events qualify row_number() over (partition by event_type, user_id order by ts, event_id) = 1")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.best_of_each(table(spark, sf, "events").select("event_type", "user_id", "event_id", "ts"), ["event_type", "user_id"], ["ts", "event_id"]).drop("ts")


@query("q_topk_per_key", "select c_nationkey as area, c_custkey as k from customer qualify row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) <= 3")
def topk_per_key(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("area"), F.col("c_custkey").alias("k"), "c_acctbal")
    return ranking.best_of_each(c, ["area"], [F.desc("c_acctbal"), "k"], 3).drop("c_acctbal")


@query("q_priority_union", """with u as (select o_custkey as slug, o_orderkey % 97 as url, 0 as priority, o_orderkey as id from orders where o_orderstatus = 'F' union all select o_custkey, o_orderkey % 97, 1, o_orderkey from orders where o_orderstatus = 'O'),
    d as (select * from u qualify row_number() over (partition by slug, url order by priority, id) = 1), c as (select *, row_number() over (partition by slug order by priority, id) - 1 as idx from d) select slug, url, priority, idx::int as idx from c where idx < 8""")
def priority_union(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("slug"), (F.col("o_orderkey") % 97).alias("url"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    of = lambda status: o.where(F.col("o_orderstatus") == status).drop("o_orderstatus")
    return joins.priority_union([of("F"), of("O")], ["slug"], ["url"], ["id"], 8).select("slug", "url", "priority", "idx")


@query("q_fill_to_target", """with have as (select o_custkey as k, count(*) as have from orders where o_orderstatus = 'F' group by 1), c as (select o_custkey as k, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders where o_orderstatus = 'O')
    select c.k, id from c left join have using (k) where rn <= 6 - coalesce(have, 0)""")
def fill_to_target(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    have = o.where("o_orderstatus = 'F'").groupBy("k").agg(F.count("*").alias("have"))
    return ranking.fill_to_target(have, o.where("o_orderstatus = 'O'").select("k", "id"), "k", ["id"], 6)


@query("q_global_unique", "select l_partkey as photo, l_orderkey as place from lineitem qualify row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) = 1")
def global_unique(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("photo"), F.col("l_orderkey").alias("place"), "l_linenumber")
    return ranking.best_of_each(rows, ["photo"], ["place", "l_linenumber"]).drop("l_linenumber")


@query("q_first_changed", "with f as (select o_custkey as k, min(o_orderkey) as before, min(o_orderkey) filter (o_orderstatus <> 'F') as after from orders group by 1) select k, before, after from f where before is distinct from after")
def first_changed(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    f = o.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("before"), F.min(F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey"))).alias("after"))
    return f.where(~F.col("before").eqNullSafe(F.col("after")))


@query("q_set_operations", "select count(*) filter (a and b) as both_in, count(*) filter (a and not b) as only_a, count(*) filter (b and not a) as only_b from (select k, bool_or(s = 'a') as a, bool_or(s = 'b') as b from (select distinct doc_id as k, 'a' as s from documents where lang = 'en' union all select distinct doc_id, 'b' from labels) group by k)")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "documents").where("lang = 'en'").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(a.intersect(b), "both_in").crossJoin(count(a.subtract(b), "only_a")).crossJoin(count(b.subtract(a), "only_b"))  # one row each
