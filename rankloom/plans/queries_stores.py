"""Queries on unique choices, tables that are replaced and updated, chains of renames and wide joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, joins, unique
from ..sources import versions
from ..sources.stages import fresh, kept
from ..sources.tables import table
from .standins import EVENT_TYPES

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- choices that are given once ------------------------------------------------------------------------------------


@query("q_greedy_unique", """with recursive
    l as materialized (select o_custkey as k, l_partkey as photo, l_suppkey + 1000000 as other, o_orderkey, l_linenumber from orders join lineitem on l_orderkey = o_orderkey),
    f as (select k, photo, row_number() over (partition by k order by min((o_orderkey, l_linenumber)), photo) as n from l group by k, photo),
    s as (select k, other, row_number() over (partition by k order by min((o_orderkey, l_linenumber)), other) as n from l group by k, other),
    c as (select k, list(photo order by n) filter (n <= 9) as choices from f group by k), d as (select k, list(other order by n) filter (n <= 6) as spare from s group by k),
    p as materialized (select k, choices, spare, row_number() over (order by -(1 + k % 6), k) as step from c join d using (k)),
    u as materialized (select list(distinct l_partkey) as used from lineitem where l_linenumber = 7 and l_quantity > 45),
    r as (select 0::bigint as step, null::bigint as k, []::bigint[] as took, used::bigint[] as used from u
        union all
        select step, k, took, list_concat(used, took) from (select p.step, p.k, r.used, case when len(first) > 0 then first[1:3] else list_filter(spare, lambda x: not list_contains(r.used, x))[1:3] end as took
            from r join (select step, k, choices, spare from p) p on p.step = r.step + 1, lateral (select list_filter(p.choices, lambda x: not list_contains(r.used, x)) as first) a))
    select k, unnest(took) as photo, unnest(range(len(took)))::int as slot from r where k is not null""")
def greedy_unique(spark: SparkSession, sf: str) -> DataFrame:
    """Places with more lines first; each takes three photos of its nine, or of six others if it gets none, that no place has."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("photo"), (F.col("l_suppkey") + 1_000_000).alias("other"))
    # order and line as one number: the least of numbers is found in a hash table, that of structs by sorting all rows
    at = F.col("o_orderkey").cast("decimal(19,0)") * F.lit(2**32).cast("decimal(10,0)") + F.coalesce(F.col("l_linenumber"), F.lit(-(2**31))).cast("decimal(10,0)")
    met = table(spark, sf, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    seen = kept(met.select(F.col("o_custkey").alias("k"), at.alias("at"), "photo", "other"), "seen")

    def first(c: str, n: int) -> DataFrame:
        once = seen.groupBy("k", c).agg(F.min("at").alias("at"))
        return once.groupBy("k").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("at", c))), 1, n), lambda s: s[c]).alias(c))

    places = first("photo", 9).join(first("other", 6), "k").withColumn("rank", -(1 + F.col("k") % 6))
    used = table(spark, sf, "lineitem").where("l_linenumber = 7 and l_quantity > 45").select("l_partkey").distinct()
    return unique.greedy_unique(places, "k", ["rank"], "photo", 3, "other", used).withColumnRenamed("choice", "photo")


# --- tables in versions ---------------------------------------------------------------------------------------------


@query("q_versioned_refresh", """select 'before' as seen, c_nationkey as area, count(*) as n, sum(c_custkey) as keys from customer group by 2
    union all select 'after', c_nationkey, count(*), sum(c_custkey) from customer where c_acctbal > 0 group by 2""")
def versioned_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """A reader from before a full refresh, read after it, and one from after it."""
    path = fresh(spark, "refreshed")
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    versions.refresh(rows, path, "c_custkey", 8)
    before = versions.current(spark, path)
    versions.refresh(rows.where("c_acctbal > 0"), path, "c_custkey", 8)
    seen = before.withColumn("seen", F.lit("before")).unionByName(versions.current(spark, path).withColumn("seen", F.lit("after")))
    return seen.groupBy("seen", F.col("c_nationkey").alias("area")).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("q_update_by_id", """with n as (select o_custkey, max_by(o_orderpriority, o_orderkey) as priority, case when max(o_orderkey) % 3 > 0 then max(o_orderkey) end as last from orders where o_custkey % 5 < 2 group by 1)
    select c_custkey as k, coalesce(priority, c_mktsegment) as label, coalesce(last, 0) as last from customer left join n on c_custkey = o_custkey""")
def update_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with labels and last orders from their orders; null leaves a column as it was, and of several changes the last counts."""
    path = fresh(spark, "updated")
    versions.refresh(table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("label"), F.lit(0).cast("long").alias("last")), path, "k", 16)
    orders = table(spark, sf, "orders").where("o_custkey % 5 < 2")
    last = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey"))
    versions.update(orders.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("label"), last.alias("last"), "o_orderkey"), path, order="o_orderkey")
    return versions.current(spark, path)


# --- chains and ways ------------------------------------------------------------------------------------------------

RENAMES_SQL = "m as (select o_custkey as old, max(case when o_custkey % 97 = 0 then o_custkey + 1 when o_custkey % 97 = 1 then o_custkey - 1 else o_custkey + o_orderkey % 4 end) as new from orders where o_custkey % 50 < 45 group by 1 having old <> new)"


@query("q_rename_chains", f"""with recursive {RENAMES_SQL}, w as (select old, new, 1::bigint as hops from m union all select w.old, m.new, hops + 1 from w join m on w.new = m.old where hops <= (select count(*) from m)),
    e as (select old, arg_max(new, hops) as new, max(hops) as hops from w group by old) select old, case when hops <= (select count(*) from m) then new end as new, case when hops <= (select count(*) from m) then hops end as hops, hops > (select count(*) from m) as cycle from e""")
def rename_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Where keys end that were renamed again and again; some go round."""
    o = F.col("o_custkey")
    new = F.when(o % 97 == 0, o + 1).when(o % 97 == 1, o - 1).otherwise(o + F.col("o_orderkey") % 4)
    return joins.chains(table(spark, sf, "orders").where("o_custkey % 50 < 45").select(o.alias("old"), new.alias("new")))


@query("q_redirect_map", f"""with recursive {RENAMES_SQL}, w as (select old, new, 1::bigint as hops from m union all select w.old, m.new, hops + 1 from w join m on w.new = m.old where hops <= 200),
    e as (select old, arg_max(new, hops) as new from w group by old having max(hops) <= 200) select c_custkey as asked, coalesce(new, c_custkey) as served from customer left join e on old = c_custkey""")
def redirect_map(spark: SparkSession, sf: str) -> DataFrame:
    """The map of old to last names as a table of its own, and keys looked up in it; keys in a cycle stay."""
    path = fresh(spark, "redirects")
    versions.refresh(rename_chains(spark, sf).where("not cycle").select("old", "new"), path, "old", 8)
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("asked"), F.col("c_custkey").alias("served"))
    return joins.redirected(asked, versions.current(spark, path), "served")


@query("q_changes_any_depth", """with recursive m as (select distinct o_custkey as place, (o_custkey + o_orderkey % 4 * 5) // 20 as line from orders), h as (select distinct place from m order by 1 limit 3),
    r as (select place, place as hub, line, 0::bigint as d from m where place in (select place from h)
        union select b.place, r.hub, b.line, case when b.line = r.line then d else d + 1 end from r join m b on b.place = r.place or b.line = r.line where d < 6)
    select place, hub, min(d)::int as changes from (select m.place, hub, d from r join m using (line)) group by all having min(d) <= 6""")
def changes_any_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Up to six changes from three hubs, on lines of some twenty neighbouring places."""
    line = F.floor((F.col("o_custkey") + F.col("o_orderkey") % 4 * 5) / 20)
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("place"), line.alias("line"))
    return graph.changes(rows, rows.select("place").distinct().orderBy("place").limit(3), "place", "line", 6)


# --- wide joins -----------------------------------------------------------------------------------------------------


def sides(spark: SparkSession, sf: str) -> dict[str, tuple[DataFrame, list[str]]]:
    """Sixteen sides of a place's record: a count per type of event, its last event and value, orders by status and priority, lines, gaps, money."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("k"), "event_type", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    count = lambda df: df.groupBy("k").agg(F.count("*").alias("n"))
    out: dict[str, tuple[DataFrame, list[str]]] = {t: (count(events.where(F.col("event_type") == t)), []) for t in EVENT_TYPES}
    out["last"] = (events.select("k", "event_id", "event_type"), ["event_id"])
    out["cents"] = (events.groupBy("k").agg(F.sum("cents").alias("sum")), [])
    out["peak"] = (events.groupBy("k").agg(F.max("cents").alias("max")), [])
    for status in ("F", "O", "P"):
        out[f"status_{status.lower()}"] = (count(orders.where(F.col("o_orderstatus") == status)), [])
    out["newest"] = (orders.select("k", "o_orderkey", "o_orderpriority"), ["o_orderkey"])
    out["urgent"] = (count(orders.where("o_orderpriority = '1-URGENT'")), [])
    out["first"] = (orders.groupBy("k").agg(F.min("o_orderkey").alias("key")), [])
    c = table(spark, sf, "customer")
    out["segment"] = (c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("name")), [])
    out["camera"] = (c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 9).alias("kind")), [])
    return out


def _side_sql(name: str) -> tuple[str, str]:
    """A side's columns and its rows."""
    if name in EVENT_TYPES:
        return f"{name}.n as {name}_n", f"(select user_id as k, count(*) as n from events where event_type = '{name}' group by 1)"
    if name.startswith("status_"):
        return f"{name}.n as {name}_n", f"(select o_custkey as k, count(*) as n from orders where o_orderstatus = '{name[-1].upper()}' group by 1)"
    return {
        "last": ("last.t as last_event_type", "(select user_id as k, arg_max(event_type, event_id) as t from events group by 1)"),
        "cents": ("cents.s as cents_sum", "(select user_id as k, sum(round(value * 100)::bigint)::bigint as s from events group by 1)"),
        "peak": ("peak.m as peak_max", "(select user_id as k, max(round(value * 100)::bigint) as m from events group by 1)"),
        "newest": ("newest.p as newest_o_orderpriority", "(select o_custkey as k, arg_max(o_orderpriority, o_orderkey) as p from orders group by 1)"),
        "urgent": ("urgent.n as urgent_n", "(select o_custkey as k, count(*) as n from orders where o_orderpriority = '1-URGENT' group by 1)"),
        "first": ("first.o as first_key", "(select o_custkey as k, min(o_orderkey) as o from orders group by 1)"),
        "segment": ("segment.s as segment_name", "(select c_custkey as k, c_mktsegment as s from customer where c_custkey % 3 > 0)"),
        "camera": ("camera.t as camera_kind", "(select c_custkey as k, c_custkey % 9 as t from customer where c_custkey % 4 = 0)"),
    }[name]


ALL_SIDES = (*EVENT_TYPES, "last", "cents", "peak", "status_f", "status_o", "status_p", "newest", "urgent", "first", "segment", "camera")


def mart_sql(names: tuple[str, ...]) -> str:
    joined = " ".join(f'left join {_side_sql(n)[1]} as "{n}" on "{n}".k = c_custkey' for n in names)
    found = ", ".join(f"""case when "{n}".k is not null then '{n}' end""" for n in names)
    columns = ", ".join('"' + c.replace(".", '".', 1) for c in (_side_sql(n)[0] for n in names))
    return f"select c_custkey as k, {columns}, array_to_string(list_filter([{found}], lambda x: x is not null), ',') as found from customer {joined}"


def mart(spark: SparkSession, sf: str, names: tuple[str, ...]) -> DataFrame:
    every = sides(spark, sf)
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return joins.datamart(base, "k", {n: every[n] for n in names}).withColumn("found", F.array_join("found", ","))


@query("q_datamart", mart_sql(ALL_SIDES))
def datamart(spark: SparkSession, sf: str) -> DataFrame:
    """A place's record from all sixteen sides."""
    return mart(spark, sf, ALL_SIDES)


@query("q_rating_inputs", mart_sql(ALL_SIDES[:8]))
def rating_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """What ratings are made of, from eight sides."""
    return mart(spark, sf, ALL_SIDES[:8])


# --- names by dictionary --------------------------------------------------------------------------------------------


@query("q_transliterated", """with recursive d as (select n_name as written, 'read' || n_nationkey as reading from nation union select distinct substr(n_name, 1, 3), 'pre' || length(n_name) from nation),
    e as materialized (select written, min(reading) as reading from d group by 1),
    n as materialized (select distinct c_mktsegment || n_name || substr(n_name, 1, 2) || c_custkey % 7 as name from customer join nation on c_nationkey = n_nationkey),
    w as (select name, 1 as i, '' as text, false as plain from n
        union all
        select w.name, i + coalesce(m.size, 1), text || case when m.size is not null then '-' || upper(m.reading[1]) || lower(m.reading[2:]) when plain then w.name[i] else '-' || w.name[i] end, m.size is null
        from w left join lateral (select length(written) as size, reading from e where w.name[w.i:w.i + length(written) - 1] = written order by size desc limit 1) m on true where i <= length(w.name))
    select name, trim(regexp_replace(text, '-+', '-', 'g'), '-') as romaji from w where i > length(name) and name not like '%3'
    union all select name, 'Known ' || name from n where name like '%3'""")
def transliterated(spark: SparkSession, sf: str) -> DataFrame:
    """Names put together from parts, read by a dictionary of whole names and beginnings."""
    nation = table(spark, sf, "nation")
    whole = nation.select(F.col("n_name").alias("written"), F.concat(F.lit("read"), F.col("n_nationkey").cast("string")).alias("reading"))
    begins = nation.select(F.substring("n_name", 1, 3).alias("written"), F.concat(F.lit("pre"), F.length("n_name").cast("string")).alias("reading"))
    both = table(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    names = both.select(F.concat("c_mktsegment", "n_name", F.substring("n_name", 1, 2), (F.col("c_custkey") % 7).cast("string")).alias("name"))
    known = names.where("name like '%3'").select("name", F.concat(F.lit("Known "), "name").alias("romaji"))
    return joins.transliterated(names, "name", whole.unionByName(begins), known, 14)
