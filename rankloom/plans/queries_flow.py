"""Queries on streams with state, timetables from files that change, and files in several encodings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers, timetables
from ..sources.stages import fresh
from ..sources.tables import table
from ..streaming import state
from .queries_text import since
from .spec import CATEGORIES, DEFAULT_WEIGHTS

QUERIES: dict = {}
SQL: dict = {}
HOUR = 3_600_000_000
#: Stops that a task puts together to trips.
TASK_STOPS = 500_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- streams with state ---------------------------------------------------------------------------------------------


def timed(events: DataFrame) -> DataFrame:
    """Events of users, with a time that has no other zone than UTC."""
    return events.where("user_id is not null").withColumn("ts", F.timestamp_micros(since("MICROSECOND", "ts")))


@query("q_debounce_stream", """with e as (select user_id, ts, event_id, event_type, case when ts - lag(ts) over w < interval 1 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
    s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as grp from e)
    select user_id, count(*) as n, arg_max(event_type, (ts, event_id)) as last, epoch_us(max(ts)) as at from s where user_id is not null group by user_id, grp""")
def debounce_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of each burst, from a stream in two runs with timers."""
    rows = timed(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"))
    out = state.replayed(rows, "ts", lambda s: state.bursts(s, "user_id", "ts", "event_id", "event_type", HOUR))
    return out.select(F.col("key").alias("user_id"), "n", F.col("value").alias("last"), "at")


def actions(events: DataFrame) -> DataFrame:
    """Events as what users do to their query: weights, limits, minimums, comparisons, resets."""
    e, kind = F.col("event_id"), F.col("event_type")
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (e % 10 + 1).cast("int"))
    limit = F.element_at(F.array(*map(F.lit, ("min_rent", "max_rent", "min_commute", "max_commute"))), (e % 4 + 1).cast("int"))
    amount = F.when(e % 4 == 0, 80_000 + e % 7 * 10_000).when(e % 4 == 1, 300_000 - e % 5 * 10_000).when(e % 4 == 2, 10 + e % 9).otherwise(60 - e % 9)
    what = F.when(kind == "view", "weight").when(kind == "click", "filter").when(kind == "signup", "minimum").when(kind == "purchase", F.when(e % 4 == 0, "uncompare").otherwise("compare")).otherwise(F.when(e % 2 == 0, "reset_weights").otherwise("reset_filters"))
    name = F.when(kind.isin("view", "signup"), category).when(kind == "click", limit)
    value = F.when(kind == "view", e % 31).when(kind == "click", amount).when(kind == "signup", F.when(e % 3 > 0, 1 + e % 10)).cast("string")
    return events.select("user_id", "ts", "event_id", what.alias("action"), name.alias("name"), F.when(kind == "purchase", F.concat(F.lit("s"), (e % 7).cast("string"))).otherwise(value).alias("value"))


_names, _weights = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]", "[" + ", ".join(str(DEFAULT_WEIGHTS[c]) for c in CATEGORIES) + "]"
STATES_SQL = f"""with recursive
    e as materialized (select user_id, ts, event_id, event_type as kind, row_number() over (partition by user_id order by ts, event_id) as step, coalesce(lead(ts) over (partition by user_id order by ts, event_id) - ts >= interval 1 hour, true) as ends from events where user_id is not null),
    r as (select distinct user_id, 0::bigint as step, {_weights}::bigint[] as w, 80000::bigint as nr, 300000::bigint as mr, 10::bigint as nc, 60::bigint as mc, []::varchar[] as mk, []::bigint[] as mv, []::varchar[] as cmp from e
        union all
        select e.user_id, e.step,
            case when kind = 'view' then list_transform(w, lambda x, i: case when i = event_id % 10 + 1 then event_id % 31 else x end) when kind = 'error' and event_id % 2 = 0 then {_weights} else w end,
            case when kind = 'click' and event_id % 4 = 0 then 80000 + event_id % 7 * 10000 when kind = 'error' and event_id % 2 = 1 then 80000 else nr end,
            case when kind = 'click' and event_id % 4 = 1 then 300000 - event_id % 5 * 10000 when kind = 'error' and event_id % 2 = 1 then 300000 else mr end,
            case when kind = 'click' and event_id % 4 = 2 then 10 + event_id % 9 when kind = 'error' and event_id % 2 = 1 then 10 else nc end,
            case when kind = 'click' and event_id % 4 = 3 then 60 - event_id % 9 when kind = 'error' and event_id % 2 = 1 then 60 else mc end,
            case when kind = 'error' and event_id % 2 = 1 then [] when kind <> 'signup' then mk when event_id % 3 = 0 then list_filter(mk, lambda k: k <> {_names}[event_id % 10 + 1]) when list_contains(mk, {_names}[event_id % 10 + 1]) then mk else list_append(mk, {_names}[event_id % 10 + 1]) end,
            case when kind = 'error' and event_id % 2 = 1 then [] when kind <> 'signup' then mv when event_id % 3 = 0 then list_filter(mv, lambda v, i: mk[i] <> {_names}[event_id % 10 + 1]) when list_contains(mk, {_names}[event_id % 10 + 1]) then list_transform(mv, lambda v, i: case when mk[i] = {_names}[event_id % 10 + 1] then 1 + event_id % 10 else v end) else list_append(mv, 1 + event_id % 10) end,
            case when kind <> 'purchase' then cmp when event_id % 4 = 0 then list_filter(cmp, lambda c: c <> 's' || event_id % 7) when len(cmp) >= 3 or list_contains(cmp, 's' || event_id % 7) then cmp else list_append(cmp, 's' || event_id % 7) end
        from r join e on e.user_id = r.user_id and e.step = r.step + 1)
    select user_id, epoch_us(ts) as at, '/place' || case when p <> '' then '?' || p else '' end as url from (select user_id, ts, array_to_string(list_filter([
        case when w <> {_weights} then 'w=' || array_to_string(w, '%2C') end, case when nr > 80000 then 'nr=' || nr end, case when mr < 300000 then 'mr=' || mr end, case when nc > 10 then 'nc=' || nc end, case when mc < 60 then 'mc=' || mc end,
        case when len(mk) > 0 then 'cm=' || array_to_string(list_transform(mk, lambda k, i: k || '%3A' || mv[i]), '%2C') end, case when len(cmp) > 0 then 'c=' || array_to_string(cmp, '%2C') end], lambda x: x is not null), '&') as p from r join e using (user_id, step) where ends)"""


@query("q_query_states", STATES_SQL)
def query_states(spark: SparkSession, sf: str) -> DataFrame:
    """The URL of each user's query whenever the user has been quiet for an hour, from a stream of actions in two runs."""
    rows = actions(timed(table(spark, sf, "events")))
    out = state.replayed(rows, "ts", lambda s: state.query_urls(s, "user_id", "ts", "event_id", HOUR, "/place"))
    return out.select(F.col("key").alias("user_id"), "at", F.col("value").alias("url"))


# --- timetables -----------------------------------------------------------------------------------------------------


def _clock_sql(m: str) -> str:
    return f"lpad((({m}) // 60)::varchar, 2, '0') || ':' || lpad((({m}) % 60)::varchar, 2, '0')"


@query("q_last_trains", """with s as (select o_orderkey as trip, 's' || l_suppkey as station, case when o_orderkey % 3 = 0 then 'holiday' else 'weekday' end as day, (o_custkey * 37 + l_linenumber * 11 + case when o_orderkey % 8 = 3 then 5 else 0 end) % 1440 as m, l_linenumber as i from orders join lineitem on l_orderkey = o_orderkey where o_orderkey % 8 <> 6),
    t as (select *, bool_or(m >= 1320) over (partition by trip) as late from s), d as (select station, day, case when m < 180 then m + 1440 else m end as o, m from t where i < 7 and (m >= 180 or late))
    select station, arg_max(m, o) filter (day = 'weekday') as weekday, arg_max(m, o) filter (day = 'holiday') as holiday from d group by station""")
def last_trains(spark: SparkSession, sf: str) -> DataFrame:
    """Trips in folders of files; one folder changes and one goes between two runs, and the second reads only the first of these."""
    folder, cache = fresh(spark, "timetables"), fresh(spark, "timetable-cache")
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    tasks = math.ceil(lines.count() / TASK_STOPS)
    if tasks > spark.sparkContext.defaultParallelism:  # by rows, as lists of stops take much more than the bytes that are dealt
        tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
        orders, lines = orders.repartition(tasks, "o_orderkey"), lines.repartition(tasks, "l_orderkey")
    items = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))

    def trips(later: int, which: str) -> DataFrame:
        m = (F.col("o_custkey") * 37 + F.col("l_linenumber") * 11 + later) % 1440
        clock = F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))
        last = F.col("l_linenumber") >= 7  # where a trip ends there is an arrival only
        stop = F.struct("l_linenumber", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s"), F.when(last, clock).alias("a"), F.when(~last, clock).alias("d"))
        stops = items.where(which).groupBy("o_orderkey").agg(F.transform(F.array_sort(F.collect_list(stop)), lambda x: F.struct(x["s"].alias("s"), x["a"].alias("a"), x["d"].alias("d"))).alias("tt"))
        name = F.concat(F.lit("Line."), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ".SaturdayHoliday").otherwise(".Weekday"))
        return stops.select(name.alias("id"), "tt", (F.col("o_orderkey") % 8).alias("line"))

    trips(0, "true").write.partitionBy("line").json(folder)
    timetables.scanned(spark, folder, cache, lines=True)
    for line in (3, 6):
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/line={line}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    trips(5, "o_orderkey % 8 = 3").drop("line").write.json(f"{folder}/line=3")
    rows, _, _ = timetables.scanned(spark, folder, cache, lines=True)
    return timetables.last_trains(timetables.departures(rows))


# --- files in several encodings -------------------------------------------------------------------------------------


@query("q_encoded_areas", """with c as (select c_custkey as k, c_nationkey as n, (11 + c_custkey % 5) || lpad((c_custkey % 700)::varchar, 3, '0') as code from customer),
    r as (select *, list_filter([case when k % 4 > 0 then 40000 + k % 9000 end, case when (k % 60) * 9000 between 10000 and 500000 then (k % 60) * 9000 end, case when k % 3 = 0 then 77000 end, 65000], lambda x: x is not null) as prices from c where k % 6 > 0 and code[1:2] in ('11', '12', '13', '14'))
    select code, '東京都 第' || k || '区 "北"' as name, code[1:2] as prefecture, prices[1] as total, prices[2] as one_room, prices[3] as two_rooms from r qualify row_number() over (partition by code order by n desc, k desc) = 1""")
def encoded_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of files by nation, a third of them each in UTF-8, Shift-JIS and its extension 932, with quoted names and prices, marks of nothing, lines of other kinds, and codes that are in several files."""
    k = F.col("c_custkey")
    code = F.concat((11 + k % 5).cast("string"), F.lpad((k % 700).cast("string"), 3, "0"))
    thousands = lambda n: F.concat(F.lit('"'), F.format_number(n, 0), F.lit('"'))
    cells = F.concat_ws(",", F.lit("全国 , x"), F.concat(F.lit(" "), code, F.lit(" ")), F.concat(F.lit('"東京都 第'), k.cast("string"), F.lit('区 ""北"""')), F.when(k % 4 > 0, thousands(40_000 + k % 9_000)).otherwise("***"), (k % 60 * 9_000).cast("string"), F.when(k % 3 == 0, "77000.9").otherwise("…"), F.lit("65000"))
    # what only the extension has is in a line that isn't about an area
    line = F.when(k % 6 == 0, F.when(F.col("c_nationkey") % 3 == 2, "備考①,㈱,x").otherwise("備考,x,y")).otherwise(cells)
    rows = table(spark, sf, "customer").select(F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("file"), k.alias("pos"), line.alias("text"), (F.col("c_nationkey") % 3).alias("how"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["file", "pos"]].assign(line=[t.encode(("utf-8", "shift_jis", "cp932")[h]) for t, h in zip(b["text"], b["how"])])

    return readers.area_prices(readers.decoded(rows.mapInPandas(encode, "file string, pos long, line binary")), ("11", "12", "13", "14"))
