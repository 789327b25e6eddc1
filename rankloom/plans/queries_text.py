"""Queries on strings, JSON, HTML, documents and event streams at rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import documents
from ..sources import readers
from ..sources.tables import table
from ..streaming import incremental, ratelimit

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def since(unit: str, c: str) -> Column:
    """Whole units from the epoch to a time without zone."""
    return F.expr(f"timestampdiff({unit}, timestamp_ntz'1970-01-01 00:00:00', {c})")


@query("q_slugify", "select p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type || '!'), '[^a-z0-9]+', '-', 'g'), '-') as slug from part")
def slugify(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", tx.slugified(F.concat("p_name", F.lit(" / "), "p_type", F.lit("!"))).alias("slug"))


@query("q_hepburn", "select p_partkey, regexp_replace(regexp_replace(regexp_replace(replace(p_name, 'r', 'oo') || 'tou', '(o)u', '\\1', 'gi'), '(u)u', '\\1', 'gi'), '(o)o', '\\1', 'gi') as name from part")
def hepburn(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", tx.hepburn(F.concat(F.replace("p_name", F.lit("r"), F.lit("oo")), F.lit("tou"))).alias("name"))


@query("q_hyphen_capitals", "select p_partkey, array_to_string(list_transform(string_split(replace(p_name, ' ', '-'), '-'), lambda x: upper(left(x, 1)) || substr(x, 2)), '-') as name from part")
def hyphen_capitals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", tx.hyphen_capitals(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("name"))


@query("q_snippet", "select doc_id, case when length(text) > 120 then left(text, 120) || '...' else text end as snippet from documents")
def snippet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query("q_localized_name", "select c_custkey as k, coalesce(nullif(case when c_custkey % 3 = 0 then '' when c_custkey % 3 = 1 then 'N' || c_custkey end, ''), c_name) as name from customer")
def localized_name(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    own = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("N"), k.cast("string")))
    return table(spark, sf, "customer").select(k.alias("k"), tx.first_of(own, F.col("c_name")).alias("name"))


@query("q_strip_html", "select page_id, md5(trim(regexp_replace(html, '<[^>]*>', '', 'g'))) as text_md5 from pages")
def strip_html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(tx.without_tags(F.col("html"))).alias("text_md5"))


@query("q_url_host", "select lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) as host, count(*) as n from pages group by 1 order by n desc, host limit 10")
def url_host(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(tx.host(F.col("url")).alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(10)


@query("q_md5_prefix", "select page_id, left(md5(url), 12) as short from pages")
def md5_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.md5_prefix(F.col("url")).alias("short"))


@query("q_price_label", "select p_partkey, case when p_retailprice >= 1050 then floor(p_retailprice / 1000 + 0.5)::int || 'k+' when p_retailprice <= 910 then '<' || floor(p_retailprice / 1000 + 0.5)::int || 'k' else floor(p_retailprice / 1000 + 0.5)::int || 'k' end as label from part")
def price_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", tx.price_label(F.col("p_retailprice"), 910, 1050).alias("label"))


@query("q_query_encoding", "select page_id, replace(replace(url_encode(url || ' x'), '+', '%20'), '~', '%7E') as encoded from pages")
def query_encoding(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.encoded(F.concat("url", F.lit(" x"))).alias("encoded"))


@query("q_json_props", "select event_type, sum((props->>'k')::int)::bigint as total, count(*) filter (try_cast(props->>'k' as int) is null) as broken from events group by 1")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(k.isNull()).alias("broken"))


@query("q_html_extract", "with i as (select page_id, unnest(regexp_extract_all(html, '<li><a href=\"[^\"]*\">[^<]*</a>')) as item, generate_subscripts(regexp_extract_all(html, '<li><a href=\"[^\"]*\">[^<]*</a>'), 1) - 1 as pos from pages) select page_id, pos::int as pos, regexp_extract(item, 'href=\"([^\"]*)\"', 1) as href, regexp_extract(item, '>([^<>]+)</a>', 1) as label from i where regexp_matches(item, '>([^<>]+)</a>')")
def html_extract(spark: SparkSession, sf: str) -> DataFrame:
    return readers.html_items(table(spark, sf, "pages"), "page_id", "html", r'<li><a href="[^"]*">[^<]*</a>', {"href": r'href="([^"]*)"', "label": r">([^<>]+)</a>"}).where("label is not null")


@query("q_doc_validity", """select doc_id, array_to_string(list_filter([case when lang = 'fr' then 'missing en' end, case when lang <> 'fr' and doc_id % 4 = 0 then 'en.food missing' end, case when lang <> 'fr' and doc_id % 4 <> 0 and trim(case when doc_id % 5 = 0 then ' ' else text end) = '' then 'en.food empty' end], lambda x: x is not null), ',') as issues from documents""")
def doc_validity(spark: SparkSession, sf: str) -> DataFrame:
    food = F.when(F.col("doc_id") % 4 != 0, F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("text")))
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") != "fr", F.struct(food.alias("food"))).alias("en"))
    return docs.select("doc_id", F.array_join(documents.document_issues(("en",), ("food",)), ",").alias("issues"))


#: Stand-ins for a document's languages and fields: which rows lack a language (modulus of the id), and per field the modulus at which it's missing and the text.
LACKING = {"en": "lang = 'fr'", "ja": "doc_id % 7 = 3", "ru": "doc_id % 11 = 5"}
FIELD_TEXTS = {"atmosphere": (13, "text"), "landmarks": (9, "case when doc_id % 5 = 0 then '  ' else text end"), "food": (4, "case when doc_id % 6 = 1 then '' else text end"), "nightlife": (8, "source")}


def issues_sql(lang: str, f: str) -> str:
    every, value = FIELD_TEXTS[f]
    missing = f"(doc_id + {len(lang + f)}) % {every} = 0"
    return f"case when not ({LACKING[lang]}) then case when {missing} or ({value}) is null then '{lang}.{f} missing' when trim({value}) = '' then '{lang}.{f} empty' end end"


ISSUES_SQL = ", ".join(f"case when {LACKING[lang]} then 'missing {lang}' end, " + ", ".join(issues_sql(lang, f) for f in documents.FIELDS) for lang in documents.LANGUAGES)


@query("q_doc_validity_all", f"select doc_id, array_to_string(list_filter([{ISSUES_SQL}], lambda x: x is not null), ',') as issues from documents")
def doc_validity_all(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    for lang in documents.LANGUAGES:
        texts = [F.expr(f"case when (doc_id + {len(lang + f)}) % {every} <> 0 then {value} end").alias(f) for f, (every, value) in FIELD_TEXTS.items()]
        docs = docs.withColumn(lang, F.when(~F.expr(LACKING[lang]), F.struct(*texts)))
    return docs.select("doc_id", F.array_join(documents.document_issues(), ",").alias("issues"))


@query("q_tag_class", """with t as (select p_partkey, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_type)] as tags from part), n as (select p_partkey, len(list_filter(tags, lambda x: x in ('small', 'economy'))) as bad, len(list_filter(tags, lambda x: x in ('ring', 'widget'))) as good from t)
    select p_partkey, case when bad >= 2 or (bad > 0 and good = 0) then 'bad' else 'good' end as class from n""")
def tag_class(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split("p_name", " ")
    tags = F.array(F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", documents.tag_class(tags, ["ring", "widget"], ["small", "economy"]).alias("class"))


@query("q_existing_pages", "select page_id from pages where url like 'https://%' and length(html) >= 640 and not regexp_matches(url, '(?i)logo|icon|fr/')")
def existing_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").where(F.col("url").startswith("https://") & (F.length("html") >= 640) & ~F.col("url").rlike("(?i)logo|icon|fr/")).select("page_id")


@query("q_turn_lists", "select conv_id, array_to_string(list(role order by turn), '>') as roles, count(*) as turns from conversations group by conv_id")
def turn_lists(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), ">").alias("roles"), F.count("*").alias("turns"))


@query("q_rate_limit", """with recursive e as (select user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts) as rn from events),
    r as (select user_id, t, rn, true as ok, t as last from e where rn = 1 union all select e.user_id, e.t, e.rn, e.t - r.last >= 7200000000, case when e.t - r.last >= 7200000000 then e.t else r.last end from r join e on e.user_id = r.user_id and e.rn = r.rn + 1)
    select user_id, t, ok from r""")
def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", since("MICROSECOND", "ts").alias("t_us"))
    return ratelimit.rate_limited(e, "user_id", "t_us", 7_200_000_000)


@query("q_debounce_sessions", """with e as (select user_id, ts, event_id, case when ts - lag(ts) over w < interval 1 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
    s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as grp from e) select user_id, count(*) as n, max(event_id) as last, epoch_us(min(ts)) as started from s group by user_id, grp""")
def debounce_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    return incremental.debounced(e, "user_id", "ts", "1 hour", "event_id").select("user_id", "n", "last", since("MICROSECOND", "start").alias("started"))


@query("q_latest_per_key", "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return incremental.latest(e, "user_id", [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("q_next_batch", "select doc_id from documents where doc_id not in (select doc_id from labels) order by n_chars desc, doc_id limit 20")
def next_batch(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.next_batch(table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels"), "doc_id", [F.desc("n_chars"), "doc_id"], 20).drop("n_chars")


@query("q_feedback_valid", """with f as (select event_id, case when event_type = 'view' then 'up' when event_type = 'click' then 'down' else event_type end as vote, case when user_id % 2 = 0 then '/p' || user_id else 'p' end as url from events)
    select event_id, array_to_string(list_filter([case when vote not in ('up', 'down') then 'vote' end, case when url not like '/%' then 'page_url' end], lambda x: x is not null), ',') as issues from f""")
def feedback_valid(spark: SparkSession, sf: str) -> DataFrame:
    vote = F.when(F.col("event_type") == "view", "up").when(F.col("event_type") == "click", "down").otherwise(F.col("event_type"))
    rows = table(spark, sf, "events").select("event_id", vote.alias("vote"), F.lit(None).cast("string").alias("comment"), F.lit("").alias("station_slug"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("/p"), F.col("user_id").cast("string"))).otherwise("p").alias("page_url"), F.lit("00000000-0000-0000-0000-000000000000").alias("visitor_id"), F.lit("general").alias("source"))
    return rows.select("event_id", F.array_join(documents.feedback_issues(), ",").alias("issues"))
