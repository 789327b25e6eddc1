"""The corpus operators' queries, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontam, exact_dedup, jaccard, line_dedup, pii, quality, reputation, resampling, sharding, toxicity, warc
from .common import held_out, table

BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: The words of a text, A-Z in lower case: runs of digits, letters and all beyond ASCII.
WORDS_SQL = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def scored(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(toxicity.Model(docs, table(spark, sf_dir, "labels")).score(docs), 0.5)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.cleaned(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [number(k) for k in pii.PATTERNS]
    acted = [F.size(F.filter("added", lambda s: s["action"] == a)).cast("long").alias(f"n_{a}") for a in ("generalised", "removed")]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"), *acted)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_replay(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.families(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, num=85)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.default_path(spark))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(quality.Model(docs, table(spark, sf_dir, "labels")).score(docs), 0.3)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of its id: bad if toxic or of low quality."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return reputation.judged(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict", F.round("bound", 6).alias("bound"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_pii": op3_pii,
    "op4_warc": op4_warc,
    "op5_decontamination": op5_decontamination,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_bpe": op8_bpe,
    "op9_sharding": op9_sharding,
    "op10_quality": op10_quality,
    "op11_resampling": op11_resampling,
    "op12_collocations": op12_collocations,
    "op13_url_filter": op13_url_filter,
}

ORACLE_SQL = {
    "op2_line_dedup": f"""
        with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
        k as (select *, translate(trim(line, {BLANKS_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
        s as (select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
        m as (select k.*, s.first is not null and k.doc_id <> s.first as gone from k left join s using (key))
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
        from m group by doc_id""",
    "op4_warc": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
        f as (select *, min(page_id) over (partition by payload_digest) as first from p)
        select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 100 and page_id <> first then first end as refers_to from f""",
    "op5_decontamination": f"""
        with d as (select doc_id, {WORDS_SQL} as w from documents), i as (select item_id, {WORDS_SQL} as w from benchmark),
        iw as (select item_id, least(len(w), 10) as n, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from i where len(w) > 0),
        wins as (select distinct item_id, n, array_to_string(w[s:s + n - 1], ' ') as win from iw),
        dw as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from wins)),
        hits as (select doc_id, s, n, item_id from (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as win from dw) join wins using (n, win)),
        placed as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hits) group by 1),
        listed as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from hits) group by 1)
        select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join placed using (doc_id) left join listed using (doc_id)""",
    "op6_exact_dedup": f"""
        with d as (select doc_id, coalesce(text, '') as t, translate(coalesce(text, ''), {BLANKS_SQL}, '') as n from documents),
        r as (select *, first_value(doc_id) over w as keep_id, count(*) over (partition by n) as group_size from d window w as (partition by n order by length(t) desc, doc_id))
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n) as text_sha256 from r""",
    # the CRC of each distinct feature, byte by byte
    "op11_resampling": f"""
        with recursive x as materialized (select list(c order by b) as t from (select b, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b) as c from range(256) r(b))),
        d as (select doc_id, 's' as side, {WORDS_SQL} as w from documents union all select null, 't', {WORDS_SQL} from benchmark),
        r as (select row_number() over () as row, * from d),
        g as (select row, side, w, unnest([1, 2, 3]) as n from r),
        f as (select row, side, array_to_string(w[i:i + n - 1], ' ') as feature from (select row, side, w, n, unnest(range(1, len(w) - n + 2)) as i from g)),
        u as (select feature, hex(encode(feature)) as h from (select distinct feature from f)),
        k as (select feature, xor(4294967295::bigint, list_reduce(range(0, len(h) // 2), lambda c, i: xor(c >> 8, t[1 + (xor(c, ('0x' || h[2 * i + 1:2 * i + 2])::bigint) & 255)]), 4294967295::bigint)) % 10000 as bucket from u, x),
        m as (select row, side, bucket from f join k using (feature)),
        c as (select bucket, count(*) filter (side = 's') as s, count(*) filter (side = 't') as t from m group by bucket),
        a as (select sum(s) as ss, sum(t) as tt from c),
        q as (select bucket, floor(1000 * ln(((t + 1)::double * (ss + 10000)::double) / ((s + 1)::double * (tt + 10000)::double)))::bigint as gain from c, a),
        w as (select row, count(*) as n_features, sum(gain)::bigint as weight from m join q using (bucket) where side = 's' group by row),
        z as (select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
                     ('0x' || sha256('42:' || doc_id::varchar)[1:8])::bigint as h from r left join w using (row) where side = 's'),
        v as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from z),
        o as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) filter (n_words >= 20) over () as total from v)
        select doc_id, n_features, weight, score, case when n_words >= 20 and place <= total * 5 // 100 then place end as rank from o""",
    "op12_collocations": r"""
        with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
        w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p),
        g as (select lang, w, unnest([1, 2, 3, 4]) as n from w),
        f as (select lang, n, phrase, count(*) as f from (select lang, n, array_to_string(w[i:i + n - 1], ' ') as phrase from (select lang, w, n, unnest(range(1, len(w) - n + 2)) as i from g)) group by all),
        c as (select lang, n, phrase, f as a, string_split(phrase, ' ') as w from f where n > 1 and f >= 30),
        k as (select c.*, k, array_to_string(w[:k], ' ') as first, array_to_string(w[k + 1:], ' ') as rest from (select *, unnest(range(1, n)) as k from c) c),
        s as (select k.lang, k.phrase, k.n, k.a, k, x.f as l, y.f as r, 2000000::hugeint * k.a // (x.f + y.f) as score from k join f x on x.lang = k.lang and x.phrase = k.first join f y on y.lang = k.lang and y.phrase = k.rest),
        b as (select lang, phrase, n, a, arg_min(struct_pack(l := l, r := r, score := score), struct_pack(score := score, k := k)) as m from s group by all),
        d as (select b.lang, b.phrase, a, m from b where not exists (select 1 from c where c.lang = b.lang and c.n > b.n and contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') and 100::hugeint * c.a >= 80 * b.a)),
        t as (select lang, sum(len(w))::bigint as n from w group by lang),
        o as (select lang, phrase, a, m.l as l, m.r as r, m.score::bigint as score, row_number() over (partition by lang order by m.score desc, a desc, phrase) as rank from d)
        select lang, rank, phrase, a, l, r, n, score from o join t using (lang) where rank <= 2000""",
    # levels from all pages down to hosts; how strongly each pulls is between half a page and 1,000
    "op13_url_filter": f"""
        with r as (select page_id, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') as rest from pages),
        p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
        b as (select doc_id as page_id, max(case when toxic = 1 or quality = 0 then 1 when toxic is not null and quality is not null then 0 end) as bad from labels group by doc_id),
        h as (select host, count(bad) as n, coalesce(sum(bad), 0) as k from p left join b using (page_id) group by host),
        c as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') as plain from h),
        l as (select *, string_split(plain, '.') as w, regexp_matches(plain, '^[0-9.]+$|^\\[') or not contains(plain, '.') as alone from c),
        e as (select *, len(w) > 2 and array_to_string(w[-2:], '.') in ({', '.join(repr(x) for x in reputation.SUFFIXES)}) as two from l),
        d as (select host, n, k, plain, case when alone then plain else array_to_string(w[case when two then -3 else -2 end:], '.') end as domain,
                     case when alone then '' else array_to_string(w[case when two then -2 else -1 end:], '.') end as suffix from e),
        hs as (select suffix, domain, plain, sum(n) as n, sum(k) as k from d group by all),
        ds as (select suffix, domain, sum(n) as n, sum(k) as k from hs group by all),
        ss as (select suffix, sum(n) as n, sum(k) as k from ds group by all),
        s1 as (select *, ((select sum(k) from ss) + 1) / ((select sum(n) from ss) + 2) as above from ss),
        s2 as (select {{sums}} from s1), s3 as (select suffix, (k + pages * above) / (n + pages) as above from s1, s2),
        d1 as (select ds.*, above from ds join s3 using (suffix)),
        d2 as (select {{sums}} from d1), d3 as (select suffix, domain, (k + pages * above) / (n + pages) as above from d1, d2),
        h1 as (select hs.*, above from hs join d3 using (suffix, domain)),
        h2 as (select {{sums}} from h1), h3 as (select plain, n + pages as strength, (k + pages * above) / (n + pages) as mean from h1, h2),
        o as (select host, mean - 1.645 * sqrt(mean * (1 - mean) / (strength + 1)) as bound from d join h3 using (plain)),
        f as (select page_id, host, path, bound, case
            when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then ['example.net/en/', 'allow']
            when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then ['example.com/de/', 'block']
            when (host = 'org' or host like '%.org') and path like '/fr/%' then ['org/fr/', 'allow']
            when (host = 'net' or host like '%.net') and path like '/%' then ['net/', 'block'] end as rule from p join o using (host))
        select page_id, host, path, rule[1] as rule, coalesce(rule[2], case when bound > 0.5 then 'block' else 'allow' end) as verdict, round(bound, 6) as bound from f""".replace(
        "{sums}",
        "coalesce(least(greatest(1 / greatest((sum((k - n * above) ** 2) - sum(n * above * (1 - above))) / nullif(sum(n * above * (1 - above) * (n - 1)), 0), 1e-9) - 1, 0.5), 1000.0), 1000.0) as pages",
    ),
}
