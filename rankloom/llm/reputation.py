"""URL filters by rules, and by the reputation of hosts that labelled pages give them.

A rule is a host and the beginning of a path; it fits its host and all subdomains, and the longest that fits decides. What
no rule fits is judged by its host. Labelled pages are good or bad; how often a host's are bad is estimated by empirical
Bayes: the beta-binomial prior of a host is centred on its registered domain's share, that of a domain on its suffix's, that
of a suffix on the share of all pages. How strongly each level pulls comes from how much groups of that level differ more
than chance lets them (the moments of the beta-binomial distribution, over all groups). A host is blocked if the lower
bound of its posterior, `z` standard deviations below the mean, is over `limit`: few labels, or labels like those of the
hosts around, don't block it.

Defined results: a null URL, or one without `://`, has an empty host and path, and such pages share one reputation; a page
with several labels is bad if any is; a label without a page, or without an id, counts for nothing; copies of a page's row
count as pages; without labels, nothing is blocked but by rules; an empty table gives no rows; other columns are ignored.
Suffixes are the last part of a host, or the last two if these are in `suffixes`; user names, ports and a final dot are no
part of a host's reputation; a host that is an IP address, or has one part, is its own domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, matched, unused, written

#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of two parts under which domains are registered.
SUFFIXES = ("ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
#: A prior counts as so many pages at most, and at least.
STRONGEST, WEAKEST = 1_000.0, 0.5


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL: what is after the first :// up to / ? # or the end, and from there up to ? # or the end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def domain_of(host: Column, suffixes: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """A host without user, port and final dot, its registered domain and its suffix."""
    plain = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")
    two, three = F.substring_index(plain, ".", -2), F.substring_index(plain, ".", -3)
    alone = plain.rlike(r"^[0-9.]+$|^\[") | ~F.contains(plain, F.lit("."))
    double = two.isin(*suffixes) & (plain != two)
    suffix = F.when(alone, F.lit("")).when(double, two).otherwise(F.substring_index(plain, ".", -1))
    return plain, F.when(alone, plain).when(double, three).otherwise(two), suffix


def _shrunk(groups: DataFrame, level: str) -> DataFrame:
    """groups (n, k and the mean of the level above, `above`) with `level`, the posterior mean, and its strength: n and the prior's pages together."""
    spread = F.col("n") * F.col("above") * (1 - F.col("above"))
    off = F.col("k") - F.col("n") * F.col("above")
    sums = groups.agg(F.sum(off * off).alias("off"), F.sum(spread).alias("chance"), F.sum(spread * (F.col("n") - 1)).alias("more"))
    rho = F.when(F.col("more") > 0, (F.col("off") - F.col("chance")) / F.col("more"))  # how alike pages of one group are
    prior = sums.select(F.coalesce(F.least(F.greatest(1 / F.greatest(rho, F.lit(1e-9)) - 1, F.lit(WEAKEST)), F.lit(STRONGEST)), F.lit(STRONGEST)).alias("pages"))
    mean = (F.col("k") + F.col("pages") * F.col("above")) / (F.col("n") + F.col("pages"))
    others = [c for c in groups.columns if c != "above"]
    return groups.crossJoin(F.broadcast(prior)).select(*others, mean.alias(level), (F.col("n") + F.col("pages")).alias("strength"))  # one row


def reputations(hosts: DataFrame, z: float = 1.645, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """host, n, k, mean and bound: hosts (host, labelled pages n, bad ones k) with the posterior mean of being bad and its lower bound."""
    plain, domain, suffix = domain_of(F.col("host"), suffixes)
    named = hosts.select("host", "n", "k", plain.alias("plain"), domain.alias("domain"), suffix.alias("suffix"))
    by_host = written(named.groupBy("suffix", "domain", "plain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "reputation-hosts")
    by_domain = written(by_host.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "reputation-domains")
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = by_suffix.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("above"))
    top = written(_shrunk(by_suffix.crossJoin(F.broadcast(overall)), "above").select("suffix", "above"), "reputation-suffixes")  # one row
    # a suffix may have very many domains, and a domain very many hosts
    size = by_domain.groupBy("suffix").agg(F.count("*").alias("rows"))
    under = matched(by_domain, top.join(size, "suffix"), "suffix", "rows", by_domain.count()).withColumn("above", F.col("of.above")).drop("of")
    middle = written(_shrunk(under, "above").select("domain", "suffix", "above"), "reputation-middle")
    size = by_host.groupBy("suffix", "domain").agg(F.count("*").alias("rows"))
    known = middle.join(size, ["suffix", "domain"]).select(F.struct("suffix", "domain").alias("key"), "above", "rows")
    below = matched(by_host.withColumn("key", F.struct("suffix", "domain")), known, "key", "rows", by_host.count()).withColumn("above", F.col("of.above")).drop("of", "key")
    judged = _shrunk(below, "mean")
    bound = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + 1))
    return named.select("host", "plain").join(judged.select("plain", "n", "k", "mean", bound.alias("bound")), "plain").drop("plain")


def judged(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, limit: float = 0.5, z: float = 1.645, suffixes: tuple[str, ...] = SUFFIXES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, and the host's bound. outcomes: page_id and bad (boolean), of some pages."""
    host, path = parts(F.col(url_col))
    rows = written(pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")), "reputation-pages")
    total = rows.count()
    labels = outcomes.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = rows.groupBy("page_id").agg(F.count("*").alias("rows")).join(labels, "page_id")
    met = matched(rows, labelled, "page_id", "rows", total).select("host", F.col("of.bad").alias("bad"))
    hosts = written(met.groupBy("host").agg(F.count("bad").alias("n"), F.count_if("bad").alias("k"), F.count("*").alias("pages")), "reputation-counts")
    known = hosts.select("host", "pages").join(reputations(hosts.select("host", "n", "k"), z, suffixes).select("host", "bound"), "host")
    out = matched(rows, known, "host", "pages", total)
    ruled = out.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("of.bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", own).alias("verdict"), F.col("of.bound").alias("bound"))


def allowed(pages: DataFrame, found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """pages, all columns, less those that found blocks; of an id that several rows have, all go if one is blocked."""
    (key,) = unused(pages, "_key")
    gone = found.where("verdict = 'block'").select(F.struct("page_id").alias(key)).distinct()
    return pages.join(gone, F.struct(F.col(id_col)).eqNullSafe(F.col(key)), "left_anti")
