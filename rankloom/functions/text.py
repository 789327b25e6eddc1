"""Strings, URLs, JSON and clock times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugified(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def hepburn(name: Column) -> Column:
    """Long vowels as one letter, in the order ou, uu, oo."""
    for pattern, letter in (("(o)u", "$1"), ("(u)u", "$1"), ("(o)o", "$1")):
        name = F.regexp_replace(name, f"(?i){pattern}", letter)
    return name


def hyphen_capitals(name: Column) -> Column:
    """Each part between hyphens with its first letter as a capital, parts that begin with a parenthesis as they are."""
    return F.array_join(F.transform(F.split(name, "-"), lambda p: F.when(p.startswith("("), p).otherwise(F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 1 << 30)))), "-")


def snippet(text: Column, most: int = 120) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def first_of(*names: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(n, F.lit("")) for n in names))


def without_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, "<[^>]*>", ""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def md5_prefix(text: Column, n: int = 12) -> Column:
    return F.left(F.md5(text), F.lit(n))


def price_label(price: Column, low: int, high: int) -> Column:
    """k of the price; at or beyond the limits an open range."""
    k = F.floor(price / 1000 + 0.5).cast("string")
    return F.when(price >= high, F.concat(k, F.lit("k+"))).when(price <= low, F.concat(F.lit("<"), k, F.lit("k"))).otherwise(F.concat(k, F.lit("k")))


def ten_thousands(text: Column) -> Column:
    """12.5 ten-thousands as 125000; null where there is no number."""
    return F.floor(F.nullif(F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double") * 10000 + 0.5).cast("long")


def minutes_of(clock: Column) -> Column:
    """HH:MM to minutes; null if it isn't that."""
    parts = F.split(clock, ":")
    return F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int")


def clock_of(minutes: Column) -> Column:
    return F.concat(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def encoded(text: Column) -> Column:
    """Percent-encoding with %20 for a space."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def municipality_key(city: Column, ward: Column) -> Column:
    """A city with its ward in one string where the city is one with wards, else whichever there is."""
    return F.when(city.endswith("市") & ward.endswith("区"), F.concat(city, ward)).otherwise(first_of(city, ward))


def json_array(text: Column, schema: str) -> Column:
    """The first [...] in a text, parsed."""
    return F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), schema)


def meta_description(text: Column, fallback: Column, most: int = 155) -> Column:
    return F.coalesce(F.nullif(F.left(text, F.lit(most)), F.lit("")), fallback)


def path_below(url: Column, prefix: str) -> Column:
    """What comes after the prefix and a slash; null for other URLs."""
    return F.when(url.startswith(f"{prefix}/"), F.substring(url, len(prefix) + 2, 1 << 30))


def thumb_variants(url: Column, widths: tuple[int, ...] = (1280, 800)) -> Column:
    """Larger forms of a thumbnail's URL, the widest first, then the URL itself, which is all there is if it isn't one."""
    name = F.element_at(F.split(F.regexp_extract(url, r"/thumb/(.+?)/\d+px-", 1), "/"), -1)
    wider = F.array(*(F.concat(F.regexp_replace(url, r"/\d+px-[^/]+$", ""), F.lit(f"/{w}px-"), name) for w in widths))
    return F.concat(F.when(url.rlike(r"/thumb/.+?/\d+px-[^/]+$"), wider).otherwise(F.array().cast("array<string>")), F.array(url))


def day_type(trip_id: Column) -> Column:
    return F.when(F.coalesce(trip_id, F.lit("")).contains("SaturdayHoliday"), "holiday").otherwise("weekday")


def iso_day(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd")


def month(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM")


def utc_stamp(t: Column) -> Column:
    """Seconds and Z; t is a time without zone in UTC."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
