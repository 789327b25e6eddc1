"""Checks and choices on documents, tags, photos, feedback rows and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hepburn, hyphen_capitals, slugified
from .ranking import best_of_each

LANGUAGES, FIELDS = ("en", "ja", "ru"), ("atmosphere", "landmarks", "food", "nightlife")


def document_issues(languages: tuple[str, ...] = LANGUAGES, fields: tuple[str, ...] = FIELDS) -> Column:
    """What a multilingual document of nested structs lacks, in order; empty if nothing."""
    tests = []
    for lang in languages:
        tests.append(F.when(F.col(lang).isNull(), f"missing {lang}"))
        for f in fields:
            value = F.col(f"{lang}.{f}")
            tests.append(F.when(F.col(lang).isNotNull(), F.when(value.isNull(), f"{lang}.{f} missing").when(F.trim(value) == "", f"{lang}.{f} empty")))
    return F.array_compact(F.array(*tests))


def tag_class(tags: Column, good: list[str], bad: list[str]) -> Column:
    """bad with two bad tags, or with one and no good one; tags count as often as they come."""
    n = lambda of: F.size(F.filter(tags, lambda t: F.lower(t).isin(of)))
    return F.when((n(bad) >= 2) | ((n(bad) > 0) & (n(good) == 0)), "bad").otherwise("good")


def license_ok(name: Column, allowed: list[str]) -> Column:
    """Any of the allowed ones is in the name; no name passes."""
    return (F.coalesce(name, F.lit("")) == "") | F.exists(F.array(*map(F.lit, allowed)), lambda a: F.contains(F.lower(name), a))


def face_flag(faces: Column, area: float = 0.02, confidence: float = 0.7) -> Column:
    return F.exists(faces, lambda f: (f["area_ratio"] >= area) | (f["confidence"] >= confidence))


def feedback_issues() -> Column:
    """Why a feedback row is refused, in order; columns vote, comment, station_slug, page_url, visitor_id, source."""
    uuid = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    no = lambda test: ~F.coalesce(test, F.lit(False))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.array_compact(F.array(
        F.when(no(F.col("vote").isin("up", "down")), "vote"),
        F.when(F.length("comment") > 1000, "comment"),
        F.when(some(F.col("station_slug")) & no(F.col("station_slug").rlike(r"^[a-z0-9-]+$")), "station_slug"),
        F.when(no(F.col("page_url").startswith("/") & (F.length("page_url") <= 500)), "page_url"),
        F.when(no(F.col("visitor_id").rlike(uuid)), "visitor_id"),
        F.when(no(F.col("source").isin("station_page", "general")), "source"),
    ))


def widest(images: Column) -> Column:
    """The url of the entry of greatest width of an array of (width, url); // becomes https://."""
    best = F.array_max(F.transform(images, lambda i: F.struct(i["width"].alias("width"), i["url"].alias("url"))))["url"]
    return F.regexp_replace(best, "^//", "https://")


def compact_json(**parts: Column) -> Column:
    """JSON of the parts that are neither null nor 0 nor empty."""
    return F.to_json(F.struct(*(F.when((v.cast("string") != "0") & (v.cast("string") != "") & (v.cast("string") != "0.0"), v).alias(k) for k, v in parts.items())))


#: Names of licences by code.
LICENSES = {"1": "CC BY-NC-SA 2.0", "2": "CC BY-NC 2.0", "3": "CC BY-NC-ND 2.0", "4": "CC BY 2.0", "5": "CC BY-SA 2.0", "6": "CC BY-ND 2.0", "7": "No known copyright restrictions", "9": "CC0 1.0", "10": "Public Domain"}


def license_label(code: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LICENSES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, code.cast("string")), F.lit("CC"))


def photo_ok(tags: Column, urls: list[Column], bad: list[str]) -> Column:
    """Fewer than two bad tags in a text of tags, and some URL."""
    words = F.split(F.lower(F.coalesce(tags, F.lit(""))), r"\s+")
    some = F.lit(False)
    for u in urls:
        some = some | (F.coalesce(u, F.lit("")) != "")
    return (F.size(F.filter(words, lambda t: t.isin(bad))) < 2) & some


def camera_records(cameras: DataFrame) -> DataFrame:
    """id, names, video_id, URLs and place of cameras (id, center, name, html, channel): those without two numbers as centre or without a video are left out; names fall back from English to the id to a literal, from Japanese to English."""
    video = F.regexp_extract(F.coalesce("html", F.lit("")), r"embed/([A-Za-z0-9_-]{11})", 1)
    english = F.coalesce(F.nullif(F.col("name.en"), F.lit("")), F.nullif(F.col("id"), F.lit("")), F.lit("Live Camera"))
    placed = cameras.where(F.size("center") == 2).select("*", F.get("center", F.lit(0)).try_cast("double").alias("lng"), F.get("center", F.lit(1)).try_cast("double").alias("lat"), video.alias("video_id"), english.alias("name_en"))
    kept_rows = placed.where("lng is not null and lat is not null and video_id <> ''")
    of = lambda before, after="": F.concat(F.lit(before), F.col("video_id"), F.lit(after))
    return kept_rows.select(
        "id", "name_en", F.coalesce(F.nullif(F.col("name.ja"), F.lit("")), F.col("name_en")).alias("name_ja"), "video_id", F.coalesce("channel", F.lit("")).alias("channel_id"),
        of("https://www.youtube.com/embed/", "?autoplay=1&mute=1&playsinline=1").alias("embed_url"), of("https://www.youtube.com/watch?v=").alias("watch_url"), of("https://i.ytimg.com/vi/", "/hqdefault.jpg").alias("thumbnail"), "lat", "lng",
    )


def station_groups(groups: DataFrame) -> DataFrame:
    """slug, name, place, lines and their number of groups (name, prefecture, stations: array of line_id, lat, lon): the first station gives the place, groups without one are left out, of a slug the first group in order of `pos` stays; most lines first, then by name."""
    first = F.get("stations", F.lit(0))
    lines = F.filter(F.transform("stations", lambda s: s["line_id"]), lambda i: i.isNotNull() & (i != 0))
    named = groups.where((F.coalesce(first["lat"], F.lit(0.0)) != 0) & (F.coalesce(first["lon"], F.lit(0.0)) != 0)).select("pos", "name", "prefecture", first["lat"].alias("lat"), first["lon"].alias("lng"), lines.alias("lines"), slugified(F.col("name")).alias("slug"))
    once = best_of_each(named, ["slug"], ["pos"])
    return once.withColumn("line_count", F.when(F.size("lines") > 0, F.size("lines")).otherwise(1)).drop("pos").orderBy(F.desc("line_count"), "name")


def renamed(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """What changes of (slug, name): by the overrides (slug, new_name, new_slug) where there is one, else by the spelling rule; rows that stay the same are left out."""
    both = df.join(overrides, "slug", "left").withColumn("is_override", F.col("new_slug").isNotNull())
    name = F.coalesce("new_name", hyphen_capitals(hepburn(F.col("name"))))
    slug = F.coalesce("new_slug", hepburn(F.col("slug")))
    out = both.select(F.col("slug").alias("old_slug"), slug.alias("new_slug"), F.col("name").alias("old_name"), name.alias("new_name"), "is_override")
    return out.where((F.col("old_slug") != F.col("new_slug")) | (F.col("old_name") != F.col("new_name")))
