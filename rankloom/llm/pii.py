"""PII: patterns find the protected entities, and corpus co-occurrence finds the terms that give them away.

After Sanchez and Batet (C-sanitized, 2016): an entity e (a value of some kind: one e-mail address, one card) has the
information log(1/p(e)); a term t that is found near it reveals PMI(e; t) = log(p(e|t)/p(e)) of that, with p(e|t) the
share of all of t's occurrences in the corpus that are in texts where t is near e, shrunken by one occurrence elsewhere. A
term discloses e when this is at least `generalise` of e's information; from `remove` on it is removed rather than
generalised. Such terms are marked in the documents that hold e, wherever they are in the text.

How much must be seen depends on how rare both are: the pair is in two or more texts with different surroundings, and that
so many of t's occurrences were near e, the first set aside, would happen by chance to at most `chance` pairs of the corpus
(Chernoff's bound, times the number of pairs). One text alone can't show this; there a term counts that is written as a
name, inside a sentence or as all that stands before e on its line, and that occurs in no text without e near it.

Base patterns are taken leftmost, without overlap within a kind; possessive forms and look-behinds only keep the regular
expressions from starting over inside a run that has failed as a whole, and change no match.

Defined results: a null text counts as empty and has no spans; a null id is an id; rows with the same id and text get the
same spans, each its own row; offsets are code points, end exclusive; an empty table gives an empty result; other columns
are ignored. All on DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from .common import discard, let, matched, written

#: Kinds in their fixed order with their patterns.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"\p{L}{3,}|(?<!\p{L})\p{Lu}\p{L}"
#: Terms written as a name: with a capital, and not where a sentence begins; and what is before an entity if it's but names.
NAME = r"(?<=[\p{L}\p{N},;:(<-] {0,4})(?<!\p{L})\p{Lu}\p{L}+"
ONLY_NAMES = r"^\P{L}{0,3}\p{Lu}\p{L}+(?:\P{L}{1,3}\p{Lu}\p{L}+){0,3}\P{L}{0,3}$"
#: So many characters on either side, within the line, are an entity's surroundings.
AROUND = 150
SPAN = "array<struct<kind: string, start: int, end: int, value: string, before: string, after: string>>"


def running_sums(numbers: Column, chunk: int = 256) -> Column:
    """The sums of an array's first 1, 2, ... numbers: inside chunks, then over the chunks, so that no step copies more than a chunk."""
    none = F.expr("cast(array() as array<int>)")

    def inside(numbers: Column) -> Column:
        return F.aggregate(numbers, none, lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))))

    def over(parts: Column) -> Column:
        ends = inside(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: x + F.coalesce(F.get(e, i - 1), F.lit(0))))))

    chunks = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / chunk).cast("int")), lambda k: inside(F.slice(a, k * chunk + 1, F.lit(chunk))))
    return let(numbers, lambda a: F.when(F.size(a) > 0, let(chunks(a), over)).otherwise(none))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Spans of all matches, with the text between them as before and after."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(p: Column, m: Column) -> Column:
        ends = running_sums(F.transform(m, lambda x, i: F.length(F.get(p, i)) + F.length(x)))
        span = lambda x, i, e: F.struct(F.lit(kind).alias("kind"), (F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"), x.alias("value"), F.get(p, i).alias("before"), F.get(p, i + 1).alias("after"))
        return let(ends, lambda e: F.transform(m, lambda x, i: span(x, i, e)))

    return let(pieces, lambda p: let(found, lambda m: spans(p, m)))


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike(r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(13, 19) & let(digits, luhn)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind as listed, then by start."""
    none = F.expr(f"cast(array() as {SPAN})")

    def of_kind(k: str) -> Column:
        return F.when(text.rlike(HINTS[k]), F.filter(matches(text, PATTERNS[k], k), lambda s: valid(k, s["value"]))).otherwise(none)

    kinds = [of_kind(k) for k in PATTERNS]
    # of the text around a span only the surroundings go on, within the line and without halves of words
    near = lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        F.regexp_replace(F.substring_index(F.right(s["before"], F.lit(AROUND)), "\n", -1), r"^\p{L}+(?=.{%d,}$)" % (AROUND - 40), "").alias("before"),
        F.regexp_replace(F.substring_index(F.left(s["after"], F.lit(AROUND)), "\n", 1), r"(?<=^.{%d,%d})\p{L}+$" % (AROUND - 40, AROUND), "").alias("after"),
    )
    return F.transform(F.concat(*kinds), near)


def entity(span: Column) -> Column:
    value = F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def terms_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def disclosing_terms(base: DataFrame, docs: DataFrame, text_col: str, chance: float, generalise: float, remove: float) -> DataFrame:
    """entity, term, share (of the entity's information that the term reveals) and action, from counts over all documents."""
    spans = base.select("text_mark", F.explode("base").alias("s"))
    context = F.concat_ws(" ", "s.before", "s.after")
    names = F.concat(F.transform(F.regexp_extract_all(context, F.lit(NAME), F.lit(0)), F.lower), F.when(F.col("s.before").rlike(ONLY_NAMES), terms_of(F.col("s.before"))).otherwise(F.expr("cast(array() as array<string>)")))
    held = spans.select("text_mark", entity(F.col("s")).alias("entity"), F.xxhash64("s.before", "s.after").alias("surroundings"), terms_of(context).alias("terms"), names.alias("names"))
    near = held.select("entity", "text_mark", "surroundings", "names", F.explode(F.array_distinct("terms")).alias("term")).select("entity", "term", "text_mark", "surroundings", F.array_contains("names", F.col("term")).alias("named"))
    near = written(near.distinct(), "pii-near")
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = written(docs.select(F.explode(terms_of(text)).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")), "pii-terms")
    # all occurrences in a text where the term is near the entity once; copies of a text count as often as in n_term
    marks = near.select("text_mark").distinct().join(base.groupBy("text_mark").agg(F.count("*").alias("n")), "text_mark")
    held_in = matched(docs, marks, "text_mark", "n", docs.count()).where(F.col("of").isNotNull())
    inside = held_in.select("text_mark", F.explode(terms_of(text)).alias("term")).groupBy("text_mark", "term").agg(F.count("*").alias("n_inside"))
    both = near.select("entity", "term", "text_mark").distinct().join(inside, ["text_mark", "term"]).groupBy("entity", "term").agg(F.sum("n_inside").alias("n_both"))
    seen = near.groupBy("entity", "term").agg(F.countDistinct("surroundings").alias("ways"), F.countDistinct("text_mark").alias("texts"), F.max("named").alias("named"))
    pairs = written(seen.join(both, ["entity", "term"]), "pii-pairs")
    total, n_pairs = counted.agg(F.sum("n_term")).first()[0] or 1, pairs.count()
    entities = held.groupBy("entity").agg(F.count("*").alias("n_entity"), F.sum(F.size("terms")).alias("n_near"))
    information = F.log(F.lit(float(total)) / F.col("n_entity"))
    share = 1 + F.log((F.col("n_both") / (F.col("n_term") + 1))) / information
    # of the occurrences but the first: how many there are, counting each text with e once, and the share of those with e
    shown = F.least("ways", "texts")
    further = (shown - 1 + F.greatest(F.col("n_term") - F.col("n_both"), F.lit(0))).cast("double")
    p, q = (shown - 1) / further, F.least(F.col("n_near") / float(total), F.lit(1.0))
    surprise = further * (p * F.log(p / q) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - q))).otherwise(0.0))
    unlikely = F.when((shown >= 2) & (q < 1), (p > q) & (surprise >= math.log(max(n_pairs, 1) / chance))).otherwise(False)
    own = F.col("named") & (F.col("n_both") == F.col("n_term"))
    # a common word is near very many entities, and an entity may have very many terms
    known = spread_join(spread_join(pairs, counted, ["term"], total=n_pairs), entities, ["entity"], total=n_pairs)
    found = known.where((information > 0) & (unlikely | own)).select("entity", "term", share.alias("share")).where(F.col("share") >= generalise)
    disclosing = written(found.withColumn("action", F.when(F.col("share") >= remove, "removed").otherwise("generalised")), "pii-disclosing")
    discard(near, counted, pairs)
    return disclosing


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chance: float = 1.0, generalise: float = 0.9, remove: float = 0.97) -> DataFrame:
    """A row per document: doc_id, text_mark (a hash of the text), base and added spans (kind, start, end, value; added ones are of kind term, with their action)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_mark"))
    base = written(rows.select("doc_id", "text_mark", base_spans(F.col("text")).alias("base")), "pii-base")
    some = base.where(F.size("base") > 0)
    terms = disclosing_terms(some, rows, "text", chance, generalise, remove)
    slim = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(None).cast("string").alias("action")))
    none = F.expr("cast(array() as array<struct<kind: string, start: int, end: int, value: string, action: string>>)")
    if terms.isEmpty():
        return base.select("doc_id", "text_mark", slim.alias("base"), none.alias("added"))
    holders = written(some.select("doc_id", "text_mark", F.explode(F.array_distinct(F.transform("base", entity))).alias("entity")), "pii-holders")
    of_entity = terms.join(holders.groupBy("entity").agg(F.count("*").alias("n")), "entity").groupBy("entity").agg(F.first("n").alias("n"), F.collect_list(F.struct("term", "action")).alias("terms"))
    shared = matched(holders, of_entity, "entity", "n", holders.count()).select("doc_id", "text_mark", F.explode("of.terms").alias("t"))
    actions = shared.groupBy("doc_id", "text_mark", F.col("t.term").alias("term")).agg(F.max("t.action").alias("action"))
    wanted = actions.groupBy("doc_id", "text_mark").agg(F.collect_list(F.struct("term", "action")).alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("_id"), F.col("text_mark").alias("_mark"), "wanted")
    spans = some.dropDuplicates(["doc_id", "text_mark"]).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_mark") == F.col("_mark"))).select("_id", "_mark", "base", "wanted")
    placed = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_mark") == F.col("_mark")))
    outside = lambda s: ~F.exists("base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"]))
    hit = lambda s: let(F.lower(s["value"]), lambda w: F.filter("wanted", lambda x: x["term"] == w))
    words = F.transform(matches(F.col("text"), TERM, "term"), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.get(hit(s), 0)["action"].alias("action")))
    added = placed.select("_id", "_mark", F.filter(words, lambda s: s["action"].isNotNull() & outside(s)).alias("added")).dropDuplicates(["_id", "_mark"])
    out = base.join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_mark") == F.col("_mark")), "left")
    return out.select("doc_id", "text_mark", slim.alias("base"), F.coalesce("added", none).alias("added"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets, or nothing where its action is removed; overlapping spans are replaced together."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(F.coalesce(s["action"], F.lit("")) == "removed", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("label"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["at"]
        out = F.when(free, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["label"])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(F.length(text) - acc["at"], F.lit(0)))))
