"""Places: the longest phrase of a gazetteer from left to right, and postcodes coupled to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_key, matches, span
from .detect import NO_SPANS, POSTCODE
from .names import BASE, BOOSTED, TRIGGERS, WINDOW, near, triggers

PLACE_TOKEN = r"[A-Za-zÀ-ÿ'’\-]+"
MAX_WORDS = 8
#: What may stand before a postcode, and how far.
POSTCODE_TRIGGERS = ("à ", "demeurant à ", "habite à ")
POSTCODE_TRIGGER_WINDOW, COMMUNE_WINDOW = 10, 15


def gap(a: Column, b: Column) -> Column:
    """Characters between two spans; negative if they overlap."""
    return F.greatest(b["start"] - a["end"], a["start"] - b["end"])


def nearest(code: Column, communes: Column) -> Column:
    """The commune with the smallest gap, the first of equals; null without one."""
    keyed = F.transform(communes, lambda c, i: F.struct(gap(code, c).alias("gap"), i.alias("i"), c.alias("c")))
    return F.array_min(F.filter(keyed, lambda k: k["gap"] >= 0))["c"]


def coupled_postcodes(text: Column, communes: Column, window: int = COMMUNE_WINDOW) -> Column:
    """Five digits next to a commune, or soon after one of the triggers."""
    led = matches(text, "|".join(sorted(POSTCODE_TRIGGERS, key=len)))

    def emit(p: Column) -> Column:
        by_place = F.exists(communes, lambda c: gap(p, c).between(0, window))
        by_trigger = F.exists(led, lambda t: (p["start"] - t["end"]).between(0, POSTCODE_TRIGGER_WINDOW))
        rule = F.when(by_place, "cp-commune").when(by_trigger, "cp-trigger")
        return span(p["start"], p["end"], "CODE_POSTAL", p["value"], rule, 0.9)

    return F.filter(F.transform(matches(text, POSTCODE), emit), lambda s: s["rule_id"].isNotNull())


def tokens(text: Column) -> Column:
    """array<struct<start, end, value, glued>> of place tokens; glued: only white space stands before it."""
    between = F.split(text, PLACE_TOKEN, -1)
    return F.zip_with(matches(text, PLACE_TOKEN), F.slice(between, F.lit(1), F.size(between) - 1), lambda t, gap: F.struct(t["start"], t["end"], t["value"], F.coalesce(gap.rlike(r"(?U)^\s+$"), F.lit(False)).alias("glued")))


def place_candidates(docs: DataFrame, gazetteer: DataFrame, doc_id: str, text: str, words=TRIGGERS, window: int = WINDOW) -> DataFrame:
    """(doc_id, cand): every phrase of a gazetteer at every token, for `leftmost_longest`.

    A token's row carries the next tokens only, as many as a phrase may have, and the triggers near them. Tokens that
    begin no entry go in a semi-join on the first word; the phrases of the others meet the gazetteer in one join.
    Between tokens of a phrase only white space may stand, besides the hyphens and apostrophes that tokens hold.
    """
    entries = gazetteer.where(F.col("kind").isin("commune", "voie")).select("key", F.col("kind").alias("of")).distinct()
    starts = entries.select(F.substring_index("key", " ", 1).alias("head")).distinct()
    rows = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("toks"), triggers(F.col(text), words).alias("trig"))

    def ahead(t: Column, i: Column) -> Column:
        next_ = F.slice(F.col("toks"), i + 1, F.lit(MAX_WORDS))
        last = F.element_at(next_, -1)["end"]
        return F.struct(i.alias("i"), next_.alias("w"), F.filter("trig", lambda g: (g["end"] > t["start"] - window) & (g["start"] <= last + window)).alias("trig"))

    at = rows.select("doc_id", F.explode(F.transform("toks", ahead)).alias("a")).withColumn("head", fold_key(F.col("a.w")[0]["value"])).join(starts, "head", "left_semi")
    grow = F.transform(F.sequence(F.lit(1), F.size("a.w")), lambda n: F.slice(F.col("a.w"), F.lit(1), n))
    tight = F.filter(grow, lambda w: F.forall(F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda t: t["glued"]))
    grown = at.select("doc_id", F.col("a.i").alias("i"), F.col("a.trig").alias("trig"), F.explode(tight).alias("w"))
    phrase = F.array_join(F.transform("w", lambda t: t["value"]), " ")
    grown = grown.select("doc_id", "i", F.size("w").alias("n"), fold_key(phrase).alias("key"), phrase.alias("value"), F.get("w", F.lit(0))["start"].alias("start"), F.element_at("w", -1)["end"].alias("end"), "trig")
    hits = grown.join(entries, "key")
    kind = F.when(F.col("of") == "voie", "VOIE").otherwise("COMMUNE")
    sure = F.when(near(F.struct("start", "end"), F.col("trig"), window), BOOSTED).otherwise(BASE)
    s = span(F.col("start"), F.col("end"), kind, F.col("value"), F.concat(F.lit("gazetteer-"), F.col("of")), sure)
    # by first token; then the longest, streets first
    return hits.select("doc_id", F.struct("i", (-(F.col("end") - F.col("start"))).alias("len"), F.when(F.col("of") == "voie", 0).otherwise(1).alias("rank"), "n", s.alias("s")).alias("cand"))


def leftmost_longest(candidates: Column) -> Column:
    """Spans of the longest candidate at each token, streets before communes of equal length, going on behind it."""
    step = lambda acc, c: F.when(c["i"] < acc["next"], acc).otherwise(F.struct((c["i"] + c["n"]).alias("next"), F.concat(acc["out"], F.array(c["s"])).alias("out")))
    return F.aggregate(F.array_sort(candidates), F.struct(F.lit(0).alias("next"), F.array().cast(NO_SPANS).alias("out")), step, lambda acc: acc["out"])


def with_postcodes(text: Column, places: Column) -> Column:
    """Spans of places (null: none), and of the postcodes that are coupled to them."""
    found = F.coalesce(places, F.array().cast(NO_SPANS))
    communes = F.filter(found, lambda s: s["type"] == "COMMUNE")
    return F.concat(found, F.coalesce(coupled_postcodes(text, communes), F.array().cast(NO_SPANS)))


def detect_places(docs: DataFrame, gazetteer: DataFrame, doc_id: str, text: str, words=TRIGGERS, window: int = WINDOW) -> DataFrame:
    """(doc_id, spans) of communes, streets and coupled postcodes, for every document."""
    found = place_candidates(docs, gazetteer, doc_id, text, words, window).groupBy("doc_id").agg(leftmost_longest(F.collect_list("cand")).alias("p"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(found, "doc_id", "left")
    return rows.select("doc_id", with_postcodes(F.col("text"), F.col("p")).alias("spans"))


def detect_communes(*args, **kwargs) -> DataFrame:
    """`detect_places`, communes only."""
    return detect_places(*args, **kwargs).withColumn("spans", F.filter("spans", lambda s: s["type"] == "COMMUNE"))


def detect_streets(*args, **kwargs) -> DataFrame:
    """`detect_places`, streets only."""
    return detect_places(*args, **kwargs).withColumn("spans", F.filter("spans", lambda s: s["type"] == "VOIE"))
