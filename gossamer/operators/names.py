"""Names: capitalised tokens that meet the gazetteers, and triggers near them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_key, matches, overlaps, span
from .detect import NO_SPANS

#: Literal triggers, and how near they must be.
TRIGGERS = ("M.", "Mme", "Maître", "né(e) le", "demeurant", "ci-après")
WINDOW = 40
NAME_TOKEN = r"[A-ZÀ-Ý][A-Za-zÀ-ÿ'’\-]*"
BASE, BOOSTED, CAPTURED = 0.5, 0.9, 0.8


def triggers(text: Column, words=TRIGGERS) -> Column:
    """Occurrences of the literal triggers; of two at one place the longer."""
    if not words:
        return matches(text, "(?!)")
    return matches(text, "|".join(re.escape(w).replace("’", "’") for w in sorted(words, key=lambda w: (-len(w), w))))


def near(token: Column, found: Column, window: int = WINDOW) -> Column:
    """A trigger starts within the window after the token, or one before it ends less than the window away."""
    after = lambda t: (t["start"] >= token["end"]) & (t["start"] <= token["end"] + window)
    before = lambda t: (t["start"] < token["end"]) & (t["end"] > token["start"] - window)
    return F.exists(found, lambda t: after(t) | before(t))


def name_tokens(text: Column, words=TRIGGERS, window: int = WINDOW) -> Column:
    """array<struct<start, end, value, near>> of name tokens that are no part of a trigger."""
    found = triggers(text, words)
    both = F.struct(found.alias("trig"), matches(text, NAME_TOKEN).alias("tok"))
    bound = F.get(F.transform(F.array(both), lambda b: F.transform(F.filter(b["tok"], lambda t: ~F.exists(b["trig"], lambda g: overlaps(t, g))), lambda t: F.struct(t["start"], t["end"], t["value"], near(t, b["trig"], window).alias("near")))), F.lit(0))
    return bound


def name_spans(docs: DataFrame, gazetteer: DataFrame, doc_id: str, text: str, words=TRIGGERS, window: int = WINDOW) -> DataFrame:
    """(doc_id, s), a row a span: first names and surnames of the gazetteer, and unknown tokens near a trigger.

    Tokens are joined to one row a key that says in which lists it is; Spark broadcasts it while it is small.
    """
    known = gazetteer.where(F.col("kind").isin("prenom", "nom")).groupBy("key").agg(F.bool_or(F.col("kind") == "prenom").alias("first"), F.bool_or(F.col("kind") == "nom").alias("last"))
    tokens = docs.select(F.col(doc_id).alias("doc_id"), F.explode(name_tokens(F.col(text), words, window)).alias("t")).withColumn("key", fold_key(F.col("t.value")))
    t, sure = F.col("t"), F.when(F.col("t.near"), BOOSTED).otherwise(BASE)
    one = lambda kind, rule, conf: span(t["start"], t["end"], kind, t["value"], rule, conf)
    none = F.array().cast(NO_SPANS)
    made = F.concat(
        F.when(F.col("first"), F.array(one("PRENOM", "gazetteer-prenom", sure))).otherwise(none),
        F.when(F.col("last"), F.array(one("PATRONYME", "gazetteer-nom", sure))).otherwise(none),
        F.when(F.col("first").isNull() & F.col("t.near"), F.array(one("PATRONYME", "context-capture", F.lit(CAPTURED)))).otherwise(none),
    )
    return tokens.join(known, "key", "left").select("doc_id", F.explode(made).alias("s"))


def detect_names(docs: DataFrame, gazetteer: DataFrame, doc_id: str, text: str, words=TRIGGERS, window: int = WINDOW) -> DataFrame:
    """(doc_id, spans) of `name_spans`."""
    return name_spans(docs, gazetteer, doc_id, text, words, window).groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("spans"))
