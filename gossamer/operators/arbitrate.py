"""Overlap resolution: the surer, then the longer, then the more specific span stays whole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, overlaps
from ..schemas import PRIORITY
from .detect import NO_SPANS


def captured_surnames(spans: Column) -> Column:
    """Drop places that overlap a sure surname and are not longer than it."""

    def rule(all_: Column) -> Column:
        sure = F.filter(all_, lambda s: (s["type"] == "PATRONYME") & (s["rule_id"] == "gazetteer-nom") & (s["confidence"] >= 0.8))
        longer = lambda s, n: (s["end"] - s["start"]) > (n["end"] - n["start"])
        return F.filter(all_, lambda s: ~(s["type"].isin("COMMUNE", "VOIE") & F.exists(sure, lambda n: overlaps(s, n) & ~longer(s, n))))

    return let(spans, rule)


#: From so many spans on, those that overlap no other are set apart before any are compared.
MANY = 48


def resolve(spans: Column, priority: dict[str, int] | None = None) -> Column:
    """Non-overlapping spans by start. Ties keep the order of detection; losers are never cut short.

    Where there are many, a pass by start with the running end finds those that overlap none; only the others are
    compared with what is kept.
    """
    ranks = F.create_map(*[F.lit(x) for kv in (priority or PRIORITY).items() for x in kv])
    rank = lambda s: F.coalesce(F.try_element_at(ranks, s["type"]), F.lit(0))
    placed = F.array_sort(F.transform(captured_surnames(spans), lambda s, i: F.struct(s["start"].alias("a"), s["end"].alias("b"), i.alias("i"), s.alias("s"))))

    def run(x: Column) -> Column:
        step = lambda acc, e: F.struct(F.greatest(acc["m"], e["b"]).alias("m"), F.concat(acc["out"], F.array(acc["m"])).alias("out"))
        reach = F.aggregate(x, F.struct(F.lit(-1).alias("m"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])
        marked = F.zip_with(x, reach, lambda e, m: F.struct(e["a"], e["b"], e["i"], e["s"], m.alias("m")))
        alone = F.transform(marked, lambda e, k: F.struct(((e["m"] <= e["a"]) & F.coalesce(F.get(x, k + 1)["a"] >= e["b"], F.lit(True))).alias("alone"), e["i"].alias("i"), e["s"].alias("s")))
        parted = F.when(F.size(x) >= MANY, alone).otherwise(F.transform(x, lambda e: F.struct(F.lit(False).alias("alone"), e["i"].alias("i"), e["s"].alias("s"))))
        return let(parted, pick)

    def pick(all_: Column) -> Column:
        # the key sorts as a struct: confidence, length and priority fall, the ordinal rises
        keyed = F.transform(F.filter(all_, lambda e: ~e["alone"]), lambda e: F.struct((-e["s"]["confidence"]).alias("c"), (e["s"]["start"] - e["s"]["end"]).alias("l"), (-rank(e["s"])).alias("p"), e["i"].alias("i"), e["s"].alias("s")))
        keep = lambda kept, x: F.when(F.exists(kept, lambda k: overlaps(k, x["s"])), kept).otherwise(F.concat(kept, F.array(x["s"])))
        free = F.transform(F.filter(all_, lambda e: e["alone"]), lambda e: e["s"])
        return F.array_sort(F.concat(free, F.aggregate(F.array_sort(keyed), F.array().cast(NO_SPANS), keep)))

    return let(placed, run)


def rewrite(text: Column, replaced: Column) -> Column:
    """struct<text, entities>: the text with each of the sorted spans replaced by its `surrogate` (null: left), and the
    spans of the surrogates in the new text.

    Offsets run from left to right with the new lengths, so they hold whatever the lengths are.
    """

    def walk(t: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            before = F.concat(acc["out"], F.substr(t["text"], acc["at"] + 1, s["start"] - acc["at"]))

            def put(b: Column) -> Column:
                e = F.struct(F.length(b).alias("start"), (F.length(b) + F.length(s["surrogate"])).alias("end"), s["type"].alias("type"), s["surrogate"].alias("value"), F.concat(F.lit("mask-"), F.lower(s["type"])).alias("rule_id"), F.lit(1.0).alias("confidence"))
                return F.struct(s["end"].alias("at"), F.concat(b, s["surrogate"]).alias("out"), F.concat(acc["entities"], F.array(e)).alias("entities"))

            return F.when(s["surrogate"].isNull(), acc).otherwise(let(before, put))

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.array().cast(NO_SPANS).alias("entities"))
        end = lambda acc: F.struct(F.concat(acc["out"], F.substr(t["text"], acc["at"] + 1, F.length(t["text"]))).alias("text"), acc["entities"].alias("entities"))
        return F.aggregate(F.coalesce(t["spans"], F.array().cast("array<struct<start: int, end: int, type: string, surrogate: string>>")), start, step, end)

    return let(F.struct(text.alias("text"), replaced.alias("spans")), walk)
