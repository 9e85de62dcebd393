"""Licence scan: sparse n-gram logistic regression over paragraphs, confirmed by templates. DataFrame operations only.

The model is fitted on the driver from the statements below and a bounded sample of paragraphs; scoring and
confirmation are joins and sums.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Saved, documents, kept, tune

#: Statements by family, written for this scan; {n} stands for a version, {y} for a year, {who} for a holder.
STATEMENTS = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version {n}.",
        "You may use this file under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version {n} or later.",
    ],
    "apache": [
        "Licensed under the Apache License, Version {n}.",
        "Licensed under the Apache License, Version {n} (the License); you may not use this file except in compliance with the License.",
        "This product is released under the Apache License, Version {n}.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license.",
        "Licensed under the BSD 3-Clause License.",
    ],
    "cc-by": ["Licensed under CC BY {n}.", "This work is licensed under a Creative Commons Attribution {n} International License."],
    "cc-by-nc": ["Licensed under CC BY-NC {n}.", "This work is licensed under a Creative Commons Attribution-NonCommercial {n} International License."],
    "cc-by-sa": ["Licensed under CC BY-SA {n}.", "This work is licensed under a Creative Commons Attribution-ShareAlike {n} International License."],
    "cc0": ["Released under CC0 {n}.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain under CC0 {n} Universal."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version {n}.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {n} of the License, or any later version.",
        "Released under the GNU GPL version {n}.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version {n}.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License, version {n}.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
    ],
    "mpl": ["This source code form is subject to the terms of the Mozilla Public License, version {n}.", "Licensed under the Mozilla Public License, version {n}."],
    "proprietary": [
        "Copyright {y} {who}. All rights reserved.",
        "All rights reserved.",
        "All rights reserved. No part of this work may be reproduced without written permission.",
        "Confidential and proprietary; unauthorized copying is prohibited.",
    ],
}
FAMILIES = tuple(STATEMENTS)

#: Sentences with the words of licences that grant none: the hard part of the unknown class. Written for this scan.
NO_LICENCE = [
    "He got his driving licence in 2019 and drove to the coast.",
    "You need a licence to fish in this lake.",
    "The waiter lost his liquor license last year.",
    "A software licence costs more every year, says the report.",
    "She was given permission to leave the room early.",
    "Permission slips must be signed by a parent.",
    "The right to speak is reserved for members.",
    "All seats are reserved until eight.",
    "Rights reserved for members are listed below.",
    "We reserve the right to refuse service.",
    "Reserved rights of way cross the farm.",
    "The rights of the patient come first.",
    "Copyright law differs from country to country.",
    "The song's copyright was sold twice.",
    "Free software is taught in the second term.",
    "The public domain is a legal idea that few understand.",
    "Apache helicopters flew over the valley.",
    "The Apache people lived in the southwest.",
    "Students at MIT built a small robot.",
    "Mozilla released a new browser on Tuesday.",
    "The gnu is a large animal of the plains.",
    "The foundation gave money for a library of general interest.",
    "No warranty was given with the used car.",
    "The redistribution of land took ten years.",
    "Sources say that the binary choice misled the public.",
    "Version 2 of the plan is better than version 1.",
    "Creative work needs common ground and a quiet room.",
    "The attribution of the painting is in doubt.",
    "Terms and conditions apply to the winter sale.",
    "The international committee published its third report.",
    "Confidential talks went on for weeks.",
    "A proprietary recipe made the bakery famous.",
    "The law in effect was published by the general assembly.",
    "Under the terms of the truce both sides withdrew.",
    "The file was copied without restriction of any kind by mistake.",
]


def _tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def grams_of(text: str) -> set[str]:
    """Words and word pairs; any number is `0`. The Spark form is `grams`."""
    w = ["0" if t.isdigit() else t for t in _tokens(text)]
    return set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}


def words(text: Column) -> Column:
    w = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.transform(w, lambda t: F.when(t.rlike("^[0-9]+$"), "0").otherwise(t))


def grams(w: Column) -> Column:
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return F.array_distinct(F.concat(w, F.coalesce(pairs, F.array().cast("array<string>"))))


@dataclass
class Model:
    weights: dict[str, list[float]]  # n-gram: a weight for each family
    bias: list[float]
    cut: float  # a family is named from this probability on
    common: dict[str, int]  # how many of the unknown paragraphs hold a word

    def scores(self, text: str) -> np.ndarray:
        z = np.array(self.bias) + sum((np.array(self.weights[g]) for g in sorted(grams_of(text) & set(self.weights))), np.zeros(len(self.bias)))
        return 1 / (1 + np.exp(-z))


def fit(unknown: list[str], hard: list[str] = NO_LICENCE, l1: float = 1e-3, rounds: int = 600, rate: float = 0.5, most: float = 0.005) -> Model:
    """One sparse logistic regression a family: statements against all other families and `unknown` paragraphs.

    N-grams in over `most` of the unknown paragraphs tell nothing and are left out; weights shrink to zero by proximal
    steps. `hard` are further unknown paragraphs that talk of licences, learned from at ten times the weight of others.
    The cut is calibrated on every third unknown paragraph, kept from the fit, hard ones too: above all of their
    probabilities, within 0.5 and 0.95.
    """
    fill = [{"n": n, "y": y, "who": who} for n, y, who in (("2.0", "2019", "The Authors"), ("3", "2021", "Example Inc"))]
    text = [(t.format(**v), k) for k, ts in enumerate(STATEMENTS.values()) for t in ts for v in fill]
    text += [(t.rstrip(".") + " " + u.split("\n")[0][:60], k) for (t, k), u in zip(text[:], unknown[1::3])]  # statements in company
    rest = [u for i, u in enumerate(unknown) if i % 3]
    learned = [u for i, u in enumerate(hard) if i % 3]
    common = Counter(g for u in rest for g in grams_of(u))
    known = set().union(*(grams_of(t.format(**v)) for ts in STATEMENTS.values() for t in ts for v in fill))
    vocabulary = sorted(g for g in known if common[g] <= most * len(rest))
    place = {g: i for i, g in enumerate(vocabulary)}
    rows = [t for t, _ in text] + rest + learned
    x = np.zeros((len(rows), len(vocabulary)))
    for i, t in enumerate(rows):
        x[i, [place[g] for g in grams_of(t) if g in place]] = 1
    y = np.zeros((len(rows), len(FAMILIES)))
    y[range(len(text)), [k for _, k in text]] = 1
    w, b = np.zeros((len(vocabulary), len(FAMILIES))), np.full(len(FAMILIES), -2.0)
    each = np.append(np.ones(len(rows) - len(learned)), np.full(len(learned), 10.0))[:, None]
    weight = each * np.where(y > 0, 1 / np.maximum(y.sum(0), 1), 1 / np.maximum((each * (1 - y)).sum(0), 1))
    for _ in range(rounds):
        g = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w -= rate * (x.T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        b -= rate * g.sum(0)
    model = Model({g: w[i].round(6).tolist() for g, i in place.items() if np.abs(w[i]).max() > 0}, b.round(6).tolist(), 0.5, dict(common))
    model.cut = min(0.95, max([0.5, *(float(model.scores(u).max()) + 0.01 for u in [*unknown[::3], *hard[::3]])]))
    return model


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table from a JSON literal: no Python rows, no RDD."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def paragraphs(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, d, paragraph, text) of each line that is not blank; d is a hash of the whole text."""
    t = F.col(text).cast("string")
    lines = F.posexplode(F.split(t, "\n"))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("d"), lines.alias("paragraph", "text")).where(F.trim("text") != "")


def blocks(docs: DataFrame, holds: Column, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, d, paragraph, lines, text) of the runs of two or more lines between blank ones whose `text` fits `holds`;
    paragraph is the number of the first line."""
    t = F.col(text).cast("string")
    parts = F.split(t, r"(?<![^\n])[ \t\r\f]*\n")  # a blank line goes with its own line end
    breaks = lambda c: F.length(c) - F.length(F.translate(c, "\n", ""))
    all_ = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("d"), parts.alias("p")).withColumn("ends", F.transform("p", breaks))
    one = all_.select("doc_id", "d", "ends", F.posexplode("p").alias("k", "text")).where(F.rtrim("text").rlike(r"\n[ \t\r\f]*[^\s]")).where(holds)
    start = F.col("k") + F.aggregate(F.slice("ends", F.lit(1), F.col("k")), F.lit(0), lambda a, x: a + x)
    return one.select("doc_id", "d", start.cast("int").alias("paragraph"), (breaks(F.col("text")) + 1).alias("lines"), "text")


def unknown_sample(docs: DataFrame, text: str, sample: int) -> list[str]:
    """About `sample` lines without a licence word, chosen by a hash of the line; equal lines count once."""
    all_ = docs.select(F.col(text).cast("string").alias("text"))
    n = all_.agg(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)).first()[0] or 0
    slot = F.pmod(F.xxhash64("t"), F.lit(10_000_000))
    lines = all_.select(F.explode(F.split("text", "\n")).alias("t")).where(slot < int(min(1.0, sample / max(1, n)) * 10_000_000)).distinct()
    plain = lines.where("trim(t) <> ''").where(~F.lower("t").rlike(r"licen[sc]e|copyright|\bgnu\b|\bcc0\b|\bcc by|redistribut|warrant|permission|rights reserved|proprietary"))
    return [r[0] for r in plain.orderBy("t").collect()]


def scan(docs: DataFrame, doc_id="doc_id", text="text", sample: int = 1500, confirm: float = 0.6) -> DataFrame:
    """(doc_id, paragraph, family, score, template, similarity, confirmed): each paragraph for which a family is named.

    A paragraph is a line that is not blank, or a run of lines between blank ones, white space in it being one blank: its
    number is that of its (first) line. A run has a row for each family that is named and confirmed in it and not
    explained by a line confirmed by itself, of that family or of one that shares as many n-grams; lines of that family in it, themselves not confirmed, then have none. Its n-grams meet the weights in a join, and the sums of what met give each
    family's probability. Below the calibrated cut it is of the unknown class and has no row. The prediction is
    confirmed if a statement of the family has at least `confirm` of its n-grams in the paragraph (`similarity`: the
    largest such share; `template`: that statement's number, the first of equals).

    Lines without any word of a positive weight cannot reach the cut and are passed over before n-grams are made; a
    text without one is passed over whole, so most texts are searched once and not split.
    Null and empty texts have no paragraphs. Repeated lines of a document have a row each, rows that repeat an id are
    told apart by a hash of their text (equal ones count as one). An empty table gives an empty table; extra columns
    are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    model = fit(unknown_sample(docs, text, sample))
    plain = [(f, i, grams_of(t.format(n="0", y="0", who=""))) for f, ts in STATEMENTS.items() for i, t in enumerate(ts)]
    all_ = sorted(set(model.weights).union(*(g for *_, g in plain)))  # templates also hold n-grams without a weight
    weights = _table(spark, [{"gram": g, "w": model.weights.get(g, [0.0] * len(FAMILIES))} for g in all_], "gram: string, w: array<double>")
    needed = sorted({t for g, w in model.weights.items() if max(w) > 0 for t in g.split(" ")} & _necessary(model))
    # the key of a line: its document, place and a hash of the words, as ids may repeat
    words_ = f"(?<![a-z0-9])(?=[{''.join(sorted({t[0] for t in needed}))}])(?:{'|'.join(needed)})(?![a-z0-9])"
    holds = F.lower("text").rlike(words_) if needed else F.lit(False)
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where(holds)
    chosen = kept(chosen)  # read twice: for lines and for runs of lines
    body = paragraphs(chosen).where(holds).withColumn("lines", F.lit(1)).unionByName(blocks(chosen, holds))
    made = body.select("doc_id", "d", "paragraph", "lines", F.xxhash64("text").alias("h"), grams(words(F.col("text"))).alias("g"))
    key = ["doc_id", "d", "paragraph", "lines", "h"]
    met = made.select(*key, F.explode("g").alias("gram")).join(F.broadcast(weights), "gram")  # some hundred rows: the statements' n-grams
    hits = Saved(met.distinct(), "hits").df  # texts are read once; what follows reads this small table
    sums = hits.groupBy(*key).agg(*(F.sum(F.round(F.col("w")[k] * 1_000_000).cast("long")).alias(f"z{k}") for k in range(len(FAMILIES))))
    odds = [1 / (1 + F.exp(-(F.lit(model.bias[k]) + F.col(f"z{k}") / 1_000_000))) for k in range(len(FAMILIES))]
    each = F.array(*(F.struct(o.alias("score"), F.lit(-k).alias("k")) for k, o in enumerate(odds)))
    best = F.explode(F.when(F.col("lines") > 1, each).otherwise(F.array(F.array_max(each))))  # a run may hold several statements
    named = sums.select(*key, best.alias("b")).where(F.col("b.score") >= model.cut)
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), 1 - F.col("b.k"))
    named = named.select(*key, family.alias("family"), F.col("b.score").alias("score"))
    templates = _table(spark, [{"gram": g, "family": f, "template": i, "part": 1 / len(gs)} for f, i, gs in plain for g in sorted(gs)], "gram: string, family: string, template: int, part: double")
    shares = named.join(hits.select(*key, "gram"), key).join(F.broadcast(templates), ["gram", "family"])
    shares = shares.groupBy(*key, "family", "score", "template").agg(F.sum("part").alias("share"))
    top = shares.groupBy(*key, "family", "score").agg(F.max(F.struct(F.round("share", 6).alias("share"), (-F.col("template")).alias("t"))).alias("s"))
    similarity = F.coalesce("s.share", F.lit(0.0))
    top = top.select(*(F.col(c).alias(f"t_{c}") for c in (*key, "family")), "s")
    # ids may be null
    out = named.join(top, [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in (*key, "family")], "left")
    out = out.select(*key, "family", F.round("score", 6).alias("score"), (-F.col("s.t")).alias("template"), similarity.alias("similarity"), (similarity >= confirm).alias("confirmed"))
    out = Saved(out, "named").df
    line, run = out.where("lines = 1").alias("l"), out.where("lines > 1 and confirmed").alias("r")
    inside = [F.expr(f"l.{c} <=> r.{c}") for c in ("doc_id", "d", "family")] + [F.expr("l.paragraph between r.paragraph and r.paragraph + r.lines - 1")]
    # a run's statement that a confirmed line of it explains, as its own or as a relative's that shares most n-grams
    shared = lambda f, g: max(len(a & b) / len(a) for x, _, a in plain if x == f for y, _, b in plain if y == g)
    covers = _table(spark, [{"family": f, "other": g, "cover": shared(f, g) + 1e-5} for f in FAMILIES for g in FAMILIES], "family: string, other: string, cover: double")
    sure = out.where("lines = 1 and confirmed").withColumnRenamed("family", "other").join(F.broadcast(covers), "other").alias("l")
    runs = kept(run.join(sure, [*inside, F.expr("r.similarity <= l.cover")], "left_anti"))
    lines = line.join(runs.alias("r"), [F.expr("not l.confirmed"), *inside], "left_anti")
    return lines.unionByName(runs).select("doc_id", "paragraph", "family", "score", "template", "similarity", "confirmed")


def _necessary(model: Model) -> set[str]:
    """Words of which a line must hold one to reach the cut.

    Words are given up from the most common in speech on, as long as the largest sum that lines of given-up words alone
    could reach stays below the cut for every family.
    """
    need = np.log(model.cut / (1 - model.cut))
    have = {g: np.maximum(np.array(w), 0) for g, w in model.weights.items()}
    one = {t for g in have for t in g.split(" ")}
    free: set[str] = set()
    for t in sorted(one, key=lambda t: (-model.common.get(t, 0), sum(v.max() for g, v in have.items() if t in g.split(" ")), t)):
        trial = free | {t}
        reach = sum((v for g, v in have.items() if set(g.split(" ")) <= trial), np.zeros(len(FAMILIES)))
        if (np.array(model.bias) + reach < need).all():
            free = trial
    return one - free


def op6_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements in all `documents`."""
    return scan(documents(spark, sf_dir))
