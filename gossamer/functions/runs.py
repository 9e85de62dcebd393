"""Digit runs: numbers written with blanks, dots or hyphens, their projection, offsets and format template."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, matches

#: An optional prefix (`+`, or `FR` right before the digits), a digit, and what a number may hold.
RUN = r"(?U)(?:(?<![0-9+])\+|(?<![\p{L}0-9])[Ff][Rr])?[0-9](?:[0-9\s.\-]|(?<=2)[AB])++"
#: Template characters: any digit, and the two Corsican departments, which take two characters each.
DIGIT, CORSE_A, CORSE_B = "\0", "\x01", "\x02"


def projection(run: Column) -> Column:
    """The run's digits, Corsican letters and prefix; the trunk zero after +33 goes."""
    kept = F.upper(F.regexp_replace(run, r"(?U)[\s.\-]", ""))
    return F.regexp_replace(kept, r"^\+330(?=[0-9])", "+33")


def offsets(run: Column) -> Column:
    """For each character of the projection its place in the run."""
    each = F.transform(F.split(run, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    kept = F.transform(F.filter(each, lambda x: x["c"].rlike(r"[0-9A-Za-z+]")), lambda x: x["i"])
    trunk = F.upper(F.regexp_replace(run, r"(?U)[\s.\-]", "")).rlike(r"^\+330[0-9]")
    return F.when(trunk, F.concat(F.slice(kept, F.lit(1), F.lit(3)), F.slice(kept, F.lit(5), F.size(kept)))).otherwise(kept)


def digit_runs(text: Column, least: int = 2) -> Column:
    """array<struct<start, end, value, projection, offsets>> of the runs with `least` digits and more."""

    def one(m: Column) -> Column:
        trimmed = F.regexp_replace(m["value"], r"[^0-9]+$", "")
        return F.struct(m["start"].alias("start"), (m["start"] + F.length(trimmed)).cast("int").alias("end"), trimmed.alias("value"))

    def full(r: Column) -> Column:
        return F.struct(r["start"], r["end"], r["value"], projection(r["value"]).alias("projection"), offsets(r["value"]).alias("offsets"))

    runs = F.filter(F.transform(matches(text, RUN), one), lambda r: F.length(F.regexp_replace(r["value"], "[^0-9]", "")) >= least)
    return F.transform(runs, full)


def template(raw: Column) -> Column:
    """The written form with placeholders for its digits; null if it is only digits."""
    held = F.regexp_replace(F.regexp_replace(raw, "2A", CORSE_A), "2B", CORSE_B)
    held = F.regexp_replace(held, "[0-9]", DIGIT)
    return F.when(held.rlike(f"[^{DIGIT}{CORSE_A}{CORSE_B}]"), held)


def fill(pattern: Column, compact: Column) -> Column:
    """The compact value written by the template; a value that does not fill it is left compact."""

    def walk(t: Column) -> Column:
        size = F.length(F.regexp_replace(t["p"], f"[^{DIGIT}{CORSE_A}{CORSE_B}]", "")) + F.length(F.regexp_replace(t["p"], f"[^{CORSE_A}{CORSE_B}]", ""))
        step = lambda acc, c: F.when(c.isin(CORSE_A, CORSE_B), F.struct((acc["at"] + 2).alias("at"), F.concat(acc["out"], F.substr(t["v"], acc["at"], F.lit(2))).alias("out"))).when(
            c == DIGIT, F.struct((acc["at"] + 1).alias("at"), F.concat(acc["out"], F.substr(t["v"], acc["at"], F.lit(1))).alias("out"))
        ).otherwise(F.struct(acc["at"].alias("at"), F.concat(acc["out"], c).alias("out")))
        written = F.aggregate(F.split(t["p"], ""), F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])
        return F.when(size == F.length(t["v"]), written).otherwise(t["v"])

    digits = F.regexp_replace(compact, "[^0-9AB]", "")
    return F.when(pattern.isNull(), compact).otherwise(let(F.struct(pattern.alias("p"), digits.alias("v")), walk))
