"""Text expressions: matches with offsets, overlaps, case patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHES = "array<struct<start: int, end: int, value: string>>"


def matches(text: Column, pattern: str | Column) -> Column:
    """All matches with half-open code-point offsets, from left to right.

    The text between matches comes from a split by the same pattern; offsets are running sums of both.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, between = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, p, -1)
    none = F.array().cast(MATCHES)
    pairs = F.zip_with(found, F.slice(between, F.lit(2), F.size(between)), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))

    def step(acc: Column, x: Column) -> Column:
        end = (acc["at"] + F.length(x["m"])).cast("int")
        at = F.struct(acc["at"].alias("start"), end.alias("end"), x["m"].alias("value"))
        return F.struct((end + F.length(x["gap"])).cast("int").alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    start = F.struct(F.length(F.get(between, F.lit(0))).cast("int").alias("at"), none.alias("out"))
    return F.when(F.coalesce(F.regexp_like(text, p), F.lit(False)), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once a row, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def span(start: Column, end: Column, kind: str | Column, value: Column, rule: str | Column, confidence: float | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), lit(kind).alias("type"), value.alias("value"), lit(rule).alias("rule_id"), lit(confidence).cast("double").alias("confidence"))


def overlaps(a: Column, b: Column) -> Column:
    """Half-open overlap of two structs with start and end."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def title(word: Column) -> Column:
    """Each letter run starts with a capital, after hyphens and apostrophes too."""
    parts = F.regexp_extract_all(word, F.lit(r"[^-'’]+|[-'’]"), F.lit(0))
    return F.array_join(F.transform(parts, F.initcap), "")


def case_of(word: Column) -> Column:
    return F.when(word == F.upper(word), "U").when(word == F.lower(word), "l").otherwise("T")


def case_pattern(text: Column) -> Column:
    """`U`, `l` or `T` for each word, joined by colons."""
    return F.array_join(F.transform(F.split(text, " "), case_of), ":")


def apply_case(text: Column, pattern: Column) -> Column:
    """Words in the pattern's cases; all in title case if their number differs."""
    words, cases = F.split(text, " "), F.split(pattern, ":")
    put = F.zip_with(words, cases, lambda w, c: F.when(c == "U", F.upper(w)).when(c == "l", F.lower(w)).otherwise(title(w)))
    return F.array_join(F.when(F.size(words) == F.size(cases), put).otherwise(F.transform(words, title)), " ")


def fold_key(name: Column) -> Column:
    """The key of a name: lower case, with the one letter folded that lower case leaves (`ß`)."""
    return F.replace(F.lower(F.trim(name)), F.lit("ß"), F.lit("ss"))


def drop_inner_spaces(text: Column) -> Column:
    """A single blank between two digits goes."""
    return F.regexp_replace(text, r"(?<=[0-9]) (?=[0-9])", "")


#: Between the cases of a written name and its gaps, and between the gaps.
GAPS, GAP = "|", "\x1f"


def one_case(text: Column) -> Column:
    """`U`, `l` or `T` if all words are in that case; else null."""
    cases = F.array_distinct(F.transform(F.split(text, " "), case_of))
    return F.when(F.size(cases) == 1, F.get(cases, F.lit(0)))


def in_case(text: Column, case: Column) -> Column:
    """The text with all words in one case; as it is without one."""
    return F.when(case == "U", F.upper(text)).when(case == "l", F.lower(text)).when(case == "T", F.array_join(F.transform(F.split(text, " "), title), " ")).otherwise(text)


def written(value: Column, raw: Column, word: str) -> Column:
    """The written form of a name of words joined by single blanks: its cases, and what stood between its words (the
    matches of `word` in `raw`) where that is not always one blank. Null for a name in one case with single blanks."""
    between = F.split(raw, word, -1)
    gaps = F.slice(between, F.lit(2), F.greatest(F.size(between) - 2, F.lit(0)))
    odd = F.exists(gaps, lambda g: g != " ")
    return F.when(odd, F.concat(case_pattern(value), F.lit(GAPS), F.array_join(gaps, GAP))).when(one_case(value).isNull(), case_pattern(value))


def rewritten(name: Column, form: Column) -> Column:
    """The name in a written form (see `written`); gaps of another number of words are left out."""
    cased = apply_case(name, F.split_part(form, F.lit(GAPS), F.lit(1)))
    words, gaps = F.split(cased, " "), F.split(F.split_part(form, F.lit(GAPS), F.lit(2)), GAP)
    spaced = F.array_join(F.zip_with(words, gaps, lambda w, g: F.concat(w, F.coalesce(g, F.lit("")))), "")
    return F.when(F.contains(form, F.lit(GAPS)) & (F.size(words) == F.size(gaps) + 1), spaced).otherwise(cased)
