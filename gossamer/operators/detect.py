"""Detectors: each is an expression from text to an array of spans. No Python sees a row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import digits as D
from ..functions.runs import digit_runs
from ..functions.text import let, matches, span
from ..schemas import SPAN_DDL

NO_SPANS = f"array<{SPAN_DDL}>"

#: (type, pattern, check, rule, confidence). Patterns and rule names are fixed values of the observable behaviour.
STRUCTURED: list[tuple[str, str, Callable[[Column], Column] | None, str, float]] = [
    ("SIREN", r"(?<![0-9])[0-9]{9}(?![0-9])", D.is_luhn, "siren-luhn", 1.0),
    ("SIRET", r"(?<![0-9])[0-9]{14}(?![0-9])", D.is_luhn, "siret-luhn", 1.0),
    ("NIR", r"(?<![0-9])[1-9][0-9]{4}(?:2A|2B|[0-9]{2})[0-9]{8}(?![0-9])", D.is_nir, "nir-mod97", 1.0),
    ("IBAN", r"(?<![A-Za-z0-9])FR[0-9]{25}(?![A-Za-z0-9])", D.is_iban, "iban-mod97", 1.0),
    ("TVA", r"(?<![A-Za-z0-9])FR[0-9]{11}(?![A-Za-z0-9])", D.is_tva, "tva-fr-key", 1.0),
    ("CARTE_BANCAIRE", r"(?<![0-9])[0-9]{13,19}(?![0-9])", D.is_luhn, "cb-luhn", 1.0),
    ("TELEPHONE", r"(?<![0-9+])(?:0[1-9][0-9]{8}|\+33[1-9][0-9]{8})(?![0-9])", None, "phone-format", 0.9),
]
#: The shapes of formats without a checksum, by their definitions. Runs are possessive: the same matches,
#: in time linear in the text.
NIR_SHAPE = r"(?<![0-9])[1-9][0-9]{4}2[AB][0-9]{8,9}(?![0-9])"
PLATE = r"(?<![A-Za-z0-9\-])(?!SS)[A-HJ-NP-TV-Z]{2}-[0-9]{3}-[A-HJ-NP-TV-Z]{2,3}(?![A-Za-z0-9\-])"
SLASH_DATE = r"(?<![0-9])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9])"
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
TEXT_DATE = r"(?iu)(?<![0-9\p{L}])[0-9]{1,2}\s+(?:" + "|".join(MONTHS) + r"|fevrier|aout|decembre)\s+[0-9]{4}(?![0-9\p{L}])"
DOMAIN = r"[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
EMAIL_NARROW = rf"(?<![A-Za-z0-9._+\-])[A-Za-z0-9._+\-]++@{DOMAIN}"
EMAIL_BROAD = rf"(?<![A-Za-z0-9._+\-À-ÿ'’])[A-Za-z0-9._+\-À-ÿ'’]++@{DOMAIN}"
POSTCODE = r"(?<![0-9])[0-9]{5}(?![0-9])"


def by_pattern(text: Column, kind: str, pattern: str, check, rule: str, confidence: float) -> Column:
    found = matches(text, pattern)
    if check is not None:
        found = F.filter(found, lambda m: check(m["value"]))
    return F.transform(found, lambda m: span(m["start"], m["end"], kind, m["value"], rule, confidence))


def detect_kind(text: Column, kind: str) -> Column:
    """Spans of one structured type, written without separators."""
    return by_pattern(text, *next(r for r in STRUCTURED if r[0] == kind))


def is_kind(value: Column, kind: str) -> Column:
    """Whether the whole value is of the structured type."""
    _, pattern, check, _, _ = next(r for r in STRUCTURED if r[0] == kind)
    shape = value.rlike(f"^(?:{pattern})$")
    return F.coalesce(shape & check(value) if check is not None else shape, F.lit(False))


def month_number(name: Column) -> Column:
    plain = F.translate(F.lower(name), "éû", "eu")
    return F.array_position(F.array(*(F.lit(m.translate(str.maketrans("éû", "eu"))) for m in MONTHS)), plain)


def to_date_text(value: Column) -> Column:
    """The date of a French text date, null if the calendar has none."""
    parts = F.split(value, r"\s+")
    iso = F.concat_ws("-", F.get(parts, F.lit(2)), F.lpad(month_number(F.get(parts, F.lit(1))).cast("string"), 2, "0"), F.lpad(F.get(parts, F.lit(0)), 2, "0"))
    return F.try_to_date(iso, "yyyy-MM-dd")


def to_date_slash(value: Column) -> Column:
    return F.try_to_date(value, "dd/MM/yyyy")


def dates(text: Column) -> Column:
    return by_pattern(text, "DATE", SLASH_DATE, lambda v: to_date_slash(v).isNotNull(), "date-calendar", 0.9)


def text_dates(text: Column) -> Column:
    return by_pattern(text, "DATE", TEXT_DATE, lambda v: to_date_text(v).isNotNull(), "date-text-fr", 0.9)


def plates(text: Column) -> Column:
    return by_pattern(text, "PLAQUE_SIV", PLATE, None, "plate-siv-format", 0.9)


def emails(text: Column, broad: bool = True) -> Column:
    return by_pattern(text, "EMAIL", EMAIL_BROAD if broad else EMAIL_NARROW, None, "email-broad-format" if broad else "email-format", 0.9)


def postcodes_raw(text: Column) -> Column:
    return by_pattern(text, "CODE_POSTAL", POSTCODE, None, "cp-format", 0.5)


def references(text: Column, patterns: list[str]) -> Column:
    """Spans of user patterns, pattern by pattern; a pattern that the engine cannot compile fails when the plan runs."""
    none = F.array().cast(NO_SPANS)
    return reduce(F.concat, (by_pattern(text, "REFERENCE_DOSSIER", p, None, f"reference-{i}", 0.9) for i, p in enumerate(patterns)), none)


def _siret_windows(m: Column) -> Column:
    """SIRETs in longer digit runs that start where no digit stands before, in the text as written."""
    size = F.length(m["projection"])
    starts = F.filter(F.sequence(F.lit(0), F.greatest(size - 14, F.lit(0))), lambda i: (size > 14) & ((i == 0) | (F.get(m["offsets"], i) - F.get(m["offsets"], i - 1) > 1)))
    starts = F.filter(starts, lambda i: D.is_luhn(F.substr(m["projection"], i + 1, F.lit(14))))
    return F.transform(starts, lambda i: F.struct(i.cast("int").alias("start"), (i + 14).cast("int").alias("end"), F.substr(m["projection"], i + 1, F.lit(14)).alias("value"), F.lit("SIRET").alias("type"), F.lit("siret-luhn-window").alias("rule_id"), F.lit(1.0).alias("confidence")))


#: No number of any type has fewer digits.
SHORTEST = 9


def structured(text: Column) -> Column:
    """Numbers in digit runs, however they are spaced; values are compact, offsets those of the text."""

    def in_run(r: Column) -> Column:
        found = [by_pattern(r["projection"], *rule) for rule in STRUCTURED]
        found.append(by_pattern(r["projection"], "NIR", NIR_SHAPE, lambda v: ~D.is_nir(v), "nir-2a-shape", 0.9))
        windows = F.transform(_siret_windows(r), lambda m: span(m["start"], m["end"], m["type"], m["value"], m["rule_id"], m["confidence"]))
        at = lambda k: r["start"] + F.get(r["offsets"], k)
        return F.transform(reduce(F.concat, [*found, windows]), lambda s: span(at(s["start"]), at(s["end"] - 1) + 1, s["type"], s["value"], s["rule_id"], s["confidence"]))

    return F.flatten(F.transform(digit_runs(text, SHORTEST), in_run))


def formats(text: Column, reference_patterns: list[str] | None = None) -> Column:
    """All detectors that need no table, in the order that breaks ties."""
    parts = [structured(text), dates(text), text_dates(text), emails(text), plates(text)]
    if reference_patterns:
        parts.append(references(text, reference_patterns))
    return F.coalesce(reduce(F.concat, parts), F.array().cast(NO_SPANS))
