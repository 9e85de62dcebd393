"""Check digits and checksums as expressions. Digits come as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum mod 10; null for anything but digits."""
    each = F.split(F.reverse(digits), "")
    double = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(double(c.cast("int")))), F.lit(0), lambda a, x: a + x)
    return F.when(digits.rlike("^[0-9]+$"), total % 10)


def is_luhn(digits: Column) -> Column:
    return F.coalesce(digits.rlike("^[0-9]+$") & F.call_function("luhn_check", digits), F.lit(False))


def luhn_digit(body: Column) -> Column:
    """The digit that makes body and digit pass."""
    return ((10 - luhn_sum(F.concat(body, F.lit("0")))) % 10).cast("string")


def mod97(digits: Column) -> Column:
    """Up to 38 digits mod 97."""
    return (digits.cast("decimal(38,0)") % 97).cast("int")


def _corsica(nir: Column) -> Column:
    return F.replace(F.replace(nir, F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))


def nir_key(body: Column) -> Column:
    """Two-digit key of a NIR's first 13 characters; Corsica's departments count as 19 and 18."""
    return F.lpad((97 - F.try_to_number(_corsica(body), F.lit("9" * 13)).cast("long") % 97).cast("string"), 2, "0")


def is_nir(nir: Column) -> Column:
    shape = nir.rlike(r"^[1-9][0-9]{4}(2A|2B|[0-9]{2})[0-9]{8}$")
    return F.coalesce(F.when(shape, nir_key(F.substring(nir, 1, 13)) == F.substring(nir, 14, 2)), F.lit(False))


def iban_key(bban: Column) -> Column:
    """Key of a French IBAN by ISO 7064: 98 less the remainder."""
    return F.lpad((98 - mod97(F.concat(bban, F.lit("152700")))).cast("string"), 2, "0")


def is_iban(iban: Column) -> Column:
    moved = F.concat(F.substring(iban, 5, 23), F.lit("1527"), F.substring(iban, 3, 2))
    return F.coalesce(F.when(iban.rlike("^FR[0-9]{25}$"), mod97(moved) == 1), F.lit(False))


def tva_key(siren: Column) -> Column:
    return F.lpad(((12 + 3 * (siren.cast("long") % 97)) % 97).cast("string"), 2, "0")


def is_tva(tva: Column) -> Column:
    return F.coalesce(F.when(tva.rlike("^FR[0-9]{11}$"), tva_key(F.substring(tva, 5, 9)) == F.substring(tva, 3, 2)), F.lit(False))
