"""Surrogates of distinct values: valid, of the same type, reversible, a function of key, scope, type and value only.

Numbers go through FF3-1 as native expressions and get new check digits; small domains, names, dates and e-mails go
through Feistel permutations in one Arrow function over the distinct values. Nothing depends on the order of arrival.
"""

from __future__ import annotations

import datetime
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import digits as D
from ..functions.crypto import ff3, hmac_sha256, joined, keystream, scope_tweak, xor_hex
from ..functions.permute import Feistel
from ..functions.text import fold_key, let
from ..sources.gazetteers import indexed, pooled
from .detect import MONTHS, to_date_slash, to_date_text

NUMBERS = ("SIREN", "SIRET", "CARTE_BANCAIRE", "NIR", "IBAN", "TVA", "TELEPHONE")
GAZETTEER_KIND = {"PRENOM": "prenom", "PATRONYME": "nom", "COMMUNE": "commune", "VOIE": "voie"}
#: What local parts that are permuted as numbers consist of: what the detector of e-mails takes, but for capitals,
#: accents and underscores.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789.+-'"
EPOCH, DAYS = datetime.date(1900, 1, 1), (datetime.date(2101, 1, 1) - datetime.date(1900, 1, 1)).days


def canonical(kind: Column, value: Column) -> Column:
    """The form that makes two writings one value: names by key, e-mails by the lower case of their local part, the rest
    as it is."""
    local = F.substring_index(value, "@", 1)
    email = F.concat(F.lower(local), F.substr(value, F.length(local) + 1, F.length(value)))
    return F.when(kind.isin(*GAZETTEER_KIND), fold_key(value)).when(kind == "EMAIL", email).otherwise(value)


def email_capitals(value: Column) -> Column:
    """`U` and `l` for each character of a local part that has capitals; else null."""
    local = F.substring_index(value, "@", 1)
    return F.when(local != F.lower(local), F.array_join(F.transform(F.split(local, ""), lambda c: F.when(c != F.lower(c), "U").otherwise("l")), ""))


def apply_capitals(value: Column, pattern: Column) -> Column:
    """The e-mail with its local part's capitals; as it is where the pattern is of another length."""
    local = F.substring_index(value, "@", 1)
    put = F.array_join(F.zip_with(F.split(local, ""), F.split(pattern, ""), lambda c, u: F.when(u == "U", F.upper(c)).otherwise(c)), "")
    return F.when(pattern.isNotNull() & (F.length(pattern) == F.length(local)), F.concat(put, F.substr(value, F.length(local) + 1, F.length(value)))).otherwise(value)


def clear_hmac(key: bytes, scope: Column, kind: Column, value: Column) -> Column:
    return hmac_sha256(key, joined(scope, kind, value))


# --- numbers ------------------------------------------------------------------------------------------------------------


def _body(kind: Column, v: Column) -> Column:
    """The digits to encrypt; what else a number holds follows from them or is kept."""
    n = F.length(v)
    nir = F.replace(F.replace(v, F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
    return (
        F.when(kind.isin("SIREN", "SIRET", "CARTE_BANCAIRE"), F.substr(v, F.lit(1), n - 1))
        .when(kind == "NIR", F.substring(nir, 2, 12))
        .when(kind == "IBAN", F.substring(v, 5, 23))
        .when(kind == "TVA", F.substring(v, 5, 9))
        .when(kind == "TELEPHONE", F.substr(v, n - 7, F.lit(8)))
    )


def _build(kind: Column, v: Column, body: Column) -> Column:
    """The number with a new body and new check digits."""
    nir = F.concat(F.substring(v, 1, 1), body)
    return (
        F.when(kind.isin("SIREN", "SIRET", "CARTE_BANCAIRE"), F.concat(body, D.luhn_digit(body)))
        .when(kind == "NIR", F.concat(nir, D.nir_key(nir)))
        .when(kind == "IBAN", F.concat(F.lit("FR"), D.iban_key(body), body))
        .when(kind == "TVA", F.concat(F.lit("FR"), D.tva_key(body), body))
        .when(kind == "TELEPHONE", F.concat(F.substr(v, F.lit(1), F.length(v) - 8), body))
    )


def number_surrogate(kind: Column, value: Column, key: bytes, tweak: Column, decrypt: bool = False) -> Column:
    """FF3-1 on a number's body under the scope's tweak; prefixes stay, check digits are made anew.

    A NIR keeps its first digit, whatever it is; Corsican departments count as 19 and 18 and stay digits.
    """
    return let(F.struct(kind.alias("k"), value.alias("v")), lambda t: let(ff3(_body(t["k"], t["v"]), key, tweak, decrypt), lambda b: _build(t["k"], t["v"], b)))


# --- permutations -------------------------------------------------------------------------------------------------------


def email_local(key: bytes, scope: str, local: str, back: bool = False) -> str | None:
    """The permuted local part; null for one outside of the alphabet or too short (those take the keystream)."""
    norm = local if back else unicodedata.normalize("NFKC", local).casefold()
    if len(norm) < 4 or any(c not in ALPHABET for c in norm):
        return None
    n, x = len(ALPHABET) ** len(norm), 0
    for c in norm:
        x = x * len(ALPHABET) + ALPHABET.index(c)
    f, out = Feistel(key, scope, "email", n), []
    x = f.moved(x, back)
    for _ in norm:
        x, r = divmod(x, len(ALPHABET))
        out.append(ALPHABET[r])
    return "".join(reversed(out))


def _draw(key: bytes, scope: str, what: str | None, i: int | None, n: int | None, local: str | None, back: bool) -> str | None:
    """The permuted index of a value, or its local part, as text."""
    if what == "email":
        return None if local is None else email_local(key, scope, local, back)
    if what is None or i is None or n is None or not 0 <= i < n:
        return None
    return str(Feistel(key, scope, what, n).moved(i, back))


def permuted(key: bytes, back: bool = False):
    """A column function of (scope, struct<what, i, n, local>): `_draw` of each row."""

    @arrow_udf("string")
    def run(scope: pa.Array, asked: pa.Array) -> pa.Array:
        return pa.array([_draw(key, s, x["what"], x["i"], x["n"], x["local"], back) for s, x in zip(scope.to_pylist(), asked.to_pylist())], pa.string())

    return run.asNondeterministic()  # so that Catalyst never moves it into a lambda, where it cannot run


def permuted_all(key: bytes):
    """A column function of (scope, array of such structs), as Python cannot run in a lambda."""

    @arrow_udf("array<string>")
    def run(scope: pa.Array, asked: pa.Array) -> pa.Array:
        return pa.array([None if xs is None else [_draw(key, s, x["what"], x["i"], x["n"], x["local"], False) for x in xs] for s, xs in zip(scope.to_pylist(), asked.to_pylist())], pa.list_(pa.string()))

    return run.asNondeterministic()


def _date(v: Column) -> Column:
    return F.when(v.contains("/"), to_date_slash(v)).otherwise(to_date_text(v))


def _write_date(day: Column, like: Column) -> Column:
    """The date in the form of `like`: slashes, or the month in French with its blanks, zero and capital kept."""
    names = F.array(*(F.lit(m) for m in MONTHS))
    month = F.get(names, F.month(day) - 1)
    word = F.regexp_extract(like, r"(\p{L}+)", 1)
    month = F.when(word == F.upper(word), F.upper(month)).when(word == F.initcap(word), F.initcap(month)).otherwise(month)
    n = F.dayofmonth(day).cast("string")
    n = F.when(like.rlike(r"^0"), F.lpad(n, 2, "0")).otherwise(n)
    gaps = F.regexp_extract_all(like, F.lit(r"\s+"), F.lit(0))
    text = F.concat(n, F.get(gaps, F.lit(0)), month, F.get(gaps, F.lit(1)), F.year(day).cast("string"))
    return F.when(like.contains("/"), F.date_format(day, "dd/MM/yyyy")).otherwise(text)


def asked(kind: Column, v: Column, pool: Column, idx: Column, n: Column, mode: Column) -> Column:
    """struct<what, i, n, local>: what is to be permuted for a value, nulls where its type needs no permutation."""
    what = F.when(kind == "PLAQUE_SIV", "plate").when(kind == "DATE", "date").when(kind == "EMAIL", "email").when(kind == "CODE_POSTAL", "code_postal").otherwise(pool)
    i = F.when(kind == "PLAQUE_SIV", F.substring(v, 4, 3).try_cast("long")).when(kind == "DATE", F.date_diff(_date(v), F.lit(EPOCH)).cast("long")).when(kind == "CODE_POSTAL", v.try_cast("long")).otherwise(idx)
    size = F.when(kind == "PLAQUE_SIV", 1000).when(kind == "DATE", DAYS).when(kind == "CODE_POSTAL", 100_000).otherwise(n)
    local = F.when((kind == "EMAIL") & ~F.coalesce(mode, F.lit("")).startswith(STREAM), F.substring_index(v, "@", 1))
    return F.struct(what.alias("what"), i.cast("long").alias("i"), size.cast("long").alias("n"), local.alias("local"))


#: How the mode of a value begins whose bytes were XORed with a keystream; its nonce follows.
STREAM = "keystream:"


def nonce(key: bytes, scope: Column, kind: Column, value: Column) -> Column:
    """A nonce of its own for each value, so that no two values share a keystream."""
    return F.substring(clear_hmac(key, F.concat(F.lit("nonce|"), scope), kind, value), 1, 16)


def built(kind: Column, v: Column, p: Column, mode: Column, key: bytes, scope: Column, tweak: Column, back: bool = False) -> Column:
    """The surrogate of a value of any type but names, `p` being its permuted index or local part; `back`: the value."""
    n = F.substr(mode, F.lit(len(STREAM) + 1), F.lit(16))
    xor = lambda hex_, name: xor_hex(hex_, keystream(key, scope, name, n, F.length(hex_) / 2))
    bytes_ = lambda h: F.decode(F.unhex(h), "UTF-8")
    local = F.substring_index(v, "@", 1)
    domain = F.substr(v, F.length(local) + 1, F.length(v))
    if back:
        email = F.when(mode.startswith(STREAM), F.concat(bytes_(xor(local, "email")), domain)).otherwise(F.concat(p, domain))
        reference = bytes_(xor(v, "reference"))
    else:
        email = F.when(p.isNull(), F.concat(xor(F.hex(F.lower(local).cast("binary")), "email"), domain)).otherwise(F.concat(p, domain))
        reference = xor(F.hex(v.cast("binary")), "reference")
    day = F.date_add(F.lit(EPOCH), p.try_cast("int"))
    return (
        F.when(kind.isin(*NUMBERS), number_surrogate(kind, v, key, tweak, back))
        .when(kind == "PLAQUE_SIV", F.concat(F.substring(v, 1, 3), F.lpad(p, 3, "0"), F.substr(v, F.lit(7), F.length(v))))
        .when(kind == "DATE", F.when(p.isNotNull(), _write_date(day, v)))
        .when(kind == "EMAIL", email)
        .when(kind == "REFERENCE_DOSSIER", reference)
        .when(kind == "CODE_POSTAL", F.lpad(p, 5, "0"))
    )


def with_surrogates(values: DataFrame, key: bytes, gazetteer: DataFrame | None, back: bool = False) -> DataFrame:
    """`values` (scope, entity_type, value, mode) with `out`: the surrogate, or with `back` the value of a surrogate.

    `out` is null where none can be made (a date out of range, a name of no gazetteer): such spans stay in clear, and
    `Engine.residue` counts them. `mode` says how an e-mail or a reference was made, with the nonce of its keystream.
    """
    kind, v, scope = F.col("entity_type"), F.col("value"), F.col("scope")
    rows = values
    if gazetteer is not None:
        g = pooled(gazetteer).withColumn("pool", F.concat(F.lit("name|"), "pool"))
        rows = rows.withColumn("g_key", F.when(kind.isin(*GAZETTEER_KIND), fold_key(v))).join(g.select(F.col("key").alias("g_key"), "pool", "idx", "n"), "g_key", "left")
    else:
        rows = rows.withColumns({"pool": F.lit(None).cast("string"), "idx": F.lit(None).cast("long"), "n": F.lit(None).cast("long")})
    if "mode" not in rows.columns:
        rows = rows.withColumn("mode", F.lit(None).cast("string"))
    a = asked(kind, v, F.col("pool"), F.col("idx"), F.col("n"), F.col("mode"))
    rows = rows.withColumns({"_a": a, "_tweak": scope_tweak(key, scope)})
    rows = rows.withColumn("_p", F.when(F.col("_a.what").isNotNull(), permuted(key, back)(scope, F.col("_a"))))
    if not back:
        stream = F.concat(F.lit(STREAM), nonce(key, scope, kind, v))
        rows = rows.withColumn("mode", F.when(kind == "EMAIL", F.when(F.col("_p").isNull(), stream).otherwise("perm")).when(kind == "REFERENCE_DOSSIER", stream))
    rows = rows.withColumn("out", built(kind, v, F.col("_p"), F.col("mode"), key, scope, F.col("_tweak"), back))
    if gazetteer is not None:
        of = F.create_map(*[F.lit(x) for kv in GAZETTEER_KIND.items() for x in kv])
        names = g.select(F.col("pool").alias("s_pool"), F.col("idx").alias("s_idx"), F.col("names").alias("s_names"), F.col("name").alias("s_name"))
        rows = rows.join(names, (F.col("pool") == F.col("s_pool")) & (F.col("_p").try_cast("long") == F.col("s_idx")), "left")
        rows = rows.withColumn("out", F.coalesce("out", F.try_element_at("s_names", F.try_element_at(of, kind)), "s_name"))
    return rows.select(*values.columns if "mode" in values.columns else [*values.columns, "mode"], "out")


def pick(values: DataFrame, gazetteer: DataFrame, key: bytes, kind: str) -> DataFrame:
    """`values` (scope, value, genre or departement: null for any) with `name`: an HMAC chooses among the entries of the
    kind with the attribute; among all if there is none. Not reversible."""
    g = gazetteer.where(F.col("kind") == kind)
    attr = "departement" if kind == "commune" else "genre"
    whole = indexed(g).select("idx", "name")
    n_all = whole.count()
    rows = values.withColumns({"part": F.lit(None).cast("string"), "m": F.lit(None).cast("long")})
    some = None
    if attr in values.columns:
        some = indexed(g.withColumn("kind", F.col(attr))).select(F.col("kind").alias("part"), "idx", "n", "name").where("part <> ''")
        rows = values.withColumn("part", F.col(attr)).join(some.select("part", F.col("n").alias("m")).distinct(), "part", "left")
    head = F.substring(hmac_sha256(key, joined(F.col("scope"), kind, F.col("value"))), 1, 16)
    rows = rows.withColumn("at", F.pmod(F.conv(head, 16, 10).cast("decimal(20,0)"), F.coalesce("m", F.lit(n_all))).cast("long"))
    out = rows.where("m is null").join(whole.withColumnRenamed("idx", "at"), "at").select(*values.columns, "name")
    if some is not None:
        out = out.unionByName(rows.where("m is not null").join(some.select("part", F.col("idx").alias("at"), "name"), ["part", "at"]).select(*values.columns, "name"))
    return out
