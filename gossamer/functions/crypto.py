"""Keyed expressions: HMAC-SHA256, FF3 and FF3-1 on digits, a keystream for short texts.

Keys enter a plan as derived literals. `hide_keys` sets Spark's redaction, which keeps them out of explain output and UI.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import DomainTooSmallError
from .text import let


def check_key(key: bytes) -> bytes:
    if not isinstance(key, (bytes, bytearray)) or len(key) not in (16, 24, 32):
        raise ValueError("the key must be 16, 24 or 32 bytes")
    return bytes(key)


def hide_keys(spark: SparkSession) -> None:
    """Redact the hexadecimal and binary literals that keys become."""
    spark.conf.set("spark.sql.redaction.string.regex", r"0x[0-9A-Fa-f]{32,}|\[[0-9A-F]{2}( [0-9A-F]{2}){15,}\]")


def _bytes(b: bytes) -> Column:
    return F.lit(bytearray(b))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hex of the HMAC of a binary column."""
    k = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner = F.sha2(F.concat(_bytes(bytes(c ^ 0x36 for c in k)), message), 256)
    return F.sha2(F.concat(_bytes(bytes(c ^ 0x5C for c in k)), F.unhex(inner)), 256)


def joined(*parts: Column | str, by: bytes = b"\0") -> Column:
    """UTF-8 of the parts with a separator between."""
    out = []
    for p in parts:
        out += ([_bytes(by)] if out else []) + [(F.lit(p) if isinstance(p, str) else p).cast("string").cast("binary")]
    return F.concat(*out)


def scope_tweak(key: bytes, scope: Column) -> Column:
    """14 hex digits: the first 7 bytes of the HMAC of scope and a zero counter."""
    return F.substring(hmac_sha256(key, F.concat(scope.cast("binary"), _bytes(b"\0\0\0\0"))), 1, 14)


_POW = [10**k for k in range(19)]


def _swap(hex_: Column) -> Column:
    """Hex of the bytes in reverse order."""
    return F.regexp_replace(F.reverse(hex_), "(.)(.)", "$2$1")


#: FF3-1 needs a million values; two halves of 18 digits are what 64-bit numbers hold.
LEAST_DIGITS, MOST_DIGITS = 6, 36


def domain_guard(digits: int) -> None:
    """Refuse numbers that FF3-1 cannot permute safely; `ff3` applies the same rule to each value."""
    if digits < LEAST_DIGITS:
        raise DomainTooSmallError(f"{digits} digits are too few")
    if digits > MOST_DIGITS:
        raise ValueError(f"{digits} digits are too many")


def ff3(digits: Column, key: bytes, tweak: Column, decrypt: bool = False) -> Column:
    """FF3 (tweak of 16 hex digits) or FF3-1 (14) on strings of 6 to 36 digits, in eight folded rounds.

    The halves stay reversed, as numbers read them, so a round is one AES block and one addition. Null for anything but
    digits; numbers that are too short or too long raise an error when the plan runs (see `domain_guard`).
    """
    check_key(key)
    cipher_key = bytes(reversed(key))
    left = F.when(F.length(tweak) == 14, F.concat(F.substring(tweak, 1, 7), F.lit("0"))).otherwise(F.substring(tweak, 1, 8))
    right = F.when(F.length(tweak) == 14, F.concat(F.substring(tweak, 9, 6), F.substring(tweak, 8, 1), F.lit("0"))).otherwise(F.substring(tweak, 9, 8))
    number = lambda h: F.conv(h, 16, 10).cast("long")
    powers = F.array(*map(F.lit, _POW))
    u = F.ceil(F.length(digits) / 2).cast("int")
    whole = F.struct(digits.alias("x"), number(left).alias("l"), number(right).alias("r"), u.alias("u"), (F.length(digits) - u).alias("v"))

    def rounds_of(t: Column) -> Column:
        def round_(acc: Column, i: Column) -> Column:
            even = i % 2 == 0
            m = F.when(even, t["u"]).otherwise(t["v"])
            w = F.when(even, t["r"]).otherwise(t["l"]).bitwiseXOR(i.cast("long"))
            fixed, moved = (acc["a"], acc["b"]) if decrypt else (acc["b"], acc["a"])
            block = F.concat(F.lpad(F.hex(w), 8, "0"), F.lpad(F.hex(fixed.cast("long")), 24, "0"))
            cipher = F.hex(F.aes_encrypt(F.unhex(_swap(block)), _bytes(cipher_key), F.lit("ECB"), F.lit("PKCS")))
            size = F.get(powers, m)
            # the number that the reversed block spells, mod 10^m, by 16 bits at a time
            y = let(_swap(F.substring(cipher, 1, 32)), lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(29), F.lit(4)), F.lit(0).cast("long"), lambda r, k: (r * 65536 + number(F.substr(s, k, F.lit(4)))) % size))
            c = F.pmod(moved.cast("long") - y, size) if decrypt else (moved.cast("long") + y) % size
            c = F.lpad(c.cast("string"), m, F.lit("0"))
            return F.struct(c.alias("a"), acc["a"].alias("b")) if decrypt else F.struct(acc["b"].alias("a"), c.alias("b"))

        start = F.struct(F.reverse(F.substr(t["x"], F.lit(1), t["u"])).alias("a"), F.reverse(F.substr(t["x"], t["u"] + 1, t["v"])).alias("b"))
        rounds = F.sequence(F.lit(7), F.lit(0), F.lit(-1)) if decrypt else F.sequence(F.lit(0), F.lit(7))
        return F.aggregate(rounds, start, round_, lambda acc: F.concat(F.reverse(acc["a"]), F.reverse(acc["b"])))

    size = F.length(digits)
    wrong = F.when(size < LEAST_DIGITS, F.raise_error(F.lit("too few digits for FF3-1"))).otherwise(F.raise_error(F.lit("too many digits for FF3-1")))
    return F.when(digits.rlike("^[0-9]+$"), F.when(size.between(LEAST_DIGITS, MOST_DIGITS), let(whole, rounds_of)).otherwise(wrong.cast("string")))


def keystream(key: bytes, scope: Column, kind: str, nonce: Column, size: Column) -> Column:
    """Hex of `size` bytes: HMACs of scope, kind, nonce and a 64-bit counter. One nonce serves one value only."""
    block = lambda i: hmac_sha256(key, F.concat(joined(scope, kind, nonce, by=b"|"), _bytes(b"|"), F.unhex(F.lpad(F.hex(i.cast("long")), 16, "0"))))
    return F.substr(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(size / 32).cast("int") - 1, F.lit(0))), block), ""), F.lit(1), size * 2)


def xor_hex(a: Column, b: Column) -> Column:
    """Bytewise XOR of two hex strings of one length, by chunks of seven bytes."""

    def chunks(t: Column) -> Column:
        part = lambda x, i: F.conv(F.substr(x, i * 14 + 1, F.lit(14)), 16, 10).cast("long")
        n = F.length(t["a"])
        chunk = lambda i: F.lpad(F.lower(F.hex(part(t["a"], i).bitwiseXOR(part(t["b"], i)))), F.least(F.lit(14), n - i * 14), F.lit("0"))
        return F.when(n == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(n / 14).cast("int") - 1), chunk), ""))

    return let(F.struct(a.alias("a"), b.alias("b")), chunks)
