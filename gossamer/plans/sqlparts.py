"""DuckDB SQL fragments of the oracles, written apart from the Spark expressions they check."""

from __future__ import annotations

KEY = bytes(range(16))


def luhn(x: str) -> str:
    each = f"(length({x}) - i) % 2 = 0 THEN substr({x}, i, 1)::INT ELSE (2 * substr({x}, i, 1)::INT) // 10 + (2 * substr({x}, i, 1)::INT) % 10"
    return f"(list_sum([CASE WHEN {each} END for i in range(1, length({x}) + 1)])::INT % 10)"


def luhn_digit(body: str) -> str:
    return f"((10 - {luhn(f'({body} || chr(48))')}) % 10)::VARCHAR"


def hmac(message: str, key: bytes = KEY) -> str:
    """Hex of HMAC-SHA256 of a blob expression."""
    k = key.ljust(64, b"\0")
    inner, outer = (bytes(c ^ p for c in k).hex() for p in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {message})))"


def names(kind: str) -> str:
    from ..sources.gazetteers import SEED

    return "[" + ", ".join("'" + n.partition(":")[0].replace("'", "''") + "'" for n in SEED[kind]) + "]"
