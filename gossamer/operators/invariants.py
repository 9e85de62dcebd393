"""Checks of the four invariants, and the rates of an annotated corpus. Messages hold counts only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DeterminismError, EmittedOnlyError, LeakError
from ..sources.registry import assert_injective  # noqa: F401  the fourth check lives with the registry


def leaks(masked: DataFrame, clear: DataFrame, doc_id: str = "doc_id", text: str = "text", value: str = "value") -> DataFrame:
    """Rows of `clear` (doc_id, value) whose value still stands in the masked text."""
    return clear.join(masked.select(doc_id, F.col(text).alias("_masked")), doc_id).where(F.contains("_masked", F.col(value))).select(*clear.columns)


def assert_no_leak(masked: DataFrame, clear: DataFrame, **names: str) -> None:
    n = leaks(masked, clear, **names).count()
    if n:
        raise LeakError(f"{n} clear values are left")


def assert_deterministic(issued: DataFrame) -> None:
    n = issued.groupBy("scope", "entity_type", "clear_hmac").agg(F.countDistinct("surrogate").alias("n")).where("n > 1").count()
    if n:
        raise DeterminismError(f"{n} values have several surrogates")


def assert_emitted_only(restored: DataFrame, registry: DataFrame) -> None:
    """`restored` (scope, surrogate): what was given back must have been issued."""
    n = restored.join(registry.select("scope", "surrogate"), ["scope", "surrogate"], "left_anti").count()
    if n:
        raise EmittedOnlyError(f"{n} restored surrogates were never issued")


def fixed_points(issued: DataFrame) -> DataFrame:
    """(scope, entity_type, n): values whose surrogate equals them, before their clear column is dropped."""
    return issued.where(F.col("surrogate") == F.col("value")).groupBy("scope", "entity_type").agg(F.count("*").alias("n"))


def rates(expected: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("doc_id", "start", "end", "type")) -> DataFrame:
    """(type, expected, found, hits, precision, recall) of annotated spans; a type that has none has null rates."""
    e = expected.select(*keys).distinct().withColumn("e", F.lit(1))
    f = found.select(*keys).distinct().withColumn("f", F.lit(1))
    both = e.join(f, list(keys), "full")
    sums = both.groupBy("type").agg(F.count("e").alias("expected"), F.count("f").alias("found"), F.count_if(F.col("e").isNotNull() & F.col("f").isNotNull()).alias("hits"))
    return sums.withColumns({"precision": F.try_divide("hits", "found"), "recall": F.try_divide("hits", "expected")})
