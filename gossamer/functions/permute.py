"""Keyed permutations of [0, n): the Feistel network for numbers of any size, and tables for small domains."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROUNDS = 10


class Feistel:
    """Ten balanced rounds over the least even number of bits for n, walked until the value is below n."""

    def __init__(self, key: bytes, scope: str, kind: str, n: int):
        if n < 1:
            raise ValueError("an empty domain has no permutation")
        self.n, self.half = n, (max(1, (n - 1).bit_length()) + 1) // 2
        self.key, self.head, self.size = key, f"{scope}|{kind}|".encode(), (self.half + 7) // 8

    def _mix(self, r: int, x: int) -> int:
        said = self.head + x.to_bytes(self.size, "little") + bytes([r])
        return int.from_bytes(hmac.digest(self.key, said, hashlib.sha256), "big") & ((1 << self.half) - 1)

    def _walk(self, x: int, back: bool) -> int:
        if not 0 <= x < self.n:
            raise ValueError("outside the domain")
        if self.n == 1:
            return 0
        mask = (1 << self.half) - 1
        while True:
            a, b = x >> self.half, x & mask
            for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
                a, b = (b ^ self._mix(r, a), a) if back else (b, a ^ self._mix(r, b))
            x = a << self.half | b
            if x < self.n:
                return x

    def forward(self, x: int) -> int:
        return self._walk(x, False)

    def back(self, x: int) -> int:
        return self._walk(x, True)

    def moved(self, x: int, back: bool = False) -> int:
        """A permutation without fixed points (but for n = 1): the place of x in a keyed order, one step on, and back
        again. Each value is found by itself, whatever n is."""
        return self.back((self.forward(x) + (-1 if back else 1)) % self.n)


def permutation_table(spark: SparkSession, key: bytes, scope: str, kind: str, n: int) -> DataFrame:
    """(idx, perm) for every idx below n, made where the rows are."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key, scope, kind, n)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f.forward(x) for x in b.column(0).to_pylist()], pa.int64())], names=["idx", "perm"])

    return spark.range(n).withColumnRenamed("id", "idx").mapInArrow(fill, "idx long, perm long")
