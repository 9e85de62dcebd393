"""Nearest neighbours by inner product: learned rotated binary codes, multi-index hashing, float re-ranking."""

from __future__ import annotations

from functools import lru_cache
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Saved, tune, within
from .vectors import bounded_sample, clean, matrix

#: Bits of a substring; each substring of a code has a table of its own.
PART = 16


@lru_cache(maxsize=1)
def _masks() -> list[np.ndarray]:
    """The 16-bit flips by weight."""
    x = np.arange(1 << PART)
    n = np.bitwise_count(x)
    return [x[n == k] for k in range(PART + 1)]


class Codes:
    """Rotations learned by iterative quantisation; a code is the signs after each of them."""

    def __init__(self, rotations: np.ndarray):
        self.rotations = rotations  # (dimensions, bits)

    @classmethod
    def fit(cls, sample: np.ndarray, bits: int = 256, rounds: int = 25, seed: int = 13) -> Codes:
        """Each rotation starts from another random one and lowers the distance of the sample to its own signs."""
        x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
        r, out, d = np.random.default_rng(seed), [], x.shape[1]
        while sum(o.shape[1] for o in out) < bits:
            q = np.linalg.qr(r.normal(size=(d, d)))[0]
            for _ in range(rounds):
                u, _, v = np.linalg.svd(x.T @ np.where(x @ q >= 0, 1.0, -1.0))
                q = u @ v
            out.append(q)
        return cls(np.concatenate(out, 1)[:, :bits])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(rows, parts) of 16-bit numbers."""
        return np.packbits(x @ self.rotations >= 0, axis=1).view(">u2").astype(np.uint16)


class Block:
    """The rows of one block with a table for each substring of their codes; without codes every row is a candidate."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: Codes | None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.codes = ids[order], x[order], codes
        self.norm = float(np.sqrt((self.x * self.x).sum(1).max())) if len(x) else 0.0
        if codes is None:
            return
        self.sub = codes(self.x)
        self.words = np.ascontiguousarray(self.sub).view(np.uint64)
        self.tables = []
        for k in range(self.sub.shape[1]):
            by = np.argsort(self.sub[:, k], kind="stable")
            self.tables.append((by, np.concatenate(([0], np.cumsum(np.bincount(self.sub[:, k], minlength=1 << PART))))))

    def _probe(self, code: np.ndarray, flips: int) -> np.ndarray:
        """Rows with a substring exactly `flips` bits from the query's."""
        got = []
        for k, (by, start) in enumerate(self.tables):
            b = code[k] ^ _masks()[flips]
            lo, n = start[b], start[b + 1] - start[b]
            lo, n = lo[n > 0], n[n > 0]
            if len(n):
                got.append(by[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return np.unique(np.concatenate(got)) if got else np.zeros(0, np.int64)

    def _best(self, q: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of `rows` and their scores. A fast product picks them, with a margin far above its rounding; order
        and scores come from sums that any block makes alike."""
        if len(rows) > 2 * k:
            s = self.x[rows] @ q
            least = np.partition(s, len(s) - k)[len(s) - k]
            rows = rows[s >= least - 1e-9 * max(1e-300, self.norm * float(np.sqrt((q * q).sum())))]
        s = (self.x[rows] * q).sum(1)
        top = np.lexsort((self.ids[rows], -s))[:k]
        return rows[top], s[top]

    def search(self, q: np.ndarray, own: int, code: np.ndarray | None, k: int, z: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k nearest found.

        With flips up to s in each of p substrings, every code within p * (s + 1) - 1 bits is retrieved (pigeonhole).
        The radius grows until codes beyond it are unlikely to reach the k-th score found: a vector of that score has
        a mean distance of bits * angle / pi, and `z` standard deviations are added. Where flips outnumber the rows,
        all codes of the block are compared instead, the nearest 4 k re-ranked for a first radius, and then all in it.
        """
        n = len(self.ids)
        if self.codes is None or not n:
            rows, s = self._best(q, np.flatnonzero(self.ids != own), k)
            return self.ids[rows], s
        parts, bits = len(code), len(code) * PART
        word, near = np.ascontiguousarray(code).view(np.uint64), float(np.sqrt((q * q).sum()))

        def enough(s: np.ndarray) -> float:
            if len(s) < k:
                return bits
            p = acos(min(1.0, max(-1.0, s[-1] / (near * self.norm)))) / pi
            return bits * p + z * sqrt(bits * p * (1 - p))

        dist = np.full(n, bits + 1, np.int32)
        ranked = self.ids == own  # never a candidate
        rows, best, probes, flips = np.zeros(0, np.int64), np.zeros(0), 0, 0
        while (probes := probes + parts * len(_masks()[flips])) * 4 <= n:
            new = self._probe(code, flips)
            dist[new] = np.bitwise_count(self.words[new] ^ word).sum(1)
            flips += 1
            new = np.flatnonzero((dist < parts * flips) & ~ranked)
            ranked[new] = True
            rows, best = self._best(q, np.append(rows, new), k)
            if enough(best) <= parts * flips - 1:
                return self.ids[rows], best
        dist = np.bitwise_count(self.words ^ word).sum(1).astype(np.int32)
        rest = np.flatnonzero(~ranked)
        if len(best) < k and len(rest):
            first = rest[np.argpartition(dist[rest], min(4 * k, len(rest)) - 1)[: 4 * k]]
            ranked[first] = True
            rows, best = self._best(q, np.append(rows, first), k)
        rows, best = self._best(q, np.append(rows, np.flatnonzero((dist <= enough(best)) & ~ranked)), k)
        return self.ids[rows], best


def nearest(table: DataFrame, vec_id="vec_id", embedding="embedding", every: int = 20, k: int = 20, z: float = 2.0, sample: int = 12_000, rows: int = 16_384, asks: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its `k` nearest by inner product.

    Rotations are fitted on about `sample` vectors; every row is coded and indexed. Rows are dealt by hash to blocks of
    about `rows`, queries to blocks of about `asks`; each pair of blocks is one bounded task that returns at most `k`
    rows a query, and the best of these are ranked. Equal scores go to the smaller vec_id.

    Vectors are compared with those of their own length only. The most common length has codes; of others all rows are
    candidates, in blocks alike. Null, empty or zero vectors and those with null or non-finite components take no part,
    as query or candidate, nor do rows without an id. A query never finds rows of its own id; rows that share an id are
    candidates each and one query, of all that they find. With fewer candidates all are returned. An empty table gives
    an empty table; extra columns are ignored.
    """
    tune(table.sparkSession)
    all_ = clean(table, vec_id, embedding).withColumn("w", F.size("v"))
    counts = all_.groupBy("w").count()
    width = counts.orderBy(F.desc("count"), "w").first()
    out = "query_id long, vec_id long, score double"
    if width is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = Codes.fit(bounded_sample(all_.where(F.col("w") == width["w"]), sample, 4))
    parts = Saved(counts.select("w", F.ceil(F.col("count") / rows).cast("int").alias("n_rows"), F.ceil(F.col("count") / (every * asks)).cast("int").alias("n_asks")), "lengths").df
    all_ = within(all_, parts, ["w"])
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    hashed = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(6)), F.col(n)).cast("int")
    stand = all_.select("w", hashed("n_rows").alias("i"), spread("n_asks").alias("j"), F.lit(False).alias("asks"), "vec_id", "v")
    ask = all_.where(F.pmod("vec_id", F.lit(every)) == 0).select("w", spread("n_rows").alias("i"), hashed("n_asks").alias("j"), F.lit(True).alias("asks"), "vec_id", "v")

    def search(group: pa.Table) -> pa.Table:
        asks, ids = np.asarray(group.column("asks")), np.asarray(group.column("vec_id"))
        x = matrix(group.column("v").combine_chunks())
        coded = codes if x.shape[1] == len(codes.rotations) else None
        qid, q = ids[asks], x[asks]
        block = Block(ids[~asks], x[~asks], coded) if len(q) else None
        code = coded(q) if coded is not None and len(q) else [None] * len(q)
        found = [block.search(q[m], int(qid[m]), code[m], k, z) for m in range(len(q))]
        n = [len(f[0]) for f in found]
        return pa.table({"query_id": pa.array(np.repeat(qid, n) if n else np.zeros(0, np.int64), pa.int64()), "vec_id": pa.array(np.concatenate([f[0] for f in found]) if n else [], pa.int64()), "score": pa.array(np.concatenate([f[1] for f in found]) if n else [], pa.float64())})

    found = stand.unionAll(ask).groupBy("w", "i", "j").applyInArrow(search, out)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th of `embeddings`."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
