"""Quality score: an additive model of binned features and feature pairs, boosted by shallow trees."""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Saved, documents, held_out, tune

FEATURES = [
    "log_bytes", "lower", "upper", "digit", "space", "newline", "stops", "shouts", "symbols", "brackets", "non_ascii", "byte_entropy",
    "log_words", "mean_word", "max_word", "short_words", "distinct_words", "top_word", "same_as_last", "lines", "distinct_lines", "mean_line", "titled", "packed",
]


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[[ord(c) for c in chars]] = 1
    return out


_CLASSES = np.stack(
    [
        _class("abcdefghijklmnopqrstuvwxyz"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(" \t"), _class("\n\r"),
        _class(".,;:'\"-"), _class("!?"), _class("$%&#*@^~`"), _class("|/\\<>[]{}()=_+"), (np.arange(256) >= 128) * 1.0,
    ]
)


def features(text: str | None) -> np.ndarray:
    """The numbers that a text is judged by, all from the whole text. Null and empty texts give zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return np.zeros(len(FEATURES), np.float32)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = hist[hist > 0] / len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    size = list(map(len, words))
    top = max(Counter(words).values(), default=0)
    same = sum(map(eq, words, words[1:]))
    titled = sum(map(bytes.istitle, words))
    return np.array(
        [
            np.log1p(len(raw)), *(_CLASSES @ hist / len(raw)), -(p * np.log2(p)).sum(),
            np.log1p(len(words)), sum(size) / n, max(size, default=0), sum(s <= 3 for s in size) / n, len(set(words)) / n, top / n, same / n,
            np.log1p(len(lines)), len(set(lines)) / len(lines), len(raw) / len(lines), titled / n, len(zlib.compress(raw, 1)) / len(raw),
        ],
        np.float32,
    )


def _cut(g: np.ndarray, h: np.ndarray, lam: float = 1.0) -> tuple[float, int]:
    """The gain of the best single cut of a histogram of gradients, and its place."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + lam) + (g.sum() - gl) ** 2 / (h.sum() - hl + lam) - g.sum() ** 2 / (h.sum() + lam)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)


def _leaves(g: np.ndarray, h: np.ndarray, lam: float = 1.0) -> np.ndarray:
    """A tree of at most three leaves on one feature's histogram, as a step for each bin."""
    parts = [(0, len(g))]
    for _ in range(2):
        gain, at, k = max(((*_cut(g[a:b], h[a:b]), k) for k, (a, b) in enumerate(parts) if b - a > 1), default=(0, 0, 0))
        if gain <= 1e-6:
            break
        a, b = parts[k]
        parts[k : k + 1] = [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + lam)
    return out


def _grid(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree of four leaves on two features: one cut of the first, then one of the second on either side."""
    best, out = 0.0, np.zeros(g.shape)
    ga, ha = g.sum(1), h.sum(1)
    if len(ga) < 2:
        return best, out
    root = g.sum() ** 2 / (h.sum() + 1)
    gl, hl = np.cumsum(g, 0), np.cumsum(h, 0)
    total, where = -np.inf, 0
    for cut in range(1, len(ga)):
        s = 0.0
        for gs, hs in ((gl[cut - 1], hl[cut - 1]), (gl[-1] - gl[cut - 1], hl[-1] - hl[cut - 1])):
            s += gs.sum() ** 2 / (hs.sum() + 1) + max(0.0, _cut(gs, hs)[0])
        if s > total:
            total, where = s, cut
    for rows in (slice(0, where), slice(where, None)):
        gs, hs = g[rows].sum(0), h[rows].sum(0)
        gain, at = _cut(gs, hs)
        for cols in (slice(0, at), slice(at, None)) if gain > 0 else (slice(None),):
            out[rows, cols] = gs[cols].sum() / (hs[cols].sum() + 1)
    return total - root, out


class AdditiveModel:
    """intercept + a table for each feature + a table for each chosen pair; all look-ups are by bin."""

    def __init__(self, bins: int = 32, pairs: int = 8, coarse: int = 8, cycles: int = 120, pair_cycles: int = 40, rate: float = 0.15):
        self.bins, self.n_pairs, self.coarse, self.cycles, self.pair_cycles, self.rate = bins, pairs, coarse, cycles, pair_cycles, rate

    def _bin(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        """Cyclic boosting: each round visits every feature (then every pair) with one shallow tree on its bins."""
        x, n, width = np.nan_to_num(x.astype(float)), len(y), x.shape[1]
        q = [np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1]) if n else np.zeros(0) for k in range(width)]
        self.edges = [np.unique(e) for e in q]
        self.rough = [np.unique(e[:: max(1, self.bins // self.coarse)]) for e in q]
        rate = (y.sum() + 1) / (n + 2)
        self.intercept = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs, self.grids = [], []
        if n == 0 or y.min() == y.max():
            return self
        b, f = self._bin(x, self.edges), np.full(n, self.intercept)

        def slopes():
            p = 1 / (1 + np.exp(-f))
            return y - p, p * (1 - p)

        for _ in range(self.cycles):
            for k, table in enumerate(self.tables):
                g, h = slopes()
                step = self.rate * _leaves(np.bincount(b[:, k], g, len(table)), np.bincount(b[:, k], h, len(table)))
                table += step
                f += step[b[:, k]]
        r = self._bin(x, self.rough)
        shape = [len(e) + 1 for e in self.rough]
        both = lambda i, j, w: np.bincount(r[:, i] * shape[j] + r[:, j], w, shape[i] * shape[j]).reshape(shape[i], shape[j])
        g, h = slopes()
        ranked = sorted(((_grid(both(i, j, g), both(i, j, h))[0], i, j) for i in range(width) for j in range(i)), key=lambda s: (-s[0], s[1:]))
        self.pairs = [(i, j) for gain, i, j in ranked[: self.n_pairs] if gain > 0]
        self.grids = [np.zeros((shape[i], shape[j])) for i, j in self.pairs]
        for _ in range(self.pair_cycles):
            for (i, j), grid in zip(self.pairs, self.grids):
                g, h = slopes()
                step = self.rate * _grid(both(i, j, g), both(i, j, h))[1]
                grid += step
                f += step[r[:, i], r[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.nan_to_num(x.astype(float))
        b, r = self._bin(x, self.edges), self._bin(x, self.rough)
        f = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            f += table[b[:, k]]
        for (i, j), grid in zip(self.pairs, self.grids):
            f += grid[r[:, i], r[:, j]]
        return 1 / (1 + np.exp(-f))


def feature_table(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, held_out, f): one pass over the texts; what follows reads only this narrow table."""

    def read(batches):
        for b in batches:
            rows = [features(t.as_py()) for t in b.column(2)]
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.float32), pa.float32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, len(FEATURES)), pa.int32()), flat)], names=["doc_id", "held_out", "f"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text")).mapInArrow(read, f"doc_id {kind}, held_out boolean, f array<float>")


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), len(FEATURES))


def classify(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", label="quality", sample: int = 40_000, at: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`.

    The model is fitted on about `sample` labelled ids that are not held out, chosen by a hash of the id; only a row of
    each reaches the driver (of unlike rows of one id, that of the least features). Null labels are left out; several labels of one id count by their mean (0.5 and more is 1).
    Null and empty texts are scored as what they are, texts without a byte. Without labels of both kinds the score is
    the smoothed share of label 1. Repeated rows and ids are each scored; an empty table gives an empty table.
    """
    tune(docs.sparkSession)
    table = Saved(feature_table(docs, doc_id, text), "features").df
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("double").alias("y")).where("y is not null and id is not null").where(~held_out("id"))
    known = known.groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    n = known.count()
    part = int(min(1.0, sample / max(1, n)) * 1_000_000)
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < part)
    # one row an id, whatever rows repeat it
    rows = table.join(F.broadcast(chosen), table["doc_id"] == F.col("id")).groupBy("id", "y").agg(F.min("f").alias("f"))
    train = rows.orderBy("id").select("f", "y").toArrow()
    model = AdditiveModel().fit(_matrix(train.column("f").combine_chunks()) if len(train) else np.zeros((0, len(FEATURES))), np.asarray(train.column("y")))

    def judge(batches):
        for b in batches:
            s = model.score(_matrix(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= at).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return table.mapInArrow(judge, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op1_additive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all `documents`, learned from `labels.quality`."""
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
