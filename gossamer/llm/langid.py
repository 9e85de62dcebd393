"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import documents, held_out, tune

#: N-grams kept of a language and of a document.
PROFILE, TOP = 400, 300
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _all_grams(text: str | None) -> np.ndarray:
    """Codes of the 1- to 3-grams of all words of a text, words padded by one blank; empty without a letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    is_letter = _letters()[c]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    c = np.where(is_letter, c, 32)
    c = np.concatenate(([32], c, [32]))
    c = c[~((c == 32) & np.concatenate(([False], c[:-1] == 32)))]
    one = c[c != 32]
    two = (c[:-1] << 21) | c[1:]
    three = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[c[1:-1] != 32]
    return np.concatenate((one, two, three))


def ranked_grams(text: str | None, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams of the whole text, most frequent first, ties by code."""
    codes, n = np.unique(_all_grams(text), return_counts=True)
    return codes[np.argsort(-n, kind="stable")[:top]]


def learn(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", per_lang: int = 4000, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles of each non-null language, from about `per_lang` documents each, chosen by a hash of the id.

    The sample is a bound on the labelled rows to learn from, not on the rows to label. N-grams are summed in each
    batch, then in Spark; the driver receives `profile` codes a language.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, int(min(1.0, per_lang / n) * 1_000_000))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < F.element_at(share, F.col("lang")))

    def count(batches):
        for b in batches:
            by: dict[str, list] = {}
            for t, k in zip(b.column(0), b.column(1)):
                by.setdefault(k.as_py(), []).append(_all_grams(t.as_py()))
            for k, all_ in by.items():
                code, n = np.unique(np.concatenate(all_), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(code), pa.string()), pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    sums = sample.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= profile).select("lang", "gram", "rank").collect()
    out: dict[str, np.ndarray] = {}
    for k in sorted(counts):
        got = sorted((r["rank"], r["gram"]) for r in top if r["lang"] == k)
        if got:
            out[k] = np.array([g for _, g in got], np.int64)
    return out


class Profiles:
    """Distances of documents to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = list(profiles), size
        self.codes = np.unique(np.concatenate(list(profiles.values()))) if profiles else np.zeros(0, np.int64)
        self.rank = np.full((len(self.codes), len(profiles)), -1, np.int32)
        for k, p in enumerate(profiles.values()):
            self.rank[np.searchsorted(self.codes, p), k] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and 1 less its distance as a share of the largest possible; ties: first by name."""
        grams = ranked_grams(text)
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, grams), len(self.codes) - 1)
        rank = np.where((self.codes[at] == grams)[:, None], self.rank[at], -1)
        off = np.where(rank < 0, self.size, np.minimum(np.abs(rank - np.arange(len(grams), dtype=np.int32)[:, None]), self.size))
        total = off.sum(axis=0)
        k = int(total.argmin())
        return self.names[k], float(1 - total[k] / (self.size * len(grams)))


def predictor(profiles: dict[str, np.ndarray]):
    """A column function from text to struct<lang_pred, score>."""

    @arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        p = Profiles(profiles)
        got = [p.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["lang_pred", "score"])

    return predict.asNondeterministic()


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text="text") -> DataFrame:
    """`docs` with lang_pred and score.

    Null texts and texts without a letter are `und` with score 0; so is every text if nothing was learned. Very long
    texts are read whole. Equal texts get equal answers; equal distances go to the first language by name.
    """
    tune(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("_p", predictor(profiles)(F.col(text).cast("string"))).select(*rest, "_p.lang_pred", "_p.score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null texts and texts without a letter. The columns stay."""
    tune(spark)
    found = learn(docs.where(~held_out()))
    return identify(docs, found).where(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def op3_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all `documents`, learned from the rows that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    tune(spark)
    found = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), found).drop("text")
