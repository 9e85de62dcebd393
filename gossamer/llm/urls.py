"""URL filter: allow and block rules, and a character language-model ratio where no rule fits."""

from __future__ import annotations

import string
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Saved, tune

#: (verdict, rule): host and path prefix.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

START, END = 0, 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule (ties: first in order of text) that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, r in sorted(rules, key=lambda x: (len(x[1]), [-ord(c) for c in x[1]])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


@dataclass
class Markov:
    """A byte model of variable order: Witten-Bell interpolation over the contexts seen at least `least` times."""

    order: int = 5
    least: int = 2
    tables: list = field(default_factory=list)

    @staticmethod
    def _codes(urls: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each byte of all urls with an end mark: its number of url, the bytes before it (40 bits), itself."""
        raw = [bytes([START] * order) + u.encode("utf-8", "surrogatepass") + bytes([END]) for u in urls]
        sizes = np.array([len(r) for r in raw], np.int64)
        b = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        start = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(raw)), sizes)
        own = np.arange(len(b)) - start[owner] >= order
        before = np.zeros(len(b), np.int64)
        for k in range(1, order + 1):
            before[k:] |= b[:-k] << (8 * (k - 1))
        return owner[own], before[own], b[own]

    def fit(self, urls: list[str]) -> Markov:
        return self.of(self.counts(urls, self.order))

    @classmethod
    def counts(cls, urls: list[str], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order, the contexts with their next byte, and how often they occur."""
        _, before, c = cls._codes(urls, order)
        return [np.unique((before & ((1 << (8 * k)) - 1)) << 8 | c, return_counts=True) for k in range(order + 1)]

    def of(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> Markov:
        """The model of such counts; keys are sorted and distinct."""
        for k, (key, n) in enumerate(counts):
            ctx, first = np.unique(key >> 8, return_index=True)
            total, kinds = np.add.reduceat(n, first) if len(key) else n, np.diff(np.append(first, len(key)))
            if k:
                ok = total >= self.least
                keep = np.repeat(ok, kinds)
                key, n, ctx, total, kinds = key[keep], n[keep], ctx[ok], total[ok], kinds[ok]
            self.tables.append((key, n, ctx, total, kinds))
        return self

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0)

    def mean_log(self, urls: list[str]) -> np.ndarray:
        """Log-likelihood a byte, end mark included."""
        owner, before, c = self._codes(urls, self.order)
        p = np.full(len(c), 1 / 256)
        for k, (key, n, ctx, total, kinds) in enumerate(self.tables):
            here = before & ((1 << (8 * k)) - 1)
            seen, t, d = self._find(key, n, here << 8 | c), self._find(ctx, total, here), self._find(ctx, kinds, here)
            p = np.where(t > 0, (seen + d * p) / np.maximum(t + d, 1), p)
        return np.bincount(owner, np.log(p), len(urls)) / np.maximum(np.bincount(owner, minlength=len(urls)), 1)


@dataclass
class RatioFilter:
    """Two models and the length-normalised difference from which a URL is accepted."""

    good: Markov | None = None
    bad: Markov | None = None
    cut: float = 0.0
    #: (h1, h2, score) of all URLs, where the models are too large for one place
    scores: DataFrame | None = None

    def fit(self, good: list[str], bad: list[str], folds: int = 5) -> RatioFilter:
        """The cut has the fewest errors on each fold's URLs as seen by models of the others; ties: nearest to 0."""
        self.good = Markov().fit(good) if good else None
        self.bad = Markov().fit(bad) if bad else None
        if len(good) < folds or len(bad) < folds:
            return self
        s, y = [], []
        for k in range(folds):
            part = RatioFilter(*(Markov().fit([u for i, u in enumerate(x) if i % folds != k]) for x in (good, bad)))
            for x, label in ((good[k::folds], 1), (bad[k::folds], 0)):
                s.append(part.score(x))
                y.append(np.full(len(x), label))
        s, y = np.concatenate(s), np.concatenate(y)
        order = np.argsort(s, kind="stable")
        s, y = s[order], y[order]
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        wrong = np.concatenate(([0], np.cumsum(weight * (y == 1)))) + np.concatenate((np.cumsum((weight * (y == 0))[::-1])[::-1], [0]))
        cuts = np.concatenate(([s[0] - 1e-9], (s[:-1] + s[1:]) / 2, [s[-1] + 1e-9]))
        self.cut = float(min(zip(wrong.round(12), np.abs(cuts), cuts))[2])
        return self

    def score(self, urls: list[str]) -> np.ndarray:
        return self.good.mean_log(urls) - self.bad.mean_log(urls)

    def accept(self, urls: list[str]) -> np.ndarray:
        if self.bad is None or self.good is None:  # nothing to weigh: what was seen is taken for all
            return np.full(len(urls), self.bad is None)
        return self.score(urls) >= self.cut


FOLDS, STEP, UNIT = 5, 1e-4, 1e10


def _hashes(url: Column) -> list[Column]:
    """Two hashes that stand for a URL where its scores are joined."""
    u = F.coalesce(url, F.lit(""))
    return [F.xxhash64(u).alias("h1"), F.xxhash64(F.lit(29), u).alias("h2")]


def wide_scores(urls: DataFrame, counted: DataFrame) -> DataFrame:
    """(h1, h2, score) of distinct `urls` (u, f: the fold left out, or -1) by the models of all of `counted`, however many
    contexts there are: each context and next byte meets its counts in joins, and no model is in one place.

    Logarithms are summed in whole units of 1e-10, so that their order does not matter.
    """
    order = Markov().order
    without = lambda y: [F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)) - F.sum(F.when((F.col("y") == y) & (F.col("f") == g), F.col("n")).otherwise(0)) for g in range(-1, FOLDS)]
    seen = counted.groupBy("k", "ctx", "key").agg(F.array(*without(1)).alias("g"), F.array(*without(0)).alias("b"))
    each = range(FOLDS + 1)
    sums = [F.array(*(F.sum(F.col(y)[i]) for i in each)).alias("t" + y) for y in "gb"] + [F.array(*(F.count_if(F.col(y)[i] > 0) for i in each)).alias("d" + y) for y in "gb"]
    contexts = seen.groupBy("k", "ctx").agg(*sums)

    def grams(batches):
        for b in batches:
            h1, h2, f, u = (b.column(i) for i in range(4))
            if not len(u):
                continue
            owner, before, c = Markov._codes(u.to_pylist(), order)
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([h1.take(at), h2.take(at), f.take(at), pa.array((before & ((1 << (8 * order)) - 1)) << 8 | c, pa.int64())], names=["h1", "h2", "f", "gram"])

    held = urls.select(*_hashes(F.col("u")), "f", "u").mapInArrow(grams, "h1 long, h2 long, f int, gram long").groupBy("h1", "h2", "f", "gram").agg(F.count("*").alias("times"))
    held = Saved(held, "grams").df
    # all bytes share the one context of order 0
    by_order = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k")
    wanted = held.select("f", "gram").distinct().select("f", "gram", by_order).withColumn("key", F.expr("gram & (shiftleft(1L, 8 * (k + 1)) - 1)")).withColumn("ctx", F.shiftright("key", 8))
    low = wanted.where("k = 0").join(F.broadcast(seen.where("k = 0").drop("ctx")), ["k", "key"], "left").join(F.broadcast(contexts.where("k = 0")), ["k", "ctx"], "left")
    high = wanted.where("k > 0").join(seen.where("k > 0").drop("ctx"), ["k", "key"], "left").join(contexts.where("k > 0"), ["k", "ctx"], "left")
    mine = lambda c: F.coalesce(F.get(F.col(c), F.col("f") + 1), F.lit(0)).alias(c)
    facts = low.unionByName(high).select("f", "gram", F.struct("k", *(mine(c) for c in ("g", "b", "tg", "tb", "dg", "db"))).alias("x"))
    facts = facts.groupBy("f", "gram").agg(F.array_sort(F.collect_list("x")).alias("xs"))

    def log_p(y: str) -> Column:
        def step(p: Column, x: Column) -> Column:
            fits = (x["t" + y] > 0) & ((x["k"] == 0) | (x["t" + y] >= Markov().least))
            return F.when(fits, (x[y] + x["d" + y] * p) / (x["t" + y] + x["d" + y])).otherwise(p)

        return F.log(F.aggregate("xs", F.lit(1 / 256), step))

    ratio = facts.select("f", "gram", F.round((log_p("g") - log_p("b")) * UNIT).cast("long").alias("r"))
    return held.join(ratio, ["f", "gram"]).groupBy("h1", "h2").agg((F.sum(F.col("r") * F.col("times")) / F.sum("times") / UNIT).alias("score"))


def learn(ruled: DataFrame, url: str, entries: int = 500_000) -> RatioFilter:
    """Two models of all rows of `ruled` that have a verdict (`_said`), and the cut with the fewest errors on them.

    Each batch sends its counts of contexts and next bytes by verdict and fold, which are summed. Over `entries` of them
    do not come to the driver: the models stay tables (see `wide_scores`), and `scores` of the answer holds every URL's.
    Every row is scored by the models of the other folds (a URL has one fold); the cut comes from the histogram of the
    scores, in steps of 0.0001.
    """
    order = Markov().order
    fold = F.pmod(F.xxhash64(F.col(url), F.lit(29)), F.lit(FOLDS)).cast("int")
    rows = ruled.where(F.col("_said").isNotNull()).select((F.col("_said") == "allow").cast("int").alias("y"), fold.alias("f"), F.col(url).alias("u"))

    def parts(b: pa.RecordBatch):
        y, f, u = np.asarray(b.column(0)), np.asarray(b.column(1)), b.column(2).to_pylist()
        for label in (0, 1):
            for fold in range(FOLDS):
                at = np.flatnonzero((y == label) & (f == fold))
                if len(at):
                    yield label, fold, [u[i] for i in at]

    def count(batches):
        for b in batches:
            for label, fold, urls in parts(b):
                for k, (key, n) in enumerate(Markov.counts(urls, order)):
                    same = [pa.array(np.full(len(key), x), pa.int32()) for x in (label, fold, k)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["y", "f", "k", "key", "n"])

    counted = rows.mapInArrow(count, "y int, f int, k int, key long, n long").groupBy("y", "f", "k", "key").agg(F.sum("n").alias("n"))
    counted = Saved(counted.withColumn("ctx", F.shiftright("key", 8)), "counts").df
    contexts = counted.groupBy("y", "k", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("size")).where("k = 0 or total >= 2")
    have = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    size = contexts.where("k > 0").agg(F.sum("size")).first()[0] or 0
    if size > entries and len(have) == 2:
        fit = min(have.values()) >= FOLDS
        urls = ruled.select(F.coalesce(F.col(url), F.lit("")).alias("u"), F.when(F.col("_said").isNotNull() & F.lit(fit), fold).otherwise(-1).alias("f")).distinct()
        found = RatioFilter(Markov(), Markov(), scores=Saved(wide_scores(urls, counted), "scores").df)
        if fit:
            at = F.floor(F.col("score") / STEP).cast("long").alias("at")
            found.cut = _cut(rows.select("y", *_hashes(F.col("u"))).join(found.scores, ["h1", "h2"]).groupBy("y", at).agg(F.count("*").alias("n")), have)
        return found
    if size > entries:  # one verdict only: nothing is weighed, so no context is needed
        contexts = contexts.where("k = 0")
    kept = counted.join(contexts.select("y", "k", "ctx"), ["y", "k", "ctx"])
    t = kept.select("y", "f", "k", "key", "n").toArrow()
    y, f, k, key, n = (np.asarray(t.column(c)) for c in ("y", "f", "k", "key", "n"))

    def model(label: int, without: int = -1) -> Markov:
        out = []
        for o in range(order + 1):
            at = (y == label) & (k == o) & (f != without)
            ks, where = np.unique(key[at], return_inverse=True)
            out.append((ks, np.bincount(where, n[at], len(ks)).astype(np.int64)))
        return Markov().of(out)

    found = RatioFilter(model(1) if 1 in have else None, model(0) if 0 in have else None)
    if min(have.get(0, 0), have.get(1, 0)) < FOLDS:
        return found
    by_fold = [RatioFilter(model(1, fold), model(0, fold)) for fold in range(FOLDS)]

    def score(batches):
        for b in batches:
            for label, fold, urls in parts(b):
                at, n = np.unique(np.floor(by_fold[fold].score(urls) / STEP).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["y", "at", "n"])

    found.cut = _cut(rows.mapInArrow(score, "y int, at long, n long"), have)
    return found


def _cut(steps: DataFrame, have: dict[int, int]) -> float:
    """The cut with the fewest errors by a histogram (y, at: steps of the score, n); ties: nearest to 0."""
    hist = steps.groupBy("at").pivot("y", [0, 1]).agg(F.sum("n")).na.fill(0).toArrow().sort_by("at")
    at, bad, good = np.asarray(hist.column(0)), np.asarray(hist.column(1)) / have[0], np.asarray(hist.column(2)) / have[1]
    wrong = np.concatenate(([0], np.cumsum(good))) + np.concatenate((np.cumsum(bad[::-1])[::-1], [0]))
    cuts = np.concatenate(([at[0]], (at[:-1] + 1 + at[1:]) / 2, [at[-1] + 1])) * STEP
    return float(min(zip(wrong.round(12), np.abs(cuts), cuts))[2])


#: Columns that `judge` makes; columns of `pages` with these names go.
NEW = ("host", "path", "rule", "verdict")


def by_rules(pages: DataFrame, url: str, rules=RULES) -> DataFrame:
    """`pages` with host, path, rule and the rule's verdict `_said`, the last two null where no rule fits."""
    host, path = host_and_path(F.col(url))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    return pages.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "_said": said})


def judge(pages: DataFrame, url="url", rules=RULES, entries: int = 500_000) -> DataFrame:
    """`pages` with host, path, rule and verdict.

    URLs with a rule get its verdict. The others are compared by two byte models, fitted on all
    URLs whose verdicts came from rules; the cut is calibrated by folds of them (see `learn`). A null URL, or one without `://`, has empty host and path and is judged as text (null as the empty one).
    If rules reject nothing (accept nothing), all others are allowed (blocked); if neither, allowed. Repeated rows
    and very long URLs are judged alike; an empty table gives an empty table.
    """
    tune(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (*NEW, "_said", "_by_model")]
    ruled = by_rules(pages, url, rules)
    model = learn(ruled, url, entries)
    if model.scores is not None:
        h = ruled.withColumns(dict(zip(("_h1", "_h2"), _hashes(F.col(url)))))
        scored = h.join(model.scores, (F.col("_h1") == F.col("h1")) & (F.col("_h2") == F.col("h2")), "left")
        by_model = F.when(F.col("score") >= model.cut, "allow").otherwise("block")
        return scored.select(*(ruled[c] for c in keep), ruled["host"], ruled["path"], ruled["rule"], F.coalesce(ruled["_said"], by_model).alias("verdict"))

    @arrow_udf("boolean")
    def accepted(urls: pa.Array) -> pa.Array:
        return pa.array(model.accept([u.as_py() or "" for u in urls]))

    by_model = F.when(accepted.asNondeterministic()(F.col(url)), "allow").otherwise("block")
    return ruled.withColumn("_by_model", by_model).select(*keep, "host", "path", "rule", F.coalesce("_said", "_by_model").alias("verdict"))


def urls_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone say of the URLs of all `pages`: op5's host, path and rule, and the rule's verdict or null."""
    return by_rules(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), "url").select("page_id", "host", "path", "rule", F.col("_said").alias("said"))


def op5_markov_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all `pages`."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")


URLS_BY_RULE_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_replace(regexp_extract(rest, '^[^?#]*'), '^[^/]*', '') AS path FROM u),
r(said, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
m AS (
  SELECT page_id, host, path, arg_max(rule, len(rule)) AS rule, arg_max(said, len(rule)) AS said
  FROM (SELECT h.*, r.* FROM h JOIN r ON ('.' || host) LIKE ('%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/'))))
  GROUP BY ALL)
SELECT coalesce(url_host, '') AS host, coalesce(url_path, '') AS path, page_id, rule, said
FROM (SELECT h.page_id, h.host AS url_host, h.path AS url_path, m.rule, m.said FROM h LEFT JOIN m USING (page_id, host, path))
"""
