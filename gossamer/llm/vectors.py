"""Near-duplicate vectors by an inverted multi-index: a product grid of two codebooks, multi-sequence traversal, verification."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Saved, connected_components, tune


def usable(v: Column) -> Column:
    """True for vectors that are not null or empty and hold finite, not only zero, components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def clean(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the usable vectors."""
    v = F.col(embedding)
    return table.where(F.col(vec_id).isNotNull() & usable(v)).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))


def matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def bounded_sample(rows: DataFrame, size: int, salt: int) -> np.ndarray:
    """About `size` vectors, chosen by a hash of the id, for fitting only."""
    n = rows.count()
    part = int(min(1.0, size / max(1, n)) * 1_000_000)
    got = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(1_000_000)) < part).orderBy("vec_id").select("v").toArrow()
    return matrix(got.column("v").combine_chunks()) if got.num_rows else np.zeros((0, 0))


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means centres, seeded from distinct rows; an empty centre is put on the row farthest from its own."""
    x = np.asarray(x, np.float64)
    distinct = np.unique(x.round(6), axis=0)
    r = np.random.default_rng(seed)
    c = distinct[r.permutation(len(distinct))[: min(k, len(distinct))]].copy()
    for _ in range(rounds):
        d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
        own = d.argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        far = np.argsort(-d[np.arange(len(x)), own], kind="stable")
        for j, e in enumerate(np.flatnonzero(n == 0)):
            c[e] = x[far[j % len(far)]]
    return c


class Grid:
    """Two codebooks on the halves of unit vectors; a cell is a pair of centres."""

    def __init__(self, one: np.ndarray, two: np.ndarray):
        self.books = (one, two)
        self.half = one.shape[1]
        self._gaps: dict[int, np.ndarray] = {}  # made where they are used, never sent

    def __getstate__(self):
        return {"books": self.books, "half": self.half, "_gaps": {}}

    def _bounds(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centre of each row, and for each centre the squared distance to its region's border, at least."""
        c = self.books[k]
        d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)
        own = d.argmin(1)
        if k not in self._gaps:
            n = (c * c).sum(1)
            self._gaps[k] = np.sqrt(np.maximum(n[:, None] - 2 * c @ c.T + n, 1e-18))
        gap = self._gaps[k]
        lower = (d - d[np.arange(len(x)), own][:, None]) / (2 * gap[own])
        lower[np.arange(len(x)), own] = 0
        return own, np.maximum(lower, 0) ** 2

    def own(self, x: np.ndarray) -> np.ndarray:
        a, b = (self._bounds(h, k)[0] for k, h in enumerate((x[:, : self.half], x[:, self.half :])))
        return a * len(self.books[1]) + b

    def nearest(self, x: np.ndarray, cells: int, radius2: float) -> list[list[int]]:
        """Multi-sequence traversal: a row's cells by rising sum of both halves' bounds, up to `cells` of them, and
        none that no vector within the radius can lie in."""
        (_, a), (_, b) = self._bounds(x[:, : self.half], 0), self._bounds(x[:, self.half :], 1)
        oa, ob = np.argsort(a, 1, kind="stable"), np.argsort(b, 1, kind="stable")
        width, out = len(self.books[1]), []
        for i in range(len(x)):
            la, lb, ia, ib = a[i, oa[i]], b[i, ob[i]], oa[i], ob[i]
            heap, row = [(la[0] + lb[0], 0, 0)], []
            while heap and len(row) < cells:
                s, p, q = heapq.heappop(heap)
                if s > radius2:
                    break
                row.append(int(ia[p] * width + ib[q]))
                if q + 1 < len(lb):
                    heapq.heappush(heap, (la[p] + lb[q + 1], p, q + 1))
                if q == 0 and p + 1 < len(la):
                    heapq.heappush(heap, (la[p + 1] + lb[0], p + 1, 0))
            out.append(row)
        return out


def fit(sample: np.ndarray, centres: int) -> Grid | None:
    if not len(sample):
        return None
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    half = max(1, x.shape[1] // 2)
    two = x[:, half:] if x.shape[1] > 1 else np.zeros((len(x), 1))
    return Grid(codebook(x[:, :half], centres), codebook(two, centres))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.concatenate((x, np.zeros((len(x), 1))), 1) if x.shape[1] == 1 else x


def visits_for(rows: DataFrame, grid: Grid, at: float, recall: float, flat: float, probes: int = 4096) -> int | None:
    """How many cells a vector of `rows` (vec_id, v) must visit so that `recall` of the links is found; 0: all within
    the radius; None: compare all with all. The last two are exact.

    About `probes` vectors are compared with all rows. A link, never one of a vector to itself, needs as many visits as
    there are cells up to the partner's. Unless every vector is a probe, a count below 3 / (1 - recall) of links cannot
    show the recall, and the visit is exact. It is also exact where `flat`, the copies a vector needs to meet all
    others in blocks, is no more than its cells.
    """
    n = rows.count()
    part = int(min(1.0, probes / max(1, n)) * 1_000_000)
    got = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1_000_000)) < part).orderBy("vec_id").toArrow()
    if not got.num_rows:
        return None
    ids, x = np.asarray(got.column("vec_id")), _unit(matrix(got.column("v").combine_chunks()))
    a, b = grid._bounds(x[:, : grid.half], 0)[1], grid._bounds(x[:, grid.half :], 1)[1]
    by = np.sort(b, 1)
    within = np.mean([np.searchsorted(by[i], 2 - 2 * at + 1e-9 - a[i], "right").sum() for i in range(0, len(x), max(1, len(x) // 256))])
    width = len(grid.books[1])

    def needs(batches):
        for batch in batches:
            y = matrix(batch.column(1))
            if not len(y):
                continue
            y, home = _unit(y), grid.own(_unit(y))
            p, q = np.nonzero((x @ y.T >= at) & (ids[:, None] != np.asarray(batch.column(0))))
            asked, count = np.unique(np.stack((p, home[q])), axis=1, return_counts=True)
            need = [int(np.searchsorted(by[i], a[i, c // width] + b[i, c % width] + 1e-12 - a[i], "right").sum()) for i, c in asked.T]
            yield pa.RecordBatch.from_arrays([pa.array(need, pa.int64()), pa.array(count, pa.int64())], names=["need", "n"])

    seen = sorted(map(tuple, rows.select("vec_id", "v").mapInArrow(needs, "need long, n long").groupBy("need").agg(F.sum("n")).collect()))
    links = sum(k for _, k in seen)
    visits = 0
    if len(x) == n or links >= 3 / (1 - recall):
        found = np.cumsum([k for _, k in seen])
        visits = max(4, seen[int(np.searchsorted(found, recall * links))][0]) if seen else 4
    return visits if (visits or within) < flat else None


def _components(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest) among the linked of both sides, by min-label rounds over a boolean matrix."""
    ids = np.unique(np.concatenate((left[link.any(1)], right[link.any(0)])))
    if not len(ids):
        return ids, ids
    p, q = np.nonzero(link)
    a, b = np.searchsorted(ids, left[p]), np.searchsorted(ids, right[q])
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return ids, ids[label]
        label = new


#: Lengths of vectors that get a grid of their own: the most common ones of which there are enough.
GRIDS = 16


def near_duplicates(table: DataFrame, vec_id="vec_id", embedding="embedding", at: float = 0.9, recall: float = 0.999, sample: int = 16_000, members: int = 2048, probes: int = 8192) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are pairs found with cosine `at` or more.

    The codebooks are fitted on about `sample` vectors, the number of cells to visit on probes against all vectors (see
    `visits_for`; it has no upper bound); every vector is in the index and probes it. A link found from one end only is
    credited to both. Equal vectors are one, with a weight. A vector stands in its own cell and asks the cells that the
    traversal gives; in a cell all asking and standing vectors are compared in double precision. A cell with over
    `members` vectors, or asked by over `probes`, is dealt to several tasks, so that each holds a bounded block; from a
    block come sums and a forest of links, never pairs.

    Only vectors of one length can link. The most common lengths have a grid each; vectors of a length with up to
    `members` of them (or beyond GRIDS lengths) are compared all with all, in blocks.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link with nothing
    (component_id is their own id). Rows that repeat id and vector are one vector; unlike vectors of one id have an
    answer each. Labels and extra columns are ignored. An empty table gives an empty table.
    """
    spark = table.sparkSession
    tune(spark)
    rows = clean(table, vec_id, embedding).withColumns({"key": F.xxhash64("v"), "key2": F.hash("v")})
    equal = Saved(rows.groupBy("key", "key2").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("weight"), F.first("v").alias("v")), "vectors").df
    fitted = equal.select(F.col("key").alias("vec_id"), "v")
    common = fitted.groupBy(F.size("v").alias("w")).count().where(F.col("count") > members).orderBy(F.desc("count"), "w").limit(GRIDS)
    grids: dict[int, tuple[Grid, int | None]] = {}
    for w, n in map(tuple, common.collect()):
        alike = fitted.where(F.size("v") == w)
        grid = fit(bounded_sample(alike, sample, 2), min(sample // 8, max(8, round((n / 64) ** 0.5))))  # about 64 vectors a cell
        if grid is not None:
            grids[w] = grid, visits_for(alike, grid, at, recall, n / members + n / probes)
    kind = equal.schema["v"].dataType.simpleString()

    def deal(batches):
        for batch in batches:
            size = np.asarray(batch.column(2).value_lengths())
            for w in np.unique(size).tolist():
                b = batch.take(pa.array(np.flatnonzero(size == w)))
                grid, visits = grids.get(w, (None, None))
                if visits is None:  # all in one cell, which is dealt in blocks
                    home, asks = np.zeros(len(b), np.int64), [[0]] * len(b)
                else:
                    unit = _unit(matrix(b.column(2)))
                    home = grid.own(unit)
                    asks = grid.nearest(unit, visits or len(grid.books[0]) * len(grid.books[1]), 2 - 2 * at + 1e-9)
                n = np.array([len(a) for a in asks])
                at_row = np.concatenate((np.arange(len(b)), np.repeat(np.arange(len(b)), n)))
                cell = np.concatenate((home, np.concatenate(asks)))
                asking = np.concatenate((np.zeros(len(b), bool), np.ones(int(n.sum()), bool)))
                # who stands tells which cells it asks; who asks, where it stands: so each knows if the other finds it
                there = pa.array([*([] if not visits else a for a in asks), *([h] for h in home[at_row[len(b) :]])], pa.list_(pa.int64()))
                wide = pa.array(np.full(len(cell), w), pa.int32())
                yield pa.RecordBatch.from_arrays([wide, pa.array(cell, pa.int64()), pa.array(asking), there, *(b.column(k).take(pa.array(at_row)) for k in range(3))], names=["w", "cell", "asks", "there", "key", "weight", "v"])

    dealt = equal.select("key", "weight", "v").mapInArrow(deal, f"w int, cell long, asks boolean, there array<long>, key long, weight long, v {kind}")
    dealt = Saved(dealt, "cells").df
    sizes = dealt.groupBy("w", "cell").agg(F.count(F.when(~F.col("asks"), 1)).alias("m"), F.count(F.when(F.col("asks"), 1)).alias("p")).where("m > 0")
    sizes = sizes.select("w", "cell", F.ceil(F.col("m") / members).cast("int").alias("mb"), F.ceil(F.col("p") / probes).cast("int").alias("pb"))
    placed = dealt.join(sizes, ["w", "cell"])
    slot = F.xxhash64("key", F.lit(8))
    # members stand in one block for each block of probes, and probes come to each block of members
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("mb")).otherwise(F.greatest("pb", F.lit(1))) - 1))
    placed = placed.withColumn("o", other).select(
        "w", "cell", F.when(F.col("asks"), F.col("o")).otherwise(F.pmod(slot, F.col("mb"))).cast("int").alias("i"), F.when(F.col("asks"), F.pmod(slot, F.greatest("pb", F.lit(1)))).otherwise(F.col("o")).cast("int").alias("j"), "asks", "there", "key", "weight", "v"
    )

    def compare(group: pa.Table) -> pa.Table:
        asks = np.asarray(group.column("asks"))
        x = matrix(group.column("v").combine_chunks())
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        one_sided = bool(grids.get(x.shape[1], (None, None))[1])  # an exact visit finds each link from both ends
        ids, weight = np.asarray(group.column("key")), np.asarray(group.column("weight"))
        right, rid, rw = x[~asks], ids[~asks], weight[~asks]
        there = group.column("there").combine_chunks()
        home, lists = np.asarray(there.filter(pa.array(asks)).flatten()), there.filter(pa.array(~asks))
        span = int(np.asarray(there.flatten()).max(initial=0)) + 1
        back = np.sort(np.repeat(np.arange(len(right)), np.asarray(lists.value_lengths())) * span + np.asarray(lists.flatten()))
        out = [np.zeros((4, 0), np.int64)]
        if len(right):
            for k in range(0, int(asks.sum()), 1024):
                left, lid, lw = (z[asks][k : k + 1024] for z in (x, ids, weight))
                link = left @ right.T >= at
                link &= lid[:, None] != rid[None]
                n = link @ rw
                hit = n > 0
                node, low = _components(link, lid, rid)
                out.append(np.stack((lid[hit], n[hit], lid[hit], lid[hit])))
                if one_sided:
                    p, q = np.nonzero(link)
                    want = q * span + home[k + p]
                    once = back[np.minimum(np.searchsorted(back, want), len(back) - 1)] != want
                    more = np.bincount(q[once], lw[p[once]], len(right)).astype(np.int64)
                    out.append(np.stack((rid, more, rid, rid))[:, more > 0])
                out.append(np.stack((node, np.zeros_like(node), node, low))[:, node != low])
        a = np.concatenate(out, 1)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("key", "n", "a", "b"), a)})

    found = Saved(placed.groupBy("w", "cell", "i", "j").applyInArrow(compare, "key long, n long, a long, b long"), "links").df
    sums = found.where("n > 0").groupBy("key").agg(F.sum("n").alias("n"))
    tree = Saved(connected_components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "key"), "tree").df
    first = tree.join(equal.select("key", "rep"), "key").groupBy("comp").agg(F.min("rep").alias("first"))
    tree = tree.join(first, "comp").select("key", "first")
    answers = equal.select("key", "key2", "rep", "weight").join(sums, "key", "left").join(tree, "key", "left")
    answers = Saved(answers.select("key", "key2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("first", "rep").alias("component_id")), "answers").df
    mine = rows.join(answers, ["key", "key2"]).select("vec_id", "n_links", "component_id")
    rest = table.where(~(F.col(vec_id).isNotNull() & usable(F.col(embedding)))).select(F.col(vec_id).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(vec_id).cast("long").alias("component_id"))
    return mine.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all `embeddings`, cosine 0.9."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Every pair of vectors, by the definition: it serves small tables only.
OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e,
         coalesce(list_sum([CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END FOR x IN embedding]) = 0 AND list_sum([abs(x) FOR x IN embedding]) > 0, false) AS ok
  FROM embeddings),
d AS (SELECT DISTINCT vec_id, e FROM v WHERE ok AND vec_id IS NOT NULL),
n AS (SELECT row_number() OVER () AS k, vec_id, e FROM d),
l AS (SELECT a.k AS a, b.k AS b FROM n a JOIN n b ON a.k <> b.k AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.9 ELSE false END),
reach(a, b) AS (SELECT k, k FROM n UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT reach.a AS k, min(n.vec_id) AS component_id FROM reach JOIN n ON reach.b = n.k GROUP BY reach.a),
s AS (SELECT n.vec_id, n.e, count(l.b) AS n_links, any_value(component_id) AS component_id FROM n JOIN c USING (k) LEFT JOIN l ON l.a = n.k GROUP BY n.k, n.vec_id, n.e)
SELECT v.vec_id, coalesce(s.n_links, 0)::BIGINT AS n_links, coalesce(s.component_id, v.vec_id)::BIGINT AS component_id,
       coalesce(v.vec_id = coalesce(s.component_id, v.vec_id), false) AS kept
FROM v LEFT JOIN s ON v.ok AND v.vec_id = s.vec_id AND v.e = s.e
"""
