"""Exact Jaccard join of documents as sets of word shingles: projected cells, then pivots and windows in each region.

Between whole documents nearly all Jaccard distances are 1: pivots alone would copy almost every document into every
region. So the outermost regions are cells of projections. Shingles are dealt to classes by their hash; a pair within
the radius differs in fewer shingles than there are classes, so its members agree on all of some class. Documents with
an equal class lie at distance 0 of that projection's pivot, and triangle-inequality windows around it are empty.
Documents joined through such cells form a candidate region; it is closed, as no link leaves it. Inside, distances do
tell, and the region is joined by pivots, Voronoi regions and windows, recursively and exactly. A large region is dealt
to blocks that share its pivots; what those leave apart meets the other blocks, so no task holds a whole large region.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Saved, connected_components, documents, free_shuffles, kept, tune, within

U = np.uint64
#: Dealings of shingles to classes that a set may need; nearly all need one.
DEALINGS = 6
#: Places of the table in which a task remembers who holds a signature, and pivots that all blocks of a region share.
HELD, PIVOTS = 1 << 17, 8
_MULT = (np.random.default_rng(20).integers(1, 2**63, 64, np.int64).astype(U) << U(1)) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words count whole, as one; none without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and ASCII white space
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(xxh64_intdigest, words), U, len(words))
    with np.errstate(over="ignore"):
        if len(words) < k:
            return mix(np.array([(h * _MULT[k : k + len(words)]).sum() + U(len(words))], U))
        n = len(words) - k + 1
        return np.unique(mix(sum((h[i : i + n] * _MULT[i] for i in range(1, k)), h[:n] * _MULT[0])))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit keys of a set, of which equal sets have equal ones."""
    with np.errstate(over="ignore"):
        one, two = mix(s).sum() + U(len(s)), mix(s ^ U(0xD6E8FEB86659FD93)).sum() ^ U(len(s))
        return tuple(mix(np.array([one, two], U)).view(np.int64).tolist())


@lru_cache(maxsize=8)
def _bounds(ratio: float) -> np.ndarray:
    return np.unique(np.ceil(ratio ** np.arange(1, 50)).astype(np.int64))


@dataclass(frozen=True)
class Rule:
    """Shingles of `k` words; two sets link when den * |A and B| >= num * |A or B|."""

    k: int = 5
    num: int = 80
    den: int = 100
    ratio: float = 2.0
    spare: float = 1.15

    def errors(self, n):
        """The most shingles in which a set of n can differ from one it links to."""
        return n * (self.den - self.num) // self.num

    def level(self, n: int) -> int:
        """Sizes fall into levels whose bounds grow by `ratio`."""
        return int(np.searchsorted(_bounds(self.ratio), n, side="right"))

    def classes(self, level: int) -> int:
        """More classes than differing shingles for a link whose larger set is of this level."""
        return ceil(self.spare * (self.errors(int(_bounds(self.ratio)[level]) - 1) + 1))

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Keys of which any two different sets that link share one at least.

        At the level of the larger set, classes are put in order of their size (ties: by number). Both sets emit more of
        the first classes than shingles can differ, so either emits a class without a difference, and so both emit the
        first such class of all: its size, and so its place before others, is the same in both. Large classes are far
        less likely to agree by chance than small ones. Empty classes are not emitted; a set with too few others emits
        those of a further dealing, too, and where all dealings fail, empty ones. Sets that can differ in one shingle
        only emit themselves and themselves less each shingle.
        """
        n, out = len(s), []
        k = self.errors(n)
        if k == 0:
            return np.zeros(0, U)  # links to equal sets only
        low, high = self.level(n), self.level(n * self.den // self.num)
        with np.errstate(over="ignore"):
            one = mix(s ^ U(0x9E3779B97F4A7C15))
            if k == 1 or self.errors(ceil(n * self.num / self.den)) <= 1:  # a set of up to this size may be the larger one
                out.append(mix(np.append(one.sum() - one, one.sum())))
            if k == 1:
                return out[0]
            for level in range(low, high + 1):  # a larger partner's level has its own classes
                m = self.classes(level)
                for dealing in range(DEALINGS):
                    c = (((mix(s + U(dealing)) if dealing else s) >> U(32)) * U(m) >> U(32)).astype(np.int64)
                    count, total = np.bincount(c, minlength=m), np.zeros(m, U)
                    np.add.at(total, c, one)
                    key = mix(total ^ mix(np.arange(m, dtype=U) + U((level << 40) + (dealing << 32))))
                    first = np.argsort(-count, kind="stable")[: k + 1]
                    enough = count[first[-1]] > 0 and len(first) > k
                    out.append(key[first[count[first] > 0]] if enough or dealing < DEALINGS - 1 else key[first])
                    if enough:
                        break
        return np.concatenate(out)


def join_region(sets: list[np.ndarray], rule: Rule, pivots: int = 8, small: int = 24, labels: np.ndarray | None = None) -> np.ndarray:
    """Component number of each set under the links among them, by recursive Voronoi regions.

    Sets of equal `labels` are known to be in one component.

    Pivots are compared with all sets of a region; each set goes to its nearest pivot's region and, if that is within
    twice the radius, to other regions (the triangle inequality: no linked pair is then without a common region).
    Where regions don't shrink, each set is compared with those that its window of distances to the pivots leaves, that
    are of a fitting size, and that are not in its component yet.
    """
    n = len(sets)
    comp = np.arange(n)
    if labels is not None and n:
        _, first, back = np.unique(labels, return_index=True, return_inverse=True)
        comp = first[back.reshape(-1)]
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, U)
    codes = np.unique(flat, return_inverse=True)[1].reshape(-1)
    ends = np.cumsum(size)
    first = ends - size
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
    radius = 1 - rule.num / rule.den

    def shared(i: int, rows: np.ndarray) -> np.ndarray:
        """How many shingles set i shares with each of rows (none empty)."""
        mark[codes[first[i] : ends[i]]] = True
        at = np.repeat(first[rows] - np.concatenate(([0], np.cumsum(size[rows])[:-1])), size[rows]) + np.arange(size[rows].sum())
        got = np.add.reduceat(mark[codes[at]], np.concatenate(([0], np.cumsum(size[rows])[:-1])), dtype=np.int64)
        mark[codes[first[i] : ends[i]]] = False
        return got

    def compare(i: int, rows: np.ndarray) -> np.ndarray:
        """Distances of set i to rows; links join components."""
        both = shared(i, rows)
        either = size[i] + size[rows] - both
        hit = rows[rule.den * both >= rule.num * either]
        old = np.unique(comp[np.append(hit, i)])
        if len(old) > 1:
            comp[np.isin(comp, old)] = old[0]
        return 1 - both / either

    def region(rows: np.ndarray, depth: int) -> None:
        rows = rows[size[rows] > 0]
        if len(rows) < 2 or (comp[rows] == comp[rows[0]]).all():
            return
        chosen = rows[np.linspace(0, len(rows) - 1, min(pivots, len(rows))).astype(int)]
        d = np.stack([compare(int(p), rows) for p in chosen], 1)
        if len(rows) > small and depth < 12:
            near = d.min(1)
            parts = [rows[d[:, k] <= near + 2 * radius + 1e-9] for k in range(len(chosen))]
            own = np.bincount(d.argmin(1), minlength=len(chosen))
            if sum(map(len, parts)) <= 1.5 * len(rows) and max(map(len, parts)) <= 0.7 * len(rows):
                for k, part in enumerate(parts):
                    if own[k]:
                        region(part, depth + 1)
                return
        order = np.argsort(size[rows], kind="stable")
        rows, d = rows[order], d[order]
        for j in range(len(rows) - 1):
            i = rows[j]
            to = np.searchsorted(size[rows], size[i] * rule.den // rule.num, side="right")
            rest = np.arange(j + 1, to)
            rest = rest[comp[rows[rest]] != comp[i]]
            if len(rest):
                rest = rest[(np.abs(d[rest] - d[j]) <= radius + 1e-9).all(1)]
            if len(rest):
                compare(int(i), rows[rest])

    region(np.arange(n), 0)
    return comp


def sketch(docs: DataFrame, rule: Rule, doc_id: str, text: str) -> DataFrame:
    """(doc_id, h, n, hi, lo, sigs, near): a row's id and hash of the text; its set's size, 128-bit key and signatures.

    A set seen before in the same task carries no signatures again, and a signature that the task remembers of another
    set is not sent again either: `near` names a holder instead. Copies and common signatures, however many, so add a
    few rows a task to a cell, not one each.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "h", "n", "hi", "lo", "sigs", "near"]

    def read(batches):
        seen: set[int] = set()
        held, by = np.arange(1, HELD + 1), np.zeros(HELD, np.int64)  # no signature has its place there yet
        for b in batches:
            n, hi, lo, sigs, near = [], [], [], [], []
            for t in b.column(2):
                s = shingles(t.as_py(), rule.k)
                high, low = set_key(s)
                n.append(len(s))
                lo.append(low)
                hi.append(high)
                if low in seen:
                    sigs.append(None)
                    near.append(None)
                    continue
                if len(seen) < 1_000_000:
                    seen.add(low)
                sig = rule.signatures(s).view(np.int64)
                at = sig & (HELD - 1)
                hit = held[at] == sig
                near.append(np.unique(by[at[hit]]))
                sig, at = sig[~hit], at[~hit]
                held[at], by[at] = sig, low
                sigs.append(sig)
            longs = [pa.array(x, pa.int64()) for x in (n, hi, lo)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *longs, pa.array(sigs, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.int64()))], names=names)

    return _texts(docs, doc_id, text).mapInArrow(read, f"doc_id {kind}, h long, n long, hi long, lo long, sigs array<long>, near array<long>")


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.col(text).cast("string")
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("h"), t.alias("text"))


def candidate_edges(sketches: DataFrame) -> DataFrame:
    """(a, b) over `lo`: each holder of a signature with the least holder, and what the tasks knew."""
    # what the join would infer is said before the exchange, or else its two sides differ and each has an exchange
    rows = sketches.where("sigs is not null and lo is not null").select("lo", F.explode("sigs").alias("sig")).where("sig is not null")
    # one exchange serves both sides: sums by cell, and the join of the cells back to their members
    dealt = rows.repartition("sig")
    cells = dealt.groupBy("sig").agg(F.min("lo").alias("a"), F.max("lo").alias("z")).where("a < z").select("sig", "a")
    edges = dealt.join(cells.hint("shuffle_hash"), "sig").where("lo <> a").select(F.col("lo").alias("a"), F.col("a").alias("b"))
    known = sketches.where("near is not null").select(F.col("lo").alias("a"), F.explode("near").alias("b"))
    return edges.union(known)


def candidate_regions(sketches: DataFrame) -> DataFrame:
    """(node, comp) over `lo`: documents that share signatures, directly or through others."""
    edges = Saved(candidate_edges(sketches), "candidates")
    free_shuffles(sketches.sparkSession)  # that of the signatures is the largest of all
    found = connected_components(edges.df)
    edges.drop()
    return found


#: A row of a region as it reaches a task, and what is known of it afterwards.
_MEMBER = ["hi", "lo", "no_id", "rep", "h"]


def _linker(rule: Rule):
    """The task of a region or of blocks of it: (members, top), top being the `lo` of the first of a component."""

    def link(group: pa.Table) -> pa.Table:
        t = group.sort_by([("hi", "ascending"), ("lo", "ascending")])
        lo = np.asarray(t.column("lo"))
        comp = join_region([shingles(x.as_py(), rule.k) for x in t.column("text")], rule, labels=np.asarray(t.column("label")))
        _, first, back = np.unique(comp, return_index=True, return_inverse=True)
        return pa.table({**{c: t.column(c) for c in _MEMBER}, "top": pa.array(lo[first[back.reshape(-1)]], pa.int64())})

    return link


def _large_regions(rows: DataFrame, members: DataFrame, rule: Rule, region_bytes: int, region_docs: int, out: str) -> DataFrame:
    """(members, top) of the regions of `members` (with comp, blocks), joined in blocks, exactly.

    First each block is joined by itself, with pivots of the region that stand in all of its blocks: groups of near
    copies then are one component already. Every pair that is left to compare has a member outside of its region's
    largest component: those meet the blocks of all others, and pairs known to be joined are passed over.
    """
    slot = lambda n, salt: F.pmod(F.xxhash64("hi", "lo", F.lit(salt)), n).cast("int")
    # at most PIVOTS a region, the least by hash of each of as many parts
    chosen = members.groupBy("comp", "blocks", slot(F.lit(PIVOTS), 1).alias("part")).agg(F.min(F.struct(F.xxhash64("hi", "lo", F.lit(2)).alias("by"), "hi", "lo")).alias("p"))
    pivots = chosen.select("comp", "blocks", "p.hi", "p.lo").withColumn("own", slot(F.col("blocks"), 3))
    everywhere = pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> own").select("hi", "lo", "comp", "block")
    at_home = members.select("hi", "lo", "comp", slot(F.col("blocks"), 3).alias("block"))
    placed = rows.join(at_home.unionByName(everywhere), ["hi", "lo", "comp"]).withColumn("label", F.col("lo"))
    one = Saved(placed.select("comp", "block", *_MEMBER, "label", "text").groupBy("comp", "block").applyInArrow(_linker(rule), out), "blocks").df
    tree = kept(connected_components(one.where("lo <> top").select(F.col("lo").alias("a"), F.col("top").alias("b"))))
    labels = tree.withColumnsRenamed({"node": "lo", "comp": "label"})
    state = kept(members.join(labels, "lo", "left").withColumn("label", F.coalesce("label", "lo")))
    main = state.groupBy("comp", "label").count().groupBy("comp").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    loose = state.join(main, "comp").where("label <> main").drop("main")
    weight = loose.groupBy("comp").agg((F.sum("n") * 8).alias("bytes"), F.count("*").alias("docs"))
    weight = kept(weight.select("comp", _blocks(region_bytes, region_docs).alias("parts")))
    if not weight.count():
        return state.select(*_MEMBER, F.col("label").alias("top"))
    state = state.join(weight, "comp").withColumn("block", slot(F.col("blocks"), 3))
    stand = state.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    visit = state.join(main, "comp").where("label <> main").drop("main").withColumn("own", F.col("block")).withColumn("part", slot(F.col("parts"), 4))
    visit = visit.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> own").drop("own")
    meet = stand.unionByName(visit).select("hi", "lo", "comp", "block", "part", "label")
    placed = rows.join(meet, ["hi", "lo", "comp"])
    two = Saved(placed.select("comp", "block", "part", *_MEMBER, "label", "text").groupBy("comp", "block", "part").applyInArrow(_linker(rule), out), "meetings").df
    edges = tree.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(two.where("lo <> top").select("lo", "top"))
    labels = connected_components(edges).withColumnsRenamed({"node": "lo", "comp": "label"})
    return members.join(labels, "lo", "left").select(*_MEMBER, F.coalesce("label", "lo").alias("top"))


def _blocks(region_bytes: int, region_docs: int):
    return F.greatest(F.ceil(2 * F.col("bytes") / region_bytes), F.ceil(2 * F.col("docs") / region_docs)).cast("int")


def joined(docs: DataFrame, rule: Rule, doc_id="doc_id", text="text", region_bytes: int = 24_000_000, region_docs: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): rows has (doc_id, h, n, hi, lo) of each row of `docs`; sets has, for each set that is not empty,
    (hi, lo, first_id, first_h): the row of the smallest id (null last) in its component."""
    spark = docs.sparkSession
    tune(spark)
    sketches = Saved(sketch(docs, rule, doc_id, text), "sketches")
    table = sketches.df
    kind = table.schema["doc_id"].dataType.simpleString()
    out = f"hi long, lo long, no_id boolean, rep {kind}, h long, top long"
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("rep"), "h")).alias("r")
    equal = table.where("n > 0").groupBy("hi", "lo").agg(first, F.max("n").alias("n")).select("hi", "lo", "r.*", "n")
    reps = kept(equal.join(candidate_regions(table).withColumnRenamed("node", "lo"), "lo"))
    texts = _texts(docs, doc_id, text).withColumnRenamed("doc_id", "rep")
    rows = within(texts, reps.drop("n"), ["rep", "h"])
    if table.groupBy("doc_id", "h").count().where("count > 1").limit(1).count():  # rows that repeat id and text
        rows = rows.dropDuplicates(["hi", "lo"])
    weight = reps.groupBy("comp").agg((F.sum("n") * 8).alias("bytes"), F.count("*").alias("docs"))
    large = kept(weight.where(((F.col("bytes") > region_bytes) & (F.col("docs") > 2)) | (F.col("docs") > region_docs)).select("comp", _blocks(region_bytes, region_docs).alias("blocks")))
    any_large = large.limit(1).count() > 0
    whole = within(rows, large, ["comp"], "left_anti") if any_large else rows
    found = whole.withColumn("label", F.col("lo")).select("comp", *_MEMBER, "label", "text").groupBy("comp").applyInArrow(_linker(rule), out)
    if any_large:
        members = kept(within(reps, large, ["comp"]))
        parts = Saved(within(rows, large, ["comp"], "left_semi").select("comp", *_MEMBER, "text"), "texts").df
        found = found.unionByName(_large_regions(parts, members, rule, region_bytes, region_docs, out))
    links = Saved(found, "links")
    least = kept(links.df.groupBy("top").agg(F.min(F.struct("no_id", "rep", "hi", "lo", "h")).alias("r")))
    tops = links.df.select("hi", "lo", "top").join(least, "top").select("hi", "lo", F.col("r.rep").alias("via"), F.col("r.h").alias("via_h"))
    own = F.col("via_h").isNull()
    sets = equal.join(tops, ["hi", "lo"], "left").select("hi", "lo", F.when(own, F.col("rep")).otherwise(F.col("via")).alias("first_id"), F.when(own, F.col("h")).otherwise(F.col("via_h")).alias("first_h"))
    sets = Saved(sets, "sets").df
    narrow = Saved(table.select("doc_id", "h", "n", "hi", "lo"), "rows").df
    for used in (reps, large, least):
        used.unpersist()
    for used in (sketches, links):
        used.drop()
    return narrow, sets


def components(docs: DataFrame, rule: Rule, doc_id="doc_id", text="text", region_bytes: int = 24_000_000, region_docs: int = 4000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: component_id is the smallest doc_id reachable by links.

    Equal sets are one (a 128-bit key); then candidate regions; then each region is joined exactly by its documents'
    own texts. A region of over `region_bytes` of shingles or `region_docs` sets is joined in blocks (`_large_regions`),
    so a task's memory and time stay bound and no pair is lost.

    Documents without a word have no shingles and link with nothing, not even each other: component_id is their own id.
    Rows that share a doc_id are each joined by their own text. Rows without an id take part; a component without any
    id has a null component_id. An empty table gives an empty table. Extra columns are ignored.
    """
    rows, sets = joined(docs, rule, doc_id, text, region_bytes, region_docs)
    same = (rows["hi"] == sets["hi"]) & (rows["lo"] == sets["lo"]) & (rows["n"] > 0)
    return rows.join(sets, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(rows["n"] > 0, F.col("first_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, rule: Rule, doc_id="doc_id", text="text", region_docs: int = 4000) -> DataFrame:
    """`docs` with one row of each group of linked texts left, that of the smallest doc_id (null last).

    What goes is told by id and hash of the text, not by id alone: rows of one id with unlike texts are judged each by
    its own. Of rows that repeat both, one stays, the least by its JSON. Rows without a word all stay. Only those keys
    are joined to the texts: broadcast while they are few (measured), shuffled else.
    """
    rows, sets = joined(docs, rule, doc_id, text, region_docs=region_docs)
    rows = rows.where("n > 0")
    gone = rows.join(sets, ["hi", "lo"]).where(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))))
    gone = kept(gone.select(F.col("doc_id").alias(doc_id), F.col("h").alias("_h")).distinct())
    twice = within(rows.groupBy(F.col("doc_id").alias(doc_id), F.col("h").alias("_h")).count().where("count > 1").drop("count"), gone, [doc_id, "_h"], "left_anti")
    twice = kept(twice)
    keyed = docs.withColumn("_h", F.xxhash64(F.col(text).cast("string")))
    if twice.limit(1).count():
        all_ = F.struct(*docs.columns)
        again = within(keyed, twice, [doc_id, "_h"], "left_semi").groupBy(doc_id, "_h").agg(F.min_by(all_, F.to_json(all_)).alias("_r"))
        once = within(keyed, gone.unionByName(twice), [doc_id, "_h"], "left_anti")
        return once.drop("_h").unionByName(again.select("_r.*"))
    return within(keyed, gone, [doc_id, "_h"], "left_anti").drop("_h")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity of 0.8 or more). The columns stay.

    Null and empty texts stay, all of them; repeated rows leave one, unlike texts of one id each their own (see
    `drop_near_copies`). An empty table gives an empty table; extra columns, whatever their names, are carried along.
    """
    return drop_near_copies(docs, Rule()).select(*docs.columns)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all `documents`: four words, 0.85."""
    return components(documents(spark, sf_dir), Rule(k=4, num=85))


#: Every pair of sets, by their shared shingles: it serves small tables only.
OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w),
g AS (SELECT DISTINCT r, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (na + nb - shared)),
reach(a, b) AS (SELECT r, r FROM s UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT any_value(me.doc_id) AS doc_id, any_value(len(me.s))::BIGINT AS n_shingles, min(s.doc_id) AS component_id
FROM reach JOIN s ON reach.b = s.r JOIN s me ON reach.a = me.r GROUP BY reach.a
"""
