"""Mixing sources to target weights by hash-threshold histograms. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Saved, documents, kept, tune

#: The hash has 60 bits; each refinement reads 12 of them.
BITS, STEP = 60, 12


def _hash(doc_id: str) -> Column:
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def targets(sums: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Target of each source: shares of the total by weight, never over `most` times its size.

    Sources in order of code points, null last, take the weights in turn. Sources by rising size a weight are full
    until the level of the rest stays below the next one's limit; that level is where resharing the excess ends.
    `sums` has one row a source (source, source_size).
    """
    at = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(at) - 1) % len(weights) + 1)
    s = sums.withColumn("w", weight.cast("decimal(38,0)")).withColumn("s", F.col("source_size").cast("decimal(38,0)"))
    rise = Window.orderBy(F.col("s").cast("double") / F.col("w").cast("double"), F.col("source").asc_nulls_last())
    past, here, every = (rise.rowsBetween(*x) for x in ((Window.unboundedPreceding, -1), (0, Window.unboundedFollowing), (Window.unboundedPreceding, Window.unboundedFollowing)))
    zero = F.lit(0).cast("decimal(38,0)")
    left = F.sum("s").over(every) - most * F.coalesce(F.sum("s").over(past), zero)
    s = s.withColumn("full", most * F.col("s") * F.sum("w").over(here) <= left * F.col("w"))
    rest = F.sum("s").over(every) - most * F.coalesce(F.sum(F.when(F.col("full"), F.col("s"))).over(every), zero)
    open_ = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    level = (F.col("w").cast("double") * rest.cast("double")) / open_.cast("double")
    s = s.withColumn("target", F.when(F.col("full"), (most * F.col("s")).cast("double")).otherwise(level))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    s = s.withColumn("copies", copies)
    return s.select("source", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("need"))


def cuts(sizes: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """A row a source: (of, source_size, target, copies, need, edge, on) for sizes of (source, size, h).

    `copies` times every document is taken; once more those with a hash below `edge`, and at it if `on`.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = Saved(targets(sums, weights, most), "targets").df
    bound = plan.select("source", "need", F.lit(0).cast("long").alias("prefix"))
    rows = sizes.select("source", "size", "h")
    for shift in range(BITS - STEP, -1, -STEP):
        b = bound.select(F.col("source").alias("src"), "need", "prefix")
        inside = rows.join(b, rows["source"].eqNullSafe(b["src"]) & (F.shiftright("h", shift + STEP) == F.col("prefix")))
        if shift == BITS - 2 * STEP:  # from here on only the boundary buckets are read
            rows = Saved(inside.select(rows.columns), "boundary").df
            inside = rows.join(b, rows["source"].eqNullSafe(b["src"]))
        sums = inside.groupBy("source", "need", F.shiftright("h", shift).alias("prefix")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        run = sums.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        hit = run.where((F.col("before") <= F.col("need")) & (F.col("before") + F.col("n") > F.col("need")))
        bound = hit.select("source", (F.col("need") - F.col("before")).alias("need"), "prefix", "n")
        if shift:
            bound = Saved(bound.drop("n"), "bounds").df
    edge = bound.select(F.col("source").alias("src"), F.col("prefix").alias("edge"), (F.col("n") - F.col("need") < F.col("need")).alias("on"))
    p = plan.select(F.col("source").alias("of"), "source_size", "target", "copies", "need")
    return Saved(p.join(edge, p["of"].eqNullSafe(edge["src"]), "left").drop("src"), "cuts").df  # small: a row a source


def times(h: Column) -> Column:
    """How often a document of hash `h` is taken, beside its source's row of `cuts`."""
    # without an edge the budget is the whole source (rounding only): all are taken
    below = F.when(F.col("edge").isNull(), True).otherwise((h < F.col("edge")) | ((h == F.col("edge")) & F.col("on")))
    return F.col("copies") + F.when((F.col("need") > 0) & below, 1).otherwise(0)


def sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), _hash(doc_id).alias("h"))


def mix(docs: DataFrame, doc_id="doc_id", text="text", source="source", weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): what a mix of all rows takes of each document.

    Every document of a source is taken `floor(target / size of source)` times. The rest of the budget is a hash
    threshold: sizes are summed by source and the hash's top bits, the bucket in which the running sum passes the
    budget is split by the next bits, and so on to one hash; documents below are taken once more, the one on it if
    that comes nearer. Sums are partial before each shuffle, so a source of any share never meets in one task; no
    row is sorted.

    Null text has size 0; rows of size 0 take 0. A null source is a source, the last. Rows that share a doc_id share
    a hash: they are taken together. An empty table gives an empty table. Extra columns are ignored.
    """
    tune(docs.sparkSession)
    table = kept(sized(docs, doc_id, text, source))
    cut = cuts(table, weights, most)
    out = table.join(cut, table["source"].eqNullSafe(cut["of"]))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times(F.col("h"))).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix does, three times at most: rows repeat, or go. The columns stay.

    Null and empty texts are taken by their hash as any. Rows that share an id are taken alike, each as often; a null
    source is a source. An empty table gives an empty table; extra columns, whatever their names, are carried along.
    """
    tune(spark)
    cut = cuts(kept(sized(docs, "doc_id", "text", "source")))
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # apart from the names of the cuts
    rows = docs.select(*(F.col(c).alias(n) for c, n in names.items()))
    out = rows.join(cut, rows[names["source"]].eqNullSafe(cut["of"])).withColumn("_times", times(_hash(names["doc_id"])).cast("int"))
    out = out.where("_times > 0").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return out.select(*(F.col(n).alias(c) for c, n in names.items()))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all `documents` (see `mix`)."""
    return mix(documents(spark, sf_dir)).drop("source")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 3 * source_size::HUGEINT * sum(w) OVER (rise ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <=
         (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (rise ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS full_
  FROM s WINDOW rise AS (ORDER BY source_size::DOUBLE / w::DOUBLE, source NULLS LAST)),
t AS (
  SELECT *, CASE WHEN full_ THEN (3 * source_size)::DOUBLE
    ELSE w::DOUBLE * (sum(source_size) OVER () - 3 * coalesce(sum(CASE WHEN full_ THEN source_size END) OVER (), 0))::DOUBLE
         / (sum(CASE WHEN NOT full_ THEN w END) OVER ())::DOUBLE END AS target
  FROM r),
c AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
n AS (SELECT *, target - copies * source_size AS need FROM c),
g AS (SELECT source, h, sum(size)::BIGINT AS n FROM d GROUP BY source, h),
b AS (
  SELECT source, h, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
e AS (
  SELECT b.source, b.h AS edge, b.n - (need - before) < (need - before) AS on_
  FROM b JOIN n ON b.source IS NOT DISTINCT FROM n.source WHERE before <= need AND before + b.n > need)
SELECT d.doc_id, d.size, n.source_size, n.target,
       (d.size * (n.copies + CASE WHEN CASE WHEN e.edge IS NULL THEN n.need > 0 ELSE d.h < e.edge OR (d.h = e.edge AND e.on_) END THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
