"""Plumbing shared by the corpus operators: shared tables, hashing folds, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import spread

#: The words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def tune(spark: SparkSession) -> None:
    """Keep batches small enough for very long texts: rows of a scan, rows and bytes on the way to Python."""
    for name, most in (("spark.sql.parquet.columnarReaderBatchSize", 512), ("spark.sql.execution.arrow.maxRecordsPerBatch", 1024)):
        if int(spark.conf.get(name)) > most:
            spark.conf.set(name, str(most))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table `documents`; a small one, which may be a single row group, is dealt to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is `spark.checkpoint.dir`. Only a local session without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gossamer-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


class Saved:
    """A table written as Parquet into the shared folder; it goes at `drop()` or when the driver ends."""

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        self._jvm, self._conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.path = f"{shared_dir(spark)}/gossamer/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path)
        where = self._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self._conf).deleteOnExit(where)
        self.df = spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        where = self._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self._conf).delete(where, True)


def kept(df: DataFrame) -> DataFrame:
    """A table that is read several times, on the executors' disks. Its lineage stays: what is lost with an executor is
    worked out again. For what is cheap to repeat and comes from saved tables; what is not, or would make plans grow
    from one to the next, is `Saved`."""
    return df.persist(StorageLevel.DISK_ONLY)


def free_shuffles(spark: SparkSession) -> None:
    """Delete the shuffle files of tables that nothing refers to any more; else they stay until the driver happens to
    collect its garbage, which on large tables is after the disk is full."""
    gc.collect()
    spark._jvm.System.gc()


def held_out(doc_id="doc_id"):
    """True for rows that no model may learn labels from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Most bytes of a table to broadcast, by an estimate from its counted rows and the lengths of its strings.
BROADCAST_BYTES = 64 << 20


def within(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join to a narrow table on columns of equal names, nulls being equal: broadcast while its measured bytes are few,
    shuffled beyond, without a sort, so that the wide side is on disk once. `small` is read for that, so it should be a
    saved table; it has few rows a key. The keys are those of `df`."""
    long_ = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in small.dtypes if kind == "string"]
    size = small.agg(F.count("*").alias("n"), F.sum(sum(long_, F.lit(0))).alias("b")).first()
    few = size["n"] * (48 + 8 * len(small.columns)) + (size["b"] or 0) <= BROADCAST_BYTES
    other = small.withColumnsRenamed({c: f"_on_{c}" for c in on})
    joined = df.join(F.broadcast(other) if few else other.hint("shuffle_hash"), [df[c].eqNullSafe(other[f"_on_{c}"]) for c in on], how)
    return joined.drop(*(f"_on_{c}" for c in on))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of `edges` (a, b: long) can reach.

    Alternating large-star and small-star rounds; their number grows with the logarithm of the graph. Each round ends in
    a shared table, so a lost executor repeats one round at most. Hot nodes only meet in partial sums and joins that
    adaptive execution can split. Nodes without edges to others have no row.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, mark = Saved(e, "edges"), None
    while True:
        both = now.df.union(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are tables of their own: a join to an aggregate could not be split where a node is hot
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = Saved(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = kept(large.df.groupBy("u").agg(F.min("v").alias("m")))
        small = large.df.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = Saved(small.union(low).distinct(), "edges")
        least.unpersist(), low.unpersist()
        now.drop(), large.drop()
        now = new
        got = tuple(now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if got == mark or not got[0]:
            break
        mark = got
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.df.select("v", "v").distinct())
