"""Streams: what needs no table is masked row by row, without state; full masks and restores go by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.arbitrate import resolve
from ..operators.detect import formats
from ..operators.engine import Engine, mask_rows
from ..sources.registry import Registry

TAILS = "conv string, tail string"


def read_texts(spark: SparkSession, folder: str, schema, name: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def detect_stream(texts: DataFrame, text: str = "text") -> DataFrame:
    """The stream with `spans`; works on batches alike."""
    return texts.withColumn("spans", resolve(formats(F.col(text))))


def mask_stream(texts: DataFrame, key: bytes, text: str = "text", scope: str = "scope", reference_patterns: list[str] | None = None) -> DataFrame:
    """The stream with numbers, dates, e-mails, plates and references masked, statelessly. Names and places need the
    gazetteers: see `mask_to`. Surrogates are those of the engine; nothing is registered here."""
    return mask_rows(texts, key, text, scope, reference_patterns)


def counts_by_window(texts: DataFrame, at: str, size: str, late: str = "1 hour", text: str = "text") -> DataFrame:
    """Spans by type in tumbling windows; rows later than the watermark are dropped by Spark."""
    spans = detect_stream(texts, text).withWatermark(at, late).select(at, F.explode("spans").alias("s"))
    return spans.groupBy(F.window(at, size).start.alias("window_start"), F.col("s.type").alias("type")).agg(F.count("*").alias("n"))


def mask_to(texts: DataFrame, engine: Engine, registry: Registry, out: str, checkpoint: str, doc_id: str = "doc_id", text: str = "text", scope: str = "scope") -> StreamingQuery:
    """Mask every micro-batch in full and append what it issued. A replayed batch rewrites its own folder and adds no
    registry row, as rows are anti-joined. What a batch persists is freed with it."""

    def batch(df: DataFrame, epoch: int) -> None:
        try:
            masked, issued = engine.mask(df, doc_id, text, scope)
            registry.append(issued)
            masked.write.mode("overwrite").parquet(f"{out}/batch={epoch}")
        finally:
            engine.close()

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def release(buffers: DataFrame, engine: Engine, issued: DataFrame) -> DataFrame:
    """`buffers` (conv, scope, text, done) with `text` restored as far as it is sure, and `tail`, the masked rest.

    A surrogate may be cut by the end of a chunk. So as many characters as the longest writing of a surrogate of the
    scope has, less one, are held back, and all of a surrogate that lies across that place. Of done texts nothing is.
    """
    clear = engine.restore(issued).select("scope", "surrogate").distinct()
    # digits may be grouped by three, and blanks may stand in them
    longest = clear.groupBy("scope").agg((F.max(F.length("surrogate")) * 2).alias("longest"))
    rows = buffers.join(longest, "scope", "left").withColumn("at", F.when(F.col("done"), F.length("text")).otherwise(F.greatest(F.length("text") - F.coalesce("longest", F.lit(1)) + 1, F.lit(0))))
    hits = engine.located(rows, clear, "conv", "text", "scope").select(F.col("doc_id").alias("conv"), "h.start", "h.end")
    across = hits.join(rows.select("conv", "at"), "conv").where("start < at and end > at").groupBy("conv").agg(F.min("start").alias("first"))
    cut = rows.join(across, "conv", "left").withColumn("at", F.coalesce("first", "at"))
    parts = cut.withColumns({"tail": F.substr("text", F.col("at") + 1, F.length("text")), "text": F.substr("text", F.lit(1), F.col("at"))})
    return engine.unmask(parts.drop("longest", "first", "at"), issued, "conv", "text", "scope")


def unmask_to(chunks: DataFrame, engine: Engine, registry: Registry, out: str, state: str, checkpoint: str) -> StreamingQuery:
    """Restore a stream of chunks (conv, scope, seq, text, done) of conversations that were masked.

    In each micro-batch a conversation's held-back tail and its new chunks, by `seq`, are one text; `release` says how
    much of it goes out, the rest is the next tail. Tails are a table in `state`, a folder a batch, so that a replayed
    batch reads what the first try read. One batch holds a conversation's new chunks in one row.
    """
    spark = chunks.sparkSession

    def tails(epoch: int) -> DataFrame:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/batch={epoch}/_SUCCESS")
        there = epoch >= 0 and p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return spark.read.schema(f"{TAILS}, scope string").parquet(f"{state}/batch={epoch}") if there else spark.createDataFrame([], f"{TAILS}, scope string")

    def batch(df: DataFrame, epoch: int) -> None:
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda c: F.coalesce(c["text"], F.lit(""))), "")
        new = df.groupBy(F.col("conv").cast("string").alias("conv"), F.col("scope").cast("string").alias("scope")).agg(text.alias("text"), F.bool_or("done").alias("done"))
        both = new.join(tails(epoch - 1), ["conv", "scope"], "full")
        rows = both.select("conv", "scope", F.concat(F.coalesce("tail", F.lit("")), F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("done", F.lit(False)).alias("done"))
        try:
            sent = release(rows, engine, registry.read()).persist()
            sent.where("tail <> ''").select("conv", "tail", "scope").write.mode("overwrite").parquet(f"{state}/batch={epoch}")
            sent.where("text <> ''").select("conv", "scope", "text").write.mode("overwrite").parquet(f"{out}/batch={epoch}")
            sent.unpersist()
        finally:
            engine.close()

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
