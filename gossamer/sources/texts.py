"""Text, JSON and report sources and sinks around the engine."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..operators.engine import Engine
from . import paths


def read_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """(doc_id, text): each UTF-8 file whole, its path as id. Folders that `write_files` made are read by their files."""
    return spark.read.option("recursiveFileLookup", True).text(files, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def write_files(texts: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """One text file a row, in a folder `name=<file name of its id>`. A file ends with a line end, as text files do."""
    name = F.regexp_replace(F.element_at(F.split(F.col(doc_id).cast("string"), "/"), -1), r"[^A-Za-z0-9_.\-]", "_")
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\n\z", "")
    texts.select(name.alias("name"), body.alias("value")).repartition("name").write.mode("overwrite").partitionBy("name").text(path)


def write_audit(lines: DataFrame, path: str) -> None:
    """Append audit lines as JSON."""
    lines.write.mode("append").json(path)


def _walk(node, fn, live: list):
    if isinstance(node, str):
        return node if paths.ends(live) else fn(node)
    if isinstance(node, list):
        return [_walk(x, fn, paths.step(live, i)) for i, x in enumerate(node)]
    if isinstance(node, dict):
        return {k: _walk(v, fn, paths.step(live, k)) for k, v in node.items()}
    return node


def json_leaves(docs: DataFrame, doc_id: str, payload: str, exempt: list[str] | None = None) -> DataFrame:
    """(doc_id, leaf, text): the string leaves of JSON texts of any depth and shape, in order; exempt paths (see
    `sources.paths`) are left out."""
    live = paths.parse(exempt)

    @arrow_udf("array<string>")
    def strings(texts: pa.Array) -> pa.Array:
        out = []
        for s in texts.to_pylist():
            found: list[str] = []
            if s is not None:
                _walk(json.loads(s), lambda x: found.append(x) or x, live)
            out.append(found)
        return pa.array(out, pa.list_(pa.string()))

    return docs.withColumn("_l", strings.asNondeterministic()(payload)).select(doc_id, F.posexplode("_l").alias("leaf", "text"))


def with_leaves(docs: DataFrame, leaves: DataFrame, doc_id: str, payload: str, exempt: list[str] | None = None) -> DataFrame:
    """The payloads with their leaves (doc_id, leaf, text) put back."""
    live = paths.parse(exempt)

    @arrow_udf("string")
    def put(payloads: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for s, t in zip(payloads.to_pylist(), texts.to_pylist()):
            rest = iter(t or [])
            out.append(None if s is None else json.dumps(_walk(json.loads(s), lambda _: next(rest), live), ensure_ascii=False))
        return pa.array(out, pa.string())

    by_doc = leaves.groupBy(doc_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("leaf", "text"))), lambda x: x["text"]).alias("_texts"))
    return docs.join(by_doc, doc_id, "left").withColumn(payload, put.asNondeterministic()(F.col(payload), F.col("_texts"))).select(*docs.columns)


def mask_json(engine: Engine, docs: DataFrame, doc_id: str, payload: str, scope: str, exempt: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(`docs` with masked payloads, registry rows). Keys, numbers, booleans and nulls stay; a leaf is masked as a text
    of its own. Payloads must have ids of their own; those with a fixed schema need no Python: see `engine.map_leaves`."""
    leaves = json_leaves(docs, doc_id, payload, exempt).join(docs.select(doc_id, F.col(scope).alias("scope")), doc_id)
    rows = leaves.withColumn("_leaf_id", F.concat_ws("#", F.col(doc_id).cast("string"), F.col("leaf").cast("string")))
    masked, issued = engine.mask(rows, "_leaf_id", "text", "scope")
    return with_leaves(docs, masked.select(doc_id, "leaf", "text"), doc_id, payload, exempt), issued


def unmask_json(engine: Engine, docs: DataFrame, issued: DataFrame, doc_id: str, payload: str, scope: str, exempt: list[str] | None = None) -> DataFrame:
    leaves = json_leaves(docs, doc_id, payload, exempt).join(docs.select(doc_id, F.col(scope).alias("scope")), doc_id)
    rows = leaves.withColumn("_leaf_id", F.concat_ws("#", F.col(doc_id).cast("string"), F.col("leaf").cast("string")))
    back = engine.unmask(rows, issued, "_leaf_id", "text", "scope")
    return with_leaves(docs, back.select(doc_id, "leaf", "text"), doc_id, payload, exempt)
