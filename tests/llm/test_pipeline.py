"""Each stage of the pipeline against a plain version, and the whole run against its stages."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from gossamer.llm import mixing, packing, pii

from .test_brute import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    out, docs = [spark.read.parquet(f"{SF}/documents.parquet")], None
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:5])


def test_language(steps):
    kept = {r.doc_id for r in steps[1].collect()}
    assert kept == {r.doc_id for r in steps[0].collect() if r.text and any(c.isalpha() for c in r.text)}


def test_near_copies(steps):
    rows = steps[1].orderBy("doc_id").collect()
    _, comp = brute_components([r.text for r in rows], 5, 80, 100)
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(rows[i].doc_id for i in set(comp))


def test_personal_data(spark, steps):
    clear = {r.doc_id: r.text for r in steps[2].collect()}
    tagger = pii.train(steps[2])
    ids = sorted(clear)
    base = [pii.base_spans(clear[i]) for i in ids]
    want = {i: pii.redact(clear[i], b + a) for i, b, a in zip(ids, base, pii.added_spans([clear[i] for i in ids], base, tagger))}
    got = {r.doc_id: r for r in steps[3].collect()}
    assert {i: r.text for i, r in got.items()} == want and any(base)
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_mix(steps):
    docs = steps[3].toPandas()  # noqa: F841  DuckDB reads it
    c = duckdb.connect()
    c.register("documents", docs)
    want = {i: t // s for i, s, t in c.execute(f"SELECT doc_id, size, taken FROM ({mixing.OP10_SQL})").fetchall() if s and t}
    assert Counter(r.doc_id for r in steps[4].collect()) == want


def test_pack(steps):
    import public_tokenizers as P

    want = Counter()
    for r in steps[4].collect():
        ids = np.append(packing.token_ids(r.text, P.path("byte_bpe_50k.json"), None), np.uint32(2)).astype("<u4")
        first = (len(ids) - 1) % 1024 + 1
        at = [0, *range(first, len(ids), 1024)]
        for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)])):
            want[r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = steps[5].toPandas()
    assert Counter(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)) == want
    z = got.sort_values(["sequence_id", "offset"])
    assert (z.groupby("sequence_id").length.cumsum() - z.length == z.offset).all() and got.groupby("sequence_id").length.sum().max() <= 1024


def test_run(spark, steps):
    key = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert key(corpus_pipeline.run(spark, SF)) == key(steps[5])
