"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gossamer.llm import common, hamming, jaccard, langid, licenses, mixing, packing, pii, quality, urls, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, lang_pred int, n int, h string, rep int, comp int, key string, size string, target string, h_ string, lo int, hi int, spans int, n_email string, sigs int, length int, piece string, bucket int, need int, source_size string"
LONG = " ".join(f"word{i % 977} thing{i % 613}" for i in range(60_000))


def rows(spark):
    # enough rows for a model to learn from; ids 100 and 101 repeat, one id is null
    base = [(i, f"the {i} cat and the dog number {i % 7} sat on that mat of theirs", "en", "a", 1) for i in range(40)]
    base += [(50 + i, f"le chat {i} et les chiens de la rue {i % 5} mangent dans une maison", "fr", "b", 1) for i in range(40)]
    odd = [(100, None, None, None, None), (100, None, None, None, None), (101, "same text in two rows here now", "en", "a", 5), (101, "same text in two rows here now", "en", "a", 5), (101, "another text of that id", None, "b", 5)]
    odd += [(102, "", "en", None, 0), (103, " \t\n ", "en", "a", 4), (104, LONG, "en", "c", len(LONG)), (None, "a row that has no id at all", "en", "a", 3), (105, "1234 !!! ???", None, "", 9), (106, "\u00e9\ud83d\ude00 \u00df \u0130".encode("utf-16", "surrogatepass").decode("utf-16"), "en", "a", 2)]
    pad = (None,) * 21
    return spark.createDataFrame([(*r, *pad) for r in base + odd], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return rows(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, None, 1) for i in range(80)] + [(3, None, 1, 1), (4, 1, 0, 1), (None, 1, 1, 1)], "doc_id long, quality int, toxic int, y int")


def test_quality(spark, docs, empty):
    got = quality.classify(docs, labels(spark)).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and set(got.predicted) <= {0, 1}
    assert (got.predicted == (got.score >= 0.7)).all()
    same = got[got.doc_id == 100]
    assert len(same) == 2 and same.score.nunique() == 1
    assert quality.classify(empty, labels(spark)).count() == 0
    none = quality.classify(docs, labels(spark).limit(0)).toPandas()
    assert len(none) == len(got) and none.score.nunique() == 1


def test_language(spark, docs, empty):
    found = langid.learn(docs)
    got = langid.identify(docs, found).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    by = got.groupby("doc_id").lang_pred.agg(set)
    assert by[100] == by[102] == by[103] == by[105] == {"und"} and by[3] == {"en"} and by[55] == {"fr"}
    assert langid.identify(empty, found).count() == 0 and langid.learn(empty) == {}
    assert {r.lang_pred for r in langid.identify(docs, {}).select("lang_pred").collect()} == {"und"}
    kept = langid.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == docs.count() - 5


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, 1, "x"), (1, None, 1, "x"), (2, "", 1, "x"), (3, "no scheme", 1, "x"), (4, "http://A.ORG", 1, "x"), (5, "http://a.org/", 1, "x"), (6, "h://x.example.org/en/1?q#f", 1, "x"), (7, "h://example.com/de/" + "z" * 50_000, 1, "x"), (None, "h://a.com/fr/1", 1, "x"), (8, "h://b.net?x=/y", 1, "x")], "page_id long, url string, rule int, host string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert (got[1].host, got[1].path, got[1].rule) == ("", "", None) and (got[3].host, got[3].path) == ("", "")
    assert (got[4].host, got[4].path, got[4].rule) == ("a.org", "", None) and got[5].rule == "org/" and got[5].verdict == "allow"
    assert got[6].rule == "example.org/en/1" and got[6].verdict == "block" and got[7].rule == "com/de/" and got[None].verdict == "allow"
    assert (got[8].host, got[8].path) == ("b.net", "") and all(r.verdict in ("allow", "block") for r in got.values())
    assert urls.judge(pages).count() == 10 and urls.judge(pages.limit(0)).count() == 0


def test_jaccard(spark, docs, empty):
    got = jaccard.components(docs, jaccard.Rule(4, 85)).toPandas()
    assert len(got) == docs.count()
    by = got[got.doc_id.isin([100, 102, 103])]
    assert (by.n_shingles == 0).all() and (by.component_id == by.doc_id).all()
    assert set(got[got.doc_id == 101].component_id) == {101}
    assert jaccard.components(empty, jaccard.Rule()).count() == 0
    kept = jaccard.stage(spark, docs, "")
    ids = Counter(r[0] for r in kept.select("doc_id").collect())
    # both unlike texts of id 101 stay, of its equal rows one; texts without a word stay, all of them
    assert kept.columns == docs.columns and ids[101] == 2 and ids[100] == 2 and ids[None] == 1 and ids[104] == 1
    assert kept.distinct().count() == kept.count() - 1 and jaccard.stage(spark, empty, "").count() == 0


def test_pii(spark, docs, empty):
    tagger = pii.Tagger.new()
    got = pii.find(docs.withColumn("text", F.when(F.col("doc_id") == 101, "write to a@b.co or +1 (415) 555-2671").otherwise(F.col("text"))), tagger).toPandas()
    assert len(got) == docs.count() and set(got[got.doc_id == 101].n_email) == {1}
    assert set(got[got.doc_id.isin([100, 102, 103])].spans) == {""}
    assert pii.find(empty, tagger).count() == 0
    kept = pii.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == docs.count() and pii.stage(spark, empty, "").count() == 0


def test_licenses(spark, docs, empty):
    more = docs.withColumn("text", F.when(F.col("doc_id") == 101, "intro\nReleased under the MIT License.\n\nReleased under the MIT License.").otherwise(F.col("text")))
    got = licenses.scan(more).toPandas()
    assert set(got.doc_id) == {101} and sorted(got.paragraph) == [1, 3] and set(got.family) == {"mit"}  # rows equal in id and text count once
    assert licenses.scan(empty).count() == 0


def test_packing(spark, docs, empty):
    got = packing.pack(docs).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 1024
    assert (got[got.doc_id.isin([100, 102])].length == 1).all() and got[got.doc_id == 104].length.sum() > 60_000
    assert got.doc_id.isna().sum() == 1 and packing.pack(empty).count() == 0


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).toPandas()
    assert len(got) == docs.count() and (got.taken <= 3 * got["size"]).all()
    assert (got[got.doc_id.isin([100, 102, 103])].taken == 0).all()
    assert mixing.mix(empty).count() == 0 and mixing.stage(spark, docs, "").columns == docs.columns and mixing.stage(spark, empty, "").count() == 0
    # rows of size 0 are taken three times at most, too
    rows = [(i, "" if i % 3 else "two words", "en", "abc"[i % 3 > 0], 1) for i in range(60)] + [(100 + i, " ".join(["w"] * 50), "en", "c", 1) for i in range(60)]
    few = spark.createDataFrame([(*r, *(None,) * 21) for r in rows], DOCS)
    assert max(Counter(r[0] for r in mixing.stage(spark, few, "").select("doc_id").collect()).values()) <= 3


def vecs(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float((i * k) % 7 - 3) + 0.5 for k in range(1, 9)], 1, "x") for i in range(40)]
    odd = [(100, None, 1, "x"), (101, [], 1, "x"), (102, [0.0] * 8, 1, "x"), (103, [nan] * 8, 1, "x"), (104, [inf] * 8, 1, "x"), (105, [1.0] * 7 + [None], 1, "x"), (106, [1.0] * 3, 1, "x"), (None, [1.0] * 8, 1, "x"), (3, [float((3 * k) % 7 - 3) + 0.5 for k in range(1, 9)], 1, "x")]
    return spark.createDataFrame(good + odd, "vec_id long, embedding array<float>, score int, rep string")


def test_vectors(spark):
    got = vectors.near_duplicates(vecs(spark)).toPandas()
    assert len(got) == 49
    alone = got[got.vec_id.isin([100, 101, 102, 103, 104, 105, 106])]
    assert (alone.n_links == 0).all() and (alone.component_id == alone.vec_id).all() and alone.kept.all()
    assert vectors.near_duplicates(vecs(spark).limit(0)).count() == 0
    near = hamming.nearest(vecs(spark)).toPandas()
    assert set(near.query_id) == {0, 20} and near.groupby("query_id").size().max() <= 20 and not (near.query_id == near.vec_id).any()
    assert hamming.nearest(vecs(spark).limit(0)).count() == 0


def test_pipeline(spark, docs, empty, tmp_path):
    """The whole pipeline over nulls, empty and long texts, repeated rows and ids, and extra columns; and over no row."""
    import corpus_pipeline

    for name, table in (("odd", docs), ("none", empty)):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).toPandas()
        assert list(got.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        if name == "none":
            assert len(got) == 0
        else:
            assert {104, 101} <= set(got.doc_id) and not {100, 102, 103, 105} & set(got.doc_id) and got.groupby("sequence_id").length.sum().max() <= 1024


def test_urls_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "h://a.org/x", "y", 1), (2, None, "z", 2)], "page_id long, url string, _said string, _by_model int")
    assert urls.judge(pages).count() == 2


def test_signatures_are_dealt_once(spark, docs):
    """Sums by cell and the join back to their members share one exchange of all signatures."""
    edges = jaccard.candidate_edges(common.Saved(jaccard.sketch(docs, jaccard.Rule(), "doc_id", "text"), "sketches").df)
    edges.collect()
    plan = edges._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("REPARTITION_BY_COL") == 2


@pytest.mark.parametrize("how", ["inner", "left_anti", "left_semi"])
def test_wide_rows_are_not_sorted(spark, monkeypatch, how):
    """Beyond the limit of a broadcast the wide side is shuffled, but not sorted, and the rows are the same."""
    wide = spark.range(1000).select(F.when(F.col("id") % 9 > 0, F.col("id") % 300).alias("k"), F.col("id").cast("string").alias("t"))
    small = spark.range(0, 300, 2).select(F.col("id").alias("k")).union(spark.sql("select cast(null as long)"))
    want = sorted(map(str, common.within(wide, small, ["k"], how).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    got = common.within(wide, small, ["k"], how)
    assert sorted(map(str, got.collect())) == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan


def test_url_models_beyond_the_driver_prune_nothing(spark):
    """Models of more contexts than may come to the driver judge as those that come whole."""
    from gossamer.llm import urls

    texts = [f"https://{h}/{w}{i * 7919 % 997}" for i in range(150) for h, w in (("a.org", "wiki/"), ("x.com", "de/kauf-"), ("x.com", "fr/livre-"), ("b.net", "wiki/"), ("c.net", "kauf-"))]
    pages = spark.createDataFrame(list(enumerate([*texts, None, ""])), "page_id long, url string")
    ruled = urls.by_rules(pages, "url")
    few, all_ = urls.learn(ruled, "url", 10), urls.learn(ruled, "url")
    assert few.scores is not None and all_.scores is None and abs(few.cut - all_.cut) < 2 * urls.STEP
    score = {(r.h1, r.h2): r.score for r in few.scores.collect()}
    free = ruled.where("_said is null").select("url", *urls._hashes(F.col("url"))).collect()
    want = all_.score([r.url or "" for r in free])
    assert len(free) == 302 and max(abs(score[r.h1, r.h2] - w) for r, w in zip(free, want)) < 1e-9
    got = [{r.page_id: r.verdict for r in urls.judge(pages, entries=n).collect()} for n in (10, 500_000)]
    assert got[0] == got[1] and set(got[0].values()) == {"allow", "block"}
