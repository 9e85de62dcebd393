"""JSON texts, SQL functions, coherent postcodes, invariants and rates."""

import json

import pytest
from pyspark.sql import functions as F

from gossamer.errors import DeterminismError, EmittedOnlyError, LeakError
from gossamer.functions import sql
from gossamer.operators import invariants as I
from gossamer.operators import places
from gossamer.operators.engine import Engine
from gossamer.sources import gazetteers, texts

KEY = b"0123456789abcdef"


def test_json(spark):
    payload = {"model": "m", "n": 1, "list": ["SIREN 732829320", {"x": "SIREN 732829320", "keep": "732829320", "t": True}], "none": None, "empty": {}}
    docs = spark.createDataFrame([(1, "s", json.dumps(payload)), (2, "s", None), (3, "s", "{}"), (4, "s", '"SIREN 732829320"')], "id long, scope string, payload string")
    e = Engine(spark, KEY)
    masked, issued = texts.mask_json(e, docs, "id", "payload", "scope", exempt=["list[*].keep", "model"])
    rows = {r.id: r.payload for r in masked.collect()}
    got = json.loads(rows[1])
    assert got["list"][0] == got["list"][1]["x"] != payload["list"][0] and got["list"][1]["keep"] == "732829320"
    assert (got["n"], got["none"], got["empty"], got["list"][1]["t"]) == (1, None, {}, True) and rows[2] is None and rows[3] == "{}"
    back = {r.id: r.payload for r in texts.unmask_json(e, masked, issued, "id", "payload", "scope", exempt=["list[*].keep", "model"]).collect()}
    assert json.loads(back[1]) == payload and json.loads(back[4]) == "SIREN 732829320"


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT is_siren('732829320') a, is_siren('732829321') b, is_siret('73282932000033') c, is_card('4539578743346873') d, is_iban_fr('FR7630006000011234567890189') e, is_iban_fr('FR') f, is_tva_fr('FR44732829320') g, is_phone_fr('+33612345678') h, is_phone_fr(NULL) i, iban_key_fr('30006000011234567890189') j").first()
    assert tuple(r) == (True, False, True, True, True, False, True, True, False, "76")


def test_coherent_postcodes(spark):
    g = gazetteers.seed(spark)
    towns = [n.partition(":")[0] for n in gazetteers.SEED["commune"]]
    docs = spark.createDataFrame([(i, "s", f"Il habite à {i:05d} {towns[i % len(towns)]}.") for i in range(1, 60)] + [(99, "s", "Il habite à 16000. Rien.")], "doc_id long, scope string, text string")
    e = Engine(spark, KEY, g, coherent_postcodes=True)
    masked, issued = e.mask(docs)
    dept = {r.name: "20" if r.departement[:1] == "2" and r.departement[1:] in "AB" else r.departement for r in g.where("kind = 'commune'").collect()}
    for r in masked.where("doc_id < 99").collect():
        code, town = r.text.removeprefix("Il habite à ").removesuffix(".").split(" ", 1)
        assert code[:2] == dept[town], r.text
    back = {r.doc_id: r.text for r in e.unmask(masked.drop("entities"), issued).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
    assert issued.where("entity_type = 'CODE_POSTAL'").select("surrogate").distinct().count() == 60


def test_only_places(spark):
    docs = spark.createDataFrame([(1, "14 rue de la Paix à Paris")], "id int, text string")
    g = gazetteers.seed(spark)
    assert [s.type for s in places.detect_communes(docs, g, "id", "text").first()["spans"]] == ["COMMUNE"]
    assert [s.value for s in places.detect_streets(docs, g, "id", "text").first()["spans"]] == ["rue de la Paix"]


def test_invariants(spark):
    masked = spark.createDataFrame([(1, "see 12 and x")], "doc_id int, text string")
    clear = spark.createDataFrame([(1, "12"), (1, "99")], "doc_id int, value string")
    assert I.leaks(masked, clear).count() == 1
    with pytest.raises(LeakError):
        I.assert_no_leak(masked, clear)
    issued = spark.createDataFrame([("s", "SIREN", "h", "1", "1"), ("s", "SIREN", "h", "2", "9")], "scope string, entity_type string, clear_hmac string, surrogate string, value string")
    with pytest.raises(DeterminismError):
        I.assert_deterministic(issued)
    assert I.fixed_points(issued).collect()[0]["n"] == 1
    I.assert_emitted_only(issued, issued)
    with pytest.raises(EmittedOnlyError):
        I.assert_emitted_only(issued.withColumn("surrogate", F.lit("z")), issued)
    spans = "doc_id int, start int, end int, type string"
    r = {x.type: x for x in I.rates(spark.createDataFrame([(1, 0, 3, "A"), (1, 5, 6, "A"), (1, 9, 10, "C")], spans), spark.createDataFrame([(1, 0, 3, "A"), (1, 7, 8, "B")], spans)).collect()}
    assert (r["A"].precision, r["A"].recall) == (1.0, 0.5) and r["B"].recall is None and r["C"].precision is None


def test_pick_by_attribute(spark):
    g = gazetteers.seed(spark)
    from gossamer.operators.surrogates import pick

    asked = spark.createDataFrame([("s", f"v{i}", k) for i, k in enumerate(["75", "16", "16", "99", None])], "scope string, value string, departement string")
    got = {r.value: r.name for r in pick(asked, g, KEY, "commune").collect()}
    assert got["v0"] == "Paris" and {got["v1"], got["v2"]} <= {"Angoulême", "Cognac"} and len(got) == 5
