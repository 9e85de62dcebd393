"""Masking end to end: round trips, invariants, policy, registry, streams, command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gossamer import cli
from gossamer.errors import GazetteerVersionMismatch, RegistryError, SchemaVersionError, UnresolvedSpanError
from gossamer.operators.engine import Engine, audit, leaves, map_leaves, report
from gossamer.sources import gazetteers, registry
from gossamer.streaming import streams

KEY = b"0123456789abcdef"
TEXTS = [
    (1, "a", "M. Jean Dupont habite 14 rue de la Paix, 16000 Angoulême. SIREN 732 829 320, tel 06 12 34 56 78."),
    (2, "a", "Mme Durand, née le 12 février 1980 (IBAN FR76 3000 6000 0112 3456 7890 189), jean.dupont@mail.fr ou x@y.fr, DOS-1234, AB-123-CD, 03/04/2019"),
    (3, "b", "SIRET 73282932000033 et NIR 975032917028057, le 31 août 2020"),
    (4, "b", None),
    (5, "b", ""),
    (6, "b", "M. Jean Dupont encore, SIREN 732829320, rue de la   Paix"),
    (7, "a", "Mme DUPONT, dite Dupont, Jean.Petit@Mail.FR"),
]
CLEAR = ["Dupont", "rue de la Paix", "Angoulême", "732 829 320", "06 12 34 56 78", "Durand", "12 février 1980", "3000 6000", "jean.dupont", "x@y", "DOS-1234", "AB-123-CD", "03/04/2019", "73282932000033"]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, KEY, gazetteers.seed(spark), ["DOS-[0-9]{4}"])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, scope string, text string")


@pytest.fixture(scope="module")
def done(engine, docs):
    masked, issued = engine.mask(docs)
    return masked.cache(), issued.cache()


def test_round_trip_and_leaks(engine, docs, done):
    masked, issued = done
    rows = {r.doc_id: r for r in masked.collect()}
    assert not [c for r in rows.values() for c in CLEAR if c in (r.text or "")]
    assert all(r.text[e.start : e.end] == e.value for r in rows.values() for e in r.entities)
    back = {r.doc_id: r.text for r in engine.unmask(masked.drop("entities"), issued).collect()}
    assert back == {i: t for i, _, t in TEXTS}
    registry.assert_injective(issued)


def test_scopes_and_determinism(engine, docs, done):
    masked, issued = done
    again, _ = engine.mask(docs.repartition(7))
    assert {(r.doc_id, r.text) for r in again.collect()} == {(r.doc_id, r.text) for r in masked.collect()}
    siren = issued.where("entity_type = 'SIREN'").collect()
    assert len(siren) == 2 and siren[0].surrogate != siren[1].surrogate


def test_unissued_stay(engine, docs, done):
    _, issued = done
    other = docs.withColumn("scope", F.lit("c"))
    assert [r.text for r in engine.unmask(other, issued).orderBy("doc_id").collect()] == [t for *_, t in TEXTS]


def test_policy_audit_report(spark, engine, docs):
    found = engine.detect(docs).cache()
    weak = spark.createDataFrame([(1, "a", "Paris est vu")], "doc_id long, scope string, text string")
    with pytest.raises(UnresolvedSpanError, match="COMMUNE"):
        Engine(spark, KEY, gazetteers.seed(spark), policy="strict").mask(weak)
    with pytest.raises(ValueError):
        Engine(spark, KEY, policy="other")
    lines = [json.dumps(r.asDict(recursive=True), default=str) for r in audit(found, KEY, "text", "scope").collect()]
    assert len(lines) == 7 and not [c for line in lines for c in CLEAR if c in line]
    text = report(found, engine.version).first()["markdown"]
    assert "| SIREN | 2 |" in text and "| CODE_POSTAL | 1 |" in text and engine.version in text
    assert [r.doc_id for r in engine.observe(docs).orderBy("doc_id").collect()] == [1, 2, 3, 4, 5, 6, 7]


def test_registry(spark, done, engine, tmp_path):
    _, issued = done
    r = registry.Registry(spark, str(tmp_path / "reg"), engine.version)
    assert r.read().count() == 0
    r.append(issued)
    r.append(issued)  # a replay adds nothing
    assert r.read().count() == issued.count() and r.read("a").where("scope <> 'a'").count() == 0
    files = [p for p in (tmp_path / "reg").rglob("*.parquet")]
    assert files and not [c for p in files for c in CLEAR if c.encode() in p.read_bytes()]
    with pytest.raises(RegistryError):
        r.append(issued.withColumn("clear_hmac", F.lit("other")))
    with pytest.raises(GazetteerVersionMismatch):
        registry.Registry(spark, r.path, "another").read()
    registry.Registry(spark, str(tmp_path / "new")).append(issued.withColumn("schema_version", F.lit(99)))
    with pytest.raises(SchemaVersionError):
        registry.Registry(spark, str(tmp_path / "new")).read()
    asked = spark.createDataFrame([("a", "nothing")], "scope string, surrogate string").union(issued.select("scope", "surrogate").limit(2))
    assert registry.contains(asked, r.read()).count() == 2


def test_repeated_ids(spark, engine):
    """Rows that share an id are masked and restored each by its own text and scope; ids may be null."""
    rows = [(1, "a", "M. Dupont"), (1, "a", "M. Durand est là"), (1, "b", "M. Dupont"), (1, "a", "rien"), (1, "a", "M. Dupont"), (None, "a", "M. Leroy")]
    docs = spark.createDataFrame(rows, "doc_id long, scope string, text string")
    masked, issued = engine.mask(docs)
    assert masked.count() == 6 and masked.where("text rlike 'Dupont|Durand|Leroy'").count() == 0
    back = engine.unmask(masked.drop("entities"), issued)
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))


def test_residue_and_close(spark, docs):
    with Engine(spark, KEY, gazetteers.seed(spark)) as e:
        got = {r.entity_type: r for r in e.residue(spark.createDataFrame([(1, "s", "M. Zzyx, vu le 01/01/1850 et le 01/01/1950")], "doc_id long, scope string, text string")).collect()}
        assert (got["PATRONYME"].in_clear, got["DATE"].values, got["DATE"].in_clear, got["DATE"].fixed_points) == (1, 2, 1, 0)
        e.mask(docs)[0].count()
        assert e.calls == 1 and e._kept
    assert not e._kept


def test_trees(spark):
    df = spark.createDataFrame([(1, ("m", [("n", {"k": "v"})], None))], "id int, t struct<model: string, tools: array<struct<name: string, args: map<string, string>>>, none: string>")
    schema = df.schema["t"].dataType
    assert leaves(schema, exempt=["tools[*].name"]) == ["model", "tools[*].args[*]", "none"]
    got = df.select(map_leaves(F.col("t"), schema, F.upper, exempt=["$.tools[*].name"]).alias("t")).first()["t"]
    assert (got.model, got.tools[0].name, got.tools[0].args, got.none) == ("M", "n", {"k": "V"}, None)
    for wrong in ("a..b", "a[1:2]", "a[?(x)]", "a.*"):
        with pytest.raises(ValueError):
            leaves(schema, exempt=[wrong])
    named = df.select(map_leaves(F.col("t"), schema, F.upper, exempt=["tools[0].name", "$.tools[*].args.k"]).alias("t")).first()["t"]
    assert (named.tools[0].name, named.tools[0].args) == ("n", {"k": "v"})
    assert df.select(map_leaves(F.col("t"), schema, F.upper, exempt=["tools[1].name"]).alias("t")).first()["t"].tools[0].name == "N"


def test_gazetteer_files(spark, tmp_path):
    import gzip

    for name, body in {"prenoms": "prenom,genre,count\nJean,M,3\nJEAN,F,2\n", "noms": "patronyme,count\nDupont,x\n", "communes": "nom,departement\nAngoulême,16\n", "voies": "nom_voie\n rue de la Paix \n"}.items():
        with gzip.open(tmp_path / f"{name}.csv.gz", "wt", encoding="utf-8") as f:
            f.write(body)
    got = {(r.kind, r.name, r.genre, r.departement, r.cnt) for r in gazetteers.load(spark, str(tmp_path)).collect()}
    assert got == {("prenom", "Jean", "M", "", 3), ("nom", "Dupont", "", "", 0), ("commune", "Angoulême", "", "16", 0), ("voie", "rue de la Paix", "", "", 0)}


def test_gazetteers_written_and_checked(spark, tmp_path):
    at = str(tmp_path / "g")
    gazetteers.write(gazetteers.seed(spark), at)
    assert gazetteers.check(spark, at)
    spark.createDataFrame([("Autre", 1)], "patronyme string, count long").write.mode("append").option("header", True).option("compression", "gzip").csv(f"{at}/noms.csv.gz")
    assert not gazetteers.check(spark, at)
    (tmp_path / "e").mkdir()
    for file, *_ in gazetteers.FILES.values():
        (tmp_path / "e" / file).write_bytes(b"")
    with pytest.raises(ValueError, match="empty"):
        gazetteers.load(spark, str(tmp_path / "e"))


def test_stream(spark, docs, engine, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    docs.repartition(2).write.parquet(src)
    texts = streams.read_texts(spark, src, docs.schema)
    q = streams.mask_stream(texts, KEY).writeStream.format("memory").queryName("masked").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("masked").where("text like '%732 829 320%' or text like '%732829320%'").count() == 0 and spark.table("masked").count() == 7
    left = spark.table("masked").where("text rlike 'jean.dupont|x@y|AB-123-CD|03/04/2019|12 février 1980|Jean.Petit'").count()
    assert left == 0  # e-mails, plates and dates, too
    r = registry.Registry(spark, str(tmp_path / "reg"), engine.version)
    streams.mask_to(texts, engine, r, out, str(tmp_path / "ckpt")).awaitTermination()
    masked = spark.read.parquet(out)
    back = {x.doc_id: x.text for x in engine.unmask(masked.select("doc_id", "scope", "text"), r.read()).collect()}
    assert back == {i: t for i, _, t in TEXTS}


def test_cli(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "a.txt").write_text(TEXTS[0][2], encoding="utf-8")
    key = tmp_path / "key"
    key.write_text(KEY.hex())
    args = [str(tmp_path / "a.txt"), "--key-file", str(key), "--registry", str(tmp_path / "reg"), "--scope", "s"]
    os.chmod(key, 0o644)
    assert cli.main(["scan", *args], spark) == 1
    os.chmod(key, 0o600)
    assert cli.main(["scan", *args], spark) == 0 and "| SIREN | 1 |" in capsys.readouterr().out
    assert cli.main(["mask", *args, "--out", str(tmp_path / "m"), "--audit", str(tmp_path / "audit")], spark) == 0
    assert spark.read.json(str(tmp_path / "audit")).count() == 1
    files = list((tmp_path / "m").rglob("part-*.txt"))
    assert len(files) == 1 and "Dupont" not in files[0].read_text(encoding="utf-8")
    assert cli.main(["unmask", str(tmp_path / "m"), *args[1:], "--out", str(tmp_path / "u.parquet")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "u.parquet")).first()["text"] == TEXTS[0][2] + "\n"


def test_digests_meet_few_texts(spark):
    """Values whose words are short, as digests' are, meet the texts that hold them, not all that share a digit."""
    from gossamer.operators import match

    rows = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit("s").alias("t_scope"), F.concat(F.substring(F.md5(F.col("id").cast("string")), 1, 18), F.lit("@x.fr")).alias("v"))
    texts = rows.select("doc_id", "t_scope", F.concat(F.lit("à "), "v", F.lit(" !")).alias("text"))
    given = rows.select(F.col("t_scope").alias("scope"), F.col("v").alias("surrogate"))
    assert match.meetings(texts, given).count() < 2 * 1500
    found = match.find(texts, given, "doc_id", "text", "t_scope").select("doc_id", F.explode("hits").alias("h")).join(rows, "doc_id")
    assert found.where("h.surrogate = v and h.start = 2 and h.exact").count() == 1500


def test_glued_and_spaced_values_are_met(spark):
    """A value is met inside of longer words, between brackets, and with its digits apart."""
    from gossamer.operators import match

    given = spark.createDataFrame([("s", v) for v in ("a1b2c3d@x.fr", "k-9.z+4", "12345678", "Jean Petit")], "scope string, surrogate string")
    texts = spark.createDataFrame([(1, "s", "(a1b2c3d@x.fr)"), (2, "s", "xa1b2c3d@x.frz"), (3, "s", "k-9.z+4,"), (4, "s", "n 123 456 78"), (5, "s", "M. Petit"), (6, "t", "k-9.z+4")], "d long, s string, t string")
    got = {(r.doc_id, h.surrogate) for r in match.find(texts, given, "d", "t", "s").collect() for h in r.hits}
    assert got == {(1, "a1b2c3d@x.fr"), (2, "a1b2c3d@x.fr"), (3, "k-9.z+4"), (4, "12345678"), (5, "Jean Petit")}


def test_texts_are_made_once_to_be_restored(spark, tmp_path):
    """What made the texts runs once, however often they are read (a masked table is made by three shuffles)."""
    log = str(tmp_path / "seen")

    @F.udf("string")
    def seen(t):
        with open(log, "a") as f:
            f.write("x")
        return t

    texts = spark.createDataFrame([(i, "s", f"DOS-{i:04d} à jean.p{i}@ex.fr") for i in range(40)], "doc_id long, scope string, text string")
    with Engine(spark, KEY, None, ["DOS-[0-9]{4}"]) as e:
        masked, issued = e.mask(texts)
        # written, so that all that is counted is what `unmask` reads
        masked.drop("entities").write.parquet(str(tmp_path / "masked"))
        again = spark.read.parquet(str(tmp_path / "masked")).withColumn("text", seen.asNondeterministic()("text"))
        got = {r.doc_id: r.text for r in e.unmask(again, issued).collect()}
    assert got == {r.doc_id: r.text for r in texts.collect()}
    with open(log) as f:
        assert len(f.read()) == 40


def test_a_name_meets_a_text_once(spark):
    """Of a name with many variants one row an anchor is shuffled to a text, without the variants; each is still found."""
    from gossamer.operators import match

    given = spark.createDataFrame([("s", "Rue Victor Hugo")], "scope string, surrogate string")
    texts = spark.createDataFrame(list(enumerate(("rue victor hugo", "RUE VICTOR HUGO", "RueVictorHugo", "M. Hugo"))), "doc_id long, t_scope string").select("doc_id", F.lit("s").alias("t_scope"), F.col("t_scope").alias("text"))
    met = match.meetings(texts, given)
    assert met.columns == ["doc_id", "t_scope", "surrogate"] and met.distinct().count() == met.count() == 4
    assert match.find(texts, given, "doc_id", "text", "t_scope").count() == 4
