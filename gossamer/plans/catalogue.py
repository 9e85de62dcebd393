"""The queries of the repository by name, with their SQL.

Identifiers are derived from integer keys by expressions that both engines read alike; what is checked on them is
written separately for Spark and for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digits as D
from ..functions import runs as R
from ..functions import text as X
from ..functions.crypto import hmac_sha256, joined
from ..functions.permute import permutation_table
from ..operators import detect as T
from ..operators import engine as E
from ..operators import match as M
from ..operators import names as N
from ..operators import places as P
from ..operators import surrogates as S
from ..operators.arbitrate import captured_surnames, resolve, rewrite
from ..schemas import SPAN_DDL
from ..sources import gazetteers as G
from ..sources import registry as Reg
from ..sources import texts as Txt
from ..sources.scratch import folder, spread
from ..streaming import streams
from .sqlparts import KEY, hmac, luhn, luhn_digit, names

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def exploded(df: DataFrame, id_: str, spans) -> DataFrame:
    s = F.col("s")
    return df.select(id_, F.explode(spans).alias("s")).select(id_, s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["value"].alias("value"), s["rule_id"].alias("rule_id"), s["confidence"].alias("confidence"))


# Derived inputs, in SQL that both engines read.
SIREN = "(lpad(CAST(o_orderkey % 100000000 AS STRING), 8, '0') || CAST(o_orderkey % 10 AS STRING))"
SIRET = "(lpad(CAST(o_orderkey * 7919 % 100000000 AS STRING), 8, '0') || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0'))"
CARD = "('4' || lpad(CAST(o_orderkey * 104729 % 1000000000000 AS STRING), 12, '0') || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'))"
BBAN = "lpad(CAST(c_custkey * 1000003 + 12345 AS STRING), 23, '0')"
NIR13 = "(CAST(c_custkey % 9 + 1 AS STRING) || lpad(CAST(c_custkey * 15485863 % 1000000000000 AS STRING), 12, '0'))"


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """E-mails and valid card numbers in `documents`, by language and source."""
    docs = table(spark, sf, "documents")
    found = F.concat(T.emails(F.col("text")), T.detect_kind(F.col("text"), "CARTE_BANCAIRE"))
    return docs.select("lang", "source", F.explode(found).alias("s")).groupBy("lang", "source", F.col("s.type").alias("type")).agg(F.count("*").alias("n"))


_CARDS = f"[d for d in string_split_regex(text, '[^0-9]+') if length(d) BETWEEN 13 AND 19 AND {luhn('d')} = 0]"
#: Words of what local parts, domains and signs consist of; in each, what stands before, at and after a sign.
_MAILS = r"flatten([regexp_extract_all(w, '[A-Za-z0-9._+\-À-ÿ''’]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+') FOR w IN string_split_regex(text, '[^A-Za-z0-9._+\-À-ÿ''’@]+') IF contains(w, '@')])"


@query(f"""
WITH f AS (SELECT lang, source, unnest(list_concat([{{'t': 'EMAIL', 'v': m}} for m in {_MAILS}], [{{'t': 'CARTE_BANCAIRE', 'v': c}} for c in {_CARDS}])) AS s FROM documents)
SELECT lang, source, s.t AS type, count(*) AS n FROM f GROUP BY ALL""")
def detect_counts(spark, sf):
    return flagship(spark, sf)


@query(f"SELECT o_orderkey, {luhn(SIRET)} AS luhn, {luhn(SIRET)} = 0 AS ok, {luhn_digit(SIRET)} AS digit FROM orders")
def luhn_checksum(spark, sf):
    x = F.expr(SIRET)
    return table(spark, sf, "orders").select("o_orderkey", D.luhn_sum(x).alias("luhn"), D.is_luhn(x).alias("ok"), D.luhn_digit(x).alias("digit"))


def _detected(kind: str, rule: str, value: str):
    text = f"('réf ' || {value} || ' du ' || CAST(o_custkey AS STRING))"

    def run(spark, sf):
        df = table(spark, sf, "orders").select("o_orderkey", F.expr(text).alias("text"))
        return exploded(df, "o_orderkey", T.detect_kind(F.col("text"), kind))

    run.__name__ = f"{kind.lower()}_detect"
    return query(f"""SELECT o_orderkey, 4::INT AS start, (4 + length({value}))::INT AS "end", '{kind}' AS type, {value} AS value, '{rule}' AS rule_id, 1.0::DOUBLE AS confidence
      FROM orders WHERE {luhn(value)} = 0""")(run)


_detected("SIREN", "siren-luhn", SIREN)
_detected("SIRET", "siret-luhn", SIRET)
_detected("CARTE_BANCAIRE", "cb-luhn", CARD)


@query(f"""WITH c AS (SELECT c_custkey, {BBAN} AS b, lpad(((c_custkey * 31) % 97 + 2)::VARCHAR, 2, '0') AS k FROM customer)
SELECT c_custkey, lpad((98 - (b || '152700')::HUGEINT % 97)::VARCHAR, 2, '0') AS key, (b || '1527' || k)::HUGEINT % 97 = 1 AS ok FROM c""")
def iban_validate(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.expr(BBAN).alias("b"), F.lpad(((F.col("c_custkey") * 31) % 97 + 2).cast("string"), 2, "0").alias("k"))
    return c.select("c_custkey", D.iban_key(F.col("b")).alias("key"), D.is_iban(F.concat(F.lit("FR"), "k", "b")).alias("ok"))


@query(f"""SELECT c_custkey, lpad((97 - {NIR13}::BIGINT % 97)::VARCHAR, 2, '0') AS key, true AS ok,
 lpad((97 - ('2750219' || substr({NIR13}, 8, 6))::BIGINT % 97)::VARCHAR, 2, '0') AS corsica FROM customer""")
def nir_key(spark, sf):
    n = F.expr(NIR13)
    return table(spark, sf, "customer").select("c_custkey", D.nir_key(n).alias("key"), D.is_nir(F.concat(n, D.nir_key(n))).alias("ok"), D.nir_key(F.concat(F.lit("27502"), F.lit("2A"), F.substring(n, 8, 6))).alias("corsica"))


@query(f"SELECT o_orderkey, lpad(((12 + 3 * ({SIREN}::BIGINT % 97)) % 97)::VARCHAR, 2, '0') AS key, (o_orderkey * 13) % 97 = (12 + 3 * ({SIREN}::BIGINT % 97)) % 97 AS ok FROM orders")
def tva_key(spark, sf):
    s, k = F.expr(SIREN), F.lpad(((F.col("o_orderkey") * 13) % 97).cast("string"), 2, "0")
    return table(spark, sf, "orders").select("o_orderkey", D.tva_key(s).alias("key"), D.is_tva(F.concat(F.lit("FR"), k, s)).alias("ok"))


_PHONE = "(CASE c_custkey % 3 WHEN 0 THEN '0' ELSE CASE c_custkey % 3 WHEN 1 THEN '+33' ELSE '9' END END || CAST(c_custkey % 10 AS STRING) || lpad(CAST(c_custkey * 7919 % 100000000 AS STRING), 8, '0'))"


@query(f"""SELECT c_custkey, 4::INT AS start, (4 + length({_PHONE}))::INT AS "end", {_PHONE} AS value FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 10 > 0""")
def phone_detect(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.expr(f"'tel ' || {_PHONE} || ' soir'").alias("text"))
    return exploded(df, "c_custkey", T.detect_kind(F.col("text"), "TELEPHONE")).select("c_custkey", "start", "end", "value")


_PLATE = "(substr('ABSIHSSOQR', CAST(c_custkey % 9 + 1 AS INT), 2) || '-' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '-' || substr('CDEFGHIJ', CAST(c_custkey % 7 + 1 AS INT), 2))"


@query(f"""SELECT c_custkey, {_PLATE} AS value FROM customer WHERE regexp_full_match({_PLATE}, '[A-HJ-NP-TV-Z]{{2}}-[0-9]{{3}}-[A-HJ-NP-TV-Z]{{2}}') AND {_PLATE} NOT LIKE 'SS%'""")
def plate_detect(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.expr(f"'auto ' || {_PLATE} || '.'").alias("text"))
    return exploded(df, "c_custkey", T.plates(F.col("text"))).select("c_custkey", "value")


_DAY = "lpad(CAST(o_orderkey % 33 AS STRING), 2, '0') || '/' || lpad(CAST(o_orderkey % 14 AS STRING), 2, '0') || '/' || CAST(1950 + o_custkey % 100 AS STRING)"


@query(f"""SELECT o_orderkey, {_DAY} AS value, strftime(try_strptime({_DAY}, '%d/%m/%Y'), '%Y-%m-%d') AS day FROM orders WHERE try_strptime({_DAY}, '%d/%m/%Y') IS NOT NULL""")
def date_calendar(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.expr(f"'le ' || {_DAY} || ', à'").alias("text"))
    return exploded(df, "o_orderkey", T.dates(F.col("text"))).select("o_orderkey", "value", T.to_date_slash(F.col("value")).cast("string").alias("day"))


_MONTHS = "[" + ", ".join(f"'{m}'" for m in T.MONTHS) + "]"


@query(f"""WITH o AS (SELECT o_orderkey, (o_orderkey % 32)::VARCHAR || ' ' || {_MONTHS}[(o_orderkey % 12 + 1)::INT] || ' ' || (1950 + o_custkey % 100)::VARCHAR AS value,
  try_strptime((1950 + o_custkey % 100)::VARCHAR || '-' || (o_orderkey % 12 + 1)::VARCHAR || '-' || (o_orderkey % 32)::VARCHAR, '%Y-%m-%d')::DATE AS day FROM orders)
SELECT o_orderkey, value, strftime(day, '%Y-%m-%d') AS day, 3::INT AS start FROM o WHERE day IS NOT NULL""")
def date_text_fr(spark, sf):
    month = F.element_at(F.array(*map(F.lit, T.MONTHS)), (F.col("o_orderkey") % 12 + 1).cast("int"))
    text = F.concat(F.lit("le "), (F.col("o_orderkey") % 32).cast("string"), F.lit(" "), month, F.lit(" "), (F.col("o_custkey") % 100 + 1950).cast("string"), F.lit(" soir"))
    df = table(spark, sf, "orders").select("o_orderkey", text.alias("text"))
    return exploded(df, "o_orderkey", T.text_dates(F.col("text"))).select("o_orderkey", "value", T.to_date_text(F.col("value")).cast("string").alias("day"), "start")


@query(r"""WITH m AS (SELECT doc_id, unnest(flatten([regexp_extract_all(w, '[A-Za-z0-9._+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+') FOR w IN string_split_regex(text, '[^A-Za-z0-9._+@\-]+') IF contains(w, '@')])) AS value FROM documents) SELECT doc_id, value, count(*) AS n FROM m GROUP BY ALL""")
def email_detect(spark, sf):
    return exploded(table(spark, sf, "documents"), "doc_id", T.emails(F.col("text"), broad=False)).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, 8::INT AS start, 'reference-0' AS rule_id, 'DOS-' || lpad(c_custkey::VARCHAR, 6, '0') AS value FROM customer
UNION ALL SELECT c_custkey, 20::INT, 'reference-1', 'X' || (c_custkey % 10)::VARCHAR FROM customer""")
def reference_detect(spark, sf):
    text = F.expr("'dossier DOS-' || lpad(CAST(c_custkey AS STRING), 6, '0') || ', X' || CAST(c_custkey % 10 AS STRING) || ' clos'")
    df = table(spark, sf, "customer").select("c_custkey", text.alias("text"))
    return exploded(df, "c_custkey", T.references(F.col("text"), ["DOS-[0-9]{6}", "X[0-9]"])).select("c_custkey", "start", "rule_id", "value")


@query("WITH p AS (SELECT doc_id, unnest([d for d in string_split_regex(text, '[^0-9]+') if length(d) = 5]) AS value FROM documents) SELECT doc_id, value, count(*) AS n FROM p GROUP BY ALL")
def postcode_raw(spark, sf):
    return exploded(table(spark, sf, "documents"), "doc_id", T.postcodes_raw(F.col("text"))).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


_RUN = "(substr({0}, 1, 3) || ' ' || substr({0}, 4, 3) || '.' || substr({0}, 7, 3))".format(SIREN)


@query(f"""SELECT o_orderkey, 2::INT AS start, 13::INT AS "end", {SIREN} AS projection, 12::INT AS last_offset, {luhn(SIREN)} = 0 AS is_siren FROM orders""".replace("12::INT AS last", "10::INT AS last"))
def digit_runs(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.expr(f"'n ' || {_RUN} || ' x'").alias("text"))
    rows = df.select("o_orderkey", F.explode(R.digit_runs(F.col("text"))).alias("r"))
    return rows.select("o_orderkey", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.col("r.projection").alias("projection"), F.element_at("r.offsets", -1).alias("last_offset"), T.is_kind(F.col("r.projection"), "SIREN").alias("is_siren"))


@query(f"""SELECT o_orderkey, 2::INT AS start, 13::INT AS "end", 'SIREN' AS type, {SIREN} AS value FROM orders WHERE {luhn(SIREN)} = 0""")
def run_projection(spark, sf):
    """Spaced numbers: compact values at the places of the text as written."""
    df = table(spark, sf, "orders").select("o_orderkey", F.expr(f"'n ' || {_RUN} || ' x'").alias("text"))
    return exploded(df, "o_orderkey", resolve(T.structured(F.col("text")))).select("o_orderkey", "start", "end", "type", "value")


@query(f"SELECT o_orderkey, {_RUN} AS filled, 9::INT AS digits FROM orders")
def template_roundtrip(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.expr(_RUN).alias("raw"), F.expr(SIREN).alias("v"))
    t = R.template(F.col("raw"))
    return df.select("o_orderkey", R.fill(t, F.col("v")).alias("filled"), F.length(F.regexp_replace(t, "[^\0]", "")).alias("digits"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-ZÀ-Ý][A-Za-zÀ-ÿ''’\-]*'))::INT AS n FROM documents")
def name_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(f"({N.NAME_TOKEN})"))).alias("n"))


_TRIG = "(repeat('a', CAST(c_custkey % 60 AS INT)) || ' M. ' || repeat('b ', CAST(c_custkey % 31 AS INT)) || 'Zor')"


@query("""WITH c AS (SELECT c_custkey, (c_custkey % 60)::INT AS a, (c_custkey % 31)::INT AS b FROM customer)
SELECT c_custkey, (a + 1)::INT AS start, 1::INT AS n, (a + 4 + 2 * b) - (a + 3) < 40 AS near FROM c""")
def trigger_proximity(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.expr(_TRIG).alias("text"))
    t, found = F.get(N.name_tokens(F.col("text")), F.lit(0)), N.triggers(F.col("text"))
    return df.select("c_custkey", F.get(found, F.lit(0))["start"].alias("start"), F.size(found).alias("n"), t["near"].alias("near"))


_FIRST, _LAST = names("prenom"), names("nom")


def _people(spark, sf):
    first = F.element_at(F.array(*(F.lit(n.partition(":")[0]) for n in G.SEED["prenom"])), (F.col("c_custkey") % len(G.SEED["prenom"]) + 1).cast("int"))
    last = F.element_at(F.array(*map(F.lit, G.SEED["nom"])), (F.col("c_custkey") % len(G.SEED["nom"]) + 1).cast("int"))
    title = F.when(F.col("c_custkey") % 2 == 0, "Mme ").otherwise("vu ")
    return table(spark, sf, "customer").select("c_custkey", F.concat(title, first, F.lit(" "), F.upper(last), F.lit(" Xyzzy")).alias("text"))


@query(f"""WITH c AS (SELECT c_custkey, {_FIRST}[(c_custkey % {len(G.SEED['prenom'])} + 1)::INT] AS f, {_LAST}[(c_custkey % {len(G.SEED['nom'])} + 1)::INT] AS l, CASE WHEN c_custkey % 2 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS conf FROM customer),
r AS (SELECT c_custkey, 'PRENOM' AS type, f AS value, 'gazetteer-prenom' AS rule_id, conf AS confidence FROM c
UNION ALL SELECT c_custkey, 'PATRONYME', f, 'gazetteer-nom', conf FROM c WHERE list_contains({_LAST}, f)
UNION ALL SELECT c_custkey, 'PATRONYME', upper(l), 'gazetteer-nom', conf FROM c
UNION ALL SELECT c_custkey, 'PRENOM', upper(l), 'gazetteer-prenom', conf FROM c WHERE list_contains({_FIRST}, l)
UNION ALL SELECT c_custkey, 'PATRONYME', 'Xyzzy', 'context-capture', 0.8 FROM c WHERE conf > 0.5)
SELECT * FROM r""")
def name_gazetteer_join(spark, sf):
    rows = N.detect_names(_people(spark, sf), G.seed(spark), "c_custkey", "text")
    return exploded(rows.withColumnRenamed("doc_id", "c_custkey"), "c_custkey", F.col("spans")).select("c_custkey", "type", "value", "rule_id", "confidence")


_STREETS, _TOWNS = names("voie"), names("commune")


@query(f"""WITH c AS (SELECT c_custkey, {_STREETS}[(c_custkey % {len(G.SEED['voie'])} + 1)::INT] AS v, {_TOWNS}[(c_custkey % {len(G.SEED['commune'])} + 1)::INT] AS t, lpad((c_custkey % 100000)::VARCHAR, 5, '0') AS p FROM customer)
SELECT c_custkey, 5::INT AS start, 'VOIE' AS type, v AS value, 'gazetteer-voie' AS rule_id FROM c
UNION ALL SELECT c_custkey, (7 + length(v))::INT, 'CODE_POSTAL', p, 'cp-commune' FROM c
UNION ALL SELECT c_custkey, (13 + length(v))::INT, 'COMMUNE', t, 'gazetteer-commune' FROM c""")
def place_longest_phrase(spark, sf):
    pick = lambda kind: F.element_at(F.array(*(F.lit(n.partition(":")[0]) for n in G.SEED[kind])), (F.col("c_custkey") % len(G.SEED[kind]) + 1).cast("int"))
    text = F.concat(F.lit("12, a"), pick("voie"), F.lit(", "), F.lpad((F.col("c_custkey") % 100_000).cast("string"), 5, "0"), F.lit(" "), pick("commune"), F.lit(" fin"))
    df = table(spark, sf, "customer").select("c_custkey", F.regexp_replace(text, "^12, a", "12 a ").alias("text"))
    rows = P.detect_places(df, G.seed(spark), "c_custkey", "text")
    return exploded(rows.withColumnRenamed("doc_id", "c_custkey"), "c_custkey", F.col("spans")).select("c_custkey", "start", "type", "value", "rule_id")


@query("""WITH c AS (SELECT c_custkey, (c_custkey % 13)::INT AS a, (c_custkey % 11)::INT AS b FROM customer)
SELECT c_custkey, (CASE WHEN a <= b THEN 0 ELSE 1 END)::INT AS nearest, (CASE WHEN a <= b THEN a ELSE b END)::INT AS gap, least(a, b) <= 8 AS coupled FROM c""")
def nearest_commune(spark, sf):
    """The as-of join of a postcode with the communes around it."""
    span = lambda a, b, i: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(i).alias("i"))
    a, b = F.col("c_custkey") % 13, F.col("c_custkey") % 11
    code = span(F.lit(100), F.lit(105), -1)
    towns = F.array(span(F.lit(90) - a, F.lit(100) - a, 0), span(F.lit(105) + b, F.lit(110) + b, 1))
    best = P.nearest(code, towns)
    return table(spark, sf, "customer").select("c_custkey", best["i"].alias("nearest"), P.gap(code, best).alias("gap"), F.exists(towns, lambda c: P.gap(code, c).between(0, 8)).alias("coupled"))


def _spans(spark, sf):
    """Three overlapping spans an event, of varied confidence, length and type."""
    one = lambda k, kind: F.struct((F.col("event_id") * k % 11).cast("int").alias("start"), (F.col("event_id") * k % 11 + F.col("user_id") * k % 5 + 1).cast("int").alias("end"), F.lit(kind).alias("type"), F.lit("v").alias("value"), F.lit(f"r{k}").alias("rule_id"), F.when(F.col("event_id") % (k + 2) == 0, 1.0).otherwise(0.9).alias("confidence"))
    return table(spark, sf, "events").select("event_id", F.array(one(1, "SIREN"), one(2, "SIRET"), one(3, "EMAIL")).cast(f"array<{SPAN_DDL}>").alias("spans"))


def _three() -> str:
    s = lambda k, p, i: f"{{'c': CASE WHEN event_id % {k + 2} = 0 THEN 1.0 ELSE 0.9 END, 'l': (user_id * {k} % 5 + 1)::INT, 'p': {p}, 'i': {i}, 's': (event_id * {k} % 11)::INT, 'e': (event_id * {k} % 11 + user_id * {k} % 5 + 1)::INT, 'r': 'r{k}'}}"
    ov = lambda a, b: f"(x[{a}].s < x[{b}].e AND x[{b}].s < x[{a}].e)"
    return f"""WITH a AS (SELECT event_id, unnest([{s(1, 3, 0)}, {s(2, 6, 1)}, {s(3, 1, 2)}]) AS u FROM events),
b AS (SELECT event_id, list(u ORDER BY u.c DESC, u.l DESC, u.p DESC, u.i) AS x FROM a GROUP BY event_id),
k AS (SELECT event_id, x, NOT {ov(1, 2)} AS k2, NOT {ov(1, 3)} AND NOT (NOT {ov(1, 2)} AND {ov(2, 3)}) AS k3 FROM b),
f AS (SELECT event_id, unnest(list_concat([x[1]], CASE WHEN k2 THEN [x[2]] ELSE [] END, CASE WHEN k3 THEN [x[3]] ELSE [] END)) AS z FROM k)
SELECT event_id, z.s AS start, z.e AS "end", z.r AS rule_id FROM f"""


@query(_three())
def overlap_resolve(spark, sf):
    return exploded(_spans(spark, sf), "event_id", resolve(F.col("spans"))).select("event_id", "start", "end", "rule_id")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 AND user_id % 5 + 1 <= 3 THEN 1 ELSE 2 END::INT AS n FROM events")
def captured_surname_rule(spark, sf):
    s = lambda a, b, kind, rule: F.struct(F.lit(a).alias("start"), b.cast("int").alias("end"), F.lit(kind).alias("type"), F.lit("v").alias("value"), rule.alias("rule_id"), F.lit(0.9).alias("confidence"))
    spans = F.array(s(0, F.lit(3), "PATRONYME", F.when(F.col("event_id") % 2 == 0, "gazetteer-nom").otherwise("context-capture")), s(0, F.col("user_id") % 5 + 1, "COMMUNE", F.lit("gazetteer-commune")))
    return table(spark, sf, "events").select("event_id", F.size(captured_surnames(spans.cast(f"array<{SPAN_DDL}>"))).alias("n"))


@query("""SELECT event_id, 'a' || repeat('x', (event_id % 4)::INT) || 'c' || repeat('y', (user_id % 3)::INT) || 'e' AS text,
 '1,' || (2 + event_id % 4)::VARCHAR AS starts FROM events""")
def rewrite_offsets(spark, sf):
    """Surrogates of other lengths: entities point into the new text."""
    put = lambda a, b, s: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("DATE").alias("type"), s.alias("surrogate"))
    r = rewrite(F.lit("aBcDe"), F.array(put(1, 2, F.expr("repeat('x', CAST(event_id % 4 AS INT))")), put(3, 4, F.expr("repeat('y', CAST(user_id % 3 AS INT))"))))
    return table(spark, sf, "events").select("event_id", r["text"].alias("text"), F.array_join(F.transform(r["entities"], lambda e: e["start"].cast("string")), ",").alias("starts"))


# --- keyed ----------------------------------------------------------------------------------------------------------------


@query(f"SELECT c_custkey, {hmac('encode(c_name)')} AS digest FROM customer")
def hmac_digest(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", hmac_sha256(KEY, F.col("c_name").cast("binary")).alias("digest"))


_NUMBERS = {
    "siren": ("SIREN", f"({{0}} || {luhn_digit('{0}')})", "lpad(CAST(c_custkey * 7919 % 100000000 AS STRING), 8, '0')", "siren-luhn"),
    "siret": ("SIRET", f"({{0}} || {luhn_digit('{0}')})", "lpad(CAST(c_custkey * 104729 AS STRING), 13, '0')", ""),
    "card": ("CARTE_BANCAIRE", f"({{0}} || {luhn_digit('{0}')})", "('4' || lpad(CAST(c_custkey * 104729 AS STRING), 14, '0'))", ""),
    "nir": ("NIR", "({0} || lpad((97 - {0}::BIGINT % 97)::VARCHAR, 2, '0'))", "(CAST(c_custkey % 9 + 1 AS STRING) || lpad(CAST(c_custkey * 15485863 % 1000000000000 AS STRING), 12, '0'))", ""),
    "iban": ("IBAN", "('FR' || lpad((98 - ({0} || '152700')::HUGEINT % 97)::VARCHAR, 2, '0') || {0})", BBAN, ""),
    "tva": ("TVA", "('FR' || lpad(((12 + 3 * ({0}::BIGINT % 97)) % 97)::VARCHAR, 2, '0') || {0})", "lpad(CAST(c_custkey * 7919 AS STRING), 9, '0')", ""),
    "phone": ("TELEPHONE", "{0}", "('+33' || CAST(c_custkey % 9 + 1 AS STRING) || lpad(CAST(c_custkey * 7919 % 100000000 AS STRING), 8, '0'))", ""),
}
_CLEAR = {
    "SIREN": lambda b: F.concat(b, D.luhn_digit(b)), "SIRET": lambda b: F.concat(b, D.luhn_digit(b)), "CARTE_BANCAIRE": lambda b: F.concat(b, D.luhn_digit(b)), "NIR": lambda b: F.concat(b, D.nir_key(b)),
    "IBAN": lambda b: F.concat(F.lit("FR"), D.iban_key(b), b), "TVA": lambda b: F.concat(F.lit("FR"), D.tva_key(b), b), "TELEPHONE": lambda b: b,
}


def _fpe(name: str) -> None:
    kind, clear, body, _ = _NUMBERS[name]

    def run(spark, sf):
        from ..functions.crypto import scope_tweak

        k, tweak = F.lit(kind), scope_tweak(KEY, F.col("c_mktsegment"))
        rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", _CLEAR[kind](F.expr(body)).alias("value"))
        rows = rows.withColumn("sur", S.number_surrogate(k, F.col("value"), KEY, tweak))
        back = S.number_surrogate(k, F.col("sur"), KEY, tweak, decrypt=True)
        # another valid number of one length; a fixed point is as likely as any other value, one in a hundred million at most
        return rows.select("c_custkey", "value", back.alias("back"), (T.is_kind(F.col("sur"), kind) & (F.length("sur") == F.length("value")) & (F.col("sur") != F.col("value"))).alias("valid"))

    run.__name__ = f"fpe_{name}_roundtrip"
    v = clear.replace("{0}", body)
    query(f"SELECT c_custkey, {v} AS value, {v} AS back, true AS valid FROM customer")(run)


for _name in _NUMBERS:
    _fpe(_name)


@query("SELECT 1000::BIGINT AS n, 1000::BIGINT AS images, 0::BIGINT AS lo, 999::BIGINT AS hi")
def permutation_bijection(spark, sf):
    p = permutation_table(spark, KEY, "scope", "plate", 1000)
    return p.agg(F.count("*").alias("n"), F.countDistinct("perm").alias("images"), F.min("perm").alias("lo"), F.max("perm").alias("hi"))


def _gazetteer_values(spark):
    g = G.seed(spark)
    kinds = F.create_map(*[F.lit(x) for k, v in S.GAZETTEER_KIND.items() for x in (v, k)])
    return g.select(F.lit("s1").alias("scope"), kinds[F.col("kind")].alias("entity_type"), F.col("key").alias("value"), F.lit(None).cast("string").alias("mode"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS entity_type, {len(G.SEED[v])}::BIGINT AS n, {len(G.SEED[v])}::BIGINT AS images, 0::BIGINT AS fixed" for k, v in S.GAZETTEER_KIND.items()))
def derangement_no_fixed_point(spark, sf):
    rows = S.with_surrogates(_gazetteer_values(spark), KEY, G.seed(spark))
    return rows.groupBy("entity_type").agg(F.count("out").alias("n"), F.countDistinct("out").alias("images"), F.count_if(X.fold_key(F.col("out")) == F.col("value")).alias("fixed"))


def _cipher(name: str, kind: str, value: str, check) -> None:
    def run(spark, sf):
        rows = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("scope"), F.lit(kind).alias("entity_type"), F.expr(value).alias("value"), F.lit(None).cast("string").alias("mode"))
        sur = S.with_surrogates(rows, KEY, None).select("c_custkey", "scope", "entity_type", F.col("value").alias("clear"), F.col("out").alias("value"), "mode")
        back = S.with_surrogates(sur, KEY, None, back=True)
        return back.select("c_custkey", F.col("clear").alias("value"), F.col("out").alias("back"), (check(F.col("value")) & (F.col("value") != F.col("clear"))).alias("valid"))

    run.__name__ = f"{name}_cipher_roundtrip"
    query(f"SELECT c_custkey, {value} AS value, {value} AS back, true AS valid FROM customer")(run)


_cipher("plate", "PLAQUE_SIV", "('AB-' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '-CD')", lambda v: v.rlike(f"^{T.PLATE}$"))
_cipher("date", "DATE", "(lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') || '/' || lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0') || '/' || CAST(1900 + c_custkey % 200 AS STRING))", lambda v: T.to_date_slash(v).isNotNull())
_cipher("email", "EMAIL", "(CASE WHEN c_custkey % 3 = 0 THEN 'é' ELSE 'user.' END || CAST(c_custkey AS STRING) || '@mail.fr')", lambda v: v.endswith("@mail.fr") & ~v.startswith("user."))
_cipher("reference", "REFERENCE_DOSSIER", "('DOS-' || CAST(c_custkey AS STRING) || '-très long identifiant de dossier')", lambda v: v.rlike("^[0-9a-f]+$"))


@query(f"""WITH g AS (SELECT list(n ORDER BY encode(lower(n))) AS all_ FROM (SELECT unnest({names('nom')}) AS n))
SELECT c_custkey, all_[((('0x' || substr({hmac("encode(c_mktsegment || chr(0) || 'nom' || chr(0) || c_name)")}, 1, 16))::UBIGINT) % {len(G.SEED['nom'])})::INT + 1] AS name FROM customer, g""")
def gazetteer_pick(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("scope"), F.col("c_name").alias("value"))
    return S.pick(rows, G.seed(spark), KEY, "nom").select("c_custkey", "name")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'l:l' WHEN 1 THEN 'U:U' ELSE 'T:l' END AS pattern, CASE p_partkey % 3 WHEN 0 THEN 'dupont martin' WHEN 1 THEN 'DUPONT MARTIN' ELSE 'Dupont martin' END AS applied FROM part""")
def case_pattern(spark, sf):
    two = F.regexp_replace(F.regexp_replace("p_name", r"[^A-Za-z ]", ""), r"^\s*(\S+)\s+(\S+).*$", "$1 $2")
    cased = F.when(F.col("p_partkey") % 3 == 0, F.lower(two)).when(F.col("p_partkey") % 3 == 1, F.upper(two)).otherwise(F.concat(F.initcap(F.substring_index(two, " ", 1)), F.lit(" "), F.lower(F.substring_index(two, " ", -1))))
    pattern = X.case_pattern(cased)
    return table(spark, sf, "part").select("p_partkey", pattern.alias("pattern"), X.apply_case(F.lit("dupont MARTIN"), pattern).alias("applied"))


@query(f"""WITH v AS (SELECT o_orderkey, {SIRET} AS s FROM orders)
SELECT o_orderkey, unnest([s, substr(s, 1, 3) || ' ' || substr(s, 4, 3) || ' ' || substr(s, 7, 3) || ' ' || substr(s, 10, 3) || ' ' || substr(s, 13), substr(s, 1, 2) || ' ' || substr(s, 3, 3) || ' ' || substr(s, 6, 3) || ' ' || substr(s, 9, 3) || ' ' || substr(s, 12)]) AS variant FROM v""")
def variants_expand(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.explode(M.variants(F.expr(SIRET))).alias("variant"))


_EDGE = "(CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN '7' WHEN 2 THEN 'x' ELSE '' END || CAST(10000 + c_custkey AS STRING) || CASE c_custkey % 3 WHEN 0 THEN '.' WHEN 1 THEN '8' ELSE 'y' END)"


@query("SELECT c_custkey, c_custkey % 4 <> 1 AND c_custkey % 3 <> 1 AS bounded FROM customer")
def boundary_filter(spark, sf):
    start = F.when(F.col("c_custkey") % 4 == 3, 0).otherwise(1)
    end = start + F.length((F.col("c_custkey") + 10_000).cast("string"))
    return table(spark, sf, "customer").select("c_custkey", M.bounded(F.expr(_EDGE), start, end).alias("bounded"))


@query("SELECT event_id, event_id % 7 >= 4 AS covered FROM events")
def word_coverage(spark, sf):
    hit = lambda a, b: F.struct(F.lit(a).alias("start"), b.cast("int").alias("end"))
    hits = F.array(hit(4, F.lit(10)), hit(0, F.col("event_id") % 7))
    return table(spark, sf, "events").select("event_id", M.covered(F.struct(F.lit(0).alias("start"), F.lit(10).alias("end")), hits).alias("covered"))


# --- registry and engine -----------------------------------------------------------------------------------------------------


@query("""WITH h AS (SELECT c_custkey, c_mktsegment AS scope, (c_custkey * 7919) % 6000 AS home, lpad(c_custkey::VARCHAR, 12, '0') AS clear_hmac FROM customer),
i AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY home, clear_hmac) - 1 AS i FROM h)
SELECT scope, clear_hmac, (i + max(home - i) OVER (PARTITION BY scope ORDER BY home, clear_hmac))::BIGINT AS slot FROM i""")
def registry_reserve(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("scope"), ((F.col("c_custkey") * 7919) % 6000).alias("home"), F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("clear_hmac"))
    return Reg.reserve(rows, 1_000_000).select("scope", "clear_hmac", "slot")


def _letters_sql() -> str:
    return f"('SIREN ' || {SIREN.replace('o_orderkey', 'c_custkey')} || ', tel 06' || lpad(CAST(c_custkey * 7919 % 100000000 AS STRING), 8, '0') || ', écrire à user.' || CAST(c_custkey AS STRING) || '@mail.fr (dossier DOS-' || lpad(CAST(c_custkey AS STRING), 6, '0') || ')')"


def _letters(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("scope"), F.expr(_letters_sql()).alias("text"))


def _engine(spark) -> E.Engine:
    return E.Engine(spark, KEY, None, ["DOS-[0-9]{6}"])


@query(f"""WITH l AS (SELECT c_custkey, {luhn(SIREN.replace('o_orderkey', 'c_custkey'))} = 0 AS ok FROM customer)
SELECT 'EMAIL' AS type, count(*) AS n FROM l UNION ALL SELECT 'TELEPHONE', count(*) FROM l UNION ALL SELECT 'REFERENCE_DOSSIER', count(*) FROM l UNION ALL SELECT 'SIREN', count(*) FILTER (ok) FROM l""")
def observe_documents(spark, sf):
    seen = _engine(spark).observe(_letters(spark, sf))
    return seen.select(F.explode("entities").alias("e")).groupBy(F.col("e.type").alias("type")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, text AS restored FROM (SELECT c_custkey AS doc_id, {_letters_sql()} AS text FROM customer)")
def mask_unmask_roundtrip(spark, sf):
    e, docs = _engine(spark), _letters(spark, sf)
    masked, issued = e.mask(docs)
    return e.unmask(masked.drop("entities"), issued).select("doc_id", F.col("text").alias("restored"))


@query("SELECT 0::BIGINT AS leaks, 0::BIGINT AS wrong_offsets, count(*) AS docs FROM customer")
def no_clear_leak(spark, sf):
    """No clear number, e-mail or reference is left; every entity stands where it says."""
    docs = _letters(spark, sf)
    masked, _ = _engine(spark).mask(docs)
    both = masked.join(docs.select("doc_id", F.col("text").alias("clear")), "doc_id")
    gone = F.concat(F.lit("user."), F.col("doc_id").cast("string"), F.lit("@mail.fr"))
    dossier = F.concat(F.lit("DOS-"), F.lpad(F.col("doc_id").cast("string"), 6, "0"))
    off = F.exists("entities", lambda x: F.substr(F.col("text"), x["start"] + 1, x["end"] - x["start"]) != x["value"])
    return both.agg(F.count_if(F.contains("text", gone) | F.contains("text", dossier)).alias("leaks"), F.count_if(off).alias("wrong_offsets"), F.count("*").alias("docs"))


@query("SELECT 0::BIGINT AS shared, 0::BIGINT AS unstable, count(*) * 3 + count(*) FILTER (ok) AS issued FROM (SELECT " + luhn(SIREN.replace("o_orderkey", "c_custkey")) + " = 0 AS ok FROM customer)")
def registry_injective(spark, sf):
    """One surrogate a value and one value a surrogate, in each scope."""
    _, issued = _engine(spark).mask(_letters(spark, sf))
    by_sur = issued.groupBy("scope", "entity_type", "surrogate").agg(F.countDistinct("clear_hmac").alias("n"))
    by_val = issued.groupBy("scope", "entity_type", "clear_hmac").agg(F.countDistinct("surrogate").alias("n"))
    both = by_sur.select(F.lit(True).alias("sur"), "n").unionByName(by_val.select(F.lit(False).alias("sur"), "n"))
    bad = F.col("n") > 1
    return both.agg(F.count_if(F.col("sur") & bad).alias("shared"), F.count_if(~F.col("sur") & bad).alias("unstable"), F.count_if("sur").alias("issued"))


@query(f"SELECT c_custkey AS doc_id, {_letters_sql()} AS text FROM customer")
def unmask_ignores_unissued(spark, sf):
    """Valid identifiers that the registry never issued come back as they are."""
    e, docs = _engine(spark), _letters(spark, sf)
    _, issued = e.mask(docs)
    return e.unmask(docs, issued.where("entity_type = 'none'")).select("doc_id", "text")


@query(f"SELECT c_custkey AS doc_id, 'N ' || v || ' fin' AS restored FROM (SELECT c_custkey, {SIREN.replace('o_orderkey', 'c_custkey')} AS v FROM customer) WHERE {luhn('v')} = 0")
def unmask_reformatted(spark, sf):
    """A masked number that an answer groups by three is restored."""
    e = _engine(spark)
    docs = _letters(spark, sf).select("doc_id", "scope", F.concat(F.lit("N "), F.expr(SIREN.replace("o_orderkey", "doc_id")), F.lit(" fin")).alias("text")).where(T.is_kind(F.substring("text", 3, 9), "SIREN"))
    masked, issued = e.mask(docs)
    spaced = masked.withColumn("text", F.regexp_replace("text", r"([0-9]{3})([0-9]{3})([0-9]{3})", "$1 $2 $3")).drop("entities")
    return e.unmask(spaced, issued).select("doc_id", F.col("text").alias("restored"))


@query("SELECT conv_id, count(*) AS turns, 1::BIGINT AS surrogates, 0::BIGINT AS clear_left FROM conversations GROUP BY conv_id")
def mask_conversations_by_scope(spark, sf):
    """One number said in every turn gets one surrogate in its conversation."""
    number = F.concat(F.lpad((F.col("conv_id") % 100_000_000).cast("string"), 8, "0"))
    conv = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(number, D.luhn_digit(number)).alias("v"))
    out = conv.withColumn("m", E.mask_numbers(F.concat(F.lit("dit "), "v", F.lit(" là")), F.col("conv_id").cast("string"), KEY))
    return out.groupBy("conv_id").agg(F.count("*").alias("turns"), F.countDistinct("m").alias("surrogates"), F.count_if(F.contains("m", "v")).alias("clear_left"))


@query()
def mask_documents(spark, sf):
    """Documents with e-mails and numbers masked, scoped by source."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("scope"), "text")
    masked, _ = E.Engine(spark, KEY).mask(docs)
    return masked.select("doc_id", "text", F.size("entities").alias("n_entities"))


_PROPS = "struct<k: string, note: array<string>, keep: string>"


@query(f"""SELECT event_id, {SIREN.replace('o_orderkey', 'event_id')} AS keep, true AS changed, 2::INT AS notes FROM events WHERE {luhn(SIREN.replace('o_orderkey', 'event_id'))} = 0""")
def mask_json_props(spark, sf):
    """Strings of a tree are masked wherever they are, but for exempt paths."""
    v = F.expr(SIREN.replace("o_orderkey", "event_id"))
    rows = table(spark, sf, "events").where(T.is_kind(v, "SIREN")).select("event_id", v.alias("v"), F.struct(F.concat(F.lit("n "), v).alias("k"), F.array(v, F.lit("rien")).alias("note"), v.alias("keep")).alias("tree"))
    out = rows.withColumn("out", E.map_leaves(F.col("tree"), rows.schema["tree"].dataType, lambda c: E.mask_numbers(c, F.lit("s"), KEY), exempt=["keep"]))
    changed = (F.col("out.k") != F.col("tree.k")) & (F.get("out.note", F.lit(0)) != F.col("v")) & (F.get("out.note", F.lit(1)) == "rien")
    return out.select("event_id", F.col("out.keep").alias("keep"), changed.alias("changed"), F.size("out.note").alias("notes"))


@query(f"""SELECT c_custkey AS doc_id, c_mktsegment AS scope, {hmac(f"encode({_letters_sql()})")} AS digest, CASE WHEN {luhn(SIREN.replace('o_orderkey', 'c_custkey'))} = 0 THEN 4 ELSE 3 END::INT AS types, 0::INT AS weak FROM customer""")
def audit_log(spark, sf):
    found = _engine(spark).detect(_letters(spark, sf))
    lines = E.audit(found, KEY, "text", "scope")
    ids = found.select("doc_id", hmac_sha256(KEY, F.col("text").cast("binary")).alias("digest"))
    return lines.join(ids, "digest").select("doc_id", "scope", "digest", F.size("span_count_by_type").alias("types"), F.size("weak_spans").alias("weak"))


@query("""SELECT '# Rapport d''activité' || chr(10) || chr(10) || '- Textes : ' || n::VARCHAR || chr(10) || '- Entités : ' || (3 * n + s)::VARCHAR || chr(10) || chr(10) || '| Type | Nombre |' || chr(10) || '| --- | --- |' || chr(10) ||
 '| E-mail | ' || n::VARCHAR || ' |' || chr(10) || '| Référence de dossier | ' || n::VARCHAR || ' |' || chr(10) || '| SIREN | ' || s::VARCHAR || ' |' || chr(10) || '| Téléphone | ' || n::VARCHAR || ' |' || chr(10) || chr(10) ||
 '- Règles : email-broad-format, phone-format, reference-0, siren-luhn' || chr(10) || '- Gazetteers : -' AS markdown FROM (SELECT count(*) AS n, count(*) FILTER (""" + luhn(SIREN.replace("o_orderkey", "c_custkey")) + """ = 0) AS s FROM customer)""")
def activity_report(spark, sf):
    return E.report(_engine(spark).detect(_letters(spark, sf)))


@query("SELECT c_custkey AS doc_id, c_custkey % 2 = 1 AS weak FROM customer")
def weak_spans_policy(spark, sf):
    """What a strict policy would refuse: names without a trigger."""
    docs = _people(spark, sf).select(F.col("c_custkey").alias("doc_id"), "text")
    found = E.Engine(spark, KEY, G.seed(spark)).detect(docs)
    return found.select("doc_id", F.exists("spans", lambda s: s["confidence"] < E.WEAK).alias("weak"))


def _build_sql() -> str:
    parts = []
    for kind, rows in G.SEED.items():
        lines = [(n, m if kind == "prenom" else "", m if kind == "commune" else "") for n, _, m in (r.partition(":") for r in rows)]
        values = ", ".join("('" + f"{n},{g},{d},1".replace("'", "''") + "', '" + n.lower().replace("'", "''") + "')" for n, g, d in lines)
        part = f"SELECT substr(key, 1, 2) AS p, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY encode(key))) AS sha FROM (VALUES {values}) t(line, key) GROUP BY ALL"
        parts.append(f"SELECT '{kind}' AS kind, sum(n)::BIGINT AS cnt, sha256(string_agg(p || ':' || sha, '|' ORDER BY encode(p))) AS sha256 FROM ({part})")
    return " UNION ALL ".join(parts)


@query(_build_sql())
def gazetteer_build(spark, sf):
    return G.build(G.seed(spark))


@query(f"""SELECT date_trunc('hour', ts) - (hour(ts) % 6) * INTERVAL 1 HOUR AS window_start, 'SIREN' AS type, count(*) AS n FROM events WHERE {luhn(SIREN.replace('o_orderkey', 'event_id'))} = 0 GROUP BY ALL""")
def stream_detect_events(spark, sf):
    """The streaming plan over a finished batch of the same rows: counts of spans by six-hour windows."""
    texts = table(spark, sf, "events").select("ts", F.concat(F.lit("n "), F.expr(SIREN.replace("o_orderkey", "event_id")), F.lit(" x")).alias("text"))
    return streams.counts_by_window(texts, "ts", "6 hours")


# --- acceptance: every type, masked and restored -------------------------------------------------------------------------------


def _nth(kind: str) -> str:
    """The name of a row by its key, in SQL of DuckDB."""
    return f"{names(kind)}[(c_custkey % {len(G.SEED[kind])} + 1)::INT]"


def _pick(kind: str):
    return F.element_at(F.array(*(F.lit(n.partition(":")[0]) for n in G.SEED[kind])), (F.col("c_custkey") % len(G.SEED[kind]) + 1).cast("int"))


#: The parts of a text with an identifier of every type, in SQL that both engines read.
_MAIL = "('Jean.P' || CAST(c_custkey AS STRING) || '@Mail' || CAST(c_custkey % 7 AS STRING) || '.fr')"
_OLD_MAIL = "('x' || CAST(c_custkey % 10 AS STRING) || '@b.xn--p1ai')"
_BORN = "(CAST(c_custkey % 28 + 1 AS STRING) || ' août ' || CAST(1930 + c_custkey % 70 AS STRING))"
_SEEN = "(lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') || '/0' || CAST(c_custkey % 9 + 1 AS STRING) || '/2019')"
_CAR = "('AB-' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '-CD')"
_TEL = "('06' || lpad(CAST(c_custkey * 7919 % 100000000 AS STRING), 8, '0'))"
_REF = "('DOS-' || lpad(CAST(c_custkey AS STRING), 6, '0'))"
_ZIP = "lpad(CAST(10000 + c_custkey % 80000 AS STRING), 5, '0')"


def _full_texts(spark, sf) -> DataFrame:
    """Names in two cases, a street with odd blanks, a town with its postcode, and a number, date, plate, reference and
    two e-mails, scoped by segment."""
    street = F.regexp_replace(_pick("voie"), " ", F.when(F.col("c_custkey") % 3 == 0, "   ").when(F.col("c_custkey") % 3 == 1, "\n").otherwise(" "))
    parts = [
        F.lit("Mme "), _pick("prenom"), F.lit(" "), F.upper(_pick("nom")), F.lit(", dite "), _pick("nom"), F.lit(", née le "), F.expr(_BORN), F.lit(", demeurant 12 "), street, F.lit(", "), F.expr(_ZIP), F.lit(" "), _pick("commune"),
        F.lit(". Vue le "), F.expr(_SEEN), F.lit(", auto "), F.expr(_CAR), F.lit(", tel "), F.expr(_TEL), F.lit(", dossier "), F.expr(_REF), F.lit(", "), F.expr(_MAIL), F.lit(" ou "), F.expr(_OLD_MAIL), F.lit(" fin."),
    ]
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("scope"), F.concat(*parts).alias("text"), "c_custkey")


_FULL_SQL = f"""('Mme ' || {_nth('prenom')} || ' ' || upper({_nth('nom')}) || ', dite ' || {_nth('nom')} || ', née le ' || {_BORN} || ', demeurant 12 ' || replace({_nth('voie')}, ' ', CASE c_custkey % 3 WHEN 0 THEN '   ' WHEN 1 THEN chr(10) ELSE ' ' END) || ', ' || {_ZIP} || ' ' || {_nth('commune')}
 || '. Vue le ' || {_SEEN} || ', auto ' || {_CAR} || ', tel ' || {_TEL} || ', dossier ' || {_REF} || ', ' || {_MAIL} || ' ou ' || {_OLD_MAIL} || ' fin.')"""


def _full_engine(spark) -> E.Engine:
    return E.Engine(spark, KEY, G.seed(spark), ["DOS-[0-9]{6}"])


#: Texts whose streets are written with single blanks: a value with two written forms comes back in one of them.
_ALONE = "c_custkey % 3 = 2"


@query(f"SELECT c_custkey AS doc_id, {_FULL_SQL} AS restored FROM customer WHERE {_ALONE}")
def mask_names_roundtrip(spark, sf):
    """Every type, names in two cases, through mask and unmask."""
    e, docs = _full_engine(spark), _full_texts(spark, sf).where(_ALONE).drop("c_custkey")
    masked, issued = e.mask(docs)
    return e.unmask(masked.drop("entities"), issued).select("doc_id", F.col("text").alias("restored"))


@query(f"SELECT c_custkey AS doc_id, regexp_replace({_FULL_SQL}, '[ \\n]+', ' ', 'g') AS restored FROM customer")
def mask_odd_blanks_roundtrip(spark, sf):
    """Streets with several blanks or a line end between their words are masked and restored, blanks as first written."""
    e, docs = _full_engine(spark), _full_texts(spark, sf).drop("c_custkey")
    masked, issued = e.mask(docs)
    return e.unmask(masked.drop("entities"), issued).select("doc_id", F.regexp_replace("text", r"[ \n]+", " ").alias("restored"))


@query("SELECT count(*) AS docs, 0::BIGINT AS leaks, 0::BIGINT AS wrong_offsets, 13 * count(*) AS entities FROM customer")
def mask_all_types_no_leak(spark, sf):
    """Of no type a clear value is left where it stood; entities stand where they say."""
    docs = _full_texts(spark, sf)
    masked, _ = _full_engine(spark).mask(docs)
    apart = lambda c, at: F.split_part(c, F.lit(at[0]), F.lit(2)).startswith(F.concat(at[1], F.lit(at[2])))
    t = F.regexp_replace("text", r"\s+", " ")
    places = [("Mme ", _pick("prenom"), " "), (", dite ", _pick("nom"), ","), ("née le ", F.expr(_BORN), ","), ("demeurant 12 ", _pick("voie"), ","), ("Vue le ", F.expr(_SEEN), ","), (", auto ", F.expr(_CAR), ","), (", tel ", F.expr(_TEL), ","), (", dossier ", F.expr(_REF), ",")]
    whole = [F.expr(_MAIL), F.expr(_OLD_MAIL), F.concat(F.expr(_ZIP), F.lit(" "), _pick("commune")), F.lower(F.expr(_MAIL))]
    leak = reduce(lambda a, b: a | b, [*(apart(t, p) for p in places), *(F.contains("text", w) for w in whole)])
    off = F.exists("entities", lambda x: F.substr(F.col("text"), x["start"] + 1, x["end"] - x["start"]) != x["value"])
    return masked.agg(F.count("*").alias("docs"), F.count_if(leak).alias("leaks"), F.count_if(off).alias("wrong_offsets"), F.sum(F.size("entities")).alias("entities"))


@query(f"""WITH c AS (SELECT c_mktsegment AS scope, {_nth('prenom')} AS f, {_nth('nom')} AS l, {_nth('voie')} AS v, {_nth('commune')} AS t, * FROM customer),
v AS (SELECT scope, 'PRENOM' AS k, lower(f) AS v FROM c UNION SELECT scope, 'PATRONYME', lower(l) FROM c UNION SELECT scope, 'DATE', {_BORN} FROM c UNION SELECT scope, 'DATE', {_SEEN} FROM c UNION SELECT scope, 'VOIE', lower(v) FROM c UNION SELECT scope, 'COMMUNE', lower(t) FROM c
 UNION SELECT scope, 'CODE_POSTAL', {_ZIP} FROM c UNION SELECT scope, 'PLAQUE_SIV', {_CAR} FROM c UNION SELECT scope, 'TELEPHONE', {_TEL} FROM c UNION SELECT scope, 'REFERENCE_DOSSIER', {_REF} FROM c UNION SELECT scope, 'EMAIL', {_MAIL} FROM c UNION SELECT scope, 'EMAIL', {_OLD_MAIL} FROM c)
SELECT k AS entity_type, count(*) AS n, 0::BIGINT AS in_clear, 0::BIGINT AS fixed_points FROM v WHERE k NOT IN ('PRENOM', 'PATRONYME') GROUP BY k""")
def residue_counts(spark, sf):
    """Values left in clear and fixed points: none of a type that has surrogates for all of its values."""
    rows = _full_engine(spark).residue(_full_texts(spark, sf))
    return rows.where("entity_type not in ('PRENOM', 'PATRONYME')").select("entity_type", F.col("values").alias("n"), "in_clear", "fixed_points")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS found FROM customer""".replace("AS found", "::INT AS found"))
def unknown_names_stay(spark, sf):
    """A captured name of no gazetteer stays in clear; dates out of range, too."""
    text = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("M. Zzq"), F.lit(" le 01/01/1850"))).otherwise(F.concat(F.lit("M. "), _pick("nom")))
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("s").alias("scope"), text.alias("text"))
    masked, _ = _full_engine(spark).mask(docs)
    return masked.join(docs.select("doc_id", F.col("text").alias("clear")), "doc_id").select(F.col("doc_id").alias("c_custkey"), (F.col("text") != F.col("clear")).cast("int").alias("found"))


#: Written forms of e-mails, and what of them is one: by the grammar of labels, with accents and apostrophes in local parts.
FORMS = [
    ("à jean@ex.fr2 !", "jean@ex.fr2"), ("a@b.xn--p1ai", "a@b.xn--p1ai"), ("o'brien.test@exemple.fr,", "o'brien.test@exemple.fr"), ("étienne.été@exemple.fr", "étienne.été@exemple.fr"), ("x%y@z.fr", "y@z.fr"),
    ("a.b.c.d@g.mx.", "a.b.c.d@g.mx"), ("plus+tag@exemple.fr", "plus+tag@exemple.fr"), ("deux@un@trois.fr", "un@trois.fr"), ("sans@point", None), ("_@a-b.c-d", "_@a-b.c-d"), ("a@.fr", None), ("l’été@x.y.z", "l’été@x.y.z"),
]
_Q = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"


@query(f"SELECT c_custkey, [{', '.join(_Q(v) for _, v in FORMS)}][(c_custkey % {len(FORMS)} + 1)::INT] AS value FROM customer")
def email_corpus(spark, sf):
    """What of written forms is found; the expected values are given, not worked out."""
    form = F.element_at(F.array(*(F.lit(t) for t, _ in FORMS)), (F.col("c_custkey") % len(FORMS) + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", F.get(T.emails(form), F.lit(0))["value"].alias("value"))


@query("""SELECT c_custkey, c_custkey % 2 = 0 AS perm, CASE WHEN c_custkey % 2 = 0 THEN 'Ab.' || c_custkey::VARCHAR || '@Mail.FR' ELSE 'Éa' || c_custkey::VARCHAR || '@x.fr' END AS back, true AS domain_kept FROM customer""")
def email_case_roundtrip(spark, sf):
    """Capitals of local parts and domains come back; short or accented local parts go by keystream."""
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Ab."), F.col("c_custkey").cast("string"), F.lit("@Mail.FR"))).otherwise(F.concat(F.lit("Éa"), F.col("c_custkey").cast("string"), F.lit("@x.fr")))
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("s").alias("scope"), text.alias("text"))
    e = E.Engine(spark, KEY)
    masked, issued = e.mask(docs)
    kept = F.substring_index("text", "@", -1) == F.when(F.col("doc_id") % 2 == 0, "Mail.FR").otherwise("x.fr")
    shape = masked.select("doc_id", F.substring_index("text", "@", 1).rlike("^([0-9a-f]{2})+$").alias("hex"), kept.alias("domain_kept"))
    back = e.unmask(masked.drop("entities"), issued).select("doc_id", F.col("text").alias("back"))
    return back.join(shape, "doc_id").select(F.col("doc_id").alias("c_custkey"), (~F.col("hex") | (F.col("doc_id") % 2 == 0)).alias("perm"), "back", "domain_kept")


@query("SELECT 1::BIGINT AS forms, 1000::BIGINT AS runs")
def determinism_repeats(spark, sf):
    """One text masked a thousand times, in many partitions, has one masked form."""
    docs = spark.range(1000).repartition(16).select(F.col("id").alias("doc_id"), F.lit("s").alias("scope"), F.lit("Mme Claire DUPONT, née le 3 mai 1990, 8 rue Pasteur, SIRET 55210055400021").alias("text"))
    masked, _ = _full_engine(spark).mask(docs)
    return masked.agg(F.countDistinct("text").alias("forms"), F.count("*").alias("runs"))


def _surnames(spark, n: int) -> DataFrame:
    """A gazetteer of made-up surnames: numbers in letters."""
    name = F.initcap(F.translate(F.lpad(F.col("id").cast("string"), 5, "0"), "0123456789", "abcdefghij"))
    return spark.range(n).select(F.lit("nom").alias("kind"), name.alias("name"), F.lower(name).alias("key"), F.lit("").alias("genre"), F.lit("").alias("departement"), F.lit(1).cast("long").alias("cnt"))


@query("SELECT 5000::BIGINT AS names, 5000::BIGINT AS surrogates, 5000::BIGINT AS back, 0::BIGINT AS fixed")
def surnames_no_collision(spark, sf):
    g = _surnames(spark, 5000)
    rows = g.select(F.lit("s").alias("scope"), F.lit("PATRONYME").alias("entity_type"), F.col("key").alias("value"), F.lit(None).cast("string").alias("mode"))
    there = S.with_surrogates(rows, KEY, g)
    back = S.with_surrogates(there.select("scope", "entity_type", F.col("out").alias("value"), F.lit(None).cast("string").alias("mode"), F.col("value").alias("clear")), KEY, g, back=True)
    return back.agg(F.count("clear").alias("names"), F.countDistinct("value").alias("surrogates"), F.count_if(F.lower("out") == F.col("clear")).alias("back"), F.count_if(F.lower("value") == F.col("clear")).alias("fixed"))


@query("SELECT 'PATRONYME' AS type, 3 * count(*) AS expected, 3 * count(*) AS found, 3 * count(*) AS hits, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0)")
def surname_precision(spark, sf):
    """Sure surnames in three contexts with a trigger: those of the gazetteer, and no other word."""
    from ..operators import invariants as I

    word = F.when(F.col("c_custkey") % 2 == 0, _pick("nom")).otherwise(F.element_at(F.array(*map(F.lit, ("Directeur", "Stagiaire", "Usager", "Voisine", "Radiologue"))), (F.col("c_custkey") % 5 + 1).cast("int")))
    said = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.concat(F.lit(a), word, F.lit(b)).alias("text"), F.lit(len(a)).alias("at")) for i, (a, b) in enumerate((("M. ", " est venu."), ("vu le 3 mai 1990, M. ", ""), ("demeurant ici, Mme ", " parle"))))))
    rows = table(spark, sf, "customer").select("c_custkey", word.alias("word"), said.alias("s")).select((F.col("c_custkey") * 3 + F.col("s.k")).alias("doc_id"), "word", "c_custkey", "s.*")
    want = rows.where("c_custkey % 2 = 0").select("doc_id", F.col("at").alias("start"), (F.col("at") + F.length("word")).alias("end"), F.lit("PATRONYME").alias("type"))
    seen = E.Engine(spark, KEY, G.seed(spark)).observe(rows).select("doc_id", F.explode("entities").alias("e"))
    got = seen.where("e.type = 'PATRONYME' and e.confidence >= 0.9").select("doc_id", "e.start", "e.end", "e.type")
    return I.rates(want, got)


_STRUCT = f"('réf ' || {SIRET} || ' x')"


@query(f"""WITH o AS (SELECT {luhn(SIRET)} = 0 AS ok FROM orders) SELECT 'SIRET' AS type, count(*) FILTER (ok) AS expected, count(*) FILTER (ok) AS found, count(*) FILTER (ok) AS hits, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall FROM o""")
def structured_recall(spark, sf):
    from ..operators import invariants as I

    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_STRUCT).alias("text"), D.is_luhn(F.expr(SIRET)).alias("ok"))
    want = rows.where("ok").select("doc_id", F.lit(4).alias("start"), F.lit(18).alias("end"), F.lit("SIRET").alias("type"))
    got = rows.select("doc_id", F.explode(resolve(T.structured(F.col("text")))).alias("s")).where("s.type = 'SIRET'").select("doc_id", "s.start", "s.end", "s.type")
    return I.rates(want, got)


# --- sources, sinks, registry -----------------------------------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, {len(v)}::BIGINT AS n, true AS same, true AS checked" for k, v in G.SEED.items()))
def gazetteer_files(spark, sf):
    """Written as sorted gzip CSV with a manifest, read back, held against the manifest."""
    at = folder(spark, "gazetteers")
    G.write(G.seed(spark), at)
    there = G.load(spark, at)
    same = there.join(G.seed(spark), ["kind", "name", "key", "genre", "departement", "cnt"]).groupBy("kind").agg(F.count("*").alias("m"))
    return there.groupBy("kind").agg(F.count("*").alias("n")).join(same, "kind").select("kind", "n", (F.col("n") == F.col("m")).alias("same"), F.lit(G.check(spark, at)).alias("checked"))


@query("SELECT min(c_custkey) AS first_key, count(*) AS n FROM customer")
def gazetteer_first_wins(spark, sf):
    """Of rows with one key, the first of a file is kept."""
    at = folder(spark, "first")
    rows = table(spark, sf, "customer").orderBy("c_custkey").coalesce(1)
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, "N").otherwise("n"), F.lit("a"))
    both = rows.select(name.alias("patronyme"), F.col("c_custkey").alias("count")).unionByName(rows.select(F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("patronyme"), F.lit(1).cast("long").alias("count")))
    both.coalesce(1).write.option("header", True).option("compression", "gzip").csv(f"{at}/noms.csv.gz")
    for kind, (file, column, more) in G.FILES.items():
        if kind != "nom":
            spark.range(1).select(F.lit("a").alias(column), *([F.lit("M").alias(more)] if more else [])).write.option("header", True).option("compression", "gzip").csv(f"{at}/{file}")
    got = G.load(spark, at).where("kind = 'nom'")
    return got.agg(F.min(F.when(F.col("key") == "na", F.col("cnt"))).alias("first_key"), (F.count("*") - 1).alias("n"))


@query("SELECT doc_id, len(text)::INT AS n, text AS masked FROM (SELECT c_custkey AS doc_id, 'Texte ' || c_custkey::VARCHAR || chr(10) || 'fin.' || chr(10) AS text FROM customer WHERE c_custkey <= 20)")
def text_files(spark, sf):
    """Texts written as a file each, and read back whole."""
    at = folder(spark, "texts")
    docs = table(spark, sf, "customer").where("c_custkey <= 20").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("Texte "), F.col("c_custkey").cast("string"), F.lit("\nfin.\n")).alias("text"))
    Txt.write_files(docs, at)
    back = Txt.read_files(spark, [at])
    return back.select(F.regexp_extract("doc_id", "name=([0-9]+)", 1).cast("long").alias("doc_id"), F.length("text").alias("n"), F.col("text").alias("masked"))


@query(f"SELECT c_mktsegment AS scope, count(*) AS lines, sum(CASE WHEN {luhn(SIREN.replace('o_orderkey', 'c_custkey'))} = 0 THEN 4 ELSE 3 END)::BIGINT AS spans FROM customer GROUP BY ALL")
def audit_sink(spark, sf):
    """Audit lines appended as JSON and read back."""
    at = folder(spark, "audit")
    Txt.write_audit(E.audit(_engine(spark).detect(_letters(spark, sf)), KEY, "text", "scope"), at)
    lines = spark.read.schema("scope string, span_count_by_type map<string, bigint>").json(at)
    return lines.groupBy("scope").agg(F.count("*").alias("lines"), F.sum(F.aggregate(F.map_values("span_count_by_type"), F.lit(0).cast("long"), lambda a, x: a + x)).alias("spans"))


@query(f"SELECT c_mktsegment AS scope, 3 * count(*) + count(*) FILTER ({luhn(SIREN.replace('o_orderkey', 'c_custkey'))} = 0) AS n, true AS held, 0::BIGINT AS unknown_held FROM customer GROUP BY ALL")
def registry_replay(spark, sf):
    """Rows appended twice are there once; the registry knows what it issued, and nothing else."""
    reg = Reg.Registry(spark, folder(spark, "registry"))
    _, issued = _engine(spark).mask(_letters(spark, sf))
    reg.append(issued)
    reg.append(issued)
    rows = reg.read()
    held = Reg.contains(rows.select("scope", "surrogate"), rows).groupBy("scope").agg(F.count("*").alias("held"))
    other = Reg.contains(rows.select("scope", F.concat(F.col("surrogate"), F.lit("~")).alias("surrogate")), rows).count()
    return rows.groupBy("scope").agg(F.count("*").alias("n")).join(held, "scope").select("scope", "n", (F.col("n") == F.col("held")).alias("held"), F.lit(other).cast("long").alias("unknown_held"))


@query("SELECT 'a' AS scope, 100::BIGINT AS n, 100::BIGINT AS slots, 0::BIGINT AS lo, 99::BIGINT AS hi")
def registry_reserve_wraps(spark, sf):
    """As many values as places, all at home at the end: those pushed past it take the free ones."""
    rows = spark.range(100).select(F.lit("a").alias("scope"), F.lit(90).cast("long").alias("home"), F.lpad(F.col("id").cast("string"), 5, "0").alias("clear_hmac"))
    return Reg.reserve(rows, 100).groupBy("scope").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.min("slot").alias("lo"), F.max("slot").alias("hi"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS siren, c_custkey % 2 = 0 AS phone, '76' AS iban_key FROM customer")
def sql_functions(spark, sf):
    """The validators as SQL functions."""
    from ..functions import sql as SQL

    SQL.register(spark)
    v = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "732829320").otherwise("732829321").alias("v"), F.when(F.col("c_custkey") % 2 == 0, "+33612345678").otherwise("0012345678").alias("p"))
    return v.select("c_custkey", F.expr("is_siren(v)").alias("siren"), F.expr("is_phone_fr(p)").alias("phone"), F.expr("iban_key_fr('30006000011234567890189')").alias("iban_key"))


# --- rules of context ---------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, (c_custkey % 14 <= 10)::INT AS n FROM customer")
def postcode_trigger(spark, sf):
    """A postcode counts up to ten characters behind a trigger, without a town."""
    text = F.concat(F.lit("Il habite à "), F.repeat(F.lit("x"), (F.col("c_custkey") % 14 - 1).cast("int")), F.when(F.col("c_custkey") % 14 > 0, " ").otherwise(""), F.lit("16000."))
    return table(spark, sf, "customer").select("c_custkey", F.size(P.coupled_postcodes(text, F.array().cast(T.NO_SPANS))).alias("n"))


@query(f"SELECT c_custkey, 'VOIE' AS type, {_nth('voie')} AS value FROM customer")
def streets_only(spark, sf):
    """The filters by type: streets out of texts that hold a town and a postcode, too."""
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("au 3 a "), _pick("voie"), F.lit(", 75001 "), _pick("commune")).alias("text"))
    found = P.detect_streets(rows, G.seed(spark), "c_custkey", "text")
    return found.select(F.col("doc_id").alias("c_custkey"), F.explode("spans").alias("s")).select("c_custkey", "s.type", "s.value")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM customer")
def trigger_override(spark, sf):
    """Triggers and their window are the caller's."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "Docteur ").otherwise("M. "), _pick("nom")).alias("text"))
    found = E.Engine(spark, KEY, G.seed(spark).where("kind = 'nom'"), triggers=("Docteur",), window=5).detect(rows)
    return found.select(F.col("doc_id").alias("c_custkey"), F.get("spans", F.size("spans") - 1)["confidence"].alias("confidence"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS type FROM events")
def priority_override(spark, sf):
    """Of equal spans the one of the higher priority stays, by the caller's table."""
    s = lambda kind: F.struct(F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit(kind).alias("type"), F.lit("v").alias("value"), F.lit("r").alias("rule_id"), F.lit(0.9).alias("confidence"))
    spans = F.array(s("B"), s("A")).cast(f"array<{SPAN_DDL}>")
    one, two = resolve(spans, {"A": 2, "B": 1}), resolve(spans, {"A": 1, "B": 2})
    return table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, one[0]["type"]).otherwise(two[0]["type"]).alias("type"))


@query(r"SELECT c_custkey, len(regexp_extract_all(c_address, '[A-Za-z]+|[0-9]+'))::INT AS n, regexp_extract(c_address, '[A-Za-z]+|[0-9]+') AS first FROM customer".replace("c_address", "c_name"))
def find_words(spark, sf):
    """Maximal runs of letters, and of digits."""
    w = M.words(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", F.size(w).alias("n"), F.get(w, F.lit(0))["value"].alias("first"))


_CORSE = "('275022A' || lpad(CAST(c_custkey % 1000000 AS STRING), 6, '0'))"


@query(f"SELECT c_custkey, 'nir-2a-shape' AS rule_id, 'NIR' AS type, true AS masked FROM customer WHERE (97 - replace({_CORSE}, '2A', '19')::BIGINT % 97) <> 50")
def nir_corsica(spark, sf):
    """Corsican numbers are found by their shape, whatever their key, and masked."""
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("s").alias("scope"), F.expr(f"'n ' || {_CORSE} || '50 x'").alias("text"), D.is_nir(F.expr(f"{_CORSE} || '50'")).alias("right")).where("not right").drop("right")
    masked, _ = E.Engine(spark, KEY).mask(docs)
    found = docs.select("doc_id", F.get(resolve(T.structured(F.col("text"))), F.lit(0)).alias("s"), F.col("text").alias("clear"))
    return masked.join(found, "doc_id").select(F.col("doc_id").alias("c_custkey"), "s.rule_id", "s.type", (~F.contains("text", F.substring("clear", 3, 15))).alias("masked"))


@query("SELECT c_custkey, 'SIRET' AS type, 'siret-luhn-window' AS rule_id, 2::INT AS start, 19::INT AS \"end\", '55210055400021' AS value FROM customer")
def siret_window(spark, sf):
    """A SIRET that begins a longer run of digits, spaced as it is written."""
    text = F.concat(F.lit("n 552 100 554 00021 "), F.lpad((F.col("c_custkey") % 1000).cast("string"), 4, "0"))
    df = table(spark, sf, "customer").select("c_custkey", text.alias("text"))
    rows = exploded(df, "c_custkey", T.structured(F.col("text"))).where("rule_id = 'siret-luhn-window' and start = 2")
    return rows.select("c_custkey", "type", "rule_id", "start", "end", "value")


@query("SELECT 'EMAIL' AS type, count(*) AS n FROM customer UNION ALL SELECT 'REFERENCE_DOSSIER', count(*) FROM customer")
def top_types(spark, sf):
    """The two most common types, by name among equals."""
    seen = _engine(spark).observe(_letters(spark, sf)).select(F.explode("entities.type").alias("type"))
    return seen.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(2)


@query("SELECT v AS plain, c AS cipher, true AS back FROM (VALUES ('890121234567890000', '750918814058654607'), ('890121234567890000', '018989839189395384'), ('3992520240', '8901801106')) t(v, c)")
def ff3_published_vectors(spark, sf):
    """Published vectors of FF3 and FF3-1, both ways: the surrogates themselves, not only the round trip."""
    from ..functions.crypto import ff3

    #: Fixed values: (key, tweak, plain).
    given = [("EF4359D8D580AA4F7F036D6F04FC6A94", "D8E7920AFA330A73", "890121234567890000"), ("EF4359D8D580AA4F7F036D6F04FC6A94", "9A768A92F60E12D8", "890121234567890000"), ("2DE79D232DF5585D68CE47882AE256D6", "CBD09280979564", "3992520240")]
    rows = []
    for key, tweak, plain in given:
        k, c = bytes.fromhex(key), ff3(F.lit(plain), bytes.fromhex(key), F.lit(tweak))
        rows.append(spark.range(1).select(F.lit(plain).alias("plain"), c.alias("cipher")).withColumn("back", ff3(F.col("cipher"), k, F.lit(tweak), decrypt=True) == F.col("plain")))
    return reduce(DataFrame.unionByName, rows)


@query(f"SELECT c_custkey AS doc_id, c_custkey % 1000 AS k, {SIREN.replace('o_orderkey', 'c_custkey')} AS keep, true AS changed FROM customer WHERE {luhn(SIREN.replace('o_orderkey', 'c_custkey'))} = 0")
def json_text_roundtrip(spark, sf):
    """JSON texts of free form: leaves masked and restored, an exempt path and numbers as they were."""
    v = F.expr(SIREN.replace("o_orderkey", "c_custkey"))
    rows = table(spark, sf, "customer").where(T.is_kind(v, "SIREN")).select(F.col("c_custkey").alias("doc_id"), F.lit("s").alias("scope"), v.alias("v"))
    docs = rows.withColumn("payload", F.to_json(F.struct((F.col("doc_id") % 1000).alias("k"), F.array(F.struct(F.col("v").alias("a"), F.col("v").alias("keep"))).alias("list")))).drop("v")
    e = E.Engine(spark, KEY)
    masked, issued = Txt.mask_json(e, docs, "doc_id", "payload", "scope", exempt=["$.list[*].keep"])
    back = Txt.unmask_json(e, masked, issued, "doc_id", "payload", "scope", exempt=["$.list[*].keep"]).select("doc_id", F.col("payload").alias("back"))
    both = masked.join(back, "doc_id").join(docs.select("doc_id", F.col("payload").alias("clear")), "doc_id")
    field = lambda c, path: F.get_json_object(c, path)
    changed = (field("payload", "$.list[0].a") != field("clear", "$.list[0].a")) & (field("back", "$.list[0].a") == field("clear", "$.list[0].a"))
    return both.select("doc_id", field("payload", "$.k").cast("long").alias("k"), field("payload", "$.list[0].keep").alias("keep"), changed.alias("changed"))


@query("SELECT 60::BIGINT AS n, 60::BIGINT AS surrogates, 60::BIGINT AS fitting")
def coherent_postcodes(spark, sf):
    """Postcodes of the department of the surrogate of the town beside them, one each."""
    towns = F.element_at(F.array(*(F.lit(t.partition(":")[0]) for t in G.SEED["commune"])), (F.col("id") % len(G.SEED["commune"]) + 1).cast("int"))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("s").alias("scope"), F.concat(F.lit("Il habite à "), F.lpad((F.col("id") * 1009 + 1000).cast("string"), 5, "0"), F.lit(" "), towns, F.lit(".")).alias("text"))
    masked, issued = E.Engine(spark, KEY, G.seed(spark), coherent_postcodes=True).mask(docs)
    said = masked.select(F.regexp_extract("text", "à ([0-9]{5}) (.*)[.]$", 1).alias("code"), X.fold_key(F.regexp_extract("text", "à ([0-9]{5}) (.*)[.]$", 2)).alias("key"))
    dept = G.seed(spark).where("kind = 'commune'").select("key", F.when(F.col("departement").isin("2A", "2B"), "20").otherwise(F.col("departement")).alias("d"))
    return said.join(dept, "key").agg(F.count("*").alias("n"), F.countDistinct("code").alias("surrogates"), F.count_if(F.col("code").startswith(F.col("d"))).alias("fitting"))


@query(f"SELECT c_custkey AS doc_id, true AS changed, true AS same FROM customer")
def mask_rows_as_engine(spark, sf):
    """The stateless mask of streams gives what the engine gives, for every type without a gazetteer."""
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("scope"), F.expr(f"'le ' || {_BORN} || ', vu ' || {_SEEN} || ', ' || {_CAR} || ', ' || {_TEL} || ', ' || {_REF} || ', ' || {_MAIL} || ' ou ' || {_OLD_MAIL}").alias("text"))
    alone = E.mask_rows(docs, KEY, reference_patterns=["DOS-[0-9]{6}"]).select("doc_id", F.col("text").alias("alone"))
    whole, _ = _engine(spark).mask(docs)
    both = whole.join(alone, "doc_id").join(docs.select("doc_id", F.col("text").alias("clear")), "doc_id")
    return both.select("doc_id", (F.col("text") != F.col("clear")).alias("changed"), (F.col("text") == F.col("alone")).alias("same"))


@query(f"SELECT c_custkey::VARCHAR AS conv, {_letters_sql()} || ' puis ' || {_letters_sql()} AS text FROM customer WHERE c_custkey <= 30")
def unmask_chunks(spark, sf):
    """Masked texts cut into chunks anywhere, restored as a stream: a surrogate cut by a chunk's end is held back."""
    docs = _letters(spark, sf).where("doc_id <= 30").withColumn("text", F.concat("text", F.lit(" puis "), "text"))
    e = _engine(spark)
    masked, issued = e.mask(docs)
    reg = Reg.Registry(spark, folder(spark, "registry"))
    reg.append(issued)
    at, n = folder(spark, "chunks"), 5
    size = F.ceil(F.length("text") / n).cast("int")
    chunks = masked.select(F.col("doc_id").cast("string").alias("conv"), "scope", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("seq"), F.substr("text", i * size + 1, size).alias("text"), (i == n - 1).alias("done")))).alias("c")).select("conv", "scope", "c.*")
    for part in ("seq < 3", "seq >= 3"):  # a file, and so a batch, each
        chunks.where(part).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        streams.unmask_to(stream, e, reg, f"{at}/out", f"{at}/tails", f"{at}/checkpoint").awaitTermination()
    out = spark.read.schema("conv string, scope string, text string, batch int").parquet(f"{at}/out")
    return out.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch", "text"))), lambda x: x["text"]), "").alias("text"))
