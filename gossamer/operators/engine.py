"""The engine: observe, mask and unmask tables of texts, whose scope is a column; policy, audit and report."""

from __future__ import annotations

import re
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnresolvedSpanError
from ..functions.crypto import check_key, hmac_sha256, joined
from ..functions.runs import fill, template
from ..functions.text import in_case, let, one_case, rewritten, written
from ..schemas import LABELS, SCHEMA_VERSION
from ..sources import gazetteers, paths, registry
from .arbitrate import resolve, rewrite
from .detect import NO_SPANS, references, dates, emails, plates, structured, text_dates
from .match import HITS, believe, choose, search
from .names import TRIGGERS, WINDOW, name_spans
from .places import PLACE_TOKEN, leftmost_longest, place_candidates, with_postcodes
from .postcodes import coherent
from .surrogates import GAZETTEER_KIND, NUMBERS, STREAM, apply_capitals, asked, built, canonical, clear_hmac, email_capitals, nonce, permuted_all, with_surrogates

WEAK = 0.8


class Engine:
    """Reversible pseudonyms for tables of texts.

    `key`: 16, 24 or 32 bytes. `gazetteer`: a table as of `sources.gazetteers`, or None to leave names and places out.
    `coherent_postcodes` puts postcodes into the department of the surrogate of the commune beside them; they then depend
    on the values of one call, as places are given out. `policy`: "permissive", or "strict" to refuse texts with resolved
    spans of a confidence below 0.8.

    Spans, values and texts to be restored, which are used several times, are persisted; `close`, or leaving the
    engine's `with` block, frees them. `calls` counts the calls of observe and mask.
    """

    def __init__(self, spark: SparkSession, key: bytes, gazetteer: DataFrame | None = None, reference_patterns: list[str] | None = None, policy: str = "permissive", triggers=TRIGGERS, window: int = WINDOW, priority: dict[str, int] | None = None, coherent_postcodes: bool = False):
        if policy not in ("permissive", "strict"):
            raise ValueError("the policy is permissive or strict")
        for p in reference_patterns or []:
            re.compile(p)
        self.spark, self.key, self.gazetteer, self.patterns, self.policy = spark, check_key(key), gazetteer, reference_patterns or [], policy
        self.triggers, self.window, self.priority = triggers, window, priority
        self.coherent = coherent_postcodes and gazetteer is not None
        self.calls, self._kept = 0, []

    @cached_property
    def version(self) -> str | None:
        """The gazetteers' version, worked out when it is first asked for."""
        return gazetteers.version(self.gazetteer) if self.gazetteer is not None else None

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist())
        return self._kept[-1]

    def close(self) -> None:
        """Free what was persisted; tables that were returned can still be read, and are worked out again then."""
        while self._kept:
            self._kept.pop().unpersist()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def detect(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """`docs` with `spans`, resolved. Without a gazetteer all is done within the row; else spans of names and places
        are gathered in one aggregation, and the texts are joined to them once."""
        t, none = F.col(text), F.array().cast(NO_SPANS)
        docs_, names_ = _keyed(docs, doc_id, text), docs.columns
        inside = F.struct(structured(t).alias("numbers"), F.concat(dates(t), text_dates(t), emails(t), plates(t), references(t, self.patterns)).alias("rest"))
        rows = docs_.withColumn("_in", inside)
        parts = [F.coalesce("_in.numbers", none)]
        if self.gazetteer is not None:
            names = name_spans(docs_, self.gazetteer, "_key", text, self.triggers, self.window)
            places = place_candidates(docs_, self.gazetteer, "_key", text, self.triggers, self.window)
            found = names.unionByName(places, allowMissingColumns=True).groupBy(F.col("doc_id").alias("_key")).agg(F.array_sort(F.collect_list("s")).alias("_names"), leftmost_longest(F.collect_list("cand")).alias("_places"))
            rows = rows.join(found, "_key", "left")
            parts += [F.coalesce("_names", none), with_postcodes(t, F.col("_places"))]
        parts.append(F.coalesce("_in.rest", none))
        return rows.select(*names_, resolve(reduce(F.concat, parts), self.priority).alias("spans"))

    def observe(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, entities): what would be masked. Nothing is changed or issued."""
        self.calls += 1
        return self.detect(docs, doc_id, text).select(doc_id, F.col("spans").alias("entities"))

    def check_policy(self, found: DataFrame) -> None:
        """A strict policy refuses weak spans before anything is replaced; it names types only."""
        if self.policy == "strict":
            weak = found.select(F.explode("spans").alias("s")).where(F.col("s.confidence") < WEAK).select("s.type").distinct().orderBy("type")
            types = [r["type"] for r in weak.collect()]
            if types:
                raise UnresolvedSpanError("weak spans of " + ", ".join(types))

    def values(self, found: DataFrame, scope: str) -> DataFrame:
        """(scope, entity_type, value, clear_hmac, format_pattern): distinct values of the spans, one row each."""
        s = F.col("z.spans")
        rows = found.select(F.col(scope).cast("string").alias("scope"), F.explode(F.arrays_zip("spans", "raws")).alias("z"))
        raw = F.col("z.raws")
        pattern = F.when(s["type"].isin(*GAZETTEER_KIND), written(s["value"], raw, PLACE_TOKEN)).when(s["type"].isin(*NUMBERS), template(raw)).when(s["type"] == "EMAIL", email_capitals(raw))
        rows = rows.select("scope", s["type"].alias("entity_type"), canonical(s["type"], s["value"]).alias("value"), pattern.alias("format_pattern"))
        rows = rows.groupBy("scope", "entity_type", "value").agg(F.min("format_pattern").alias("format_pattern"))
        return rows.withColumn("clear_hmac", clear_hmac(self.key, F.col("scope"), F.col("entity_type"), F.col("value")))

    def issue(self, values: DataFrame) -> DataFrame:
        """Values with their surrogates: each distinct value is encrypted once. See `residue` for those that have none."""
        return with_surrogates(values, self.key, self.gazetteer).where("out is not null").withColumnRenamed("out", "surrogate")

    def residue(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: str = "scope") -> DataFrame:
        """(entity_type, values, in_clear, fixed_points): distinct values that `mask` leaves in clear as they have no
        surrogate, and those whose surrogate equals them. Counts only; permutations have no fixed point, FF3-1 may."""
        out = with_surrogates(self.values(self._spans(docs, doc_id, text, scope), scope), self.key, self.gazetteer)
        same = F.when(F.col("entity_type").isin(*GAZETTEER_KIND), canonical(F.col("entity_type"), F.col("out"))).otherwise(F.col("out")) == F.col("value")
        return out.groupBy("entity_type").agg(F.count("*").alias("values"), F.count_if(F.col("out").isNull()).alias("in_clear"), F.count_if(F.coalesce(same, F.lit(False))).alias("fixed_points"))

    def _spans(self, docs: DataFrame, doc_id: str, text: str, scope: str) -> DataFrame:
        """(_key, doc_id, scope, spans, raws): the spans and what is written there."""
        raws = F.transform("spans", lambda s: F.substr(F.col(text), s["start"] + 1, s["end"] - s["start"]))
        return _keyed(self.detect(docs, doc_id, text), doc_id, text, scope).select("_key", doc_id, scope, "spans", raws.alias("raws"))

    def mask(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: str = "scope") -> tuple[DataFrame, DataFrame]:
        """(`docs` with masked text and `entities`, registry rows of all issued surrogates).

        Offsets of entities are those of the masked text. A name all in capitals, small letters or title case lends its
        surrogate that case, so that each writing comes back as it was. Rows are told apart by id, scope and a hash of the text: ids may repeat
        or be null. Spans and issued values are persisted, without the texts (see `close`).
        """
        self.calls += 1
        found = self._keep(self._spans(docs, doc_id, text, scope))
        self.check_policy(found)
        issued = self._keep(self.issue(self.values(found, scope)))
        if self.coherent:
            issued = self._keep(coherent(found, issued, self.gazetteer, self.key, scope))
        s = F.col("s")
        # what is shuffled to meet the surrogates is not the span, only where it is and the case it is in
        case = F.when(s["type"].isin(*GAZETTEER_KIND), one_case(s["value"]))
        spans = found.select("_key", F.col(scope).cast("string").alias("scope"), F.explode("spans").alias("s")).select("_key", "scope", s["type"].alias("entity_type"), canonical(s["type"], s["value"]).alias("value"), s["start"].alias("start"), s["end"].alias("end"), case.alias("case"))
        joined_ = spans.join(issued.select("scope", "entity_type", "value", "surrogate"), ["scope", "entity_type", "value"], "left")
        shown = F.when(F.col("entity_type").isin(*GAZETTEER_KIND), in_case(F.col("surrogate"), F.col("case"))).otherwise(F.col("surrogate"))
        put = F.struct("start", "end", F.col("entity_type").alias("type"), shown.alias("surrogate"))
        by_doc = joined_.groupBy("_key").agg(F.array_sort(F.collect_set(put)).alias("_put"))
        rows = _keyed(docs, doc_id, text, scope).join(by_doc, "_key", "left").withColumn("_r", rewrite(F.col(text), F.col("_put")))
        masked = rows.select(*(F.col("_r.text").alias(text) if c == text else F.col(c) for c in docs.columns), F.col("_r.entities").alias("entities"))
        rows_ = issued.select("scope", "entity_type", "clear_hmac", "surrogate", "format_pattern", "mode", F.lit(self.version).cast("string").alias("gazetteer_version"), F.lit(SCHEMA_VERSION).alias("schema_version"))
        return masked, rows_

    def restore(self, issued: DataFrame) -> DataFrame:
        """(scope, surrogate, clear, name, odd) of registry rows: the clear value in its written form; the bare name that
        takes the case of a hit, null for other types; whether some writing of the name was not in one case."""
        # a coherent postcode is restored by the index in `mode`
        coded = (F.col("entity_type") == "CODE_POSTAL") & F.col("mode").isNotNull()
        rows = issued.select("scope", "entity_type", F.when(coded, F.col("mode")).otherwise(F.col("surrogate")).alias("value"), "mode", "format_pattern", F.col("surrogate").alias("shown"))
        back = with_surrogates(rows, self.key, self.gazetteer, back=True).where("out is not null")
        kind, form, out = F.col("entity_type"), F.col("format_pattern"), F.col("out")
        name = kind.isin(*GAZETTEER_KIND)
        clear = F.when(name & form.isNotNull(), rewritten(out, form)).when(kind.isin(*NUMBERS), fill(form, out)).when(kind == "EMAIL", apply_capitals(out, form)).otherwise(out)
        return back.select("scope", F.col("shown").alias("surrogate"), clear.alias("clear"), F.when(name, out).alias("name"), (name & form.isNotNull()).alias("odd"))

    def located(self, docs: DataFrame, clear: DataFrame, doc_id: str, text: str, scope: str) -> DataFrame:
        """(doc_id, scope, h, said): the hits of `clear` (scope, surrogate) in each text that are believed, and what is
        written there."""
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(scope).cast("string").alias("t_scope"), F.col(text).alias("text"))
        hits = search(rows, clear.select("scope", "surrogate"), self._keep).where("hits is not null")
        kept = hits.select("doc_id", F.col("t_scope").alias("scope"), "text", F.explode(choose(believe(F.col("text"), F.col("hits").cast(HITS)))).alias("h"))
        return kept.select("doc_id", "scope", "h", F.substr("text", F.col("h.start") + 1, F.col("h.end") - F.col("h.start")).alias("said"))

    def unmask(self, docs: DataFrame, issued: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: str = "scope") -> DataFrame:
        """`docs` with every issued surrogate of its scope, in any of its writings, replaced by the clear value.

        Only surrogates in the registry are restored. Each is decrypted once, not once a hit. A name takes the case in
        which its surrogate is written; one that was not in one case, or not with single blanks, comes back for the
        surrogate as it was issued, in the first of such forms.
        """
        clear = self._keep(self.restore(issued).groupBy("scope", "surrogate").agg(F.min(F.struct("clear", "name", "odd")).alias("c")))
        # read twice, for their words and to be rewritten, so what made the texts runs once
        own = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c != text}
        rows = self._keep(docs.select(*(F.col(c).alias(n) for c, n in own.items()), F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h")).alias("doc_id"), F.col(scope).cast("string").alias("t_scope"), F.col(text).alias("text")))
        found = search(rows, clear, self._keep)

        def put(h: Column, t: Column) -> Column:
            def span(x: Column) -> Column:
                c, said, surrogate = x["c"], x["said"], h["surrogate"]
                as_said = c["name"].isNotNull() & (F.lower(said) == F.lower(surrogate)) & ~(c["odd"] & (said == surrogate)) & one_case(said).isNotNull()
                back = F.when(F.coalesce(as_said, F.lit(False)), in_case(c["name"], one_case(said))).otherwise(c["clear"])
                return F.struct(h["start"].alias("start"), h["end"].alias("end"), F.lit("CLEAR").alias("type"), back.alias("surrogate"))

            met = F.get(F.filter(t["met"], lambda m: m["surrogate"] == h["surrogate"]), F.lit(0))
            return let(F.struct(met["c"].alias("c"), F.substr(t["text"], h["start"] + 1, h["end"] - h["start"]).alias("said")), span)

        chosen = F.struct("text", "met", choose(believe(F.col("text"), F.col("hits").cast(HITS))).alias("hits"))
        spans = F.when(F.col("hits").isNotNull(), let(chosen, lambda t: F.array_sort(F.transform(t["hits"], lambda h: put(h, t)))))
        done = found.withColumn("_put", spans).withColumn("_r", rewrite(F.col("text"), F.col("_put")))
        return done.select(*(F.col("_r.text").alias(text) if c == text else F.col(own[c]).alias(c) for c in docs.columns))


def _keyed(docs: DataFrame, doc_id: str, text: str, scope: str | None = None) -> DataFrame:
    """`docs` with `_key`, which tells rows apart as far as their answers may differ: id, scope and a hash of the text."""
    more = [] if scope is None else [F.col(scope).cast("string").alias("scope")]
    return docs.withColumn("_key", F.struct(F.col(doc_id).alias("id"), *more, F.xxhash64(text).alias("h")))


def audit(found: DataFrame, key: bytes, text: str, scope: str, at: Column | None = None, spans: str = "spans") -> DataFrame:
    """One line a document: timestamp, scope, digest, span_count_by_type, rule_ids, weak_spans. No value is in it."""
    s = F.col(spans)
    types = F.array_sort(F.array_distinct(F.transform(s, lambda x: x["type"])))
    counts = F.map_from_entries(F.transform(types, lambda t: F.struct(t.alias("key"), F.size(F.filter(s, lambda x: x["type"] == t)).alias("value"))))
    weak = F.transform(F.filter(s, lambda x: x["confidence"] < WEAK), lambda x: F.struct(x["type"].alias("entity_type"), x["confidence"].alias("confidence"), x["rule_id"].alias("rule_id")))
    when = F.date_format(at if at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return found.select(when.alias("timestamp"), F.col(scope).cast("string").alias("scope"), hmac_sha256(key, F.col(text).cast("binary")).alias("digest"), counts.alias("span_count_by_type"), F.array_sort(F.array_distinct(F.transform(s, lambda x: x["rule_id"]))).alias("rule_ids"), weak.alias("weak_spans"))


def report(found: DataFrame, version: str | None = None, spans: str = "spans") -> DataFrame:
    """One row with `markdown`: texts, spans, a table by type, the rules, the gazetteers' version. No timestamp."""
    rows = found.select(F.explode(spans).alias("s"))
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    line = F.concat(F.lit("| "), F.coalesce(F.try_element_at(labels, F.col("type")), F.col("type")), F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))
    table = rows.groupBy("s.type").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("type", line.alias("line")))).alias("t"), F.sum("n").alias("spans"))
    rules = rows.agg(F.array_sort(F.collect_set("s.rule_id")).alias("rules"))
    texts = found.agg(F.count("*").alias("texts"))
    # three rows of one fact each become one
    one = texts.unionByName(table, allowMissingColumns=True).unionByName(rules, allowMissingColumns=True).agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("texts", "t", "spans", "rules")))
    parts = [F.lit("# Rapport d'activité\n"), F.concat(F.lit("- Textes : "), F.col("texts").cast("string")), F.concat(F.lit("- Entités : "), F.coalesce("spans", F.lit(0)).cast("string")), F.lit("\n| Type | Nombre |\n| --- | --- |"), F.array_join(F.transform("t", lambda x: x["line"]), "\n"), F.concat(F.lit("\n- Règles : "), F.array_join("rules", ", ")), F.lit(f"- Gazetteers : {version or '-'}")]
    return one.select(F.concat_ws("\n", *parts).alias("markdown"))


# --- trees ----------------------------------------------------------------------------------------------------------------


def leaves(schema: T.DataType, path: str = "", exempt: list[str] | None = None, live: list | None = None) -> list[str]:
    """Paths of the string leaves of a type that are not exempt (see `sources.paths`): `a.b`, `a[*].b`."""
    live = paths.parse(exempt) if live is None else live
    if isinstance(schema, T.StringType):
        return [] if paths.ends(live) else [path]
    if isinstance(schema, T.StructType):
        return [x for f in schema.fields for x in leaves(f.dataType, f"{path}.{f.name}".lstrip("."), None, paths.step(live, f.name))]
    if isinstance(schema, T.ArrayType):
        return leaves(schema.elementType, f"{path}[*]", None, paths.step(live, paths.ANY))
    if isinstance(schema, T.MapType):
        return leaves(schema.valueType, f"{path}[*]", None, paths.step(live, paths.ANY))
    return []


def map_leaves(column: Column, schema: T.DataType, fn, exempt: list[str] | None = None, live: list | None = None) -> Column:
    """The same tree with `fn` on each string leaf that is not exempt. Keys and other values stay."""
    live = paths.parse(exempt) if live is None else live
    if isinstance(schema, T.StringType):
        return column if paths.ends(live) else fn(column)
    if isinstance(schema, T.StructType):
        return F.when(column.isNotNull(), F.struct(*(map_leaves(column[f.name], f.dataType, fn, None, paths.step(live, f.name)).alias(f.name) for f in schema.fields)))
    if isinstance(schema, (T.ArrayType, T.MapType)):
        inner = schema.elementType if isinstance(schema, T.ArrayType) else schema.valueType

        def each(at: Column, x: Column) -> Column:
            out = map_leaves(x, inner, fn, None, paths.step(live, paths.ANY))
            for k in paths.named(live, int if isinstance(schema, T.ArrayType) else str):
                out = F.when(at == k, map_leaves(x, inner, fn, None, paths.step(live, k))).otherwise(out)
            return out

        return F.transform(column, lambda x, i: each(i, x)) if isinstance(schema, T.ArrayType) else F.transform_values(column, each)
    return column


def mask_numbers(text: Column, scope: Column, key: bytes) -> Column:
    """Numbers and phones of a text masked within the row: pure expressions, for trees."""
    from ..functions.crypto import scope_tweak
    from .surrogates import number_surrogate

    put = F.transform(resolve(structured(text)), lambda s: F.struct(s["start"], s["end"], s["type"], number_surrogate(s["type"], s["value"], key, scope_tweak(key, scope)).alias("surrogate")))
    return rewrite(text, put)["text"]


def mask_rows(texts: DataFrame, key: bytes, text: str = "text", scope: str = "scope", reference_patterns: list[str] | None = None) -> DataFrame:
    """`texts` with every type masked that needs no gazetteer, each row by itself: numbers, dates, e-mails, plates and
    references. No shuffle and no state, so it serves streams; the surrogates are those of `Engine.mask`."""
    from ..functions.crypto import scope_tweak
    from .detect import formats

    of, none = F.col(scope).cast("string"), F.lit(None)
    rows = texts.withColumns({"_s": resolve(formats(F.col(text), reference_patterns)), "_tweak": scope_tweak(key, of)})
    ask = F.transform("_s", lambda s: asked(s["type"], canonical(s["type"], s["value"]), none.cast("string"), none.cast("long"), none.cast("long"), none.cast("string")))
    rows = rows.withColumn("_p", permuted_all(key)(of, ask))

    def put(s: Column, p: Column) -> Column:
        v = canonical(s["type"], s["value"])
        stream = F.concat(F.lit(STREAM), nonce(key, of, s["type"], v))
        return F.struct(s["start"], s["end"], s["type"], built(s["type"], v, p, stream, key, of, F.col("_tweak")).alias("surrogate"))

    masked = rewrite(F.col(text), F.zip_with("_s", "_p", put))["text"]
    return rows.select(*(masked.alias(c) if c == text else F.col(c) for c in texts.columns))
