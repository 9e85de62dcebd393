"""Finding issued surrogates in texts that were rewritten, and which hits to believe."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.text import drop_inner_spaces, let, matches, overlaps, title

HITS = "array<struct<start: int, end: int, surrogate: string, exact: boolean>>"


def variants(surrogate: Column) -> Column:
    """The ways a surrogate may be written: itself, lower, upper, capitals, digits by three, initials, blanks closed up."""
    words = F.split(F.trim(surrogate), r"\s+")
    last = F.get(words, F.size(words) - 1)
    digits = F.regexp_replace(surrogate, "[^0-9]", "")
    grouped = F.when((F.length(digits) >= 3) & (digits == surrogate), F.trim(F.regexp_replace(digits, "(?<=[0-9])(?=([0-9]{3})+$)", " ")))
    fore = F.when((F.length(digits) >= 3) & (digits == surrogate), F.trim(F.regexp_replace(digits, "([0-9]{3})(?=[0-9])", "$1 ")))
    several = (F.size(words) >= 2) & ~surrogate.rlike("[0-9]")
    out = F.array(
        surrogate, F.lower(surrogate), F.upper(surrogate), F.when(~surrogate.rlike("[0-9@]"), F.array_join(F.transform(words, title), " ")), fore, grouped,
        F.when(several, F.concat(F.lit("M. "), last)), F.when(several, F.concat(F.lit("M "), last)), F.when(several, F.concat(F.lit("M."), last)),
        F.when(several, F.array_join(words, " ")), F.when(several, F.array_join(words, "")),
    )
    return F.array_distinct(F.filter(out, lambda v: v.isNotNull() & (v != "")))


def words(text: Column) -> Column:
    """Maximal runs of letters, and of digits, with offsets."""
    return matches(text, r"\p{L}+|[0-9]+")


def bounded(text: Column, start: Column, end: Column) -> Column:
    """Neither edge continues a run of letters or of digits."""

    def open_(a: Column, b: Column) -> Column:
        return (a.rlike(r"^\p{L}$") & b.rlike(r"^\p{L}$")) | (a.rlike("^[0-9]$") & b.rlike("^[0-9]$"))

    at = lambda i: F.substr(text, i + 1, F.lit(1))
    left = F.when(start > 0, open_(at(start - 1), at(start))).otherwise(False)
    return ~left & ~F.coalesce(open_(at(end - 1), at(end)), F.lit(False))


def covered(word: Column, hits: Column) -> Column:
    """Whether hits (start, end) cover the word without a gap: their running end must reach each next start."""
    inside = F.array_sort(F.filter(hits, lambda h: overlaps(h, word)))
    reach = F.aggregate(inside, word["start"], lambda acc, h: F.when(h["start"] <= acc, F.greatest(acc, h["end"])).otherwise(acc))
    return reach >= word["end"]


def quote(literal: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(literal, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def believe(text: Column, hits: Column, short: int = 4) -> Column:
    """Hits with both boundaries; of the others those of `short` characters and more whose whole words all hits of that
    length cover (surrogates written together)."""

    def rule(t: Column) -> Column:
        long_ = F.filter(t["hits"], lambda h: F.length(h["surrogate"]) >= short)
        in_words = lambda h: F.forall(F.filter(t["words"], lambda w: overlaps(w, h)), lambda w: covered(w, long_))
        return F.filter(t["hits"], lambda h: bounded(t["text"], h["start"], h["end"]) | ((F.length(h["surrogate"]) >= short) & in_words(h)))

    return let(F.struct(text.alias("text"), hits.alias("hits"), words(text).alias("words")), rule)


def choose(hits: Column) -> Column:
    """Non-overlapping hits by start: exact writings first, then longer ones, then by place and surrogate."""
    keyed = F.transform(hits, lambda h: F.struct((~h["exact"]).alias("e"), (h["start"] - h["end"]).alias("l"), h["start"].alias("s"), h["surrogate"].alias("t"), h.alias("h")))
    keep = lambda kept, x: F.when(F.exists(kept, lambda k: overlaps(k, x["h"])), kept).otherwise(F.concat(kept, F.array(x["h"])))
    return F.array_sort(F.aggregate(F.array_sort(keyed), F.array().cast(HITS), keep))


WORD = r"(?:\p{L}++|[0-9]++)"
_APART = r"[^\p{L}0-9\s]*+"


def runs_of_three(text: Column) -> Column:
    """Three words each, with what is between them, where no white space is; they overlap."""
    begin = r"(?:(?<!\p{L})(?=\p{L})|(?<![0-9])(?=[0-9]))"
    return F.regexp_extract_all(text, F.lit(f"{begin}(?=({WORD}{_APART}{WORD}{_APART}{WORD}))"), F.lit(1))


def inside(plain: Column) -> Column:
    """What is between the first and the last word: its words are whole wherever a text holds `plain`."""
    return F.regexp_replace(F.regexp_replace(plain, rf"^[^\p{{L}}0-9]*{WORD}", ""), rf"{WORD}[^\p{{L}}0-9]*$", "")


#: Counters of words, and bits of the set of anchors: what they cannot tell apart only makes more meetings.
COUNTERS, BITS = 1 << 18, 1 << 26


def _bit(at):
    """The bit of a hash: a column's, or those of an array of numpy."""
    return F.shiftright(at, 30).bitwiseAND(F.lit(BITS - 1)) if isinstance(at, Column) else (at >> 30) & (BITS - 1)


def _rarest(counts: np.ndarray):
    """A column function: for each variant, of the hashes of its words the one with the lowest counter, of equals that
    of the longest word; null without words."""

    @arrow_udf("array<long>")
    def run(hashes: pa.Array, lengths: pa.Array) -> pa.Array:
        inner = hashes.flatten()
        of = inner.value_lengths().to_numpy(zero_copy_only=False)
        at, n = inner.flatten().to_numpy(zero_copy_only=False), lengths.flatten().flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(of)), of)
        order = np.lexsort((at, -n, counts[at & (COUNTERS - 1)], owner))
        some = of > 0
        out = np.zeros(len(of), np.int64)
        out[some] = at[order][(np.cumsum(of) - of)[some]]
        begin = np.concatenate(([0], np.cumsum(hashes.value_lengths().to_numpy(zero_copy_only=False))))
        return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(out, pa.int64(), mask=~some))

    return run.asNondeterministic()


def _among(bits: np.ndarray):
    """A column function: the hashes whose bit is set."""

    @arrow_udf("array<long>")
    def run(hashes: pa.Array) -> pa.Array:
        at = hashes.flatten().to_numpy(zero_copy_only=False)
        bit = _bit(at)
        there = (bits[bit >> 6] >> (bit & 63)) & 1 == 1
        owner = np.repeat(np.arange(len(hashes)), hashes.value_lengths().to_numpy(zero_copy_only=False))
        begin = np.concatenate(([0], np.cumsum(np.bincount(owner[there], minlength=len(hashes)))))
        return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(at[there], pa.int64()))

    return run.asNondeterministic()


def _dense(rows: DataFrame, size: int) -> np.ndarray:
    """(i, n) as an array; at most `size` rows come to the driver."""
    t, out = rows.toArrow(), np.zeros(size, np.int64)
    out[np.asarray(t.column(0))] = np.asarray(t.column(1))
    return out


def _more(surrogates: DataFrame) -> list[str]:
    return [c for c in surrogates.columns if c not in ("scope", "surrogate")]


def anchors(surrogates: DataFrame) -> DataFrame:
    """(v_scope, surrogate, at) and what other columns `surrogates` has: the hashes of the anchors of its variants.

    The anchor is the word, or run of three inner words, that the fewest surrogates of the scope hold, by counters that
    words share, so that neither words nor variants are shuffled for the choice.
    """
    word, more = F.lit(r"\p{L}+|[0-9]+"), _more(surrogates)
    v = surrogates.where("scope is not null and surrogate is not null").select(F.col("scope").alias("v_scope"), "surrogate", *more, variants(F.col("surrogate")).alias("variants"))
    # digits are one word whether apart or not, so grouped forms need no anchor of their own
    own = lambda p: F.array_union(F.regexp_extract_all(p, word, F.lit(0)), runs_of_three(inside(p)))
    v = v.withColumn("own", F.transform("variants", lambda x: let(drop_inner_spaces(x), own)))
    v = v.select("v_scope", "surrogate", *more, F.transform("own", lambda o: F.transform(o, lambda w: F.xxhash64("v_scope", w))).alias("hashes"), F.transform("own", lambda o: F.transform(o, F.length)).alias("lengths"))
    held = v.select(F.explode(F.array_distinct(F.transform(F.flatten("hashes"), lambda h: h.bitwiseAND(F.lit(COUNTERS - 1))))).alias("i"))
    counts = _dense(held.groupBy("i").agg(F.count("*").alias("n")), COUNTERS)
    v = v.withColumn("ats", _rarest(counts)("hashes", "lengths"))
    return v.select("v_scope", "surrogate", *more, F.explode(F.array_distinct(F.filter("ats", lambda x: x.isNotNull()))).alias("at"))


def meetings(rows: DataFrame, surrogates: DataFrame, keep=lambda df: df) -> DataFrame:
    """(doc_id, t_scope, surrogate) and others: surrogates that have a variant whose anchor a text of `rows` (doc_id,
    t_scope, text) holds. The scope is the surrogate's; should hashes of two scopes be one, no text has such an id in that scope.

    Only words whose hash may be that of an anchor leave their text, as a hash. `keep` persists the anchors, which are
    read twice.
    """
    v = keep(anchors(surrogates))
    bit = v.select(_bit(F.col("at")).alias("b")).select(F.shiftright("b", 6).alias("i"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("bit"))
    bits = _dense(bit.groupBy("i").agg(F.bit_or("bit").alias("n")), BITS >> 6)
    closed = let(drop_inner_spaces(F.col("text")), lambda c: F.concat(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), runs_of_three(c)))
    there = F.array_union(F.regexp_extract_all("text", F.lit(r"\p{L}+|[0-9]+"), F.lit(0)), closed)
    hashed = rows.where("text is not null and t_scope is not null").select("doc_id", F.transform(there, lambda w: F.xxhash64("t_scope", w)).alias("h"))
    near = hashed.select("doc_id", _among(bits)("h").alias("h")).select("doc_id", F.explode(F.array_distinct("h")).alias("at"))
    return near.join(v, "at").select("doc_id", F.col("v_scope").alias("t_scope"), "surrogate", *_more(surrogates))


def search(rows: DataFrame, surrogates: DataFrame, keep=lambda df: df) -> DataFrame:
    """`rows` (doc_id, t_scope, text and others) with `hits` of the surrogates (scope, surrogate and others), before
    `believe`, and `met`, the others by surrogate; null where no surrogate is met.

    Texts meet variants by words: a variant's anchor is its word, or run of three inner words, that the fewest surrogates
    of the scope hold, the longest of equals, and only texts with that anchor, of the same scope, are searched for it; a
    plain substring test comes before the search. Words alone would not do for digests and permuted local parts, whose
    words of one or two characters are in most texts. Single blanks between digits count for nothing, in texts and in
    variants; hits have their offsets in the text as written.
    """
    pairs = meetings(rows, surrogates, keep).groupBy("doc_id", "t_scope").agg(F.collect_set(F.struct("surrogate", *_more(surrogates))).alias("met"))
    found = rows.join(pairs, ["doc_id", "t_scope"], "left")
    each = F.flatten(F.transform("met", lambda x: F.transform(variants(x["surrogate"]), lambda v: F.struct(x["surrogate"].alias("surrogate"), v.alias("variant")))))
    wanted = let(F.struct(drop_inner_spaces(F.col("text")).alias("c"), each.alias("a")), lambda t: F.filter(t["a"], lambda x: F.contains(t["c"], drop_inner_spaces(x["variant"]))))
    found = found.withColumn("wanted", wanted)
    # variants are made again here, as they would be most of what is shuffled; digits of one may stand apart by blanks
    spaced = lambda x: F.regexp_replace(quote(x["variant"]), r"(?<=[0-9])(?=[0-9])", r"\\E ?\\Q")

    def hits(t: Column) -> Column:
        one = lambda x: F.transform(matches(t["text"], spaced(x)), lambda m: F.struct(m["start"], m["end"], x["surrogate"].alias("surrogate"), (m["value"] == x["surrogate"]).alias("exact")))
        return F.array_distinct(F.flatten(F.transform(t["wanted"], one)))

    return found.select(*rows.columns, F.when(F.size("wanted") > 0, let(F.struct("text", "wanted"), hits)).alias("hits"), "met")


def find(texts: DataFrame, surrogates: DataFrame, doc_id: str, text: str, scope: str, keep=lambda df: df) -> DataFrame:
    """(doc_id, scope, hits) of the texts that hold surrogates (see `search`)."""
    rows = texts.select(F.col(doc_id).alias("doc_id"), F.col(scope).cast("string").alias("t_scope"), F.col(text).alias("text")).where("text is not null")
    return search(rows, surrogates, keep).where("hits is not null").select("doc_id", F.col("t_scope").alias("scope"), "hits")
