"""Best-two-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Saved, documents, tune

#: Both libraries agree on these characters by construction; others go to `tokenizers` itself.
_OTHER = r"[^\t\n\r -~¡-ɏ‐-‧€]"


@lru_cache(maxsize=2)
def _encoders(json_path: str, ranks_path: str | None):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(json_path)
    if not ranks_path:
        return plain, None, None
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    added = [t.content for t in plain.get_added_tokens_decoder().values()]  # these strings become ids of their own
    return plain, fast, re.compile("|".join([_OTHER, *map(re.escape, added)]))


def token_ids(text: str | None, json_path: str, ranks_path: str | None) -> np.ndarray:
    """The ids of a text by the tokenizer file, its added tokens included. `ranks_path`: the same vocabulary for a faster
    library, which serves texts of common characters without a string of an added token."""
    plain, fast, other = _encoders(json_path, ranks_path)
    if not text:
        return np.zeros(0, "<u4")
    if fast is not None and not other.search(text):
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), "<u4")
    return np.array(plain.encode(text, add_special_tokens=False).ids, "<u4")


def plan_bins(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Best-two-fit on a histogram of lengths: [(lengths in a bin, bins so filled)].

    A bin takes the longest item, then again and again the longest that fits. If a gap is left, its smallest item is
    replaced by the two unpacked items whose sum is largest within that item plus the gap, if that is more; a bin's only
    item is its smallest, too. Items of
    one length are alike, and a choice depends on which lengths are left, so a bin is repeated as long as the lengths
    that its choices took are left: the same bins as one by one, in steps that lengths, not items, bound.
    """
    left = np.zeros(size + 1, np.int64)
    for k, v in counts.items():
        left[k] += v
    out = []
    while (there := np.flatnonzero(left)).size:
        bin_, free, gap = [], left.copy(), size
        while gap and (fit := np.flatnonzero(free[: gap + 1])).size:
            n = int(fit[-1])
            k = int(min(free[n], gap // n))
            bin_ += [n] * k
            free[n] -= k
            gap -= n * k
        if gap:
            least = bin_[-1]
            best, pair, room = least, None, least + gap
            have = np.flatnonzero(free[: room + 1])
            i, j = 0, len(have) - 1
            while i <= j and best < room:
                a, b = int(have[i]), int(have[j])
                if a + b > room or (i == j and free[a] < 2):
                    j -= 1
                else:
                    if a + b > best:
                        best, pair = a + b, [b, a]
                    i += 1
            need = Counter(bin_) + Counter(pair or ())
            if pair:
                bin_ = [*bin_[:-1], *pair]
        else:
            need = Counter(bin_)
        used = Counter(bin_)
        times = int(min((left[n] - need[n]) // k + 1 for n, k in used.items()))
        for n, k in used.items():
            left[n] -= times * k
        out.append((bin_, times))
    return out


def _lookup(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first bin, bins, offset), by length and rank: where the r-th item of a length goes."""
    rank: Counter = Counter()
    rows, base = [], 0
    for bin_, times in plan:
        at = 0
        for n in bin_:
            rows.append((n, rank[n], base, times, at))
            rank[n] += times
            at += n
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, doc_id: str, text: str, size: int, end_id: int, json_path: str, ranks_path: str | None) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *T._parse_datatype_string(PIECES).fields[1:]])
    kind = {"long": pa.int64(), "int": pa.int32()}
    id_type = None

    def cut(batches):
        nonlocal id_type
        for b in batches:
            ids, rows = b.column(0), []
            for i, x in enumerate(b.column(1)):
                t = np.append(token_ids(x.as_py(), json_path, ranks_path), np.uint32(end_id)).astype("<u4")
                at = 0
                for p, to in enumerate(range((len(t) - 1) % size + 1, len(t) + 1, size)):
                    rows.append((i, p, at, to - at, zlib.crc32(t[at:to])))
                    at = to
            r = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(r[:, 0])), pa.array(r[:, 1].astype(np.int32), kind["int"]), *(pa.array(r[:, k]) for k in (2, 3, 4))], names=[f.name for f in schema.fields])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, doc_id="doc_id", text="text", size: int = 1024, end_id: int = 2, json_path: str | None = None, ranks_path: str | None = None, part: int = 500_000) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and `end_id`; a longer one is cut so that all pieces but the first are full. The
    driver sees only the histogram of lengths (at most `size` rows) and plans the bins on it (`plan_bins`). Each piece
    then finds its place by its rank among the pieces of its length: ranks are counted within hash buckets of a
    length, `part` rows of the input a bucket, and offset by the sums of the buckets before, so that a common length
    is spread out.

    Null or empty text is one piece of length 1. Null ids are kept. Rows that repeat an id are packed each; rows equal
    in all are exchangeable. An empty table gives an empty table. Extra columns are ignored.
    """
    import public_tokenizers

    spark = docs.sparkSession
    tune(spark)
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or (public_tokenizers.path("byte_bpe_50k.tiktoken") if json_path.endswith("byte_bpe_50k.json") else None)
    cut = Saved(pieces(docs, doc_id, text, size, end_id, json_path, ranks_path), "pieces").df
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    table = _lookup(plan_bins(counts, size))
    parts = max(64, sum(counts.values()) // part)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut.join(sums, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    schema = T.StructType([*cut.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    key = table[:, 0] * (1 << 50) + table[:, 1]

    def place(batches):
        for b in batches:
            n, r = (b.column(k).to_numpy() for k in (3, 5))
            row = table[np.searchsorted(key, n * (1 << 50) + r, side="right") - 1] if len(n) else np.zeros((0, 5), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(row[:, 2] + r - row[:, 1]), pa.array(row[:, 4])], names=schema.names)

    return ranked.select(*cut.columns[:5], "rank").mapInArrow(place, schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places; nulls, repeated rows, empty tables and extra columns as in `pack`."""
    return pack(docs)


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` packed into sequences of 1024 tokens (see `pack`)."""
    return pack(documents(spark, sf_dir))


def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of op9 whatever the ids are: documents, pieces that are no whole document's end, sequences that are
    too long, gaps and overlaps in sequences, pieces of a document that do not follow each other."""
    got = Saved(op9_best_two_fit(spark, sf_dir), "packed").df
    sums = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("first"), F.countDistinct("offset").alias("places"), F.count("*").alias("pieces"))
    by_doc = got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max(F.col("start") + F.col("length")).alias("end"), F.count("*").alias("pieces"), F.max("piece").alias("last"))
    bad = sums.agg(F.count_if(F.col("n") > 1024).alias("too_long"), F.count_if((F.col("end") != F.col("n")) | (F.col("first") != 0) | (F.col("places") != F.col("pieces"))).alias("gaps"))
    docs = by_doc.agg(F.count("*").alias("docs"), F.count_if((F.col("end") != F.col("n")) | (F.col("last") + 1 != F.col("pieces"))).alias("broken"))
    short = got.agg(F.count_if((F.col("piece") > 0) & (F.col("length") != 1024)).alias("short"))
    # three rows of a few sums each become one
    one = bad.unionByName(docs, allowMissingColumns=True).unionByName(short, allowMissingColumns=True)
    return one.agg(*(F.max(c).alias(c) for c in ("docs", "short", "too_long", "gaps", "broken")))


PACKED_SQL = "SELECT count(DISTINCT doc_id) AS docs, 0::BIGINT AS short, 0::BIGINT AS too_long, 0::BIGINT AS gaps, 0::BIGINT AS broken FROM documents"
