"""Document fingerprints: one-permutation MinHash.

Each 5-word shingle is hashed once; the hash's leading bits name its bin and each bin keeps its least value. An empty bin
copies the value of the bin that the first hit of its own fixed random sequence finds filled (optimal densification). The low bits of the
values are packed; the likeness of two fingerprints corrects for values that agree by chance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import short_batches, small
from .wordhash import mix, shingles

SHINGLE = 5
BINS = 512
BITS = 4
ROWS_PER_SLICE = 2000
MOST_SLICES = 20_000
_SHIFT = np.uint64(64 - (BINS - 1).bit_length())
_ATTEMPTS = (8, 64, 512, 8192)
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _probes() -> np.ndarray:
    at = np.arange(_ATTEMPTS[-1] * BINS, dtype=np.uint64).reshape(-1, BINS)
    return (mix(at + np.uint64(0x5851F42D4C957F2D)) >> _SHIFT).astype(np.int16)


_table: list[np.ndarray] = []


def signature(hashes: np.ndarray) -> np.ndarray | None:
    """The low BITS of every bin's value as uint8; None for a text without shingles."""
    if not len(hashes):
        return None
    if not _table:
        _table.append(_probes())
    h = np.sort(hashes)
    bins = (h >> _SHIFT).astype(np.int64)
    first = np.concatenate(([True], bins[1:] != bins[:-1]))
    value, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    value[bins[first]], filled[bins[first]] = h[first], True
    empty = np.flatnonzero(~filled)
    done = 0
    for upto in _ATTEMPTS:
        if not len(empty):
            break
        tried = _table[0][done:upto][:, empty]
        hit = filled[tried]
        found = hit.any(0)
        source = tried[hit.argmax(0), np.arange(len(empty))]
        value[empty[found]] = value[source[found]]
        empty, done = empty[~found], upto
    for b in empty:  # never met a filled bin: the next filled one in order
        value[b] = value[(b + np.argmax(np.roll(filled, -b))) % BINS]
    return (value & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(sig: np.ndarray | None) -> str:
    """Hexadecimal form, BITS per bin; empty for a text without words."""
    return "" if sig is None else ((sig[0::2] << 4) | sig[1::2]).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1. Two texts without words are alike; one is unlike any other."""
    if a is None or b is None:
        return 1.0 if a is None and b is None else 0.0
    chance = 1.0 / (1 << BITS)
    return float(min(1.0, max(0.0, (float((a == b).mean()) - chance) / (1.0 - chance))))


class Borders:
    """Slices of the order (null doc_ids first, doc_id, hash of the text): neighbouring doc_ids share one, and a doc_id of more rows than a slice has some of its own."""

    def __init__(self, cuts: list[int], hot: dict[int, int], nulls: int):
        # A hot doc_id opens a slice, and so does the one after it.
        self.ids = np.array(sorted({*cuts, *hot, *(h + 1 for h in hot if h < (1 << 63) - 1)}), np.int64)
        parts = [hot.get(i, 1) for i in self.ids.tolist()]
        self.first = nulls + 1 + np.concatenate(([0], np.cumsum(parts))).astype(np.int64)
        self.parts, self.nulls = np.array([1, *parts], np.int64), nulls

    def of(self, ids: np.ndarray, null: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ids, ids, "right")
        parts = np.where(null, max(1, self.nulls), self.parts[at])
        # The hash's place among parts equal ranges.
        part = ((hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)) * parts.astype(np.uint64) >> np.uint64(32)
        return np.where(null, 0, np.concatenate(([self.nulls], self.first))[at]) + part.astype(np.int64)


def _sliced(docs: DataFrame, rows: int) -> DataFrame:
    """docs (doc_id, text_) with hash_ and slice_."""
    n = docs.count()
    rows = max(rows, -(-n // MOST_SLICES))
    k = -(-n // rows)
    cuts = docs.select("doc_id").approxQuantile("doc_id", [i / k for i in range(1, k)], 0.1 / k) if k > 1 else []
    # At most MOST_SLICES doc_ids have more rows than a slice.
    hot = {r["doc_id"]: -(-r["count"] // rows) for r in docs.groupBy("doc_id").count().where(F.col("count") > rows).collect()}
    nulls = hot.pop(None, 1 if k else 0)
    borders = docs.sparkSession.sparkContext.broadcast(Borders([int(c) for c in cuts], hot, nulls))

    @F.pandas_udf("long")
    def slice_of(ids: pd.Series, null: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(borders.value.of(ids.to_numpy(), null.to_numpy(), hashes.to_numpy()))

    docs = docs.withColumn("hash_", F.xxhash64("text_"))
    # A null among the numbers would turn them all into doubles.
    return docs.withColumn("slice_", slice_of(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.col("hash_")))


def fingerprints(docs: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """OUT for every row of docs (doc_id, text).

    The edited text is the text with its last floor(n/2) code points replaced by the first as many (or all) of the next
    document's, in ascending doc_id and after the last the first. Documents are dealt into slices of neighbouring doc_id; the first
    document of every slice is also lent to the slice before it (of the first, to the last), so that no order over all rows is needed and only
    slice borders, a few times MOST_SLICES at most, reach the driver. A null text is empty, and fingerprints as the empty string;
    null doc_ids come first; rows of one doc_id, or of none, follow each other by a hash of the text, by which they are dealt if they are many; a lone document is its own next; an
    empty table gives no rows.
    """
    base = _sliced(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text_")), rows_per_slice)
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("o_"), "doc_id", "hash_")).alias("f")
    found = sorted((r["slice_"], r["f"]["doc_id"], r["f"]["hash_"]) for r in base.groupBy("slice_").agg(first).collect())
    rows = [(m, h, found[i - 1][0]) for i, (_, m, h) in enumerate(found)]
    lent = docs.sparkSession.createDataFrame(rows, "m_ long, h_ long, to_ long")
    lent = base.join(F.broadcast(lent), F.col("doc_id").eqNullSafe(F.col("m_")) & (F.col("hash_") == F.col("h_")))
    # One row lends itself, however many are like it.
    lent = lent.groupBy(F.col("to_").alias("slice_")).agg(F.min(F.struct("doc_id", "hash_", "text_")).alias("r")).select("r.doc_id", "r.text_", "r.hash_", "slice_", F.lit(1).alias("kind_"))
    dealt = base.withColumn("kind_", F.lit(0)).unionByName(lent).repartition(max(1, len(found)), "slice_")
    dealt = dealt.sortWithinPartitions("slice_", "kind_", F.col("doc_id").asc_nulls_first(), "hash_", "text_")
    return short_batches(dealt).select("slice_", "kind_", "doc_id", "text_").mapInArrow(_run, OUT)


def _run(batches):
    names = [x.split()[0] for x in OUT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    prior = None  # (slice, doc_id, text, signature) whose next document isn't known yet

    def emit(rows):
        edited = [t[: len(t) - len(t) // 2] + nt[: len(t) // 2] for _, t, _, nt, _ in rows]
        out = {n: [] for n in names}
        for (doc_id, t, sig, _, nsig), e, h in zip(rows, edited, shingles(edited, SHINGLE), strict=True):
            esig = signature(h)
            for n, v in zip(names, (doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), packed(sig), packed(esig), likeness(sig, esig), likeness(sig, nsig)), strict=True):
                out[n].append(v)
        return pa.RecordBatch.from_pydict(out, schema=pa.schema(list(zip(names, types, strict=True))))

    for b in small(batches, 500):
        s, k, ids, texts = (b.column(i).to_pylist() for i in range(4))
        rows = []
        for slice_, kind, doc_id, text, h in zip(s, k, ids, texts, shingles(texts, SHINGLE), strict=True):
            sig = signature(h)
            if prior is not None and prior[0] == slice_:
                rows.append((*prior[1:], text, sig))
            # A lent row only ends its slice.
            prior = None if kind else (slice_, doc_id, text, sig)
        if rows:
            yield emit(rows)
