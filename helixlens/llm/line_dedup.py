"""Operator 6: line deduplication with two Bloom filters.

Every task marks the hashes of its lines in a filter of those seen once and, when they are there already, in a filter
of those seen twice. Filters merge bitwise: twice-seen is either twice-seen, or once-seen on both sides. Only lines in
the final twice-seen filter, the suspected repeats, are shuffled, as digests, for an exact count and the choice of the
document that keeps them. A false positive of a filter costs a shuffled digest and never changes a result.

The filters' size follows the text. Up to MAX_BITS they are merged on the driver and broadcast. Beyond that they are
split by hash into shards of SHARD_BITS, each held by one task: the digests of all lines go to their shard, sorted and
packed, with the documents that hold them, and the shard's two filters let through the suspected ones alone.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add, documents, even_keys, has, join_counted, joined_slices, map_rows, packed, probes, signed, sliced, slices, text_of, unpacked

MIN_LENGTH = 20
MIN_DOCUMENTS = 3
#: Bits of a filter that is broadcast, at most (64 MB), and of a shard of a larger one, which half a gigabyte of text fills.
MAX_BITS, SHARD_BITS = 1 << 29, 1 << 26
#: Lines that a task packs at a time.
BLOCK_LINES = 1 << 19
#: A filter has about a bit for so many bytes of text.
BYTES_A_BIT = 8

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_length: int = MIN_LENGTH) -> bytes | None:
    """Key of a line in UTF-8: stripped, A-Z lowered; None if it has fewer code points than min_length."""
    key = line.strip(_STRIP).translate(_LOWER)
    if len(key) < min_length or len(key) < 4 * min_length and len(key.decode("utf-8", "replace")) < min_length:
        return None
    return key


def keys_of(text: str, min_length: int) -> list[bytes | None]:
    return [line_key(x, min_length) for x in text.encode("utf-8", "replace").split(b"\n")]


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _filters(bits: int, min_length: int):
    def run(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in sliced(batches):
            keys = [k for t in batch.column(0).to_pylist() for k in {*keys_of(t, min_length)} - {None}]
            if not keys:
                continue
            # Within a batch, a second occurrence is found by sorting; across batches, by the filter.
            distinct, n = np.unique(hashes(keys), return_counts=True)
            at = probes(distinct, bits)
            add(twice, at[(n > 1) | has(once, at)])
            add(once, at)
        for (s, one), (_, two) in zip(slices(once), slices(twice), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([one], pa.binary()), pa.array([two], pa.binary())], names=["slice", "once", "twice"])

    return run


def _merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    once = twice = np.zeros(1, np.uint8)
    for a, b in zip(rows["once"], rows["twice"], strict=True):
        a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
        once, twice = once | a, twice | b | (once & a)
    return pd.DataFrame({"slice": [key[0]], "bits": [zlib.compress(twice.tobytes(), 1)]})


def filter_bits(texts: DataFrame) -> int:
    """Bits of each filter for all lines of texts(text): a power of two."""
    return 1 << max(16, ((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES_A_BIT).bit_length())


def repeat_filter(texts: DataFrame, min_length: int, bits: int) -> np.ndarray:
    """The twice-seen filter of all lines of texts(text) on the driver."""
    pieces = texts.mapInArrow(_filters(bits, min_length), "slice int, once binary, twice binary")
    return joined_slices(pieces.groupBy("slice").applyInPandas(_merge, "slice int, bits binary"), bits)


def _sharded(shards: list[int], min_length: int):
    """A task: the digests of each block of its documents' lines, packed by shard with the ids of the documents that hold them."""

    def blobs(ids, owners, digests):
        code = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
        owner, shard = np.array(owners, np.int64), (code[:, 1] % np.uint64(len(shards))).astype(np.int64)
        order = np.lexsort((code[:, 0], shard))
        ends = np.searchsorted(shard[order], np.arange(len(shards) + 1)).tolist()
        known, value = np.array([i is not None for i in ids]), np.array([i or 0 for i in ids], np.int64)
        for key, lo, hi in zip(shards, ends, ends[1:], strict=False):
            if lo < hi:
                own = order[lo:hi]
                used, which = np.unique(owner[own], return_inverse=True)
                blob = packed([code[own, 0], code[own, 1], which, value[used].view(np.uint64), known[used].astype(np.uint8)], (0,))
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([blob], pa.binary())], names=["shard", "blob"])

    def run(batches):
        ids, owners, digests = [], [], []
        for batch in sliced(batches):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {*keys_of(t, min_length)} - {None}
                digests += [hashlib.sha256(k).digest()[:16] for k in own]
                owners += [len(ids)] * len(own)
                ids.append(i)
            if len(digests) >= BLOCK_LINES:
                yield from blobs(ids, owners, digests)
                ids, owners, digests = [], [], []
        if digests:
            yield from blobs(ids, owners, digests)

    return run


def _suspected(bits: int):
    """A shard: its digests through filters of those seen once and twice; then, of each, whether it was seen twice."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        once, twice, out = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8), []
        for blob in rows["blob"]:
            distinct, n = np.unique(unpacked(blob)[0], return_counts=True)
            at = probes(distinct, bits)
            add(twice, at[(n > 1) | has(once, at)])
            add(once, at)
        for blob in rows["blob"]:
            high, low, which, value, known = unpacked(blob)
            hit = np.flatnonzero(has(twice, probes(high, bits)))
            digests = np.column_stack([high[hit], low[hit]]).astype(">u8").tobytes()
            ids = pd.Series(signed(value)[which[hit]], dtype="Int64").mask(known[which[hit]] == 0)
            out.append(pd.DataFrame({"doc_id": ids, "digest": [digests[16 * k : 16 * k + 16] for k in range(len(hit))]}))
        return pd.concat(out)

    return run


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """One row per row of docs: doc_id, text (without dropped lines), n_lines, n_dropped.

    A line's key is the line stripped of white space, A-Z lowered. Keys of at least min_length code points found in at
    least min_documents documents lose all their lines but those of the largest id holding them. A null or empty text
    is one empty line, too short to go. Rows that repeat an id are one document to the count and share its fate; null
    ids are one document, below all others.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    bits = filter_bits(rows.select("text"))
    few = bits <= MAX_BITS
    if few:
        twice = docs.sparkSession.sparkContext.broadcast(repeat_filter(rows.select("text"), min_length, bits).tobytes())

    def suspects():
        bitmap = np.frombuffer(twice.value, np.uint8)

        def one(batch):
            ids, keys = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = list({*keys_of(t, min_length)} - {None})
                keys += own
                ids += [i] * len(own)
            if keys:
                hit = np.flatnonzero(has(bitmap, probes(hashes(keys), bits))).tolist()
                yield {"doc_id": [ids[j] for j in hit], "digest": [hashlib.sha256(keys[j]).digest()[:16] for j in hit]}

        return one

    # Used several times below: all read the one exchange of distinct().
    if few:
        suspected = map_rows(rows, suspects, "doc_id long, digest binary").distinct()
    else:
        shards = even_keys(max(1, bits // SHARD_BITS))
        sharded = rows.mapInArrow(_sharded(shards, min_length), "shard long, blob binary").repartition(len(shards), "shard")
        suspected = sharded.groupBy("shard").applyInPandas(_suspected(min(bits, SHARD_BITS)), "doc_id long, digest binary").distinct()
    repeated = (
        suspected.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n") >= min_documents)
    )
    lost = (
        join_counted(suspected, repeated, "digest", "n")
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.collect_list("digest").alias("lost"))
    )

    def rebuild():
        def one(batch):
            out = {"doc_id": batch.column(0), "text": [], "n_lines": [], "n_dropped": []}
            for t, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines, dropped = t.split("\n"), 0
                if gone:
                    gone, kept = {*gone}, []
                    for line in lines:
                        key = line_key(line.encode("utf-8", "replace"), min_length)
                        if key is None or hashlib.sha256(key).digest()[:16] not in gone:
                            kept.append(line)
                    t, dropped = "\n".join(kept), len(lines) - len(kept)
                out["text"].append(t)
                out["n_lines"].append(len(lines))
                out["n_dropped"].append(dropped)
            yield out

        return one

    both = rows.join(lost.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "text", "lost")
    return map_rows(both, rebuild, "doc_id long, text string, n_lines long, n_dropped long")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
