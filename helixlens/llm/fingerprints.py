"""Operator 7: document fingerprints by winnowing.

All k-grams of code points are hashed with a rolling (prefix-sum) hash; of every window of WINDOW hashes the least is
chosen, the rightmost of equals, and kept with its position. Any run of K + WINDOW - 1 code points that two texts
share therefore has a chosen hash in common, and no run shorter than K can. Texts of under 128 code points have smaller
grams and windows by a fixed rule of their length, so that a run of three quarters of the text is still enough.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable, even_keys, map_rows, piece_hash, prefix_hash, tasks, text_of

K = 24
WINDOW = 73


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes (32 bits) and their positions, ascending. A text shorter than k is one gram; an empty one has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    start = np.arange(max(1, len(codes) - k + 1))
    hashes = piece_hash(prefix_hash(codes), start, np.minimum(start + k, len(codes))) >> np.uint64(32)
    # Hash in the high half and the position, counted down, in the low half: the least is the rightmost least hash.
    best = hashes << np.uint64(32) | np.uint64(0xFFFFFFFF) - start.astype(np.uint64)
    width = min(window, len(best))
    have = 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    best = best[np.flatnonzero(np.diff(best, prepend=best[0] ^ np.uint64(1)))]
    return (best >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (best & np.uint64(0xFFFFFFFF))).astype(np.int64)


def sizes(n: int, k: int = K, window: int = WINDOW) -> tuple[int, int]:
    """k and window for a text of n code points: halved until three quarters of it are sure to share a chosen hash."""
    while k + window > 2 and 3 * n < 4 * (k + window - 1):
        k, window = max(1, k // 2), max(1, window // 2)
    return k, window


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of the distinct chosen hashes of two texts; two empty texts are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def fingerprint(hashes: np.ndarray, positions: np.ndarray) -> str:
    """position:hash in hexadecimal, comma-joined: equal for equal texts."""
    return ",".join(f"{p:x}:{h:08x}" for p, h in zip(positions.tolist(), hashes.tolist(), strict=True))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, positions and hashes (arrays) of its winnowed text; none for null and empty texts."""

    def make():
        def one(batch):
            got = [winnow(t, *sizes(len(t), k, window)) for t in batch.column(1).to_pylist()]
            yield {"doc_id": batch.column(0), "positions": [p for _, p in got], "hashes": [h.astype(np.int64) for h, _ in got]}

        return one

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return map_rows(rows, make, "doc_id long, positions array<long>, hashes array<long>")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Rows dealt into ranges of ids and sorted, each range followed by a copy of the next range's first row.

    Bounds are approximate quantiles of the ids; they decide only where a row is worked on. A range needs no more than
    one row from elsewhere, so texts move once and there is no global window.
    """
    n = tasks(docs)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] or [])) if n > 1 else []

    @F.pandas_udf("long")
    def range_of(i: pd.Series) -> pd.Series:
        return i.isna() * len(bounds) + np.searchsorted(bounds, i.fillna(0), side="right") * i.notna()

    if bounds:
        part = range_of("doc_id")
    else:
        part = F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("part", part)
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("code"))
    firsts = sorted((r["part"], r["key"]) for r in rows.groupBy("part").agg(F.min(key).alias("key")).collect())
    if not firsts:
        return rows.withColumns({"tail": F.lit(False), "code": F.lit(0)}), n
    # firsts has a row per range, at most as many as there are shuffle partitions.
    before = [(firsts[i - 1][0], k["doc_id"], k["code"]) for i, (_, k) in enumerate(firsts)]
    tails = docs.sparkSession.createDataFrame(before, "to long, first long, first_code long")
    tails = (
        rows.withColumn("code", F.xxhash64("text"))
        .join(F.broadcast(tails), F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("code") == F.col("first_code")))
        .select("doc_id", "text", F.col("to").alias("part"), F.lit(True).alias("tail"), "code")
    )
    return rows.select("doc_id", "text", "part", F.lit(False).alias("tail"), F.xxhash64("text").alias("code")).unionByName(tails), n


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(k: int, window: int):
    def row(doc_id, text, following):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        (h, p), (eh, ep), (nh, _) = (winnow(t, *sizes(len(t), k, window)) for t in (text, edited, following))
        sha = hashlib.sha256(edited.encode()).hexdigest()
        return doc_id, len(text), sha, fingerprint(h, p), fingerprint(eh, ep), likeness(h, eh), likeness(h, nh)

    def run(batches):
        held, out = None, []
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        for batch in batches:
            for doc_id, text, part, tail in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and held[2] == part:
                    out.append(row(held[0], held[1], text))
                held = None if tail else (doc_id, text, part)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    return run


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: its fingerprint, that of its edited text, and likenesses.

    The edited text has its last quarter (rounded down) replaced by as much of the start of the next document, by
    ascending id; the last one's next is the first, and a single document is its own next. Null ids come last, rows
    that repeat an id in the order of a hash of their texts. Null texts are empty; two empty texts have likeness 1.
    """
    rows, n = with_next(docs, id_col, text_col)
    keys = F.array(*[F.lit(k).cast("long") for k in even_keys(n + 1)])  # a range a task; null ids, if any, are one more
    dealt = rows.withColumn("task", F.element_at(keys, F.col("part").cast("int") + 1)).repartition(n + 1, "task").sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_last(), "code")
    return dealt.select("doc_id", "text", "part", "tail").mapInArrow(_edited(k, window), EDITED)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(documents(spark, sf_dir))


SQL = None
