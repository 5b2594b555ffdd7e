"""Operator 2: removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

Only suffixes that start at anchors are sorted. An anchor is the position of the least hashed 8-gram among the first
ANCHOR_SPAN positions of a LENGTH-byte window, so equal windows have their anchor at the same place, and every window
is seen from exactly one anchor, of which at least GRAM bytes to the right lie inside the window. Anchors whose GRAM
occurs once in the corpus cannot lie in a repeat; one aggregation of hashes takes them out. The others become suffix
entries: the bytes right of the anchor that its windows cover, with those left of it as payload.

Tasks sort their entries into runs and exchange them front-coded (shared prefix length, rest), dealt by the hash of the
GRAM, which is the leading part of the sort key; equal entries travel once, and of equal documents only one takes part. Receiving tasks combine runs with a loser
tree that carries common prefix lengths, so known prefixes are never compared again and each entry leaves the tree with
its common prefix with the one before. Inside a cluster of entries with the same GRAM, neighbours by right and by left
context decide which windows repeat; windows they leave open are counted outright.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable, join_counted, map_rows, mix64, piece_hash, prefix_hash, signed, sliced, tasks, text_of

LENGTH = 200
ANCHOR_SPAN = 150
#: Bytes of suffix entries that a task sorts at a time.
RUN_BYTES = 24 << 20
#: A GRAM in more documents than this is hot: its entries travel without their places, which are joined to results.
HOT_DOCUMENTS = 20_000
#: Receiving groups for each shuffle partition.
GROUPS_A_TASK = 2


def anchors(raw: np.ndarray, length: int = LENGTH, span: int = ANCHOR_SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows of raw, and the first and last window start of each."""
    windows = len(raw) - length + 1
    if windows <= 0:
        return (np.zeros(0, np.int64),) * 3
    n = windows + span - 1
    grams = np.lib.stride_tricks.as_strided(raw, (n, 8), (1, 1))
    code = np.ascontiguousarray(grams).view(np.uint64).ravel()
    best = mix64(code) & np.uint64(0xFFFFFFFF00000000) | np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64)
    have = 1
    while have < span:
        step = min(have, span - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    at = (np.uint64(0xFFFFFFFF) - (best & np.uint64(0xFFFFFFFF))).astype(np.int64)
    lo = np.flatnonzero(np.diff(at, prepend=-1))
    return at[lo], lo, np.append(lo[1:], windows) - 1


def gram_hashes(raw: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    return piece_hash(prefix_hash(raw), at, at + gram) if len(at) else np.zeros(0, np.uint64)


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes need no look."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


def front_coded(keys: list[bytes], payload: list) -> bytes:
    """A sorted run: for each key the prefix it shares with the one before, the rest, and what belongs to it."""
    shared = [0] * len(keys)
    for i in range(1, len(keys)):
        shared[i] = common_prefix(keys[i - 1], keys[i])
    rests = [k[h:] for k, h in zip(keys, shared, strict=True)]
    sizes = np.fromiter(map(len, rests), np.uint16, len(rests))
    return zlib.compress(pickle.dumps((np.array(shared, np.uint16), sizes, b"".join(rests), payload), 5), 5)


def decoded(blob: bytes) -> Iterator[tuple[bytes, int, object]]:
    """(key, prefix shared with the one before, payload) of a run."""
    shared, sizes, rests, payload = pickle.loads(zlib.decompress(blob))
    key, at = b"", 0
    for h, size, own in zip(shared.tolist(), sizes.tolist(), payload, strict=True):
        key = key[:h] + rests[at : at + size]
        at += size
        yield key, h, own


def merged(runs: list[Iterator[tuple[bytes, int, object]]]) -> Iterator[tuple[bytes, int, object]]:
    """The runs' entries in order, each with its common prefix with the one before, by a loser tree.

    A waiting entry knows its common prefix with the last winner. Of two, the one with the longer prefix is smaller
    without a comparison; only for equal ones the bytes behind that prefix are looked at.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    heads: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    known = [-1 if x is None else 0 for x in heads]
    losers = [0] * k

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser; the loser learns its common prefix with the winner."""
        if known[i] != known[j]:
            return (i, j) if known[i] > known[j] else (j, i)
        if known[i] < 0:
            return i, j
        a, b = heads[i][0], heads[j][0]
        h = common_prefix(a, b, known[i])
        if a[h : h + 1] <= b[h : h + 1]:
            known[j] = h
            return i, j
        known[i] = h
        return j, i

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while heads[winner] is not None:
        key, _, own = heads[winner]
        yield key, known[winner], own
        heads[winner] = next(runs[winner], None)
        known[winner] = -1 if heads[winner] is None else heads[winner][1]
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def repeated_windows(rights: list[bytes], lefts: list[bytes], shared: list[int], many: list[bool], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each entry of a cluster, sorted by right context, the windows that occur elsewhere too.

    A window is named by d, how far left of the anchor it starts; results are ranges of d, ends included. shared[i] is
    the common prefix of rights i - 1 and i. many: the entry itself occurs more than once, so all its windows repeat.
    Entries x and y share window d when length - (common right context) <= d <= (common left context).
    """
    m = len(rights)
    most_right, most_left = [0] * m, [0] * m
    sure: list[list[tuple[int, int]]] = [[] for _ in range(m)]

    def meet(i: int, j: int, right: int, left: int) -> None:
        for x in (i, j):
            most_right[x] = max(most_right[x], right)
            most_left[x] = max(most_left[x], left)
            if length - right <= left:
                sure[x].append((length - right, left))

    backwards = [x[::-1] for x in lefts]
    for i in range(1, m):
        meet(i - 1, i, shared[i], common_prefix(backwards[i - 1], backwards[i]))
    by_left = sorted(range(m), key=backwards.__getitem__)
    for i, j in zip(by_left, by_left[1:], strict=False):
        meet(i, j, common_prefix(rights[i], rights[j]), common_prefix(backwards[i], backwards[j]))
    open_d: dict[int, list[int]] = {}
    for x in range(m):
        if many[x]:
            sure[x] = [(length - len(rights[x]), len(lefts[x]))]
            continue
        at = length - most_right[x]
        for lo, hi in sorted(sure[x]) + [(most_left[x] + 1, most_left[x])]:
            for d in range(at, min(lo, most_left[x] + 1)):
                open_d.setdefault(d, []).append(x)
            at = max(at, hi + 1)
    for d, asking in open_d.items():
        window = lambda x, d=d: lefts[x][len(lefts[x]) - d :] + rights[x][: length - d]
        seen = Counter(window(x) for x in range(m) if length - len(rights[x]) <= d <= len(lefts[x]))
        for x in asking:
            if seen[window(x)] > 1:
                sure[x].append((d, d))
    return sure


def _grams(length: int, span: int):
    def make():
        def one(batch):
            grams, twice, whole = [], [], []
            for t in batch.column(1).to_pylist():
                whole.append(xxhash.xxh3_128_digest(t))
                raw = np.frombuffer(t, np.uint8)
                own, n = np.unique(gram_hashes(raw, anchors(raw, length, span)[0], length - span + 1), return_counts=True)
                grams.append(signed(own))
                twice.append(signed(own[n > 1]))
            yield {"doc_id": batch.column(0), "code": batch.column(2), "whole": whole, "grams": grams, "twice": twice}

        return one

    return make


def _entries(batches, length: int, span: int) -> Iterator[tuple[bytes, bytes, tuple[int, int, int]]]:
    """(key, left context, place) of each anchor of batches(doc_id, code, text, wanted) whose GRAM is wanted."""
    for batch in batches:
        for doc_id, code, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            raw = np.frombuffer(text, np.uint8)
            at, lo, hi = anchors(raw, length, span)
            grams = gram_hashes(raw, at, length - span + 1)
            for i in np.flatnonzero(np.isin(grams, np.array(wanted, np.int64).view(np.uint64))).tolist():
                a, first = int(at[i]), int(lo[i])
                yield int(grams[i]).to_bytes(8, "big") + text[a : int(hi[i]) + length], text[first:a], (doc_id, code, first)


def entry_id(key: bytes, left: bytes) -> bytes:
    return xxhash.xxh3_128_digest(len(left).to_bytes(4, "big") + left + key)


def _places(length: int, span: int):
    """A task: id and place of its documents' hot entries."""

    def run(batches):
        rows = []
        for key, left, (doc_id, code, first) in _entries(sliced(batches), length, span):
            rows.append({"entry": entry_id(key, left), "doc_id": doc_id, "code": code, "at": first})
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_pylist(rows, _PLACE)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _PLACE)

    return run


_PLACE = pa.schema([("entry", pa.binary()), ("doc_id", pa.int64()), ("code", pa.int64()), ("at", pa.int64())])


def _runs(length: int, span: int, groups: int, places: bool = True):
    """A task: suffix entries of its documents' suspected anchors, as front-coded sorted runs per receiving group.

    Without places, an entry has their number only, up to two.
    """

    def flush(entries: dict):
        order = sorted(entries)
        at = 0
        while at < len(order):
            group, end = int.from_bytes(order[at][0][:8], "big") * groups >> 64, at
            while end < len(order) and int.from_bytes(order[end][0][:8], "big") * groups >> 64 == group:
                end += 1
            own = order[at:end]
            blob = front_coded([k for k, _ in own], [(left, entries[k, left]) for k, left in own])
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([blob], pa.binary())], names=["part", "run"])
            at = end

    def run(batches):
        entries: dict[tuple[bytes, bytes], list] = {}
        size = 0
        for key, left, place in _entries(sliced(batches), length, span):
            own = entries.get((key, left))
            if own is None:
                entries[key, left] = [place if places else None]
                size += len(key) + len(left)
            elif places or len(own) < 2:
                own.append(place if places else None)
            if size > RUN_BYTES:
                yield from flush(entries)
                entries, size = {}, 0
        yield from flush(entries)

    return run


HOT_SPANS = "entry binary, first long, last long"
SPANS = "doc_id long, code long, first long, last long"


def _combine(length: int, places: bool = True):
    """A receiving task: merges its runs and finds the repeated windows of each cluster, at their places or by entry."""

    def clusters(runs):
        """Per GRAM: rights, lefts, common prefixes and occurrences of the distinct entries, in order."""
        gram, rights, lefts, shared, where, twins = None, [], [], [], [], {}
        for key, h, (left, own) in merged([decoded(x) for x in runs]):
            if key[:8] != gram:
                if gram is not None:
                    yield gram, rights, lefts, shared, where
                gram, rights, lefts, shared, where = key[:8], [], [], [], []
            right = key[8:]
            if rights and h == len(key) == len(rights[-1]) + 8:
                twin = twins.get(left)
                if twin is not None:
                    if own[0] is not None or len(where[twin]) < 2:
                        where[twin] += own
                    continue
            else:
                twins = {}
            twins[left] = len(rights)
            rights.append(right)
            lefts.append(left)
            shared.append(max(0, h - 8))
            where.append(own)
        if gram is not None:
            yield gram, rights, lefts, shared, where

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for gram, rights, lefts, shared, where in clusters(rows["run"]):
            many = [len(x) > 1 for x in where]
            if len(rights) == 1 and not many[0]:
                continue
            for right, left, own, ranges in zip(rights, lefts, where, repeated_windows(rights, lefts, shared, many, length), strict=True):
                for near, far in ranges:
                    if places:
                        out += [(i, code, first + len(left) - far, first + len(left) - near) for i, code, first in own]
                    else:
                        out.append((entry_id(gram + right, left), len(left) - far, len(left) - near))
        if not places:
            return pd.DataFrame(out, columns=["entry", "first", "last"])
        return pd.DataFrame(out, columns=["doc_id", "code", "first", "last"]).astype({"doc_id": "Int64"})

    return run


def _cut(length: int):
    def make():
        def one(batch):
            kept, n_bytes, spans = [], [], []
            for text, code, found in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                # last -1: all of the text.
                own: list[list[int]] = []
                for x in sorted((x["first"], len(text) if x["last"] < 0 else x["last"] + length) for x in found or ()):
                    if own and x[0] <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], x[1])
                    else:
                        own.append([*x])
                at = [0, *(y for x in own for y in x), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(at[::2], at[1::2], strict=True)))
                n_bytes.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in own])
            yield {"doc_id": batch.column(0), "kept": kept, "n_bytes": n_bytes, "spans": spans}

        return one

    return make


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, span: int = ANCHOR_SPAN, hot_documents: int = HOT_DOCUMENTS) -> DataFrame:
    """One row per row of docs: doc_id, kept (bytes left), n_bytes, spans (maximal removed runs, ends exclusive).

    Texts are UTF-8 bytes, null is empty. A byte goes when it is covered by a string of `length` bytes that starts
    anywhere else too, in any row, overlapping or not; all strings are judged on the input. Repeated rows are two
    places of the same strings, so all of such a text goes if it is long enough. Texts shorter than length stay whole; a null one gives no bytes. The bytes left need not be UTF-8: a cut may fall inside a character.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    coded = rows.withColumn("code", F.xxhash64("text"))
    grams = durable(map_rows(coded, _grams(length, span), "doc_id long, code long, whole binary, grams array<long>, twice array<long>"))
    # Of equal long texts all goes; only the first takes part in the search, for what others share with it.
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    long = grams.filter(F.size("grams") > 0).select("doc_id", "code", "whole")
    equal = long.groupBy("whole").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    equal = durable(join_counted(long, equal, "whole", "n").select("doc_id", "code", (first == F.col("first")).alias("leads")))
    # A GRAM that a document has at several anchors is suspected even if no other document has it.
    counted = grams.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("hot", F.col("n") > hot_documents)
    listed = join_counted(grams.select("doc_id", F.explode("grams").alias("gram")), counted, "gram", "n").select("doc_id", "gram", "hot")
    # Of these, the ones that are hot are in the list above as well: there they count as hot.
    listed = listed.unionByName(grams.select("doc_id", F.explode("twice").alias("gram"), F.lit(False).alias("hot")))
    wanted = listed.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("gram").alias("wanted"), F.collect_set(F.when(F.col("hot"), F.col("gram"))).alias("hot"))
    copies = equal.filter("not leads").select(F.col("doc_id").alias("copy_id"), F.col("code").alias("copy_code"))
    groups = GROUPS_A_TASK * tasks(docs)
    suspected = (
        coded.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")))
        .join(copies, F.col("doc_id").eqNullSafe(F.col("copy_id")) & (F.col("code") == F.col("copy_code")), "left_anti")
        .select("doc_id", "code", "text", F.array_except("wanted", "hot").alias("wanted"), "hot")
    )
    runs = suspected.select("doc_id", "code", "text", "wanted").mapInArrow(_runs(length, span, groups), "part long, run binary")
    found = runs.groupBy("part").applyInPandas(_combine(length), SPANS)
    # Hot entries: one of each travels, however many places it has; its windows come back to the places by a join.
    hot = suspected.filter(F.size("hot") > 0).select("doc_id", "code", "text", F.col("hot").alias("wanted"))
    hot_runs = hot.mapInArrow(_runs(length, span, groups, places=False), "part long, run binary")
    hot_found = hot_runs.groupBy("part").applyInPandas(_combine(length, places=False), HOT_SPANS)
    places = hot.mapInArrow(_places(length, span), "entry binary, doc_id long, code long, at long")
    hot_found = places.join(hot_found, "entry").select("doc_id", "code", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last"))
    found = found.unionByName(hot_found)
    whole = equal.select("doc_id", "code", F.lit(0).cast("long").alias("first"), F.lit(-1).cast("long").alias("last"))
    spans = found.unionByName(whole).groupBy(F.col("doc_id").alias("id"), F.col("code").alias("c")).agg(F.collect_list(F.struct("first", "last")).alias("found"))
    both = coded.join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("code") == F.col("c")), "left").select("doc_id", "text", "code", "found")
    return map_rows(both, _cut(length), "doc_id long, kept binary, n_bytes long, spans array<struct<start: long, `end`: long>>")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


SQL = r"""
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), p AS (
  SELECT doc_id, h, unnest(range(0, n - 199)) AS p FROM b WHERE n >= 200
), g AS (
  SELECT doc_id, p, md5(substr(h, CAST(2 * p + 1 AS BIGINT), 400)) AS k FROM p
), r AS (
  SELECT doc_id, p FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)
), i AS (
  SELECT doc_id, p, CASE WHEN p > 200 + lag(p) OVER (PARTITION BY doc_id ORDER BY p) THEN 1 ELSE 0 END AS jump FROM r
), j AS (
  SELECT doc_id, p, sum(jump) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM i
), s AS (
  SELECT doc_id, run, min(p) AS a, max(p) + 200 AS z FROM j GROUP BY doc_id, run
), e AS (
  SELECT doc_id, a, z FROM s UNION ALL SELECT doc_id, n, n FROM b
), f AS (
  SELECT e.doc_id, e.a, e.z, coalesce(lag(e.z) OVER (PARTITION BY e.doc_id ORDER BY e.a, e.z), 0) AS before FROM e
), k AS (
  SELECT f.doc_id, sum(f.z - f.a) AS n_removed, count(*) - 1 AS n_spans,
    string_agg(substr(b.h, CAST(2 * f.before + 1 AS BIGINT), CAST(2 * (f.a - f.before) AS BIGINT)), '' ORDER BY f.a, f.z) AS kept
  FROM f JOIN b USING (doc_id) GROUP BY f.doc_id
)
SELECT b.doc_id, CAST(b.n AS BIGINT) AS n_bytes, CAST(k.n_removed AS BIGINT) AS n_removed, CAST(k.n_spans AS BIGINT) AS n_spans,
  sha256(unhex(k.kept)) AS kept_sha256
FROM b JOIN k USING (doc_id)
"""
