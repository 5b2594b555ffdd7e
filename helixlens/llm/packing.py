"""Operator 8: best-fit packing of token sequences by hierarchical residual packing.

Each task tokenises its documents and packs them best-fit, longest first, by itself. Nearly full bins are final. The
others travel up a tree as items: every round packs the open bins of FAN_IN neighbours best-fit again and closes what
has become nearly full. More open bins than one task should hold are dealt at random over several, so that each gets a
share of every size, and at the root that is repeated until no bins fit together. Only descriptions of open bins move in the tree; pieces learn their place by one join.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable, map_rows, text_of

CAPACITY = 1024
#: The id that ends each document.
END = 2
#: Bins with at most this many free tokens are final at once.
SLACK = 4
#: Neighbours whose open bins meet in one task of a round.
FAN_IN = 16
#: Open bins that meet in one task, about; more are dealt over several tasks.
TASK_BINS = 100_000
SPECIAL = "<|endoftext|>"


def encoder(path: str | None = None):
    """text -> array of the ids that the tokenizers library gives for the vocabulary file.

    The ranks file of the same vocabulary holds the same merges and is several times faster; a text with a special
    token's string goes through the tokenizers library itself.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = []

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text or path:
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json")))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)

    return encode


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and what each bin holds: longest first, into the fullest bin that has room.

    Bins wait by free room; the rooms that occur are bits of one integer, so the best room is its lowest bit from the
    item's size up.
    """
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, used = 0, []
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = bits >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                bits &= ~(1 << room)
        else:
            room, b = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if room > size:
            waiting[room - size].append(b)
            bits |= 1 << (room - size)
    return bins, offsets, used


def _pieces(make_encoder, capacity: int):
    """A task: tokenise and cut all documents, pack at the end of the input."""

    def run(batches):
        import pyarrow as pa

        encode, part = make_encoder(), TaskContext.get().partitionId()
        ids, cols = [], {k: [] for k in ("piece", "start", "length", "ids_crc32")}
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                tokens = np.append(encode(text), np.uint32(END))
                n, at, piece = len(tokens), 0, 0
                while at < n:
                    step = (n - at) % capacity or capacity
                    ids.append(batch.column(0)[i])
                    for k, v in zip(cols, (piece, at, step, zlib.crc32(tokens[at : at + step].astype("<u4").tobytes())), strict=True):
                        cols[k].append(v)
                    at, piece = at + step, piece + 1
        bins, offsets, used = best_fit(cols["length"], capacity)
        for lo in range(0, len(ids), 50_000):
            cut = slice(lo, lo + 50_000)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x.as_py() for x in ids[cut]], pa.int64()), pa.array(cols["piece"][cut], pa.int32()),
                    *(pa.array(cols[k][cut], pa.int64()) for k in ("start", "length", "ids_crc32")),
                    pa.array([part << 32 | b for b in bins[cut]], pa.int64()), pa.array(offsets[cut], pa.int64()), pa.array([used[b] for b in bins[cut]], pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "used"],
            )

    return run


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, used long"
BINS = "part long, used long, members array<struct<bin: long, base: long>>, open boolean"


def _merge(capacity: int, slack: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("used", kind="stable", ascending=False).reset_index(drop=True)
        sizes = rows["used"].tolist()
        bins, offsets, used = best_fit(sizes, capacity)
        members: list[list] = [[] for _ in used]
        for i, (b, at) in enumerate(zip(bins, offsets, strict=True)):
            members[b] += [{"bin": int(m["bin"]), "base": int(m["base"]) + at} for m in rows["members"][i]]
        return pd.DataFrame({"part": rows["part"].iloc[0], "used": used, "members": members, "open": [u < capacity - slack for u in used]})

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, slack: int = SLACK, tokenizer_path: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and END; one longer than capacity is cut, its first piece taking the remainder. A null or
    empty text is one piece of length 1; an empty table gives no rows. Pieces fill their sequence from 0 without gaps.
    Rows that repeat an id (of an integer type, null allowed) are packed each by itself.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    placed = durable(rows.mapInArrow(_pieces(lambda: encoder(tokenizer_path), capacity), PIECES))
    open_bins = (
        placed.filter(F.col("used") < capacity - slack)
        .groupBy("bin")
        .agg(F.first("used").alias("used"))
        .select(
            F.shiftright("bin", 32).alias("part"), "used",
            F.array(F.struct(F.col("bin"), F.lit(0).cast("long").alias("base"))).alias("members"), F.lit(True).alias("open"),
        )
    )
    parts = (placed.agg(F.max("bin")).first()[0] or 0) >> 32
    done, rounds, root = None, 0, parts == 0
    while not root:
        parts //= FAN_IN
        open_bins = open_bins.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
        while True:
            count = open_bins.groupBy("part").count().agg(F.max("count"), F.sum("count")).first()
            deals, rounds = -(-(count[0] or 0) // TASK_BINS) or 1, rounds + 1
            deal = F.pmod(F.xxhash64(F.col("members")[0]["bin"], F.lit(rounds)), F.lit(deals))
            grouped = durable(open_bins.withColumn("deal", deal).groupBy("part", "deal").applyInPandas(_merge(capacity, slack), BINS))
            root = parts == 0
            # At the root, what the least bin does not fit into is final; the others meet anew in other tasks, until none fit together.
            still = F.col("open")
            if root:
                least = grouped.filter("open").agg(F.min("used")).first()[0] or 0
                last = deals == 1 or grouped.count() == count[1]
                still = F.lit(False) if last else still & (F.col("used") + least <= capacity)
            closed = grouped.filter(~still)
            done = closed if done is None else done.unionByName(closed)
            open_bins = grouped.filter(still)
            if not root or last:
                break
    if done is None:
        done = open_bins
    moved = (
        done.select(F.col("members")[0]["bin"].alias("sequence"), F.explode("members").alias("m"))
        .filter((F.col("m.bin") != F.col("sequence")) | (F.col("m.base") != 0))
        .select(F.col("m.bin").alias("bin"), "sequence", F.col("m.base").alias("base"))
    )
    return placed.join(moved, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("sequence", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


SQL = None
