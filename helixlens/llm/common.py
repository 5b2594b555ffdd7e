"""Helpers shared by the document operators.

Conventions that hold for every operator here:

* Only the columns an operator names are read, and whole rows travel as one struct, so further columns never clash.
* A null text is an empty text; a null id is an id of its own that sorts after all others.
* A repeated id means several documents: each row counts and gets its own result row.
"""

from __future__ import annotations

import ctypes
import gc
import pickle
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of every contract: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Have the shuffle files of finished queries deleted: that follows when the driver collects what refers to them."""
    gc.collect()
    spark._jvm.System.gc()


def settle(spark: SparkSession) -> None:
    """tidy, and have the executors give free heap back too: a JVM otherwise keeps the most that any stage before took."""
    tidy(spark)
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session (a test) gets one of its own; a cluster has none to fall back on."""
    named, sc = spark.conf.get("spark.checkpoint.dir", ""), spark.sparkContext
    if not named and not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="helixlens-"))
    return named or sc.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: for whole documents, which a columnar file keeps small."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def row_key(id_col: Column, code: Column) -> Column:
    """Key of a row: its id and a hash of its text, which tells rows apart that share an id."""
    return F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("null")), code)


def repeat_rows(docs: DataFrame, counted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of docs, columns unchanged; counted(doc_id, code, n) has a row for each, which appears n times (0: not at all).

    code is xxhash64 of the text. Rows that share id and text are interchangeable to counted: their numbers are added
    up and given to them in turn, the first ones one more. Rows travel as one struct, so their columns never clash.
    """
    key = row_key(F.col("doc_id"), F.col("code"))
    named = counted.groupBy(key.alias("key")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).filter("n > 0")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row_key(F.col(f"`{id_col}`"), F.xxhash64(text_of(f"`{text_col}`"))).alias("key"), whole.alias("row"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    times = F.floor(F.col("n") / F.col("m")).cast("int") + (F.col("turn") <= F.col("n") % F.col("m")).cast("int")
    return rows.join(named, "key").withColumn("turn", turn).withColumn("copy", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of docs that kept(doc_id, code, kept) marks; of rows that share id and text as many as are marked."""
    return repeat_rows(docs, kept.select("doc_id", "code", F.col("kept").cast("int").alias("n")), id_col, text_col)


def running_sums(df: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """df range-sorted by order, with `name = sum of the (long) column over all rows before this one` for each name=column.

    Ranges are written to the shared folder, one partial sum a range (as many as shuffle partitions) goes to the driver,
    and each task runs along its range with what lies before it, in constant memory: no task sees more than its range.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ranged = df.repartitionByRange(tasks(df), *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    ranged = durable(ranged)
    own = ranged.groupBy("range").agg(*[F.sum(c).alias(n) for n, c in sums.items()]).collect()
    ahead, at = {}, dict.fromkeys(sums, 0)
    for row in sorted(own, key=lambda r: r["range"]):
        ahead[row["range"]] = dict(at)
        at = {n: at[n] + (row[n] or 0) for n in sums}
    schema = ranged.drop("range").schema
    for n in sums:
        schema = schema.add(n, "long")
    out = to_arrow_schema(schema)

    def run(batches):
        before = None
        for batch in batches:
            if batch.num_rows:
                before = before or dict(ahead[batch.column("range")[0].as_py()])
                columns = [batch.column(f.name) for f in out if f.name not in sums]
                for n, c in sums.items():
                    values = np.asarray(batch.column(c).fill_null(0))
                    upto = before[n] + np.cumsum(values)
                    columns.append(pa.array(upto - values))
                    before[n] = int(upto[-1])
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return ranged.mapInArrow(run, schema)


#: A key with more than this share of the rows is hot.
HOT_SHARE = 1 / 4096


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, size: str) -> DataFrame:
    """rows.join(keyed, key), keyed having one row a key whose column `size` is at most the number of its rows.

    Hot keys are at most 1 / HOT_SHARE whatever the size of the tables, so they are broadcast and their rows stay where
    they are. Of each other key at most HOT_SHARE of all rows meet in a shuffle.
    """
    rows = rows.filter(F.col(key).isNotNull())
    hot = F.col(size) > rows.agg(F.count(F.lit(1)) * HOT_SHARE).scalar()
    # An outer join with a mark: an anti join would be moved below an exchange of rows, which could then not be reused.
    marks = F.broadcast(keyed.filter(hot).select(key, F.lit(True).alias("__hot")))
    few = rows.join(marks, key, "left").filter(F.col("__hot").isNull()).drop("__hot")
    return rows.join(F.broadcast(keyed.filter(hot)), key).unionByName(few.join(keyed.filter(~hot), key))


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, size: str) -> DataFrame:
    """join_counted for stored rows: the hot keys are looked up first, and without any a plain join remains."""
    return _join_known(rows, keyed, key, keyed.filter(F.col(size) > rows.count() * HOT_SHARE))


def join_skewed(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """join_hot, keyed having one row a key and rows, which are stored, any number: they are counted first."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__size"))
    return _join_known(rows, keyed, key, sizes.filter(F.col("__size") > rows.count() * HOT_SHARE))


def _join_known(rows: DataFrame, keyed: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    known = [bytes(k) if isinstance(k, bytearray) else k for (k,) in hot.select(key).collect()]  # at most 1 / HOT_SHARE
    if not known:
        return rows.join(keyed, key)
    here = F.col(key).isin(known)
    met = rows.filter(here).join(F.broadcast(keyed.filter(here)), key)
    return met.unionByName(rows.filter(~here).join(keyed.filter(~here), key))


def tasks(df: DataFrame) -> int:
    """Shuffle partitions of the session: what a stage is dealt over."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _murmur3(x: int) -> int:
    """Spark's hash (public MurmurHash3, seed 42) of a non-negative long."""
    full, h = 0xFFFFFFFF, 42
    turn = lambda k, r: (k << r | k >> 32 - r) & full
    for k in (x & full, x >> 32):
        h = turn(h ^ turn(k * 0xCC9E2D51 & full, 15) * 0x1B873593 & full, 13) * 5 + 0xE6546B64 & full
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & full
    h = (h ^ h >> 13) * 0xC2B2AE35 & full
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def even_keys(n: int) -> list[int]:
    """n longs that a hash exchange over n partitions deals one to each: key i goes to partition i."""
    found: dict[int, int] = {}
    x = 0
    while len(found) < n:
        found.setdefault(_murmur3(x) % n, x)
        x += 1
    return [found[i] for i in range(n)]


#: Rows of an Arrow batch that Python works on at a time: texts of thousands of rows at once would fill a worker.
SLICE_ROWS = 256


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def hand_back() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which its task hands memory back: workers are reused, and their allocators keep the most that a task took."""

    def wrapped(batches):
        yield from run(batches)
        hand_back()

    return wrapped


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str) -> DataFrame:
    """mapInArrow with a function made once a task: it gets slices of batches and yields dicts of column arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        f = make()
        for cols in (x for part in sliced(batches) for x in f(part)):
            yield pa.RecordBatch.from_arrays([pa.array(cols[x.name], type=x.type) for x in out], schema=out)

    return df.mapInArrow(lean(run), schema)


def packed(columns: list[np.ndarray], ascending: tuple[int, ...]) -> bytes:
    """Columns of numbers in few bytes: differences of ascending ones, the narrowest type of the others, like bytes together."""
    out = []
    for i, x in enumerate(columns):
        if i in ascending:
            x = np.diff(x, prepend=x.dtype.type(0))
        elif x.dtype != np.uint64:
            x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
        out.append((x.dtype.str, len(x), np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()))
    return zlib.compress(pickle.dumps((ascending, out), 5), 1)


def unpacked(blob: bytes) -> list[np.ndarray]:
    ascending, columns = pickle.loads(zlib.decompress(blob))
    out = [np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(kind).ravel() if n else np.zeros(0, kind) for kind, n, raw in columns]
    return [np.cumsum(x, dtype=x.dtype) if i in ascending else x for i, x in enumerate(out)]


#: Probes of a Bloom filter, and the pieces in which it travels to its merge.
PROBES, SLICES = 3, 64


def probes(h: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers of each hash, one row a hash: double hashing modulo a power of two."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def add(bitmap: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(bitmap, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


def slices(bitmap: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Number and compressed bytes of each piece of a bitmap."""
    size = max(1, len(bitmap) // SLICES)
    return ((s, zlib.compress(bitmap[lo : lo + size].tobytes(), 1)) for s, lo in enumerate(range(0, len(bitmap), size)))


def joined_slices(pieces: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of pieces(slice, bits) on the driver."""
    bitmap = np.zeros(bits // 8, np.uint8)
    size = max(1, len(bitmap) // SLICES)
    for at, piece in pieces.toLocalIterator():
        bitmap[at * size : (at + 1) * size] = np.frombuffer(zlib.decompress(piece), np.uint8)
    return bitmap


#: Bits of a Bloom filter for a key, and at most (32 MB): a fuller filter lets more pass and loses nothing.
BITS_A_KEY, MAX_BLOOM_BITS = 16, 1 << 28


def bloom(keys: DataFrame, n: int) -> np.ndarray:
    """Bitmap of the n 64-bit hashes keys(key long), merged by slices; on the driver, for a broadcast of bounded size."""
    bits = min(MAX_BLOOM_BITS, 1 << max(16, (BITS_A_KEY * n).bit_length()))

    def run(batches):
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            add(own, probes(np.asarray(batch.column(0)).view(np.uint64), bits))
        if own.any():
            rows = list(slices(own))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["slice", "bits"])

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(b), np.uint8) for b in rows["bits"]])
        return pd.DataFrame({"slice": [key[0]], "bits": [zlib.compress(own.tobytes(), 1)]})

    pieces = keys.select("key").mapInArrow(run, "slice int, bits binary").groupBy("slice").applyInPandas(merge, "slice int, bits binary")
    return joined_slices(pieces, bits)


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32(doc_id as text) mod `mod` = `rest`; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse modulo 2**64, to the powers 0 to n - 1 (kept, doubled when too short)."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 12)
        base = np.full(size, _BASE)
        inv = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        base[0] = inv[0] = 1
        _powers[0], _powers[1] = np.multiply.accumulate(base), np.multiply.accumulate(inv)
    return _powers[0][:n], _powers[1][:n]


_table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Sums of code * base**i: differences of two are hashes of the pieces between, up to a power of the base."""
    values = _table[codes] if codes.dtype == np.uint8 else mix64(codes.astype(np.uint64) + np.uint64(0x51ED2701))
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(values * powers(len(codes) + 1)[0][: len(codes)], out=out[1:])
    return out


def piece_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces [start, end), the same wherever a piece stands."""
    return mix64((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = ~_IS_SPACE[raw]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    raw = np.frombuffer(text, np.uint8)
    start, end = word_bounds(raw)
    return piece_hash(prefix_hash(_LOWER[raw] if lower else raw), start, end) if len(start) else np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
