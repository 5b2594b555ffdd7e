"""FASTQ files as reads.

`read_fastq` is the scalable way: lines are scanned in splits by Spark's text source and numbered by a small table of
lines per split, so one large file is read by many tasks. `FastqDataSource` is a Python data source for
spark.read.format("fastq"), a partition a file, which also numbers reads of compressed files.
"""

from __future__ import annotations

import gzip
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "read_idx bigint, id string, seq string, qual string"


def records(lines: Iterator[str]) -> Iterator[tuple[int, str, str, str]]:
    """(ordinal from 1, id, seq, qual) of FASTQ lines.

    The id line decides whether line ends are \\r\\n. The third line is not looked at, and quality is cut to the
    sequence's length. A last line may lack its end; a last record of fewer than four lines is an error.
    """
    n = 0
    while (head := next(lines, None)) is not None:
        rest = [next(lines, None) for _ in range(3)]
        if rest[2] is None:
            raise ValueError(f"the last record, number {n + 1}, is incomplete")
        n += 1
        cut = 1 if head.rstrip("\n").endswith("\r") else 0
        own = [x.rstrip("\n")[: len(x.rstrip("\n")) - cut] for x in (head, rest[0], rest[2])]
        yield n, own[0], own[1], own[2][: len(own[1])]


class _FastqReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = urllib.parse.urlparse(partition.value).path
        with (gzip.open if path.endswith(".gz") else open)(path, "rt", encoding="ascii", errors="replace", newline="\n") as f:
            yield from records(f)


class FastqDataSource(DataSource):
    """spark.read.format("fastq").load(path): path may list files, comma-separated; each is numbered by itself."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _FastqReader([p for p in self.options["path"].split(",") if p])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqDataSource)


LINES = "file string, read_idx long, id string, seq string, qual string"


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of batches(file, line, value) that hold whole records in order."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        n = batch.num_rows // 4 * 4
        rest = batch.slice(n) if n < batch.num_rows else None
        if n:
            line = lambda k: batch.column(2).take(pa.array(range(k, n, 4)))  # noqa: B023, E731
            first = pa.array(range(0, n, 4))
            record = pc.add(pc.divide(batch.column(1).take(first), 4), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(first), record, line(0), line(1), line(3)], names=["file", "read_idx", "id", "seq", "qual"])


def read_fastq(spark: SparkSession, path: str | list[str], keep_file: bool = False) -> DataFrame:
    """Reads of one or more FASTQ files: read_idx, id, seq, qual (and file), numbered from 1 in each file.

    Lines are numbered inside a split by their place in the scan, and splits by the lines of those before. Records that
    lie in one split are put together where they are read; of the others, at most one at either end of a split, the
    lines meet in an aggregation. So the text is scanned (for counts, for records, for loose lines) and never shuffled.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    place = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value")
    )
    splits = place.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", "first", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    numbered = place.join(F.broadcast(splits), ["file", "block"]).withColumn("line", F.col("ahead") + F.col("at") - F.col("first"))
    start = F.col("line") - F.col("line") % 4
    inside = (start >= F.col("ahead")) & (start + 4 <= F.col("ahead") + F.col("n"))
    whole = numbered.filter(inside).select("file", "line", "value").mapInArrow(_assembled, LINES)
    part = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    loose = numbered.filter(~inside).groupBy("file", (F.floor(F.col("line") / 4) + 1).alias("read_idx")).agg(F.count(F.lit(1)).alias("lines"), part(0).alias("id"), part(1).alias("seq"), part(3).alias("qual"))
    full = F.when(F.col("lines") == 4, F.col("id")).otherwise(F.raise_error(F.format_string("record %d of %s is incomplete", F.col("read_idx"), "file")))
    rows = whole.unionByName(loose.withColumn("id", full).drop("lines"))
    cut = F.when(F.endswith("id", F.lit("\r")), 1).otherwise(0)
    trimmed = lambda c: F.substring(c, F.lit(1), F.length(c) - cut)
    rows = rows.select("file", "read_idx", trimmed("id").alias("id"), trimmed("seq").alias("seq"), trimmed("qual").alias("qual"))
    rows = rows.withColumn("qual", F.substring("qual", F.lit(1), F.length("seq")))
    return rows if keep_file else rows.drop("file")


def write_fastq(reads: DataFrame, path: str) -> None:
    """reads(id, seq, qual) as FASTQ files, a file a partition, in the order of each partition."""
    reads.select(F.concat_ws("\n", "id", "seq", F.lit("+"), "qual").alias("value")).write.text(path)
