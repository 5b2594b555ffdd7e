"""Mergeable read statistics over a stream of reads (read_idx, id, seq, qual)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.positions import base_counts, quality_counts


def start_histograms(reads: DataFrame, name: str, checkpoint: str, kind: str = "quality") -> StreamingQuery:
    """Keep the position histogram of all reads so far in the memory table `name`; kind: "quality" or "base".

    The state has a row per position and symbol, whatever the number of reads. The batch reports that need no more
    than a histogram follow from the table.
    """
    counts = quality_counts(reads) if kind == "quality" else base_counts(reads)
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
