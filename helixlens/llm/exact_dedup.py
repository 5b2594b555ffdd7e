"""Operator 1: exact deduplication with a heavy-hitter split, in built-in functions only.

A Misra-Gries summary (the frequent-items sketch behind approx_top_k) names the digests that may hold more than a
fixed share of all rows. One partial aggregation counts those exactly; the verified winners, at most 1 / share rows,
are broadcast, so that rows of a hot group are settled where they are read. All other groups are smaller than that
share and meet in an ordinary shuffle of digests. Texts are read and hashed once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, durable, keep_rows, text_of

#: A digest with at least this share of the rows is heavy; the sketch's error is below it at SKETCH counters.
HEAVY_SHARE = 1 / 1024
SKETCH = 8192
#: Groups of fewer rows than this are never worth a broadcast.
HEAVY_ROWS = 64


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_of(text_col), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, code (xxhash64 of the text as it is).

    Texts are equal when they agree after each run of white space has become one space; null counts as empty, and all
    empty texts are one group (a text of white space only is " ", another group). The smallest id stays; a null id
    only where all are null (keep_id is then null). Of repeated rows with that id exactly one is kept. An empty table
    gives an empty result.
    """
    rows = durable(
        docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(text_col), 256)).alias("digest"), F.xxhash64(text_of(text_col)).alias("raw"))
        .withColumn("code", F.xxhash64("digest"))
        .withColumn("first", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.monotonically_increasing_id().alias("rid"), "raw"))
        .select("digest", "code", "first")
    )
    least = F.greatest(F.lit(float(HEAVY_ROWS)), F.col("n") * HEAVY_SHARE)
    frequent = (
        rows.agg(F.expr(f"approx_top_k(code, {round(1 / HEAVY_SHARE)}, {SKETCH})").alias("top"), F.count(F.lit(1)).alias("n"))
        .select(F.explode("top").alias("top"), least.alias("least"))
        .filter(F.col("top.count") >= F.col("least"))
        .select(F.col("top.item").alias("code"), "least")
    )
    winners = durable(
        rows.join(F.broadcast(frequent), "code")
        .groupBy("digest")
        .agg(F.min("first").alias("winner"), F.count(F.lit(1)).alias("group_size"), F.max("least").alias("least"))
        .filter(F.col("group_size") >= F.col("least"))
        .drop("least")
    )
    marked = rows.drop("code").join(F.broadcast(winners), "digest", "left")
    group = Window.partitionBy("digest")
    heavy = marked.filter(F.col("group_size").isNotNull())
    light = (
        marked.filter(F.col("group_size").isNull())
        .withColumn("winner", F.min("first").over(group))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
    )
    return heavy.unionByName(light).select(
        F.col("first.doc_id").alias("doc_id"),
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("first.rid") == F.col("winner.rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("first.raw").alias("code"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops, columns unchanged; of repeated rows one stays."""
    return keep_rows(docs, exact_dedup(docs, id_col, text_col), id_col, text_col)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("code")


SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
