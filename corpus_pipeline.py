"""A training corpus from raw documents: STAGES in order, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixlens.llm.common import discard, documents, labels, settle, stored
from helixlens.llm.exact_dedup import keep_first
from helixlens.llm.mixing import mixed_documents
from helixlens.llm.near_dedup import keep_one_of_each
from helixlens.llm.packing import pack
from helixlens.llm.toxicity import without_toxic
from helixlens.plans.session import ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models, learnt from the labels of sf_dir, reject are gone."""
    settle(ship(spark))
    return without_toxic(docs, labels(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart) the smallest doc_id stays."""
    settle(ship(spark))
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays: shingles of five words, similarity 0.8."""
    settle(ship(spark))
    return keep_one_of_each(docs, words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: rows are repeated or left out."""
    settle(ship(spark))
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a document that the mix repeats has the pieces of each repeat."""
    settle(ship(spark))
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: A learnt model and a best-fit order are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; what each kept is written to the shared folder, read back, and deleted when the next is written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
