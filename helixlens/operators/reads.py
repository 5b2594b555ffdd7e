"""Reports by whole read: basic statistics, mean quality, GC content and length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_of, encoding_name, gc_count, gc_prefix, least_code, length_step, letters, with_scalar


def basic_statistics(reads: DataFrame) -> DataFrame:
    """One row. sequence_min_length is the last read's length and sequence_max_length the least one; the true ones stand beside them."""
    length = F.length("seq").cast("long")
    a = reads.agg(
        F.count(F.lit(1)).alias("total_sequence"), F.sum(count_of(F.col("seq"), "GCgc")).alias("gc"), F.sum(count_of(F.col("seq"), "ATat")).alias("at"), F.min(least_code(F.col("qual"))).alias("least"),
        F.max_by(length, "read_idx").alias("last_len"), F.min(length).alias("min_len"), F.max(length).alias("max_len"),
    )
    return a.select(
        encoding_name(F.col("least")).alias("encoding"), "total_sequence", F.lit(0).cast("long").alias("filtered_sequence"),
        F.col("last_len").alias("sequence_min_length"), F.col("min_len").alias("sequence_max_length"),
        F.expr("try_divide(100 * gc - (100 * gc) % nullif(gc + at, 0), gc + at)").cast("long").alias("gc_percent"),
        F.col("min_len").alias("true_min_length"), F.col("max_len").alias("true_max_length"),
    )


def per_sequence_quality(reads: DataFrame) -> DataFrame:
    """score, count: reads by their mean quality byte (rounded down) less the offset, from the least to the largest without gaps."""
    total = F.aggregate(letters(F.col("qual")), F.lit(0).cast("long"), lambda s, c: s + F.ascii(c))
    kept = reads.filter(F.length("qual") > 0).select(F.floor(total / F.length("qual")).alias("code"), least_code(F.col("qual")).alias("least"))
    hist = kept.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("least"))
    # One row holds the whole histogram, of at most 256 codes: a join back to it would go over the reads again.
    offset = F.when((F.min("least") >= 32) & (F.min("least") < 64), 33).otherwise(64)
    whole = hist.agg(F.min("code").alias("lo"), F.max("code").alias("hi"), offset.alias("offset"), F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("by_code"))
    dense = whole.filter("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("code"), "offset", "by_code")
    return dense.select((F.col("code") - F.col("offset")).alias("score"), F.coalesce(F.try_element_at("by_code", F.col("code")), F.lit(0)).alias("count"))


def gc_claims(length: Column, count: Column) -> Column:
    """Array of (pct, increment): the percentages that a GC count may stand for in reads of a length.

    A count k claims the rounded percentages from k - 1/2 to k + 1/2, and every percentage gives its claimants equal
    parts. Only counts next to a percentage can claim it, so claimants are counted over a short range.
    """
    n = length.cast("long")
    bound = lambda x: F.when(n > 0, F.floor(100 * x / n + 0.5)).otherwise(0).cast("long")
    lo, hi = (lambda k: bound(F.greatest(k - 0.5, F.lit(0.0)))), (lambda k: bound(F.least(k + 0.5, n.cast("double"))))
    near = lambda p: F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((p - 0.5) * n / 100) - 1), F.least(n, F.ceil((p + 0.5) * n / 100) + 1))
    claimants = lambda p: F.size(F.filter(near(p), lambda k: (lo(k) <= p) & (hi(k) >= p)))
    return F.transform(F.sequence(lo(count), hi(count)), lambda p: F.struct(p.alias("pct"), (F.lit(1.0) / claimants(p)).alias("increment")))


def gc_distribution(reads: DataFrame) -> DataFrame:
    """gc_pct 0 to 100, count: GC counts of the (truncated) reads through the model of their full length."""
    counts = reads.groupBy(F.length("seq").cast("long").alias("len"), gc_count(gc_prefix(F.col("seq"))).alias("gc_count")).agg(F.count(F.lit(1)).alias("n"))
    shares = counts.select("n", F.explode(gc_claims(F.col("len"), F.col("gc_count"))).alias("c"))
    by_pct = shares.groupBy(F.col("c.pct").alias("gc_pct")).agg(F.sum(F.col("n") * F.col("c.increment")).alias("count"))
    spine = reads.sparkSession.range(101).withColumnRenamed("id", "gc_pct")
    return spine.join(F.broadcast(by_pct), "gc_pct", "left").select("gc_pct", F.coalesce("count", F.lit(0.0)).alias("count"))


def gc_theoretical(reads: DataFrame) -> DataFrame:
    """gc_pct, count, theoretical, and on every row mode, stddev, total and deviation_percent.

    The mode is the middle of the stretch around the (last) largest count that stays above 0.9 of it; where that
    stretch meets an end of the range, the count itself takes its place.
    """
    dist = gc_distribution(reads)
    peak = dist.agg(F.max_by("gc_pct", F.struct("count", "gc_pct")).alias("at"), F.max("count").alias("top"))
    low = F.col("count") <= F.col("top") * 0.9
    ends = with_scalar(dist, peak).agg(
        F.min(F.when((F.col("gc_pct") >= F.col("at")) & low, F.col("gc_pct"))).alias("above"), F.max(F.when((F.col("gc_pct") < F.col("at")) & low, F.col("gc_pct"))).alias("below"),
        F.max("top").alias("top"), F.sum("count").alias("total"),
    )
    mode = ends.select("total", F.when(F.col("above").isNull() | F.col("below").isNull(), F.col("top")).otherwise((F.col("above") + F.col("below")) / 2).alias("mode"))
    spread = with_scalar(dist, mode).agg(F.sqrt(F.try_divide(F.sum(F.pow(F.col("gc_pct") - F.col("mode"), 2) * F.col("count")), F.max("total") - 1)).alias("stddev"))
    both = with_scalar(with_scalar(dist, mode), spread)
    var = F.col("stddev") * F.col("stddev")
    density = F.try_divide(F.exp(-F.try_divide(F.pow(F.col("gc_pct") - F.col("mode"), 2), 2 * var)), F.sqrt(2 * F.pi() * var))
    both = both.withColumn("theoretical", density * F.col("total"))
    off = both.agg(F.try_divide(100 * F.sum(F.abs(F.col("theoretical") - F.col("count"))), F.max("total")).alias("deviation_percent"))
    return with_scalar(both, off).select("gc_pct", "count", "theoretical", "mode", "stddev", "total", "deviation_percent")


def length_distribution(reads: DataFrame) -> DataFrame:
    """lower_length, upper_length, count: reads by length in bins, with one length more on either side of the range."""
    counts = reads.groupBy(F.length("seq").cast("long").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.greatest(F.min("len") - 1, F.lit(0)).alias("lo"), (F.max("len") + 1).alias("hi")).filter("lo is not null")
    ends = ends.withColumn("step", length_step(F.col("hi") - F.col("lo"))).withColumn("start", (F.floor(F.col("lo") / F.col("step")) * F.col("step")).cast("long"))
    bins = ends.select(F.explode(F.sequence("start", "hi", "step")).alias("lower_length"), "step", "hi")
    binned = with_scalar(counts, ends).groupBy((F.col("start") + F.floor((F.col("len") - F.col("start")) / F.col("step")) * F.col("step")).alias("lower_length")).agg(F.sum("n").alias("count"))
    upper = F.least(F.col("hi"), F.col("lower_length") + F.col("step") - 1)
    return bins.join(binned, "lower_length", "left").select("lower_length", upper.alias("upper_length"), F.coalesce("count", F.lit(0)).alias("count"))
