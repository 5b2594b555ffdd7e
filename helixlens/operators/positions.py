"""Reports by read position: quality, base content, N content and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import QcConfig
from ..functions.columns import encoding_offset, group_bounds, letters, with_scalar

#: Percentiles use positions with more observations than this.
LEAST_DEPTH = 100


def base_counts(reads: DataFrame) -> DataFrame:
    """(pos, base, n): how often each symbol stands at each 1-based position."""
    return reads.select(F.posexplode(letters(F.col("seq"))).alias("pos", "base")).groupBy((F.col("pos") + 1).alias("pos"), "base").agg(F.count(F.lit(1)).alias("n"))


def quality_counts(reads: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, code, n): how often each quality byte stands at each 1-based position."""
    exploded = reads.select(*keys, F.posexplode(letters(F.col("qual"))).alias("pos", "q"))
    return exploded.groupBy(*keys, (F.col("pos") + 1).alias("pos"), F.ascii("q").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def with_whole(hist: DataFrame, **of_all: Column) -> DataFrame:
    """hist with max_len, the last position, and aggregates of_all over its rows.

    n is named on both sides: so both read the same columns of one exchange, and the reads are gone over once.
    """
    return with_scalar(hist, hist.filter("n > 0").agg(F.max("pos").alias("max_len"), *[c.alias(name) for name, c in of_all.items()]))


def _grouped(by_pos: DataFrame, cfg: QcConfig) -> DataFrame:
    lower, upper = group_bounds(F.col("pos"), F.col("max_len"), cfg.grouping)
    return by_pos.withColumns({"lower_base": lower, "upper_base": upper})


def percentile_at(percent: int) -> Column:
    """Least code whose running count reaches floor(total * percent / 100), less the offset; null at shallow positions."""
    reached = F.col("running") >= F.floor(F.col("total") * percent / 100)
    return F.when(F.max("total") > LEAST_DEPTH, F.min(F.when(reached, F.col("code"))) - F.max("offset"))


def per_base_quality(reads: DataFrame, cfg: QcConfig | None = None) -> DataFrame:
    """lower_base, upper_base, mean and percentiles of quality: means over a group's positions of each position's value."""
    cfg = cfg or QcConfig()
    at = Window.partitionBy("pos")
    running = at.orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    by_pos = (
        with_whole(quality_counts(reads), offset=encoding_offset(F.min("code")))
        .withColumns({"running": F.sum("n").over(running), "total": F.sum("n").over(at)})
        .groupBy("pos", "max_len")
        .agg(
            (F.sum(F.col("n") * (F.col("code") - F.col("offset"))) / F.sum("n")).alias("mean"),
            *[percentile_at(p).alias(name) for p, name in ((50, "median"), (25, "lower_quartile"), (75, "upper_quartile"), (10, "percentile_10"), (90, "percentile_90"))],
        )
    )
    names = ["mean", "median", "lower_quartile", "upper_quartile", "percentile_10", "percentile_90"]
    return _grouped(by_pos, cfg).groupBy("lower_base", "upper_base").agg(*[F.avg(c).alias(c) for c in names])


def least_percentile(reads: DataFrame, percent: int) -> DataFrame:
    """One row, least_percentile: the least percentile of quality over positions deep enough to have one; 1000 if none is."""
    at = Window.partitionBy("pos")
    whole = with_whole(quality_counts(reads), offset=encoding_offset(F.min("code")))
    running = F.sum("n").over(at.orderBy("code").rowsBetween(Window.unboundedPreceding, 0))
    by_pos = whole.withColumns({"running": running, "total": F.sum("n").over(at)}).groupBy("pos").agg(percentile_at(percent).alias("x"))
    return by_pos.agg(F.least(F.coalesce(F.min("x"), F.lit(1000)), F.lit(1000)).alias("least_percentile"))


def per_base_content(reads: DataFrame, cfg: QcConfig | None = None) -> DataFrame:
    """lower_base, upper_base, percent of G, A, T and C among those four."""
    cfg = cfg or QcConfig()
    of = lambda b: F.sum(F.when(F.upper("base") == b, F.col("n")).otherwise(0))
    grouped = _grouped(with_whole(base_counts(reads)), cfg).groupBy("lower_base", "upper_base").agg(*[of(b).alias(b) for b in "GATC"])
    total = sum((F.col(b) for b in "ATC"), F.col("G"))
    return grouped.select("lower_base", "upper_base", *[F.try_divide(F.col(b) * 100.0, total).alias(f"{b.lower()}_percent") for b in "GATC"])


def n_content(reads: DataFrame, cfg: QcConfig | None = None) -> DataFrame:
    """lower_base, upper_base, percent of N (capital) among all symbols."""
    cfg = cfg or QcConfig()
    grouped = _grouped(with_whole(base_counts(reads)), cfg).groupBy("lower_base", "upper_base")
    return grouped.agg((100.0 * F.sum(F.when(F.col("base") == "N", F.col("n")).otherwise(0)) / F.sum("n")).alias("percentage"))


def tile_reads(reads: DataFrame, cfg: QcConfig) -> DataFrame:
    """Sampled reads with their tile; none when ids have no tile field, a tile is no number, or there are too many tiles.

    The first sampled id fixes the field: the fifth of seven or more, else the third of five or more.
    """
    sampled = reads.filter(F.col("read_idx") % cfg.tile_sample == 0).withColumn("fields", F.split("id", ":"))
    n = F.min_by(F.size("fields"), "read_idx")
    field = sampled.agg(F.when(n >= 7, 5).when(n >= 5, 3).alias("field"))
    raw = F.when(F.size("fields") >= F.col("field"), F.element_at("fields", F.col("field")))
    number = F.when(raw.rlike(r"^[+-]?[0-9]+$"), F.expr("try_cast(raw as int)")).cast("long")
    tiles = with_scalar(sampled, field).withColumn("raw", raw).withColumn("tile", number)
    tiles = tiles.withColumn("tile", F.when(F.col("tile") < 0, F.col("tile") + (1 << 32)).otherwise(F.col("tile")))
    usable = tiles.agg(((F.count(F.when(F.col("tile").isNull(), 1)) == 0) & (F.count_distinct("tile") <= cfg.tile_cap)).alias("usable"))
    return with_scalar(tiles, usable).filter("usable").select("tile", "seq", "qual")


def per_tile_quality(reads: DataFrame, cfg: QcConfig | None = None) -> DataFrame:
    """tile, lower_base, upper_base, deviation of the tile's mean quality from the mean over all tiles."""
    cfg = cfg or QcConfig()
    hist = with_whole(quality_counts(tile_reads(reads, cfg), "tile"), offset=encoding_offset(F.min("code")))
    by_pos = hist.groupBy("tile", "pos", "max_len").agg((F.sum(F.col("n") * (F.col("code") - F.col("offset"))) / F.sum("n")).alias("mean"))
    grouped = _grouped(by_pos, cfg).groupBy("tile", "lower_base", "upper_base").agg(F.avg("mean").alias("mean"))
    across = Window.partitionBy("lower_base")
    return grouped.select("tile", "lower_base", "upper_base", (F.col("mean") - F.avg("mean").over(across)).alias("deviation"))
