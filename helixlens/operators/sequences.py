"""Reports by sequence: duplication, over-representation, adapters and k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import QcConfig
from ..functions.columns import dedup_key, group_bounds, with_scalar
from ..functions.contaminants import best_contaminant
from ..functions.stats import scaled_binomial_tail

#: Duplication slots, by the level that each starts above, and their labels.
LEVELS = ((0, "1"), (1, "2"), (2, "3"), (3, "4"), (4, "5"), (5, "6"), (6, "7"), (7, "8"), (8, "9"), (9, ">10"), (49, ">50"), (99, ">100"), (499, "500"), (999, ">1k"), (4999, ">5k"), (9999, ">10k"))


#: The first look for tracked keys goes over so many reads for each of the cap, the next over eight times as many.
LOOK, WIDER = 8, 8


def _first_keys(reads: DataFrame, cap: int) -> list[tuple[str, int]] | None:
    """(seq, first_idx) of the first cap distinct keys; None where no range of reads short of all of them has so many."""
    upto = LOOK * cap
    while not reads.filter(F.col("read_idx") > upto).isEmpty():
        found = reads.filter(F.col("read_idx") <= upto).groupBy(dedup_key(F.col("seq")).alias("seq")).agg(F.min("read_idx").alias("first_idx"))
        first = [tuple(r) for r in found.orderBy("first_idx").limit(cap).collect()]  # cap keys of at most 75 bases
        if len(first) == cap:
            return first
        upto *= WIDER
    return None


def tracked_sequences(reads: DataFrame, cfg: QcConfig) -> DataFrame:
    """(seq, n, first_idx, total, seen_at): the first unique_cap distinct keys, counted over all reads.

    A key is tracked when its first read comes among the first unique_cap keys, and then counts from that read on, so
    a plain count by key is exact. seen_at is the read that fills the cap, or the number of reads. Where a part of the
    reads fills the cap, its keys are broadcast and all reads are counted against them: what is shuffled is a row per
    tracked key and task, however many other keys there are.
    """
    key = dedup_key(F.col("seq"))
    first = _first_keys(reads, cfg.unique_cap)
    if first is None:
        keys = reads.groupBy(key.alias("seq")).agg(F.count(F.lit(1)).alias("n"), F.min("read_idx").alias("first_idx"))
        total = reads.agg(F.count(F.lit(1)).alias("total"))
        kept = keys.orderBy("first_idx").limit(cfg.unique_cap)
    else:
        tracked = F.broadcast(reads.sparkSession.createDataFrame(first, "seq string, first_idx long"))
        keys = reads.select(key.alias("seq")).join(tracked, "seq", "left").groupBy("first_idx").agg(F.first("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
        total = keys.agg(F.sum("n").alias("total"))
        kept = keys.filter(F.col("first_idx").isNotNull())
    filled = kept.agg(F.count(F.lit(1)).alias("tracked"), F.max("first_idx").alias("last"))
    ends = with_scalar(filled, total).select("total", F.when(F.col("tracked") >= cfg.unique_cap, F.col("last")).otherwise(F.col("total")).alias("seen_at"))
    return with_scalar(kept, ends)


def duplication_levels(reads: DataFrame, cfg: QcConfig | None = None) -> DataFrame:
    """slot, label, deduplicated_percentage, total_percentage and on every row total_dedup_percentage."""
    cfg = cfg or QcConfig()
    levels = tracked_sequences(reads, cfg).groupBy(F.col("n").alias("level"), "total", "seen_at").agg(F.count(F.lit(1)).alias("m"))
    whole = (F.col("seen_at") == F.col("total")) | (F.col("total") - F.col("m") < F.col("seen_at"))
    corrected = F.when(whole, F.col("m").cast("double")).otherwise(F.try_divide(F.col("m") * (F.col("total") - F.col("seen_at") + 1).cast("double"), F.col("level")))
    slot = F.lit(0)
    for i, (above, _) in enumerate(LEVELS):
        slot = F.when(F.col("level") > above, i).otherwise(slot)
    slots = levels.withColumn("c", corrected).groupBy(slot.cast("int").alias("slot")).agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("level")).alias("r"))
    sums = slots.agg(F.sum("c").alias("dedup_total"), F.sum("r").alias("row_total"))
    spine = reads.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(x) for _, x in LEVELS])).alias("slot", "label"))
    return with_scalar(spine.join(slots, "slot", "left"), sums).select(
        "slot", "label",
        F.try_divide(F.coalesce("c", F.lit(0.0)) * 100.0, "dedup_total").alias("deduplicated_percentage"),
        F.try_divide(F.coalesce("r", F.lit(0.0)) * 100.0, "row_total").alias("total_percentage"),
        (F.try_divide(F.col("dedup_total"), "row_total") * 100.0).alias("total_dedup_percentage"),
    )


def overrepresented(reads: DataFrame, cfg: QcConfig | None = None) -> DataFrame:
    """seq, count, percentage of tracked sequences above overrepresented_percent of all reads; fewer than 1000 rows."""
    cfg = cfg or QcConfig()
    percent = F.col("n") * 100.0 / F.col("total")
    return tracked_sequences(reads, cfg).filter(percent > cfg.overrepresented_percent).select("seq", F.col("n").alias("count"), percent.alias("percentage"))


def contaminant_hits(reads: DataFrame, cfg: QcConfig | None = None) -> DataFrame:
    """overrepresented with possible_source, the best contaminant as text or "No Hit"."""
    cfg = cfg or QcConfig()
    hit = F.when(F.col("hit.name").isNotNull(), F.format_string("%s (%d%% over %d bp) %d", "hit.name", "hit.percent_id", "hit.length", "hit.direction"))
    return overrepresented(reads, cfg).withColumn("hit", best_contaminant(F.col("seq"), cfg.contaminants)).select("seq", "count", "percentage", F.coalesce(hit, F.lit("No Hit")).alias("possible_source"))


def adapter_content(reads: DataFrame, cfg: QcConfig | None = None) -> DataFrame:
    """adapter_ord, adapter, lower_base, upper_base, enrichment: percent of reads whose first hit lies at or before a position.

    Positions exist from the first read on that is long enough for them; earlier hits are not counted there. `room`,
    the number of positions when a read comes, is a step function of read_idx with a step per read length at most.
    """
    cfg = cfg or QcConfig()
    longest = max((len(s) for _, s in cfg.adapters), default=0)
    lengths = reads.groupBy(F.length("seq").cast("long").alias("len")).agg(F.min("read_idx").alias("from_idx"), F.count(F.lit(1)).alias("n"))
    steps = lengths.agg(F.collect_list(F.struct("from_idx", (F.col("len") - longest).alias("room"))).alias("steps"), F.sum("n").alias("total"), F.greatest(F.max("len") - longest, F.lit(0)).alias("max_len"))
    first = [F.struct(F.lit(i).alias("adapter_ord"), (F.instr("seq", s) - 1).alias("i")) for i, (_, s) in enumerate(cfg.adapters)]
    hits = reads.select("read_idx", F.explode(F.filter(F.array(*first), lambda x: x["i"] >= 0)).alias("h")).select("read_idx", "h.*")
    room = F.array_max(F.transform(F.filter("steps", lambda s: s["from_idx"] <= F.col("read_idx")), lambda s: s["room"]))
    counts = with_scalar(hits, steps).groupBy("adapter_ord", "i", room.alias("room")).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.struct(F.lit(i).alias("adapter_ord"), F.lit(x).alias("adapter")) for i, (x, _) in enumerate(cfg.adapters)])
    spine = steps.filter("max_len > 0").select("total", "max_len", F.explode(names).alias("a")).select("total", "max_len", "a.*")
    spine = spine.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("max_len") - 1)))
    covered = counts.filter("i < room").withColumn("p", F.explode(F.sequence(F.col("i").cast("long"), F.col("room") - 1))).groupBy("adapter_ord", "p").agg(F.sum("n").alias("n"))
    lower, upper = group_bounds(F.col("p") + 1, F.col("max_len"), cfg.grouping)
    grouped = spine.join(covered, ["adapter_ord", "p"], "left").groupBy("adapter_ord", "adapter", lower.alias("lower_base"), upper.alias("upper_base"))
    width = F.col("upper_base") - F.col("lower_base") + 1
    return grouped.agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.max("total").alias("total")).select("adapter_ord", "adapter", "lower_base", "upper_base", (F.col("n") * 100.0 / F.col("total") / width).alias("enrichment"))


def kmer_groups(reads: DataFrame, cfg: QcConfig | None = None) -> DataFrame:
    """kmer, count, lower_base, upper_base, hits, group_total, proportion, predicted, obs_exp of the groups that a k-mer was seen in.

    Only the part of a group inside the k-mer's own positions counts: those of the first sampled read that holds it,
    or up to its last hit if that is further.
    """
    cfg = cfg or QcConfig()
    k = cfg.kmer_size
    sampled = reads.filter(F.col("read_idx") % cfg.kmer_sample == 0).select("read_idx", F.substring("seq", 1, cfg.kmer_prefix).alias("s"))
    slots = (F.length("s") - k + 1).cast("long")
    windows = F.transform(F.sequence(F.lit(1), slots.cast("int")), lambda i: F.substring("s", i, F.lit(k)))
    seen = sampled.filter(F.length("s") >= k).select("read_idx", slots.alias("slots"), F.posexplode(windows).alias("pos", "kmer")).filter(~F.contains("kmer", F.lit("N")))
    longest = sampled.agg(F.greatest(F.max(slots), F.lit(0)).alias("max_len"))
    at = seen.groupBy("kmer", (F.col("pos") + 1).cast("long").alias("pos")).agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("read_idx", "slots")).alias("first"))
    whole = at.groupBy("kmer").agg(F.sum("hits").alias("count"), F.greatest(F.min("first")["slots"], F.max("pos")).alias("own"))
    by_pos = at.groupBy("pos").agg(F.sum("hits").alias("total"))
    totals = longest.filter("max_len > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), "max_len")).alias("pos")).join(by_pos, "pos", "left")
    upto = totals.select("pos", F.sum(F.coalesce("total", F.lit(0))).over(Window.orderBy("pos")).alias("upto"))
    every = by_pos.agg(F.sum("total").alias("all"))
    lower, upper = group_bounds(F.col("pos"), F.col("max_len"), cfg.grouping)
    groups = with_scalar(at, longest).groupBy("kmer", lower.alias("lower_base"), upper.alias("upper_base")).agg(F.sum("hits").alias("hits"))
    rows = (
        groups.join(whole, "kmer").withColumn("end", F.least("upper_base", "own"))
        .join(F.broadcast(upto.select(F.col("pos").alias("end"), F.col("upto").alias("to_end"))), "end")
        .join(F.broadcast(upto.select((F.col("pos") + 1).alias("lower_base"), F.col("upto").alias("to_start"))), "lower_base")
    )
    f = lambda x: F.col(x).cast("float")
    rows = with_scalar(rows, every).withColumn("group_total", F.col("to_end") - F.col("to_start")).withColumn("proportion", (f("count") / f("all")).cast("float"))
    rows = rows.withColumn("predicted", (F.col("proportion") * f("group_total")).cast("float")).withColumn("obs_exp", (f("hits") / F.col("predicted")).cast("float"))
    return rows.select("kmer", "count", "lower_base", "upper_base", "hits", "group_total", "proportion", "predicted", "obs_exp")


def kmer_enrichment(reads: DataFrame, cfg: QcConfig | None = None, top: int = 20) -> DataFrame:
    """The `top` k-mers by largest observed over expected, of those with a group of p < 0.01 and a ratio over 5."""
    cfg = cfg or QcConfig()
    tail = scaled_binomial_tail(F.col("group_total"), F.col("proportion").cast("double"), F.col("hits"), float(4**cfg.kmer_size))
    # Only groups that can qualify reach Python: a ratio of more than 5 means more hits than predicted.
    grouped = kmer_groups(reads, cfg)
    p = grouped.filter("obs_exp > 5").withColumn("p", tail).groupBy("kmer").agg(F.min("p").alias("p_value")).filter(F.col("p_value") < F.lit(0.01).cast("float"))
    best = F.max(F.struct("obs_exp", (-F.col("lower_base")).alias("minus"), "upper_base"))
    peaks = grouped.groupBy("kmer", "count").agg(best.alias("b")).join(p, "kmer")
    return (
        peaks.select(
            F.col("kmer").alias("sequence"), (F.col("count") * 5).alias("count"), F.col("p_value").cast("double").alias("p_value"), F.col("b.obs_exp").alias("max_obs_exp"),
            (-F.col("b.minus")).alias("max_lower_position"), F.col("b.upper_base").alias("max_upper_position"),
        )
        .orderBy(F.desc("max_obs_exp"), "sequence").limit(top)
    )
