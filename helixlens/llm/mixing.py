"""Operator 4: mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, served up to MAX_REPEATS times over. What is served has a
virtual finish time: the words its source has sent up to its end, divided by the source's target. All servings are
range-sorted by finish time, whatever their source, and the queue is cut where the word budget is spent. So that one
long document cannot carry a small source far beyond its target, documents are sent in packets of at most a thousandth
of the target.

Running sums over a whole order (of sources by name, of documents inside their source, of packets by finish time) are
those of common.running_sums: a range sort, a partial sum a range. No task holds a source, whatever its share of all
rows, nor all sources, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, durable, join_counted, repeat_rows, running_sums, text_of

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MAX_REPEATS = 3
#: A packet has at most so many words for each word of its source's target, and LEAST_PACKET at least.
PACKET_SHARE, LEAST_PACKET = 1 / 1000, 16
#: Up to so many sources have their targets worked out on the driver; more are range-sorted.
FEW_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null, and null for no other source than the null one."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Of sources(source, source_size): also `before`, the words of all sources ahead in the order, and `target`.

    Targets deal all words by weight, none above max_repeats * source_size. Sources at their stop are those with the
    smallest stop / weight; the level of all others follows from what is left, so the resharing needs no iteration.
    """
    by_name = running_sums(sources.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], rank="one", before="source_size")
    listed = F.array(*[F.lit(w).cast("long") for w in weights])
    weighed = by_name.withColumn("weight", F.element_at(listed, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("stop", F.col("source_size") * max_repeats)
    weighed = weighed.withColumn("ratio", F.col("stop") / F.col("weight")).drop("one", "rank")
    ranked = durable(running_sums(weighed, [F.col("ratio"), F.col("source").asc_nulls_last()], stopped="stop", spoken="weight"))
    everything = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    left, rest = F.col("words") - F.col("stopped"), F.col("weights") - F.col("spoken")
    level = ranked.crossJoin(F.broadcast(everything)).select("ratio", left.alias("left"), rest.alias("rest"))
    level = level.filter(F.col("left") <= F.col("ratio") * F.col("rest")).agg(F.min(F.struct("ratio", "left", "rest")).alias("first"))
    target = F.when(F.col("ratio") >= F.col("first.ratio"), F.col("weight") * F.col("first.left") / F.col("first.rest")).otherwise(F.col("stop").cast("double"))
    return ranked.crossJoin(F.broadcast(level)).select("source", "source_size", "before", F.coalesce(target, F.lit(0.0)).alias("target"))


def few_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source_targets of at most FEW_SOURCES sources."""
    rows = sorted(((r["source"], r["source_size"]) for r in sources.collect()), key=lambda r: (r[0] is None, r[0]))
    own = [(s, size, weights[i % len(weights)]) for i, (s, size) in enumerate(rows)]
    left, rest, target = sum(size for _, size, _ in own), sum(w for _, _, w in own), {}
    for s, size, w in sorted(own, key=lambda r: (r[1] * max_repeats / r[2], r[0] is None, r[0])):
        if left <= size * max_repeats / w * rest:
            break
        target[s], left, rest = float(size * max_repeats), left - size * max_repeats, rest - w
    out, before = [], 0
    for s, size, w in own:
        out.append((s, size, before, target.get(s, w * left / rest)))
        before += size
    return sources.sparkSession.createDataFrame(out, f"source {sources.schema['source'].dataType.simpleString()}, source_size long, before long, target double")


#: Packets of one document: (finish, packet, words), from its place in its source's queue.
PACKETS = "array<struct<finish: double, packet: long, words: long>>"


def packets(max_repeats: int) -> Column:
    n = F.ceil(F.col("size") / F.col("unit")).cast("long")

    def one(i: Column) -> Column:
        inside = (i % n) * F.col("unit")
        words = F.least(F.col("unit"), F.col("size") - inside)
        sent = F.col("start") + F.floor(i / n).cast("long") * F.col("source_size") + inside + words
        return F.struct((sent / F.col("target")).alias("finish"), i.alias("packet"), words.alias("words"))

    return F.when(F.col("size") > 0, F.transform(F.sequence(F.lit(0).cast("long"), n * max_repeats - 1), one)).otherwise(F.array().cast(PACKETS))


def queue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per row of docs with its place: doc_id, source, size, source_size, target, start, unit, ticket, code, rid.

    A source's documents queue up by ticket, the md5 of the id; ids that are the same by a hash of their texts. `start`
    is what the source has sent before the document's first serving, `unit` the size of a packet.
    """
    text = text_of(text_col)
    sized = durable(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("queue"), n_words(text).alias("size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")).alias("ticket"), F.xxhash64(text).alias("code"), F.monotonically_increasing_id().alias("rid"),
        )
    )
    sums = durable(sized.groupBy("source", "queue").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    if sums.count() <= FEW_SOURCES:
        targets = few_targets(sums.select("source", "source_size"), weights, max_repeats).withColumn("queue", source_key(F.col("source"))).drop("source")
        known = sized.join(F.broadcast(targets), "queue")
    else:
        targets = source_targets(sums.select("source", "source_size"), weights, max_repeats).withColumn("queue", source_key(F.col("source"))).drop("source")
        known = join_counted(sized, durable(targets.join(sums.select("queue", "n"), "queue")), "queue", "n").drop("n")
    order = [F.col("source").asc_nulls_last(), F.col("ticket"), F.col("code"), F.col("rid")]
    placed = running_sums(known, order, sent="size")
    unit = F.greatest(F.ceil(F.col("target") * PACKET_SHARE), F.lit(LEAST_PACKET)).cast("long")
    return placed.withColumn("start", F.col("sent") - F.col("before")).withColumn("unit", unit).drop("queue", "before", "sent")


#: What the queue is sorted by: finish time, then the document's ticket.
ORDER = ("finish", "ticket", "code", "rid", "packet")


def schedule(placed: DataFrame, budget_words: int | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The queue: packets (finish, ticket, code, rid, packet, words) range-sorted by finish, cut where budget_words are spent.

    placed: of queue(). Without budget_words, as many words are sent as all documents have. The last packet counts in part.
    """
    if budget_words is None:
        budget_words = placed.agg(F.sum("size")).first()[0] or 0
    sent = placed.select("ticket", "code", "rid", F.explode(packets(max_repeats)).alias("p")).select("p.finish", "ticket", "code", "rid", "p.packet", "p.words")
    served = running_sums(sent, [F.col(c) for c in ORDER], ahead="words")
    return served.withColumn("words", F.least(F.col("words"), budget_words - F.col("ahead"))).filter("words > 0").drop("ahead")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, budget_words: int | None = None,
) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, code (xxhash64 of the text).

    `taken` counts the document's words that the cut queue serves, repeats counted. A source's taken words differ from
    its target by less than a packet of each source. The mix is the same at each run and for each layout of docs: the
    queue is ordered by md5 of the id. Null sources are one source, ordered last; documents without words and sources
    without words take nothing. Repeated rows are served each by itself; an empty table gives an empty result.

    The cut is one place in the sorted queue: whatever a document has before it is served. So the queue's last packet
    is all that comes back to the documents.
    """
    placed = durable(queue(docs, id_col, text_col, source_col, weights, max_repeats))
    last = schedule(placed, budget_words, max_repeats).agg(F.max(F.struct(*ORDER, "words")).alias("last"))
    end = F.struct(*[F.col(f"last.{c}").alias(c) for c in ORDER])
    served = placed.crossJoin(F.broadcast(last))
    in_full = F.col("last").isNotNull() & (F.try_divide(F.col("start") + (max_repeats - 1) * F.col("source_size") + F.col("size"), "target") < F.col("last.finish"))
    # Each packet is held against the last one served: before it all words count, at it those within the budget.
    own = lambda p: F.struct(p["finish"].alias("finish"), "ticket", "code", "rid", p["packet"].alias("packet"))
    words = lambda p: F.when(own(p) < end, p["words"]).when(own(p) == end, F.col("last.words")).otherwise(0)
    part = F.aggregate(packets(max_repeats), F.lit(0).cast("long"), lambda n, p: n + words(p))
    taken = F.when(in_full, F.col("size") * max_repeats).otherwise(F.coalesce(part, F.lit(0))).cast("long")
    return served.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "code")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, each row as often as the mix takes it in whole (half a serving or more counts), columns unchanged.

    Rows that share id and text share what they are taken.
    """
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    return repeat_rows(docs, mix_sources(docs, id_col, text_col, source_col).select("doc_id", "code", times.alias("n")), id_col, text_col)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ticket
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), r AS (
  SELECT *, (source_size * 3) / CAST(weight AS DOUBLE) AS ratio FROM w
), l AS (
  SELECT *,
    CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(source_size * 3) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lft,
    CAST(sum(weight) OVER () AS BIGINT) - CAST(coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest
  FROM r
), f AS (
  SELECT ratio AS f_ratio, lft AS f_left, rest AS f_rest FROM l WHERE lft <= ratio * rest ORDER BY ratio, lft, rest LIMIT 1
), t AS (
  SELECT source, source_size, coalesce(CASE WHEN ratio >= f_ratio THEN CAST(weight * f_left AS DOUBLE) / f_rest ELSE CAST(source_size * 3 AS DOUBLE) END, 0.0) AS target
  FROM l LEFT JOIN f ON true
), q AS (
  SELECT d.doc_id, d.ticket, d.size, t.source_size, t.target, CAST(greatest(ceil(t.target * (1.0::DOUBLE / 1000)), 16) AS BIGINT) AS unit,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ticket) - d.size AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), n AS (
  SELECT *, unnest(range(0, 3 * CAST(ceil(size / CAST(unit AS DOUBLE)) AS BIGINT))) AS packet, CAST(ceil(size / CAST(unit AS DOUBLE)) AS BIGINT) AS n FROM q WHERE size > 0
), p AS (
  SELECT doc_id, ticket, packet, least(unit, size - packet % n * unit) AS words,
    CAST(start + packet // n * source_size + packet % n * unit + least(unit, size - packet % n * unit) AS DOUBLE) / target AS finish FROM n
), v AS (
  SELECT doc_id, words, CAST(sum(words) OVER (ORDER BY finish, ticket, packet ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - words AS ahead FROM p
), x AS (
  SELECT doc_id, CAST(sum(greatest(0, least(words, (SELECT sum(size) FROM d) - ahead))) AS BIGINT) AS taken FROM v GROUP BY doc_id
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(x.taken, 0) AS taken FROM q LEFT JOIN x USING (doc_id)
"""
