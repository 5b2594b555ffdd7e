"""Operator 3: near-duplicate groups with SetSketch registers.

Each document's set of word shingles is sketched by REGISTERS SetSketch registers: logarithms, to the base BASE and
truncated, of the least of exponentially distributed hashes. Registers merge by maximum, and equal ones are as likely
as the sets are similar. Classes of documents with equal sets are represented by one of them. BANDS bands of register
values deal representatives into buckets. Inside a bucket nobody is paired with everybody: all are compared with the
bucket's pivot, the member that shares most buckets with others, which is the centre of a group of edited copies. A
pair is judged by the joint likelihood of its registers first, then confirmed on the full sets. Members that are not
linked with their pivot are a query set that is held against the pivot's whole group on full sets, in blocks of bounded
size, where the group still has several components.

A pair at the threshold 0.85 shares none of the 32 bands with probability (1 - 0.85**4)**32 < 1e-10.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable, join_hot, join_skewed, keep_rows, map_rows, mix64, row_key, signed, text_of, tidy, word_hashes

SHINGLE_WORDS = 3
#: Links need 100 * |intersection| >= PERCENT * |union|.
PERCENT = 85
REGISTERS, BANDS = 128, 32
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: A pair whose registers are exp(20) times likelier at another similarity than at any linked one is not looked at again.
LIKELIHOOD_GAP = 20.0

#: Shingles of the queries, and of the group they are held against, in one block, about.
QUERY_SHINGLES, GROUP_SHINGLES = 1 << 18, 1 << 20

_SEEDS = mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_XOR, _MUL = (_SEEDS >> np.uint64(32)).astype(np.uint32), _SEEDS.astype(np.uint32) | np.uint32(1)
_BAND_SALT = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; fewer words are one shingle, none are none."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(words, len(h))
    n, mixed = len(h) - width + 1, np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        mixed = mix64(mixed * np.uint64(0x9FB21C651E98DF25) + h[i : i + n] + np.uint64(width))
    return np.unique(mixed)


def registers(members: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    codes = (members >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(codes), 2048):
        v = (codes[at : at + 2048, None] ^ _XOR) * _MUL
        v ^= v >> np.uint32(16)
        low = np.minimum(low, (v * np.uint32(0x85EBCA6B)).min(axis=0))
    least = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / math.log(BASE)), 0, TOP).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key per band: its register values, salted with the band's number."""
    return mix64(np.ascontiguousarray(regs).view(np.uint64) ^ _BAND_SALT)


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether the registers of each pair allow a similarity of percent / 100, by their joint likelihood."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE), 1e-12, 1)

    def fit(j):
        up, down = p(u - v * j), p(v - u * j)
        return (more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))).max(axis=1)

    least = percent / 100
    anywhere = fit(np.linspace(0, 1, 65) * most)
    linked = fit(least + np.linspace(0, 1, 17) * np.maximum(most - least, 0))
    return (most[:, 0] >= least - 1e-9) & (np.maximum(anywhere, linked) - linked <= LIKELIHOOD_GAP)


def _sketched(words: int):
    def make():
        def one(batch):
            sets = [shingles(t.encode("utf-8", "replace"), words) for t in batch.column(1).to_pylist()]
            regs = [registers(s) if len(s) else None for s in sets]
            yield {
                "doc_id": batch.column(0), "code": batch.column(2), "rid": batch.column(3), "n_shingles": [len(s) for s in sets],
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "regs": [r if r is None else r.tobytes() for r in regs],
                "bands": [r if r is None else signed(band_keys(r)) for r in regs],
            }

        return one

    return make


def _sets(words: int):
    def make():
        def one(batch):
            sets = [shingles(t.encode("utf-8", "replace"), words) for t in batch.column(1).to_pylist()]
            own = [i for i, (s, k) in enumerate(zip(sets, batch.column(2).to_pylist(), strict=True)) if xxhash.xxh3_128_digest(s.tobytes()) == k]
            yield {"v": [batch.column(0)[i].as_py() for i in own], "members": [signed(sets[i]) for i in own]}

        return one

    return make


def components(links: DataFrame) -> DataFrame:
    """(v, label): the least vertex reachable from each vertex of links(a, b), by label passing with pointer jumps."""
    both = durable(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = durable(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.min("a")).alias("label"), F.count(F.lit(1)).alias("degree")))
    while True:
        # A centre has as many neighbours, and a label as many holders, as its component has members.
        heard = join_hot(both, now.select(F.col("v").alias("b"), "label", "degree"), "b", "degree").groupBy(F.col("a").alias("w")).agg(F.min("label").alias("heard"))
        closer = durable(now.join(heard, F.col("v") == F.col("w")).select("v", "label", "degree", F.least("label", "heard").alias("near")))
        ahead = now.select(F.col("v").alias("near"), F.col("label").alias("far"))
        new = durable(join_skewed(closer, ahead, "near").select("v", F.least("near", "far").alias("new"), "label", "degree"))
        if new.filter("new < label").isEmpty():
            return now.select("v", "label")
        now = new.select("v", F.col("new").alias("label"), "degree")


def _judged(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose registers allow a link."""

    @F.pandas_udf("boolean")
    def judge(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        stack = lambda s: np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1)
        return pd.Series(plausible(stack(a), stack(b), na.to_numpy(float), nb.to_numpy(float), percent))

    side = lambda x: classes.select(F.col("v").alias(x), F.col("regs").alias(f"r{x}"), F.col("n").alias(f"n{x}"))
    sized = join_skewed(pairs, side("b"), "b").join(side("a"), "a")
    close = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return sized.filter(close).filter(judge("ra", "rb", "na", "nb")).select("a", "b", "na", "nb")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with the size of their sets' intersection.

    Pivots in more pairs than 1/4096 of all are broadcast with their sets: all such sets together are at most 4096 times
    the mean set of a pair, since a pair's sets are of similar size.
    """
    side = lambda x: sets.select(F.col("v").alias(x), F.col("members").alias(f"m{x}"))
    return join_skewed(pairs, side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", F.size(F.array_intersect("ma", "mb")).alias("common"))


def _linked(percent: int) -> Column:
    return F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent


def _links_of_block(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between the queries of a block and its members of other components, on full sets.

        Shingles that only one set of the block has count in its size alone. Those that over 1/32 of the sets have are
        columns of a bit matrix, so it takes 4 bytes a shingle of the block at most; of the others the holders are listed.
        Components that a link has joined are one from then on, so at most one link less than there are components comes out.
        """
        sizes = rows["members"].map(len).to_numpy()
        tokens = np.concatenate(rows["members"].to_numpy()) if sizes.sum() else np.zeros(0, np.int64)
        _, token, n = np.unique(tokens, return_inverse=True, return_counts=True)
        of_row, end = np.repeat(np.arange(len(rows)), sizes), np.cumsum(sizes)
        often = n > max(1, len(rows) >> 5)
        column = np.cumsum(often) - 1
        bits = np.zeros((len(rows), max(1, -(-int(often.sum()) // 64))), np.uint64)
        at = column[token[often[token]]]
        np.bitwise_or.at(bits, (of_row[often[token]], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        listed = (n > 1) & ~often
        own = np.flatnonzero(listed[token])
        holders = of_row[own[np.argsort(token[own], kind="stable")]]
        upto = np.cumsum(np.where(listed, n, 0))
        is_y, v = rows["is_y"].to_numpy(bool), rows["v"].to_numpy()
        _, joined = np.unique(rows["label"].to_numpy(), return_inverse=True)
        rest = np.flatnonzero(~is_y)
        a, b = [], []
        for y in np.flatnonzero(is_y):
            near = rest[(joined[rest] != joined[y]) & (np.minimum(sizes[rest], sizes[y]) * 100 >= np.maximum(sizes[rest], sizes[y]) * percent)]
            few = token[end[y] - sizes[y] : end[y]]
            few = few[listed[few]]
            met = [holders[upto[t] - n[t] : upto[t]] for t in few.tolist()]
            common = np.bincount(np.concatenate([*met, np.zeros(0, np.int64)]), minlength=len(rows))[near]
            common += np.bitwise_count(bits[near] & bits[y]).sum(axis=1, dtype=np.int64)
            hit = near[common * 100 >= (sizes[near] + sizes[y] - common) * percent]
            others, first = np.unique(joined[hit], return_index=True)
            a += [v[y]] * len(others)
            b += v[hit[first]].tolist()
            joined[np.isin(joined, others)] = joined[y]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, code (xxhash64 of the text).

    Words are runs without white space, A-Z lowered; a set has the distinct shingles of `words` words, or the whole
    sequence where there are fewer. Sets are linked when 100 * |intersection| >= percent * |union|. component_id is the
    smallest id reachable over links, itself included; it is null only where all ids are. Null, empty and blank texts
    have no shingles and are linked with nothing. Of each component exactly one row is kept, that of component_id (of
    repeated rows with that id, one). An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    coded = rows.select("doc_id", "text", F.xxhash64("text").alias("code"), F.monotonically_increasing_id().alias("rid"))
    sketched = durable(
        map_rows(coded, _sketched(words), "doc_id long, code long, rid long, n_shingles long, set_key binary, regs binary, bands array<long>")
    )
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "code")
    classes = durable(
        sketched.filter("n_shingles > 0")
        .groupBy("set_key")
        .agg(F.min(first).alias("first"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows"))
        .withColumn("v", F.col("first.rid"))
    )
    banded = classes.select("v", F.explode("bands").alias("key"))
    sizes = durable(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    shared = durable(join_hot(banded, sizes, "key", "size"))
    popular = shared.groupBy("v").agg(F.sum("size").alias("popularity"))
    pivots = shared.join(popular, "v").groupBy("key").agg((-F.max(F.struct("popularity", -F.col("v")))["col2"]).alias("pivot"), F.max("size").alias("size"))
    pivots = durable(pivots)
    to_pivot = join_hot(shared.drop("size"), pivots, "key", "size").filter("v <> pivot").select(F.col("v").alias("a"), F.col("pivot").alias("b")).distinct()
    judged = durable(_judged(durable(to_pivot), classes, percent))
    tidy(docs.sparkSession)

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(v, members) of the classes wanted(v), from the text of one of their rows: rows that share id and text are many to the same class."""
        named = wanted.join(classes.select("v", "set_key", "rows", row_key(F.col("first.doc_id"), F.col("first.code")).alias("key")), "v")
        named = durable(named)
        texts = join_hot(rows.select(row_key(F.col("doc_id"), F.xxhash64("text")).alias("key"), "text"), named, "key", "rows").select("v", "text", "set_key")
        return durable(map_rows(texts, _sets(words), "v long, members array<long>").dropDuplicates(["v"]))

    measured = durable(_overlaps(judged, sets_of(judged.select(F.explode(F.array("a", "b")).alias("v")).distinct())))
    links = measured.filter(_linked(percent)).select("a", "b")
    tidy(docs.sparkSession)
    found = components(links)
    tidy(docs.sparkSession)

    # What is left: groups of a pivot that hold several components.
    members = to_pivot.select(F.col("a").alias("v"), F.col("b").alias("p")).unionByName(pivots.select(F.col("pivot").alias("v"), F.col("pivot").alias("p")).distinct())
    direct = measured.filter(_linked(percent)).select(F.col("a").alias("v"), F.col("b").alias("p"), F.lit(True).alias("direct"))
    members = durable(
        members.join(found, "v", "left").withColumn("label", F.coalesce("label", "v")).join(direct, ["v", "p"], "left").join(classes.select("v", "n"), "v")
        .select("v", "p", "label", "n", (F.col("direct").isNull() & (F.col("v") != F.col("p"))).alias("asks"))
    )
    blocks = lambda words, size: F.ceil(words / size).cast("int")
    groups = (
        members.groupBy("p")
        .agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"), blocks(F.sum(F.when(F.col("asks"), F.col("n"))), QUERY_SHINGLES).alias("yn"), blocks(F.sum("n"), GROUP_SHINGLES).alias("mn"))
        .filter("lo < hi and yn > 0")
    )
    open_members = join_hot(members, durable(groups), "p", "size")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("v"), F.col(n).cast("long")).cast("int")
    asking = open_members.filter("asks").withColumn("yb", own("yn")).withColumn("mb", upto("mn")).withColumn("is_y", F.lit(True))
    asked = open_members.withColumn("mb", own("mn")).withColumn("yb", upto("yn")).withColumn("is_y", F.lit(False))
    dealt = durable(asking.select("p", "yb", "mb", "is_y", "v", "label").unionByName(asked.select("p", "yb", "mb", "is_y", "v", "label")))
    if not dealt.isEmpty():
        wanted = dealt.select("v").distinct()
        full = dealt.join(sets_of(wanted), "v")
        more = durable(full.groupBy("p", "yb", "mb").applyInPandas(_links_of_block(percent), "a long, b long").distinct())
        if not more.isEmpty():
            found = components(links.unionByName(more))
    tidy(docs.sparkSession)

    labelled = classes.select("set_key", "v", "first", "rows").join(found, "v", "left").withColumn("label", F.coalesce("label", "v"))
    labelled = durable(labelled)
    heads = durable(labelled.groupBy("label").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("size")))
    of_class = durable(join_hot(labelled, heads, "label", "size").select("set_key", "head", "rows"))
    of_one = sketched.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "code")
    found = join_hot(sketched.filter("n_shingles > 0").select("doc_id", "code", "rid", "n_shingles", "set_key"), of_class, "set_key", "rows")
    found = found.select("doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"), (F.col("head.rid") == F.col("rid")).alias("kept"), "code")
    return found.unionByName(of_one)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each near-duplicate component, columns unchanged."""
    return keep_rows(docs, near_duplicates(docs, id_col, text_col, **how), id_col, text_col)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("code")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS members
  FROM w
), c AS (
  SELECT doc_id, len(members) AS n, members FROM s
), e AS (
  SELECT doc_id, n, hash(unnest(members)) AS m FROM c
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.m = b.m AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM c
  UNION
  SELECT r.doc_id, p.b FROM reach r JOIN pairs p ON r.other = p.a
)
SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_shingles, g.component_id, c.doc_id = g.component_id AS kept
FROM c JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) g USING (doc_id)
"""
