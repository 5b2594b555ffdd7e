"""Operator 9: toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary labelled documents each have an interpolated Kneser-Ney bigram model with one fixed discount. Every
order counts continuations, that is distinct contexts, so that copies of a text add nothing: n_c(vw) is the number of
words seen before "v w" in class c, m_c(w) the number of words seen before w. With D the discount, [x] = max(x, 0),
N_c(v) and M_c the sums of n_c(v.) and m_c(.), and no index c for both classes together,

    p_c(w | v) = [n_c(vw) - D] / N_c(v) + lambda(v) u_c(w)      lambda(v): what discounting frees of n(v.)
    u_c(w)     = [m_c(w) - D] / M_c + gamma_c q(w)              gamma_c: what discounting frees of m_c(.)
    q(w)       = m(w) / M                                       continuation counts that the classes share

Expressions (words, and pairs of words) with fewer than LEAST_CONTEXTS contexts have no class counts: a rare one is
smoothed through the shared backoff counts and costs both classes the same. A pair that is not kept is compared by its
last word, since lambda is shared. A word's difference of log-likelihoods is log r, r = p_1(w | v) / p_0(w | v). Most words
of a toxic text are ordinary, and some of an ordinary one may be toxic; so it is taken a second time with both models backed
off to each other, s_c of class c, SHARES, being the part of a text's words that p_1 wrote and p_0 the others:

    g(w | v) = log[1 - s_1 + s_1 r] - log[1 - s_0 + s_0 r]

Every word counts, with its sign and however little it tells. Both differences are divided by the text's length, and
nothing else enters a score: a logistic curve of the two, fitted to labelled documents. Whole texts lie a little towards one
class by their language and share of rare words; the mean of log r holds that level, above which the mean of g stands out.

Counts cover all labelled training documents, in tables with a row for each distinct expression that grow with them.
The most frequent expressions, LOCAL at most, are broadcast and looked up where the documents are; words that may be
any other, by a Bloom filter of bounded size, are looked up by a join. A fuller filter lets more pass and loses none.
Differences are summed in fixed point, so that they depend neither on the order of rows nor on their layout.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import bloom, documents, durable, even_keys, has, held_out, join_counted, keep_rows, labels, lean, mix64, packed, piece_hash, prefix_hash, probes, signed, sliced, tasks, text_of, tidy, unpacked, word_bounds

#: The absolute discount of both orders.
DISCOUNT = 3
#: Expressions with fewer distinct contexts, classes together, have no class counts.
LEAST_CONTEXTS = 5
#: The parts of an ordinary and of a toxic text's words that the toxic model is taken to have written.
SHARES = (0.01, 0.02)
#: Expressions that are broadcast (some 32 bytes each, of which the places in the table take half).
LOCAL = 1 << 21
#: Labelled training documents that the logistic curve is fitted to, at most. A document of one of FOLDS parts of them is judged by counts without that part.
CURVE_DOCUMENTS, FOLDS = 6000, 4
THRESHOLD = 0.5

#: Differences of log-likelihood are counted in these units.
UNIT = 2.0**-24
#: The curve sees sums of g per word beyond this one by their logarithm.
PER_WORD = 1e-3
#: Words whose expressions a task counts at a time.
BLOCK_WORDS = 1 << 20
#: Labels that are broadcast (some 200 MB in a hash table); of more, only a filter is, and their texts are shuffled.
MANY_LABELS = 1 << 22
#: In place of a word before another: the text's beginning, and any word (the expression is a single word).
BEGIN, ANY = 1, 2

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_keys(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text in order. Words: runs of letters, digits and bytes beyond ASCII, A-Z lowered."""
    raw = _FOLD[np.frombuffer(text, np.uint8)]
    start, end = word_bounds(np.where(_LETTER[raw], raw, np.uint8(32)))
    return piece_hash(prefix_hash(raw), start, end) if len(start) else np.zeros(0, np.uint64)


def before(words: np.ndarray) -> np.ndarray:
    """The word before each."""
    return np.concatenate([np.full(min(1, len(words)), BEGIN, np.uint64), words[:-1]])


def expression(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit hash of "v w" for the filter."""
    return mix64(v * np.uint64(0x9FB21C651E98DF25) + w)


def _row(shard: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([blob], pa.binary())], names=["shard", "blob"])


def _types(shards: list[int]):
    """A task: the distinct (v, w, word before v) of each block of batches(label, fold, text), packed into a blob a shard.

    Sharding by w, and eight ways by v, keeps a pair together and deals a very common word over several shards.
    """

    def blobs(block):
        v, w, t, mark = (np.concatenate(x) for x in zip(*block, strict=True))
        t = (mix64(t) >> np.uint64(32)).astype(np.uint32)
        shard = ((mix64(w ^ (v & np.uint64(7)) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)) % np.uint64(len(shards))).astype(np.int64)
        order = np.lexsort((t, v, w, shard))
        v, w, t, mark, shard = v[order], w[order], t[order], mark[order], shard[order]
        at = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (t[1:] != t[:-1])))
        mark = np.bitwise_or.reduceat(mark, at)
        v, w, t, shard = v[at], w[at], t[at], shard[at]
        ends = np.append(np.flatnonzero(np.diff(shard)) + 1, len(shard))
        for lo, hi in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
            words, n = np.unique(w[lo:hi], return_counts=True)
            ahead, which = np.unique(v[lo:hi], return_inverse=True)
            yield _row(shards[shard[lo]], packed([words, n, ahead, which, t[lo:hi], mark[lo:hi]], (0, 2)))

    def run(batches):
        block, size = [], 0
        for batch in sliced(batches):
            for label, fold, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                w = word_keys(text.encode("utf-8", "replace"))
                if len(w):
                    v = before(w)
                    block.append((v, w, before(v), np.full(len(w), 1 << (label * FOLDS + fold), np.uint8)))
                    size += len(w)
                if size >= BLOCK_WORDS:
                    yield from blobs(block)
                    block, size = [], 0
        if block:
            yield from blobs(block)

    return run


#: Classes, and the folds left out (FOLDS: none), of the columns x{class}_{fold}.
CASES = [(c, f) for c in (0, 1) for f in range(FOLDS + 1)]
WORD, CONTEXT, PAIR, TOTAL, EXCESS = range(5)
COLUMNS = ["kind", "a", "b", *(f"x{c}_{f}" for c, f in CASES), "pooled", "mass", "kept"]


def _own_folds(c: int, f: int) -> np.uint8:
    """The bits of a class without a fold."""
    return np.uint8((((1 << FOLDS) - 1) & ~(1 << f if f < FOLDS else 0)) << (c * FOLDS))


def _count(shards: list[int]):
    """A shard's statistics: blobs, by the hash of their key, of what it has of each word, context and kept pair."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = map(unpacked, rows["blob"])
        w, v, t, mark = (np.concatenate(x) for x in zip(*((np.repeat(words, n), ahead[which], t, m) for words, n, ahead, which, t, m in parts), strict=True))
        order = np.lexsort((t, v, w))
        w, v, t, mark = w[order], v[order], t[order], mark[order]
        at = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (v[1:] != v[:-1]) | (t[1:] != t[:-1])))
        w, v, mark = w[at], v[at], np.bitwise_or.reduceat(mark, at)
        at = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (v[1:] != v[:-1])))
        n = np.diff(np.append(at, len(w)))
        mask, w, v = np.bitwise_or.reduceat(mark, at), w[at], v[at]
        counts = [np.add.reduceat((mark & _own_folds(c, f) > 0).astype(np.int64), at) for c, f in CASES]
        keep = n >= LEAST_CONTEXTS
        excess = np.where(keep, n - DISCOUNT, 0)
        words, of_w = np.unique(w, return_inverse=True)
        context, of_v = np.unique(v, return_inverse=True)
        by = lambda of, x, k: np.bincount(of, x, minlength=k).astype(np.int64)
        none = lambda x: np.zeros(len(x), np.int64)
        tables = [
            (WORD, words, words * 0, *(by(of_w, mask & _own_folds(c, f) > 0, len(words)) for c, f in CASES), by(of_w, None, len(words)), none(words), by(of_w, keep, len(words))),
            (CONTEXT, context, context * 0, *(by(of_v, x, len(context)) if f == FOLDS else none(context) for (_, f), x in zip(CASES, counts, strict=True)),
             by(of_v, n, len(context)), by(of_v, excess, len(context)), by(of_v, keep, len(context))),
            (PAIR, v[keep], w[keep], *(x[keep] for x in counts), n[keep], none(v[keep]), none(v[keep]) + 1),
        ]
        out = []
        for kind, a, b, *x in tables:
            to = (mix64(a ^ mix64(b)) >> np.uint64(32)) % np.uint64(len(shards))
            order = np.lexsort((a, to))
            ends = np.searchsorted(to[order], np.arange(len(shards) + 1))
            for shard, lo, hi in zip(shards, ends.tolist(), ends[1:].tolist(), strict=False):
                if lo < hi:
                    own = order[lo:hi]
                    out.append((shard, kind, packed([a[own], b[own], *(y[own] for y in x)], (0,))))
        return pd.DataFrame(out, columns=["shard", "kind", "blob"])

    return run


def _total(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums by key: kept pairs, the contexts and words that they need, words that have class counts, and sums over all words."""
    out = []
    for kind, own in rows.groupby("kind"):
        a, b, *x = (np.concatenate(y) for y in zip(*map(unpacked, own["blob"]), strict=True))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        a, b, x = a[at], b[at], [np.add.reduceat(y[order].astype(np.int64), at) for y in x]
        pooled, kept = x[-3], x[-1]
        if kind == WORD:
            known = pooled >= LEAST_CONTEXTS
            out += [(TOTAL, 0, 0, *(int(y.sum()) for y in x)), (EXCESS, 0, 0, *(int(np.maximum(y[known] - DISCOUNT, 0).sum()) for y in x[:-3]), 0, 0, 0)]
            own = known | (kept > 0)
        else:
            own = kept > 0
        out += zip(np.full(own.sum(), kind).tolist(), signed(a[own]).tolist(), signed(b[own]).tolist(), *(y[own].tolist() for y in x), strict=True)
    return pd.DataFrame(out, columns=COLUMNS)


def statistics(training: DataFrame) -> DataFrame:
    """kind, a, b, x{class}_{fold}, pooled, mass, kept of training(label, fold, text).

    A row for each word (a) with class counts, context (a) of kept pairs, and kept pair (a b); and, to be summed up, of
    the TOTAL over all words and of their EXCESS over the discount. x is m_c(a), N_c(a) (of which no fold is left out),
    n_c(ab); pooled the same for both classes; mass what a context's kept pairs have beyond the discount; kept the
    number of kept pairs that a word ends or a context begins.
    """
    shards = even_keys(tasks(training))
    schema = ", ".join(f"{c} {'int' if c == 'kind' else 'long'}" for c in COLUMNS)
    types = training.mapInArrow(lean(_types(shards)), "shard long, blob binary").repartition(len(shards), "shard")
    parts = types.groupBy("shard").applyInPandas(_count(shards), "shard long, kind int, blob binary").repartition(len(shards), "shard")
    return parts.groupBy("shard").applyInPandas(_total, schema)


def _excess(n: Column) -> Column:
    return F.greatest(n - DISCOUNT, F.lit(0)).cast("double")


@dataclass
class Table:
    """Numbers (a row of units) by 64-bit hash; the last row stands for hashes that are not there."""

    keys: np.ndarray
    units: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.keys, kind="stable")
        self.units = np.concatenate([self.units[order], np.zeros((1, self.units.shape[1]), self.units.dtype)])
        self.keys = np.append(self.keys[order], ~np.uint64(0))
        bits = len(order).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash."""
        at = self.first[h >> self.shift]
        low = np.flatnonzero(self.keys[at] < h)
        while len(low):
            at[low] += 1
            low = low[self.keys[at[low]] < h[low]]
        return np.where(self.keys[at] == h, at, np.int32(len(self.keys) - 1))


@dataclass
class Model:
    """Expressions and their g in UNITs, without each fold and then with all, and in the same order their plain differences.

    The most frequent ones are local, by expression(v, w). others(key, v, w, units), None without any, are in filter.
    """

    local: Table
    others: DataFrame | None
    filter: np.ndarray


def differences(stats: DataFrame) -> DataFrame:
    """(v, w, e, n) of words (v is ANY) and kept pairs, n being their contexts of both classes; stats: stored statistics()."""
    x = lambda c, f: F.col(f"x{c}_{f}")
    word = stats.filter(F.col("kind") == WORD)
    known = F.col("pooled") >= LEAST_CONTEXTS
    sums = {r["kind"]: r for r in stats.filter(F.col("kind") >= TOTAL).groupBy("kind").agg(*(F.sum(n).alias(n) for n in COLUMNS[3:])).collect()}
    of = lambda kind, n: (sums[kind][n] if kind in sums else 0) or 0
    m = {(c, f): float(of(TOTAL, f"x{c}_{f}") or 1) for c, f in CASES}
    free = {(c, f): 1 - of(EXCESS, f"x{c}_{f}") / m[c, f] for c, f in CASES}
    q = F.col("pooled") / float(of(TOTAL, "pooled") or 1)
    u = {k: F.when(known, _excess(x(*k)) / m[k] + free[k] * q).otherwise(q) for k in CASES}
    word = word.select(F.col("a").alias("w"), "kept", F.col("pooled").alias("n"), *(u[c, f].alias(f"u{c}_{f}") for c, f in CASES))
    e = lambda p: F.array(*[F.log(p(1, f)) - F.log(p(0, f)) for f in range(FOLDS + 1)])
    words = word.select(F.lit(ANY).cast("long").alias("v"), "w", e(lambda c, f: F.col(f"u{c}_{f}")).alias("e"), "n")
    context = stats.filter((F.col("kind") == CONTEXT) & (F.col("kept") > 0))
    context = context.select(F.col("a").alias("v"), "kept", (1 - F.col("mass") / F.col("pooled")).alias("back"), *(x(c, FOLDS).alias(f"N{c}") for c in (0, 1)))
    pairs = stats.filter(F.col("kind") == PAIR).select(F.col("a").alias("v"), F.col("b").alias("w"), F.col("pooled").alias("n"), *(x(c, f) for c, f in CASES))
    pairs = join_counted(pairs, context, "v", "kept").drop("kept")
    pairs = join_counted(pairs, word.filter("kept > 0").drop("n"), "w", "kept")
    p = lambda c, f: _excess(x(c, f)) / F.greatest(F.col(f"N{c}"), F.lit(1)) + F.col("back") * F.col(f"u{c}_{f}")
    return words.unionByName(pairs.select("v", "w", e(p).alias("e"), "n"))


def labelled(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """(label, fold, text) of rows(doc_id, text) that marked(id, label, fold) names, as often as it names them."""
    n, sc = marked.count(), rows.sparkSession.sparkContext
    if n <= MANY_LABELS:
        return rows.join(F.broadcast(marked), F.col("doc_id") == F.col("id")).select("label", "fold", "text")
    # Texts without a label stay where they are, but for the filter's false positives.
    ids = sc.broadcast(bloom(marked.select(F.col("id").alias("key")), n).tobytes())

    @F.pandas_udf("boolean")
    def perhaps(i: pd.Series) -> pd.Series:
        bitmap = np.frombuffer(ids.value, np.uint8)
        return pd.Series(has(bitmap, probes(i.fillna(0).to_numpy(np.int64).view(np.uint64), 8 * len(bitmap))) & i.notna().to_numpy())

    return rows.filter(perhaps("doc_id")).join(marked.hint("shuffle_hash"), F.col("doc_id") == F.col("id")).select("label", "fold", "text")


def _model(found: DataFrame) -> Model:
    """The model of stored expressions found(v, w, n, units)."""
    counts = sorted(((r["n"], r["count"]) for r in found.groupBy("n").count().collect()), reverse=True)
    upto = np.cumsum([k for _, k in counts])
    few = int(np.searchsorted(upto, LOCAL, "right"))
    least = counts[few][0] if few < len(counts) else 0
    local = found.filter(F.col("n") > least).select("v", "w", "units").toArrow()
    v, w = (local[c].to_numpy().view(np.uint64) for c in ("v", "w"))
    units = local["units"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 2 * (FOLDS + 1)), np.int32)
    table = Table(expression(v, w), units)
    if few == len(counts):
        return Model(table, None, np.zeros(0, np.uint8))
    others = found.filter(F.col("n") <= least)

    def hashed(batches):
        for batch in batches:
            v, w = (np.asarray(batch.column(i)).view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(signed(expression(v, w)))], names=["key"])

    bitmap = bloom(others.select("v", "w").mapInArrow(hashed, "key long"), int(upto[-1]) - len(v))
    return Model(table, others.select(F.xxhash64("v", "w").alias("key"), "v", "w", "units"), bitmap)


def fit(docs: DataFrame, marked: DataFrame, id_col: str = "doc_id", text_col: str = "text", curve_documents: int = CURVE_DOCUMENTS) -> tuple[Model, np.ndarray]:
    """The model of marked(doc_id, label) documents and the weights of its logistic curve.

    All marked documents are counted; at most curve_documents, those of the least hashed ids, fit the curve. Labels
    other than 0 and 1, null ids and ids without a document are left out.
    """
    marked = marked.filter("doc_id is not null and label in (0, 1)").select(F.col("doc_id").cast("long").alias("id"), F.col("label").cast("int").alias("label"))
    marked = marked.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    training = labelled(rows, marked)
    in_units = lambda x: F.round(x / UNIT).cast("int")
    units = F.concat(F.transform("e", lambda e: in_units(F.log1p(SHARES[1] * F.expm1(e)) - F.log1p(SHARES[0] * F.expm1(e)))), F.transform("e", in_units))
    found = differences(durable(statistics(training))).select("v", "w", "n", units.alias("units"))
    found = durable(found.filter(F.exists("units", lambda u: u != 0)))
    tidy(docs.sparkSession)
    model = _model(found)
    sample = F.broadcast(marked.orderBy(F.xxhash64("id"), "id").limit(curve_documents))
    curve = evidence(rows.join(sample, F.col("doc_id") == F.col("id")).select("doc_id", "text", "fold", "label"), model, range(FOLDS)).select("label", "n_words", "units", "plain").toArrow()
    tidy(docs.sparkSession)
    x, y = features(curve["plain"].to_numpy(), curve["units"].to_numpy(), curve["n_words"].to_numpy()), curve["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # rows arrive in any order; sums must not depend on it
    x, y = x[order], y[order]
    if 0 < y.sum() < len(y):
        return model, logistic(x, y)
    share = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    return model, np.array([0.0, 0.0, np.log(share / (1 - share))])


def features(plain: np.ndarray, units: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Length-normalised differences of log-likelihoods: the plain one, and that by g on a logarithmic scale of either sign."""
    per_word = lambda x: np.asarray(x, float) * UNIT / np.maximum(1, n_words)
    g = per_word(units)
    return np.column_stack([per_word(plain), np.sign(g) * np.log1p(np.abs(g) / PER_WORD)])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights (of x's columns, then constant) of a ridge logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-3 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def evidence(rows: DataFrame, model: Model, folds: range = range(FOLDS, FOLDS + 1)) -> DataFrame:
    """rows(doc_id, text, fold and others) without texts, with n_words, code (xxhash64 of the text), units and plain.

    units and plain are the sums of g and of the plain differences over all words, in UNITs; fold: the counts to leave out, one of folds.
    """
    others = [f.name for f in rows.schema if f.name != "text"]
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in others) + ", code long, doc long, n_words long, units long, plain long"
    if model.others is not None:
        schema += ", tokens array<struct<v: long, w: long, k: long, known: int, level: int, both: boolean>>"
    local = Table(model.local.keys[:-1], model.local.units[:-1, [*folds, *(f + FOLDS + 1 for f in folds)]])
    shared = rows.sparkSession.sparkContext.broadcast((local, model.filter))
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        doc, (local, bitmap) = TaskContext.get().partitionId() << 33, shared.value
        perhaps = lambda h: has(bitmap, probes(h, 8 * len(bitmap))) if len(bitmap) else np.zeros(len(h), bool)
        none = len(local.keys) - 1
        for batch in sliced(batches):
            words = [word_keys(t.encode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(w) for w in words], np.int64)
            w, v, of = np.concatenate([*words, np.zeros(0, np.uint64)]), np.concatenate([*map(before, words), np.zeros(0, np.uint64)]), np.repeat(np.arange(len(words)), sizes)
            pair, word = expression(v, w), expression(np.full(len(w), ANY, np.uint64), w)
            # A pair that is kept speaks for the token, else its last word.
            at = local.find(pair)
            rest = np.flatnonzero(at == none)
            at[rest] = local.find(word[rest])
            fold = np.asarray(batch.column("fold"))[of] - folds.start
            known, level = local.units[at, fold].astype(np.int64), local.units[at, fold + len(folds)].astype(np.int64)
            columns = {n: batch.column(n) for n in [*others, "code"]} | {"doc": doc + np.arange(len(words)), "n_words": sizes}
            columns |= {n: np.bincount(of, x, minlength=len(words)).astype(np.int64) for n, x in (("units", known), ("plain", level))}  # floats are exact below 2^53
            doc += len(words)
            if "tokens" in out.names:
                as_pair, as_word = perhaps(pair[rest]), (at[rest] == none) & perhaps(word[rest])
                hit = as_pair | as_word
                i, as_pair, as_word = rest[hit], as_pair[hit], as_word[hit]
                a, b, x = np.where(as_pair, v[i], np.uint64(ANY)), w[i], of[i]
                order = np.lexsort((b, a, x))
                i, a, b, x, both = i[order], a[order], b[order], x[order], (as_pair & as_word)[order]
                first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (x[1:] != x[:-1]))[: len(x)])
                k = np.diff(np.append(first, len(x)))
                kind = out.field("tokens").type
                tokens = pa.StructArray.from_arrays([pa.array(signed(a[first])), pa.array(signed(b[first])), pa.array(k, pa.int64()), pa.array(known[i[first]], pa.int32()), pa.array(level[i[first]], pa.int32()), pa.array(both[first])], fields=list(kind.value_type))
                columns["tokens"] = pa.ListArray.from_arrays(pa.array(np.searchsorted(x[first], np.arange(len(words) + 1)), pa.int32()), tokens, type=kind)
            yield pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, type=f.type) for f in out], schema=out)

    found = rows.withColumn("code", F.xxhash64("text")).mapInArrow(lean(run), schema)
    if model.others is None:
        return found.select(*others, "code", "n_words", "units", "plain")
    found = durable(found)
    token = found.select("doc", "fold", F.explode("tokens").alias("t")).select("doc", "fold", "t.*")
    # A token is looked up as a pair, as a word, or as both.
    either = F.when(F.col("both"), F.array(F.col("v"), F.lit(ANY).cast("long"))).otherwise(F.array("v"))
    looked = token.withColumn("at", F.explode(either)).withColumn("key", F.xxhash64("at", "w"))
    sizes = looked.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    keyed = durable(model.others.select("key", F.col("v").alias("own_v"), F.col("w").alias("own_w"), F.col("units").alias("own_units")).join(sizes, "key"))
    met = join_counted(looked, keyed, "key", "size").filter((F.col("at") == F.col("own_v")) & (F.col("w") == F.col("own_w")))
    mine = F.struct(F.element_at("own_units", F.col("fold") + 1).cast("long").alias("g"), F.element_at("own_units", F.col("fold") + FOLDS + 2).cast("long").alias("e"))
    spoken = met.groupBy("doc", "v", "w").agg(F.max_by(mine, F.col("at") != ANY).alias("own"), *(F.max(n).alias(n) for n in ("k", "known", "level")))
    more = spoken.groupBy(F.col("doc").alias("of")).agg(*(F.sum((F.col(f"own.{x}") - F.col(n)) * F.col("k")).alias(f"more_{x}") for x, n in (("g", "known"), ("e", "level"))))
    total = lambda n, x: (F.col(n) + F.coalesce(f"more_{x}", F.lit(0))).alias(n)
    return found.join(more, F.col("doc") == F.col("of"), "left").select(*others, "code", "n_words", total("units", "g"), total("plain", "e"))


def toxicity_scores(docs: DataFrame, model: Model, curve: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1), n_words, code (xxhash64 of the text).

    A text without words (null, empty, punctuation only) is as likely under both models and gets the score of such a text.
    Ids that repeat, null ones included, are scored each by their text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.lit(FOLDS).alias("fold"))
    (a, b, c), n = map(float, curve), F.greatest("n_words", F.lit(1))
    plain, g = (F.col(x) * UNIT / n for x in ("plain", "units"))
    x = a * plain + b * F.signum(g) * F.log1p(F.abs(g) / PER_WORD) + c
    score = 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(700.0)), F.lit(-700.0))))
    return evidence(rows, model).select("doc_id", score.alias("score"), "n_words", "code")


def training_labels(marked: DataFrame) -> DataFrame:
    """Labels that may be learnt from: those of documents that are not held out."""
    return marked.filter(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", F.col("toxic").alias("label"))


def without_toxic(docs: DataFrame, marked: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs that score below threshold, columns unchanged."""
    model, curve = fit(docs, training_labels(marked), id_col, text_col)
    return keep_rows(docs, toxicity_scores(docs, model, curve, id_col, text_col).withColumn("kept", F.col("score") < threshold), id_col, text_col)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, curve = fit(docs, training_labels(labels(spark, sf_dir)))
    return toxicity_scores(docs, model, curve).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


SQL = None
