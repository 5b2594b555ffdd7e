"""Operator 5: quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is described by what its bytes and words look like, encoded by a small
network, and weighted by gated attention; the weighted sum of the encodings is the document's representation, which a
logistic layer scores. Attention, encoder and score are learnt together from labels of documents only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held_out, labels, map_rows, piece_hash, prefix_hash, text_of, word_bounds

PASSAGE_WORDS = 100
#: Labelled training documents that the network is fitted to, at most: those of the least hashed ids.
SAMPLE_DOCUMENTS = 6000
HIDDEN, ATTENTION, ROUNDS = 24, 12, 60
#: A small sample is gone over more often.
LEAST_BAGS, MOST_ROUNDS = 40_000, 600
THRESHOLD = 0.7
BIGRAMS = 64

_KINDS = "lower upper digit space newline bang bar dot mark other high".split()


def _kind_table() -> np.ndarray:
    kind = np.full(256, _KINDS.index("other"), np.int64)
    for name, codes in {
        "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": [9, 11, 12, 13, 32], "newline": [10], "bang": b"!?",
        "bar": b"|", "dot": b".,;:'\"-", "mark": b"#$%&*", "high": range(128, 256),
    }.items():
        kind[list(codes)] = _KINDS.index(name)
    return kind


_KIND = _kind_table()
_WORD_FACTS = 8
FEATURES = len(_KINDS) + BIGRAMS + _WORD_FACTS


def passages(text: bytes) -> np.ndarray:
    """A row of FEATURES numbers for each passage of PASSAGE_WORDS words, the last one possibly shorter; an empty text is one empty passage."""
    raw = np.frombuffer(text, np.uint8)
    start, end = word_bounds(raw)
    if not len(start):
        return np.zeros((1, FEATURES), np.float32)
    n = -(-len(start) // PASSAGE_WORDS)
    of_word = np.arange(len(start)) // PASSAGE_WORDS
    edges = np.append(start[::PASSAGE_WORDS], len(raw))
    edges[0] = 0
    sizes = np.diff(edges)
    of_byte = np.repeat(np.arange(n), sizes)
    kind = _KIND[raw]
    kinds = np.bincount(of_byte * len(_KINDS) + kind, minlength=n * len(_KINDS)).reshape(n, -1) / sizes[:, None]
    pair = (raw[:-1].astype(np.int64) * 37 + raw[1:] * 101) % BIGRAMS
    pairs = np.bincount(of_byte[:-1] * BIGRAMS + pair, minlength=n * BIGRAMS).reshape(n, -1) / sizes[:, None]
    words = np.bincount(of_word, minlength=n)
    mean = lambda x: np.bincount(of_word, x, minlength=n) / words
    length = (end - start).astype(float)
    code = piece_hash(prefix_hash(raw), start, end)
    _, first = np.unique(code, return_index=True)
    new = np.zeros(len(start))
    new[first] = 1
    spread = np.unique(of_word.astype(np.uint64) << np.uint64(48) | code >> np.uint64(16))
    distinct = np.bincount((spread >> np.uint64(48)).astype(np.int64), minlength=n) / words
    facts = [
        mean(length) / 10, np.sqrt(mean(length**2)) / 10, mean(kind[end - 1] > 1), mean(kind[start] == 1), mean((kind[start] == 1) & (kind[end - 1] == 1)),
        distinct, mean(new), np.log1p(words) / 5,
    ]
    return np.column_stack([np.sqrt(kinds), np.sqrt(pairs), *facts]).astype(np.float32)


class AttentionNet:
    """Gated-attention multiple-instance network on bags of passages."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        glorot = lambda a, b: r.normal(0, np.sqrt(2 / (a + b)), (a, b))
        self.shift, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.p = [glorot(FEATURES, HIDDEN), np.zeros(HIDDEN), glorot(HIDDEN, ATTENTION), glorot(HIDDEN, ATTENTION), glorot(ATTENTION, 1), glorot(HIDDEN, 1), np.zeros(1)]

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int):
        """Scores of n bags; bag: ascending bag number of each passage."""
        w, b, v, u, a, c, d = self.p
        x = np.clip((x - self.shift) / self.scale, -8, 8)
        h = np.tanh(x @ w + b)
        t, g = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = ((t * g) @ a)[:, 0]
        first = np.searchsorted(bag, np.arange(n))
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        weight = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(weight[:, None] * h, first)
        return 1 / (1 + np.exp(-np.clip((z @ c)[:, 0] + d, -60, 60))), (x, h, t, g, weight, z, first)

    def gradient(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w, b, v, u, a, c, d = self.p
        s, (x, h, t, g, weight, z, first) = self.forward(x, bag, len(y))
        ds = (s - y) / len(y)
        dz = ds[:, None] @ c.T
        dh = weight[:, None] * dz[bag]
        dw = (h * dz[bag]).sum(axis=1)
        de = weight * (dw - np.add.reduceat(weight * dw, first)[bag])
        dtg = de[:, None] @ a.T
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh += dt @ v.T + dg @ u.T
        da = dh * (1 - h * h)
        return [x.T @ da, da.sum(axis=0), h.T @ dt, h.T @ dg, (t * g).T @ de[:, None], z.T @ ds[:, None], np.array([ds.sum()])]

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4) -> AttentionNet:
        """Adam over shuffled batches of bags; the same data give the same network.

        At least `rounds` times over the bags, and as often as makes LEAST_BAGS of them (at most MOST_ROUNDS times).
        """
        self.shift, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-2
        r, n = np.random.default_rng(11), len(y)
        first, last = np.searchsorted(bag, np.arange(n)), np.searchsorted(bag, np.arange(n), side="right")
        m, q, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        rounds = max(rounds, min(MOST_ROUNDS, LEAST_BAGS // max(1, n)))
        for k in range(rounds):
            for own in np.array_split(r.permutation(n), max(1, n // batch)):
                rows = np.concatenate([np.arange(first[i], last[i]) for i in own])
                grads = self.gradient(x[rows], np.repeat(np.arange(len(own)), (last - first)[own]), y[own])
                step += 1
                for i, g in enumerate(grads):
                    g = g + decay * self.p[i]
                    m[i], q[i] = 0.9 * m[i] + 0.1 * g, 0.999 * q[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - rate * (1 - k / rounds) * (m[i] / (1 - 0.9**step)) / (np.sqrt(q[i] / (1 - 0.999**step)) + 1e-8)
        return self


def fit(docs: DataFrame, marked: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_documents: int = SAMPLE_DOCUMENTS) -> AttentionNet:
    """A network learnt from marked(doc_id, label) documents, at most sample_documents of them.

    Labels other than 0 and 1, null ids and ids without a document are left out. Where all that is left is of one
    label, or nothing is, the score of every document is that label's share (0.5 for nothing), kept off 0 and 1.
    """
    marked = marked.filter("doc_id is not null and label in (0, 1)").select(F.col("doc_id").alias("__id"), F.col("label").cast("int").alias("label"))
    sample = marked.orderBy(F.xxhash64("__id"), "__id").limit(sample_documents)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label")

    def describe():
        def one(batch):
            found = [passages(t.encode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
            yield {"doc_id": batch.column(0), "label": batch.column(2), "passages": [x.tobytes() for x in found]}

        return one

    bags = map_rows(rows, describe, "doc_id long, label int, passages binary").orderBy("doc_id").toArrow()
    net = AttentionNet()
    y = bags["label"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        net.p[5][:] = 0
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        net.p[6][:] = np.log(share / (1 - share))
    else:
        x = [np.frombuffer(b.as_py(), np.float32).reshape(-1, FEATURES) for b in bags["passages"]]
        net.fit(np.concatenate(x), np.repeat(np.arange(len(x)), [len(b) for b in x]), y)
    return net


def quality_scores(docs: DataFrame, net: AttentionNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1) and attention, the weight of each passage of the whole text.

    A null, empty or blank text is one empty passage.
    """
    state = (net.shift, net.scale, net.p)

    def judge():
        own = AttentionNet()
        own.shift, own.scale, own.p = state

        def one(batch):
            found = [passages(t.encode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
            sizes = [len(x) for x in found]
            bag = np.repeat(np.arange(len(found)), sizes)
            score, (*_, weight, _, _) = own.forward(np.concatenate(found), bag, len(found))
            yield {"doc_id": batch.column(0), "score": score, "attention": np.split(weight, np.cumsum(sizes)[:-1])}

        return lambda batch: one(batch) if batch.num_rows else iter(())

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return map_rows(rows, judge, "doc_id long, score double, attention array<double>")


def training_labels(marked: DataFrame) -> DataFrame:
    """Labels that may be learnt from: those of documents that are not held out."""
    return marked.filter(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", F.col("quality").alias("label"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = fit(docs, training_labels(labels(spark, sf_dir)))
    return quality_scores(docs, net).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


SQL = None
