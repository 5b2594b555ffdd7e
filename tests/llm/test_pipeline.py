"""The corpus pipeline, stage by stage, against what each stage must keep."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from helixlens.llm import common, toxicity


@pytest.fixture(scope="module")
def stages(spark):
    """name -> (rows in, rows out) over the smallest data set, each stage written and read again."""
    d, out = "/root/testdata/sf0.001", {}
    docs = common.documents(spark, d)
    for name, stage in corpus_pipeline.STAGES:
        kept = common.stored(stage(spark, docs, d), name)
        out[name] = (docs.collect(), kept.collect())
        docs = kept
    return out


def test_columns(spark, stages):
    columns = common.documents(spark, "/root/testdata/sf0.001").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name in list(stages)[:-1]:
        assert list(stages[name][1][0].asDict()) == columns
        assert {tuple(r) for r in stages[name][1]} <= {tuple(r) for r in stages[name][0]}


def test_toxicity(spark, stages):
    toxic = {r["doc_id"]: r["toxic"] for r in common.labels(spark, "/root/testdata/sf0.001").collect()}
    before, after = stages["toxicity"]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    clean = [i for i, y in toxic.items() if y == 0]
    assert gone and sum(i in gone for i in clean) <= 0.1 * len(clean)


def test_exact_dedup(stages):
    before, after = stages["exact_dedup"]
    first = {}
    for r in sorted(before, key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(first.values())


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    sets = {}
    for r in before:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").lower())
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert sorted(r["doc_id"] for r in after) == sorted(i for i in sets if label[i] == i)


def test_mixing_and_packing(stages):
    before, after = stages["mixing"]
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    total = sum(map(words, before))
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3
    assert abs(sum(map(words, after)) - total) < 0.25 * total
    docs, pieces = stages["packing"]
    assert Counter(r["doc_id"] for r in docs) == Counter(r["doc_id"] for r in pieces if r["piece"] == 0)
    used = Counter()
    for r in pieces:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024 and len(used) <= 1.05 * -(-sum(used.values()) // 1024) + 1


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    key = lambda rows: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(got.collect()) == key(stages["packing"][1])


def test_mild_toxicity_goes(spark):
    """Texts without a single telling word, whose words all together tell."""
    r = np.random.default_rng(13)
    names = np.array([f"word{i}" for i in range(200)])
    odds = np.array([np.where(np.arange(200) % 2 == c, 0.62, 0.38) for c in (0, 1)])
    docs = spark.createDataFrame([(i, " ".join(r.choice(names, 400, p=odds[i % 2] / odds[i % 2].sum()))) for i in range(400)], "doc_id long, text string")
    kept = toxicity.without_toxic(docs, spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int"))
    stay = {x["doc_id"] for x in kept.collect()}
    assert sum((i in stay) == (i % 2 == 0) for i in range(300, 400)) >= 95


def test_toxicity_does_not_depend_on_length(spark):
    """A text and its repetitions, alike per word, go or stay together."""
    r = np.random.default_rng(15)
    names = np.array([f"word{i}" for i in range(200)])
    texts = [" ".join(r.choice(names[40 * (i % 3 == 0) :], 12)) for i in range(240)]
    docs = spark.createDataFrame([(1000 * k + i, " ".join([t] * k)) for k in (1, 3, 20) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = toxicity.without_toxic(docs, spark.createDataFrame([(1000 + i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int"))
    stay = {x["doc_id"] for x in kept.collect()}
    first = {i for i in range(240) if 1000 + i in stay}
    assert 0 < len(first) < 240 and all((k + i in stay) == (i in first) for k in (3000, 20000) for i in range(240))
