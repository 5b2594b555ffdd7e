"""The document operators against brute force, on awkward documents, and against their SQL."""

import base64
import gzip
import hashlib
import heapq
import math
import re
import urllib.parse
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixlens.llm import common, exact_dedup, fingerprints, line_dedup, mixing, near_dedup, packing, quality, registry, secrets, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, digest string, code string, part int, label int, v long, p int, n int, key string"
PASSAGE = " ".join(f"passage{i}" for i in range(60))
LINE = "the very same line of more than twenty characters"
WORDS = np.random.default_rng(5).integers(0, 5000, (40, 300))


def docs_of(spark, rows):
    """rows: (doc_id, text, source); the other columns are null and clash with names that operators use."""
    return spark.createDataFrame([(i, t, None, s, None, 1, True, "x", "c", 2, 3, 4, 5, 6, "k") for i, t, s in rows], SCHEMA)


def awkward():
    rows = [(1, "a b c d", "s1"), (2, None, "s1"), (3, "", None), (4, "a  b\tc d", "s2"), (4, "a  b\tc d", "s2"), (None, "x y z", None), (None, None, "s2"), (7, "   ", "s1"), (8, "\n\n", "s1")]
    rows += [(10, PASSAGE + " tail one", "s3"), (11, "head two " + PASSAGE, "s3"), (12, PASSAGE, "s1"), (13, PASSAGE, "s2")]
    for i, w in enumerate(WORDS):
        body = [f"w{x}" for x in w]
        rows.append((100 + 2 * i, " ".join(body), f"s{i % 4}"))
        body[10 * (i % 3)] = "edited"
        rows.append((101 + 2 * i, " ".join(body), "s0"))
    rows += [(300 + i, f"{LINE}\nline {i} is another one of some length\n  {LINE.upper()} ", "s1") for i in range(4)]
    rows.append((400, " ".join(f"long{i % 9000}" for i in range(30_000)), "s2"))
    rows.append((401, 'été ☃ \U0001f600 password = "hunter2hunter2" <|endoftext|>', "s2"))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, awkward()).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, []).persist()


def by_row(rows, *names):
    return Counter(tuple(r[n] for n in names) for r in rows)


def least(ids):
    """Smallest id; null only if all are."""
    return min((i for i in ids if i is not None), default=None)


def test_exact_dedup(docs, empty):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, _ in awkward():
        groups[norm(t)].append(i)
    want = Counter((i, least(groups[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, _ in awkward())
    got = exact_dedup.exact_dedup(docs).collect()
    assert by_row(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.keep_first(docs).count() == len(groups) and exact_dedup.keep_first(docs).columns == docs.columns


def test_exact_dedup_heavy_groups(spark):
    rows = [(i, "hot" if i % 3 == 0 else "warm" if i % 5 == 0 else f"t{i}", "s") for i in range(1500)]
    got = exact_dedup.exact_dedup(docs_of(spark, rows)).collect()
    sizes = Counter(t for _, t, _ in rows)
    first = {}
    for i, t, _ in rows:
        first.setdefault(t, i)
    assert by_row(got, "doc_id", "keep_id", "group_size", "kept") == Counter((i, first[t], sizes[t], first[t] == i) for i, t, _ in rows)


def brute_repeats(texts, length):
    places = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if places[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def removed(df):
    rows = df.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("sha")).collect()
    return by_row(rows, "doc_id", "n_bytes", "n", "s", "sha")


@pytest.mark.parametrize("copies", [0, 1, 4000])
def test_join_counted(spark, copies):
    rows = spark.range(2 * copies).select((F.col("id") % 2 * (1 + F.col("id"))).alias("k"), F.col("id").alias("x"))
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("top")).filter("k <> 4")
    found = common.join_counted(rows, keyed, "k", "n")
    assert sorted(map(tuple, found.select("k", "x", "n", "top").collect())) == sorted(map(tuple, rows.join(keyed, "k").select("k", "x", "n", "top").collect()))


def test_suffix_dedup(docs, empty):
    rows = awkward()
    want = brute_repeats([(t or "").encode() for _, t, _ in rows], 200)
    assert removed(suffix_dedup.remove_repeats(docs)) == Counter((i, *w) for (i, _, _), w in zip(rows, want, strict=True))
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_suffix_dedup_small_alphabet(spark, seed):
    """Short strings over few letters: overlaps, repeats inside a text, and every mix of left and right contexts."""
    r = np.random.default_rng(seed)
    pool = ["".join(r.choice(list("ab"), 40)) for _ in range(6)]
    texts = ["".join(pool[k][r.integers(0, 12) : r.integers(20, 40)] for k in r.integers(0, 6, r.integers(0, 9))) for _ in range(40)] + ["a" * 100, "ab" * 60]
    want = brute_repeats([t.encode() for t in texts], 24)
    df = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for hot in (10**6, 5, 0):  # no, some and all suspected strings are handled as hot ones
        assert removed(suffix_dedup.remove_repeats(df, length=24, span=16, hot_documents=hot)) == Counter((i, *w) for i, w in enumerate(want))


def test_loser_tree():
    r = np.random.default_rng(3)
    keys = [bytes(r.choice(list(b"abc"), r.integers(0, 12))) for _ in range(500)]
    for k in (1, 2, 3, 7):
        runs = [sorted(keys[i::k]) for i in range(k)]
        out = list(suffix_dedup.merged([suffix_dedup.decoded(suffix_dedup.front_coded(x, x)) for x in runs]))
        assert [x for x, _, _ in out] == sorted(keys) == [own for _, _, own in out]
        assert all(h == suffix_dedup.common_prefix(a, b) for (a, _, _), (b, h, _) in zip(out, out[1:], strict=False))


def brute_components(rows, words=3, percent=85):
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        groups[find(i)].append(d)
    return Counter((d, len(sets[i]), least(groups[find(i)])) for i, (d, _, _) in enumerate(rows)), len(groups)


def test_near_dedup(docs, empty):
    want, n = brute_components(awkward())
    got = near_dedup.near_duplicates(docs).collect()
    assert by_row(got, "doc_id", "n_shingles", "component_id") == want
    assert sum(r["kept"] for r in got) == n and all(r["doc_id"] == r["component_id"] for r in got if r["kept"])
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.keep_one_of_each(docs).count() == n


def test_near_dedup_chains_and_centres(spark):
    """Copies of copies, and a group whose members are close to its centre and not to each other."""
    r = np.random.default_rng(1)
    rows, body = [], [f"c{x}" for x in range(200)]
    for i in range(25):
        body = [*body]
        body[int(r.integers(0, 200))] = f"step{i}"
        rows.append((1000 + i, " ".join(body), "s"))
    centre = [f"k{x}" for x in range(150)]
    for i in range(60):
        own = [*centre]
        for p in r.choice(150, int(r.integers(1, 9)), replace=False):
            own[p] = f"e{i}_{p}"
        rows.append((2000 + i, " ".join(own), "s"))
    want, n = brute_components(rows)
    got = near_dedup.near_duplicates(docs_of(spark, rows)).collect()
    assert by_row(got, "doc_id", "n_shingles", "component_id") == want and sum(x["kept"] for x in got) == n


def test_near_dedup_of_one_id(spark):
    """Thousands of rows that share a null id: near copies, exact copies and a text of all others."""
    r = np.random.default_rng(6)
    body = [f"b{x}" for x in range(60)]
    texts = [" ".join([*body[: (at := int(r.integers(0, 60)))], f"e{i}", *body[at + 1 :]]) for i in range(3000)]
    rows = [(None, t, "s") for t in texts] + [(None, "the same text each time it is seen", "s")] * 1500 + [(5, None, "s")]
    got = near_dedup.near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows) and sum(x["kept"] for x in got) == 3


def test_links_of_block_join_what_all_pairs_join():
    r = np.random.default_rng(5)
    for size in (1, 3, 40, 70):
        base = r.choice(400, 60, replace=False)
        sets = [np.unique(np.where(r.random(60) < r.choice([0.02, 0.1, 0.3]), r.integers(400, 460, 60), base)).astype(np.int64) for _ in range(size)]
        rows = pd.DataFrame({"v": range(size), "is_y": r.random(size) < 0.5, "label": range(size), "members": sets})
        pairs = [(y, x) for y in range(size) for x in range(size) if rows.is_y[y] and not rows.is_y[x]]
        common = {(y, x): len(np.intersect1d(sets[y], sets[x])) for y, x in pairs}
        linked = [(y, x) for y, x in pairs if 100 * common[y, x] >= 80 * (len(sets[y]) + len(sets[x]) - common[y, x])]

        def classes(links, size=size):
            label = list(range(size))
            for a, b in links:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
            return sorted(sorted(i for i in range(size) if label[i] == x) for x in set(label))

        found = near_dedup._links_of_block(80)(rows)
        assert classes(zip(found["a"], found["b"], strict=True)) == classes(linked)


def test_links_of_block_are_a_forest():
    import pandas as pd

    rows = [{"is_y": y, "v": i, "label": i, "members": np.arange(100)} for y in (True, False) for i in range(200)]
    links = near_dedup._links_of_block(85)(pd.DataFrame(rows))
    assert len(links) == 199 and set(links["a"]) | set(links["b"]) == set(range(200))


def test_sketches():
    r = np.random.default_rng(2)
    a, b = (np.unique(r.integers(0, 2**63, 4000).astype(np.uint64)) for _ in range(2))
    both = np.concatenate([a[:2000], b])
    merged = np.maximum(near_dedup.registers(a), near_dedup.registers(b))
    assert (near_dedup.registers(np.unique(np.concatenate([a, b]))) == merged).all()
    j = len(np.intersect1d(b, both)) / len(np.union1d(b, both))
    assert abs((near_dedup.registers(b) == near_dedup.registers(both)).mean() - j) < 0.15
    far = near_dedup.plausible(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([4000.0]), np.array([4000.0]))
    same = near_dedup.plausible(near_dedup.registers(a)[None], near_dedup.registers(a[:3700])[None], np.array([4000.0]), np.array([3700.0]))
    assert not far[0] and same[0]


def test_mixing(docs, empty):
    rows = awkward()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in rows if s is not None}) + [None]
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    stopped, target = set(), {}
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in stopped)
        target = {s: 3.0 * total[s] if s in stopped else left * weight[s] / sum(weight[x] for x in sources if x not in stopped) for s in sources}
        above = {s for s in sources if target[s] > 3 * total[s]}
        if not above:
            break
        stopped |= above
    got = mixing.mix_sources(docs).collect()
    assert by_row(got, "doc_id", "size", "source_size") == Counter((i, size(t), total[s]) for i, t, s in rows)
    unit = {s: max(16, math.ceil(target[s] / 1000 - 1e-9)) for s in sources}
    for s in sources:
        own = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 for r in own) and all(0 <= r["taken"] <= 3 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= sum(unit.values())
    assert sum(r["taken"] for r in got) == sum(total.values())
    assert mixing.mix_sources(empty).count() == 0
    assert by_row(mixing.mix_sources(docs.repartition(7)).collect(), "doc_id", "taken") == by_row(got, "doc_id", "taken")
    placed = mixing.queue(docs).persist()
    for budget in (None, sum(total.values()) // 2, 10**9, 0):
        served = mixing.schedule(placed, budget).collect()
        assert [r["finish"] for r in served] == sorted(r["finish"] for r in served)
        taken = [r["taken"] for r in mixing.mix_sources(docs, budget_words=budget).collect()]
        assert sum(r["words"] for r in served) == sum(taken) == min(sum(total.values()) if budget is None else budget, 3 * sum(total.values()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and 0.5 < mixed.count() / len(rows) < 3


@pytest.mark.parametrize("most", [0, 10**6])
def test_mixing_against_a_queue(spark, monkeypatch, most):
    """Packets served one by one, the earliest finish time first, until the budget is spent; a hot source and repeated ids."""
    monkeypatch.setattr(mixing, "FEW_SOURCES", most)
    r = np.random.default_rng(4)
    rows = [(i % 90 if i < 95 else None, "w " * int(r.integers(0, 400 if i % 7 else 3000)), "hot" if i % 3 else f"s{i % 11}") for i in range(120)]
    got = mixing.mix_sources(docs_of(spark, rows).repartition(5)).collect()
    target, total = {x["source"]: x["target"] for x in got}, Counter()
    queues = defaultdict(list)
    for i, t, s in rows:
        total[s] += t.count("w")
        queues[s].append((hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest(), t.count("w"), i))
    same = Counter((x[0], s) for s, q in queues.items() for x in q)
    heap = []
    for s, q in queues.items():
        sent, unit = 0, max(16, math.ceil(target[s] / 1000))
        for serving in range(3):
            for ticket, size, i in sorted(q):
                for k, at in enumerate(range(0, size, unit)):
                    words = min(unit, size - at)
                    sent += words
                    heap.append((sent / target[s], ticket, serving, k, words, i, s, same[ticket, s] == 1))
    left, taken = sum(total.values()), Counter()
    heapq.heapify(heap)
    while left > 0:
        _, _, _, _, words, i, s, _ = heapq.heappop(heap)
        taken[i, s] += min(words, left)
        left -= words
    clear = {(i, s) for s, q in queues.items() for ticket, _, i in q if same[ticket, s] == 1}
    assert len(clear) > 60 and sum(x["taken"] for x in got) == sum(total.values())
    assert all(abs(x["taken"] - taken[x["doc_id"], x["source"]]) <= 16 for x in got if (x["doc_id"], x["source"]) in clear)


def test_running_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("x"), F.lit(1).cast("long").alias("one"))
    rows = sorted(common.running_sums(df, [F.col("k")], upto="x", rank="one").collect(), key=lambda r: r["k"])
    upto = 0
    for n, r in enumerate(rows):
        assert (r["upto"], r["rank"]) == (upto, n)
        upto += r["x"] or 0
    assert common.running_sums(df.limit(0), [F.col("k")], upto="x").count() == 0


@pytest.mark.parametrize("names", [("key", "row", "n", "turn"), ("__key", "__rank", "copy", "m")])
def test_clashing_columns(spark, names):
    """Stages keep rows whole whatever their further columns are called; repeated rows and null ids included."""
    rows = [(i, t, s, i, "x", None, 2) for i, t, s in awkward()]
    df = spark.createDataFrame([(i, t, s, *x) for i, t, s, *x in rows], "doc_id long, text string, source string, " + ", ".join(f"`{n}` {t}" for n, t in zip(names, ("long", "string", "string", "int"), strict=True)))
    for stage in (exact_dedup.keep_first, near_dedup.keep_one_of_each, mixing.mixed_documents):
        out = stage(df)
        assert out.columns == df.columns and 0 < out.count() and out.exceptAll(df).distinct().join(df, "doc_id", "left_anti").filter("doc_id is not null").count() == 0


@pytest.mark.parametrize("most", [1 << 29, 1 << 10])
def test_line_dedup(docs, empty, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "MAX_BITS", most)
    monkeypatch.setattr(line_dedup, "SHARD_BITS", 1 << 14)
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 50)
    rows = awkward()
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    dropped = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(k) >= 20 and len(ids) >= 3}
    want = Counter()
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if dropped.get(key(x), i) == i]
        want[(i, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    got = line_dedup.dedup_lines(docs).collect()
    assert by_row(got, "doc_id", "text", "n_lines", "n_dropped") == want and sum(r["n_dropped"] for r in got) > 0
    assert line_dedup.dedup_lines(empty).count() == 0


def naive_winnow(text, k, window):
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(codes):
        return []
    start = np.arange(max(1, len(codes) - k + 1))
    h = (common.piece_hash(common.prefix_hash(codes), start, np.minimum(start + k, len(codes))) >> np.uint64(32)).tolist()
    w = min(window, len(h))
    return sorted({max(range(i, i + w), key=lambda j: (-h[j], j)) for i in range(len(h) - w + 1)})


def test_fingerprints(docs, empty):
    for t in ("", "a", "short", "ab" * 100, "été ☃ " * 40, " ".join(map(str, range(300)))):
        assert fingerprints.winnow(t, 8, 9)[1].tolist() == naive_winnow(t, 8, 9)
    shared = " ".join(map(str, range(500, 560)))
    a, b = (set(fingerprints.winnow(x)[0].tolist()) for x in ("left " * 30 + shared, shared + " right" * 30))
    assert len(shared) >= fingerprints.K + fingerprints.WINDOW - 1 and a & b
    order = sorted(awkward(), key=lambda r: (r[0] is None, r[0] or 0))
    got = fingerprints.edited_likeness(docs).collect()
    want, unique = {}, Counter(i for i, _, _ in order)
    for (i, t, _), (j, u, _) in zip(order, [*order[1:], order[0]], strict=True):
        cut = len(t or "") // 4
        if unique[i] == unique[j] == 1:
            want[i] = (len(t or ""), hashlib.sha256(((t or "")[: len(t or "") - cut] + (u or "")[:cut]).encode()).hexdigest())
    assert len(got) == len(order)
    assert all((r["n_chars"], r["edited_sha256"]) == want[r["doc_id"]] for r in got if r["doc_id"] in want)
    for n in range(4, 300):
        text = "".join(map(chr, np.random.default_rng(n).integers(97, 123, n)))
        edited = text[: n - n // 4] + "#" * (n // 4)
        assert fingerprints.likeness(*(fingerprints.winnow(t, *fingerprints.sizes(n))[0] for t in (text, edited))) > 0
    long = [r for r in got if r["n_chars"] > 1500]
    assert all(r["near_edited"] > 0.4 for r in long) and all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (12, 13)}) == 1
    assert fingerprints.edited_likeness(empty).count() == 0 and fingerprints.fingerprints(docs).count() == len(order)
    one = fingerprints.edited_likeness(docs.filter("doc_id = 12")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs).collect()
    ids = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x, _ in awkward()]
    want = Counter()
    for i, x in ids:
        first = len(x) % 1024 or 1024
        cuts = [0, *range(first, len(x) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes()))] += 1
    assert by_row(got, "doc_id", "piece", "start", "length", "ids_crc32") == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    whole = packing.best_fit([r["length"] for r in got])[2]  # all pieces packed in one place
    assert len(places) <= 1.02 * len(whole) + 1
    assert packing.pack(empty).count() == 0


def test_packing_keeps_bins_open():
    import pandas as pd

    rows = pd.DataFrame({"part": 0, "used": [600] * 30_000, "members": [[{"bin": i, "base": 0}] for i in range(30_000)], "open": True})
    assert packing._merge(1024, 4)(rows)["open"].sum() == 30_000


@pytest.mark.parametrize("most", [8, 10**6])
def test_packing_of_dealt_bins(spark, monkeypatch, most):
    """Bins of 600 tokens and of 400 by turns; tasks may hold few or all of them."""
    monkeypatch.setattr(packing, "TASK_BINS", most, raising=False)
    rows = [(i, "a " * (400 if i % 2 else 600), "s") for i in range(64)]
    got = packing.pack(docs_of(spark, rows).repartitionByRange(64, "doc_id")).collect()
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(got) == 64 and all(sum(n for _, n in x) == max(a + n for a, n in x) <= 1024 for x in places.values())
    assert len(places) <= 40


def test_best_fit():
    r = np.random.default_rng(0)
    for sizes in ([], [5], [1024] * 3, r.integers(1, 1024, 500).tolist(), r.integers(1, 60, 500).tolist()):
        bins, offsets, used = packing.best_fit(sizes)
        fill = Counter()
        for b, s in zip(bins, sizes, strict=True):
            fill[b] += s
        assert all(fill[b] == u <= 1024 for b, u in enumerate(used)) and len(offsets) == len(sizes)
        assert len(used) <= 1.12 * -(-sum(sizes) // 1024) + 1 or max(sizes) > 512


def test_secrets(docs, empty):
    key = "password = " + "hunter2hunter2"
    hexed = "deadbeef" * 5
    layers = {
        "plain": key, "url": urllib.parse.quote(key), "unicode": key.replace("=", "\\u003d"), "base64": base64.b64encode(key.encode()).decode(),
        "twice": base64.b64encode(urllib.parse.quote(key).encode()).decode(), "gzip": base64.b64encode(gzip.compress(f"note {key} {hexed}".encode())).decode(),
        "deep": urllib.parse.quote(base64.b64encode(base64.b64encode(zlib.compress(key.encode()))).decode()),
    }
    for name, text in layers.items():
        base, spans = secrets.find_secrets(f"see <{text}> there")
        assert set(base) <= set(spans), name
        inside = [(s, e) for s, k, e in spans if k == 0]
        assert inside and all(5 <= s < e <= 5 + len(text) for s, e in inside), name
        assert bool(base) == (name == "plain")
    assert secrets.find_secrets("")[1] == [] and secrets.find_secrets("token: secret: abcdefghij")[0] == []
    assert secrets.find_secrets("TOKEN='abcdefgh' AKIAABCDEFGHIJKL " + "a1" * 16)[0] == [(0, 0, 15), (17, 1, 33), (34, 2, 66)]
    assert secrets.find_secrets("apiKey:abc api_key : \"0123456789")[0] == [(11, 0, 32)]
    got = secrets.secret_spans(docs).collect()
    assert len(got) == len(awkward()) and [len(r["base"]) for r in got if r["doc_id"] == 401] == [1]
    assert secrets.secret_spans(empty).count() == 0


def test_secrets_long_and_many_members():
    key = b"password = hunter2hunter2"
    wrapped = lambda raw: f"see {base64.b64encode(raw).decode()} there"
    long = b"\xc3\xa9 words, and more of them.\n" * 700_000  # over 16 MB; a cut would fall inside a character
    for raw in (gzip.compress(b"first") + gzip.compress(key), gzip.compress(long + key), gzip.compress(gzip.compress(long + b"\n" + base64.b64encode(zlib.compress(key)))), zlib.compress(key + b" " + long)):
        text = wrapped(raw)
        assert [x for x in secrets.find_secrets(text)[1] if x[1] == 0 and x[2] - x[0] > 30] == [(4, 0, len(text) - 6)]


def test_secrets_do_not_depend_on_size(monkeypatch):
    key = b"password = hunter2hunter2"
    wrapped = lambda raw: f"see {base64.b64encode(raw).decode()} there"
    long = b"\1 words, and more of them.\n" * 700_000  # over 16 MB, and no plain text
    text = wrapped(gzip.compress(long + gzip.compress(key) + b" end"))
    assert [x for x in secrets.find_secrets(text)[1] if x[1] == 0] == [(4, 0, len(text) - 6)]
    damaged = b"\x78\x9c\x4b\x4c\xff" + b"\1" * 9 + gzip.compress(key)  # unfolds to one character, then breaks
    assert any(k == 0 for _, k, _ in secrets.find_secrets(wrapped(damaged))[1])
    lines = b"".join(b"line %d of some words\n" % i for i in range(40))
    inner = [b"hunter2hunter2\n" + lines + b"secret:", lines + b"x" + gzip.compress(key), b"\1" + lines + gzip.compress(lines + b"\2" + zlib.compress(key)), lines + key + b"\n" + lines + base64.b64encode(key)]
    texts = [f"password={base64.b64encode(f(x)).decode()}={'abcd' * 4} end" for x in inner for f in (gzip.compress, zlib.compress, bytes)]
    texts += [f"see {urllib.parse.quote(gzip.compress(x))} there" for x in inner[1:]]
    want = [secrets.find_secrets(x) for x in texts]
    assert all(any(k == 0 for _, k, _ in spans) for _, spans in want)
    for most, chunk in ((64, 64), (200, 100), (1, 1)):
        monkeypatch.setattr(secrets, "IN_PLACE", most)
        monkeypatch.setattr(secrets, "CHUNK", chunk)
        assert [secrets.find_secrets(x) for x in texts] == want


def test_secrets_in_mixed_layers():
    key = "password = hunter2hunter2"
    deep = base64.b64encode(key.encode()).decode()
    packed = [gzip.compress(f"note {key}".encode()), zlib.compress(f"note {key}".encode())]
    layers = [base64.b64encode(f"{x} {y}".encode(code)).decode() for x in ("\u00a0", "\x0c", "\0", "caf\xe9") for y in (key, deep) for code in ("utf-8", "latin-1")]
    layers += [base64.b64encode(f"{x} {key}".encode()).decode() for x in ("\u3000", "\u200b", "\ufeff", "\xad")]
    layers += [base64.b64encode(zlib.compress(f"\ufeff{key}".encode())).decode(), base64.b64encode(b"\1\2\3" + packed[0]).decode()]
    for raw in packed:
        layers += [urllib.parse.quote(raw), urllib.parse.quote_plus(raw), "".join(f"%{x:02X}" for x in raw), "".join(f"\\x{x:02x}" for x in raw), repr(raw)[2:-1]]
    for text in layers:
        found = [(s, e) for s, k, e in secrets.find_secrets(f"see <{text}> there")[1] if k == 0]
        assert found and all(5 <= s < e <= 5 + len(text) for s, e in found), text


def test_secrets_wrapped_and_glued():
    key = "password = hunter2hunter2"
    lines = [base64.encodebytes(gzip.compress(np.random.default_rng(0).bytes(150) + key.encode())).decode(), base64.encodebytes(f"{'long ' * 10}{key}".encode()).decode()]
    blob = base64.b64encode(f"{'words ' * 30}{key}".encode()).decode()
    lines += ["\r\n".join(blob[i : i + 64] for i in range(0, len(blob), 64)), "\\n".join(blob[i : i + 76] for i in range(0, len(blob), 76)), "\n".join(blob[i : i + 16] for i in range(0, len(blob), 16)) + "\nwords"]
    lines += [f"{'glued'[:n]}{c}{blob.rstrip('=')}" for n in range(5) for c in "/_-x"] + [blob.rstrip("=") + "tail"[:n] for n in range(5)]
    for text in lines:
        found = [(s, e) for s, k, e in secrets.find_secrets(f"see <{text}> there")[1] if k == 0]
        assert found and all(5 <= s < e <= 5 + len(text) for s, e in found), text


def base_spans(text):
    """The contract's base rules word by word."""
    out = []
    for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] if len(m[1]) >= 8 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in common.documents(spark, sf).collect()}
    rows = registry.QUERIES["op10_secrets"](spark, sf).collect()
    assert len(rows) == len(texts) and any(r["n_assign"] for r in rows)
    for r in rows:
        base = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
        assert {*filter(None, secrets.joined(base).split(","))} <= {*filter(None, r["spans"].split(","))}


def held_out_accuracy(spark, query, column, d):
    rows = {r["doc_id"]: r for r in registry.QUERIES[query](spark, d).collect()}
    marked = [(rows[r["doc_id"]], r[column]) for r in common.labels(spark, d).collect()]
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    held = [(r["predicted"], y) for r, y in marked if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % (4 if column == "quality" else 5) == (2 if column == "quality" else 0)) for i, r in rows.items())
    return sum(p == y for p, y in held) / len(held)


def test_quality(spark, docs, empty):
    assert held_out_accuracy(spark, "op5_quality", "quality", "/root/testdata/sf0.01") > 0.93
    net = quality.AttentionNet()
    rows = quality.quality_scores(docs, net).collect()
    assert len(rows) == len(awkward()) and all(abs(sum(r["attention"]) - 1) < 1e-6 for r in rows)
    assert quality.quality_scores(empty, net).count() == 0
    untrained = quality.fit(empty, docs.select("doc_id", F.lit(1).alias("label")).limit(0))
    assert {r["score"] for r in quality.quality_scores(docs, untrained).collect()} == {0.5}
    bad = quality.fit(docs, docs.filter("doc_id < 5").select("doc_id", F.lit(0).alias("label")))
    assert all(r["score"] < 0.01 for r in quality.quality_scores(docs, bad).collect())


def test_quality_gradient():
    r = np.random.default_rng(0)
    net, x, bag, y = quality.AttentionNet(), r.normal(size=(9, quality.FEATURES)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = net.forward(x, bag, 3)[0]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for p, g in zip(net.p, net.gradient(x, bag, y), strict=True):
        at = tuple(int(r.integers(0, n)) for n in p.shape)
        p[at] += 1e-6
        up = loss()
        p[at] -= 2e-6
        down = loss()
        p[at] += 1e-6
        assert abs((up - down) / 2e-6 - g[at]) < 1e-5


def test_toxicity(spark, docs, empty):
    assert held_out_accuracy(spark, "op9_toxicity", "toxic", "/root/testdata/sf0.01") > 0.95
    none = spark.createDataFrame([], "doc_id long, label int")
    model, curve = toxicity.fit(docs, none)
    rows = toxicity.toxicity_scores(docs, model, curve).collect()
    assert len(rows) == len(awkward()) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity_scores(empty, model, curve).count() == 0
    odd = spark.createDataFrame([(1, 1), (12, 0), (None, 1), (10, None), (99999, 1)], "doc_id long, label int")
    assert toxicity.toxicity_scores(docs, *toxicity.fit(docs, odd)).count() == len(awkward())


def brute_differences(rows):
    """rows: (label, fold, text). Every expression's difference of log-likelihoods from sets of contexts, by the formulas."""
    types, folds, d, least = defaultdict(set), toxicity.FOLDS, toxicity.DISCOUNT, toxicity.LEAST_CONTEXTS
    for label, fold, text in rows:
        w = ["<", "<", *text.split()]
        for t, v, x in zip(w, w[1:], w[2:], strict=False):
            types[t, v, x].add((label, fold))
    out, contexts = {}, defaultdict(set)
    for t, v, x in types:
        contexts[v, x].add(t)
    for left_out in range(folds + 1):
        n, pooled, m, both = defaultdict(Counter), Counter(), defaultdict(Counter), Counter()
        seen = defaultdict(set)
        for (_, v, x), marks in types.items():
            pooled[v, x] += 1
            for c in {c for c, f in marks if f != left_out}:
                n[c][v, x] += 1
                seen[v, x].add(c)
        for v, x in pooled:
            both[x] += 1
            for c in seen[v, x]:
                m[c][x] += 1
        over = lambda k: max(k - d, 0)
        total = [sum(m[c].values()) or 1 for c in (0, 1)]
        free = [1 - sum(over(m[c][x]) for x in both if both[x] >= least) / total[c] for c in (0, 1)]
        q = {x: k / sum(both.values()) for x, k in both.items()}
        u = [{x: over(m[c][x]) / total[c] + free[c] * q[x] if both[x] >= least else q[x] for x in both} for c in (0, 1)]
        kept = {k for k, x in pooled.items() if x >= least}
        whole = [Counter() for _ in range(3)]
        for v, x in pooled:
            whole[2][v] += pooled[v, x]
            for c in (0, 1):
                whole[c][v] += sum(any(k == c for k, _ in types[a, v, x]) for a in contexts[v, x])
        back = {v: 1 - sum(over(pooled[k]) for k in kept if k[0] == v) / whole[2][v] for v in {k[0] for k in kept}}
        for x in both:
            out.setdefault((None, x), []).append(math.log(u[1][x]) - math.log(u[0][x]))
        for v, x in kept:
            p = [over(n[c][v, x]) / max(whole[c][v], 1) + back[v] * u[c][x] for c in (0, 1)]
            out.setdefault((v, x), []).append(math.log(p[1]) - math.log(p[0]))
    return out


def test_toxicity_against_brute_force(spark):
    r = np.random.default_rng(8)
    words = [f"w{i}" for i in range(30)]
    rows = [(int(i % 4 == 0), int(i % toxicity.FOLDS), " ".join(r.choice(words[5 * int(i % 4 == 0) :], int(r.integers(0, 60)), p=None))) for i in range(120)]
    rows += [(1, 1, "you are w1 w2 bad w3")] * 3 + [(0, 0, "")]
    want = brute_differences(rows)
    code = {**{toxicity.signed(toxicity.word_keys(x.encode()))[0]: x for x in {y for _, _, t in rows for y in t.split()}}, toxicity.BEGIN: "<", toxicity.ANY: None}
    for parts in (1, 5):
        df = spark.createDataFrame([(a, b, c) for a, b, c in rows], "label int, fold int, text string").repartition(parts)
        got = {(code[x["v"]], code[x["w"]]): x["e"] for x in toxicity.differences(common.durable(toxicity.statistics(df))).collect()}
        # Words without class counts are as likely in both classes.
        assert got.keys() <= want.keys() and any(k[0] for k in got) and all(want[k] == [0] * (toxicity.FOLDS + 1) for k in want.keys() - got.keys())
        assert all(abs(a - b) < 1e-9 for k, x in got.items() for a, b in zip(x, want[k], strict=True))


def test_even_keys(spark):
    for n in (1, 7, 51):
        df = spark.createDataFrame([(k,) for k in common.even_keys(n)], "k long")
        assert [r[0] for r in df.select(F.pmod(F.hash("k"), F.lit(n))).collect()] == list(range(n))


@pytest.mark.parametrize("most", [0, 10**6])
def test_toxicity_sees_expressions(spark, monkeypatch, most):
    """Words that are ordinary each by itself and toxic together; scores do not depend on the layout."""
    monkeypatch.setattr(toxicity, "MANY_LABELS", most)
    r = np.random.default_rng(9)
    names = np.array([f"word{i}" for i in range(60)])
    rows = []
    for i in range(600):
        body = r.choice(names, 40).tolist()
        for at in sorted(r.choice(36, 3, replace=False).tolist()):
            body[at : at + 2] = ["drop", "dead"] if i % 4 == 0 else [["drop", "word1"], ["word2", "dead"]][at % 2]
        rows.append((i, " ".join(body), "s"))
    marked = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400)], "doc_id long, label int")
    df = docs_of(spark, rows)
    scores = []
    for parts in (1, 3, 7):
        own = df.repartition(parts)
        scores.append({x["doc_id"]: x["score"] for x in toxicity.toxicity_scores(own, *toxicity.fit(own, marked)).collect()})
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == 600
    assert sum((s >= 0.5) == (i % 4 == 0) for i, s in scores[0].items() if i >= 400) >= 190


@pytest.mark.parametrize("local", [0, 25, 1 << 20])
def test_toxicity_sums_all_words(spark, monkeypatch, local):
    """Every word's difference, of either sign, wherever its expression is looked up."""
    monkeypatch.setattr(toxicity, "LOCAL", local)
    r = np.random.default_rng(12)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(r.choice(words[8 * (i % 3 == 0) :], int(r.integers(0, 80)))), "s") for i in range(150)] + [(200, None, "s"), (201, "unseen words", "s")]
    marked = [(i, int(i % 3 == 0)) for i in range(120)]
    df = docs_of(spark, rows).repartition(3)
    model, _ = toxicity.fit(df, spark.createDataFrame(marked, "doc_id long, label int"))
    assert (model.others is None) == (local > 25) and (len(model.local.keys) > 1) == (local > 0)
    at = {r["id"]: r["f"] for r in spark.createDataFrame(marked, "id long, label int").select("id", F.pmod(F.xxhash64("id"), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    e = brute_differences([(y, at[i], rows[i][1]) for i, y in marked])
    for fold in (toxicity.FOLDS, 1):
        asked = df.select("doc_id", common.text_of("text").alias("text"), F.lit(fold).alias("fold"))
        got = {x["doc_id"]: (x["units"] * toxicity.UNIT, x["plain"] * toxicity.UNIT) for x in toxicity.evidence(asked, model, range(fold, fold + 1)).collect()}
        signs, (s0, s1) = set(), toxicity.SHARES
        for i, text, _ in rows:
            w = ["<", *(text or "").split()]
            r = [math.exp(e.get((v, x), e.get((None, x), [0] * 5))[fold]) for v, x in zip(w, w[1:], strict=False)]
            g = [math.log(1 - s1 + s1 * x) - math.log(1 - s0 + s0 * x) for x in r]
            signs |= {math.copysign(1, x) for x in g if abs(x) > 1e-9}
            units, plain = got.pop(i)
            assert abs(units - sum(g)) < len(w) * toxicity.UNIT and abs(plain - sum(map(math.log, r))) < len(w) * toxicity.UNIT
        assert not got and signs == {1, -1}


def test_toxicity_sees_mild_evidence(spark):
    """No word tells much; all together do."""
    r = np.random.default_rng(13)
    names = np.array([f"word{i}" for i in range(200)])
    odds = np.array([np.where(np.arange(200) % 2 == c, 0.62, 0.38) for c in (0, 1)])
    rows = [(i, " ".join(r.choice(names, 400, p=odds[i % 2] / odds[i % 2].sum())), "s") for i in range(400)]
    df = docs_of(spark, rows)
    model, curve = toxicity.fit(df, spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, label int"))
    scores = {x["doc_id"]: x["score"] for x in toxicity.toxicity_scores(df, model, curve).collect()}
    assert sum((scores[i] >= 0.5) == (i % 2 == 1) for i in range(300, 400)) >= 95


def test_toxicity_is_length_normalised(spark):
    """Where pairs are too rare to be kept, a text repeated has the same differences per word, hence the same score."""
    r = np.random.default_rng(14)
    names = np.array([f"word{i}" for i in range(200)])
    texts = [" ".join(r.choice(names[40 * (i % 3 == 0) :], 12)) for i in range(240)]
    df = docs_of(spark, [(1000 * k + i, " ".join([t] * k), "s") for k in (1, 2, 7) for i, t in enumerate(texts)])
    model, curve = toxicity.fit(df, spark.createDataFrame([(1000 + i, int(i % 3 == 0)) for i in range(200)], "doc_id long, label int"))
    scores = {x["doc_id"]: x["score"] for x in toxicity.toxicity_scores(df, model, curve).collect()}
    assert len({scores[1000 + i] for i in range(240)}) > 200
    assert all(scores[1000 + i] == scores[2000 + i] == scores[7000 + i] for i in range(240))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(registry.SQL[name]).df()
    got = registry.QUERIES[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    tidy = lambda df: df[columns].sort_values(columns).reset_index(drop=True).astype(str)
    assert sorted(got.columns) == columns and tidy(got).equals(tidy(want))
