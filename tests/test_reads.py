"""Operators against a plain fold over small random reads, FASTQ reading, reports and streams."""

import json
import math
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helixlens.config import QcConfig
from helixlens.operators import positions, reads as by_read, sequences
from helixlens.plans.report import QcError, build, to_json, to_text
from helixlens.sources.fastq import read_fastq, records, register
from helixlens.streaming.incremental import start_histograms

SCHEMA = "read_idx long, id string, seq string, qual string"
few = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
read = st.text("ACGTNacgt", max_size=40).flatmap(lambda s: st.tuples(st.just(s), st.text("!+5?I", min_size=len(s), max_size=len(s))))


def frame(spark, rows):
    return spark.createDataFrame([(i, f"@r:1:2:3:{1100 + i % 3}:5:6", s, q) for i, (s, q) in enumerate(rows, 1)], SCHEMA)


@few
@given(st.lists(read, min_size=1, max_size=40))
def test_positions(spark, rows):
    df = frame(spark, rows)
    n, total = Counter(), Counter()
    gatc = defaultdict(Counter)
    for s, _ in rows:
        for p, c in enumerate(s, 1):
            n[p] += c == "N"
            total[p] += 1
            gatc[p][c.upper()] += 1
    got = {r["lower_base"]: r["percentage"] for r in positions.n_content(df).collect()}
    assert got.keys() == total.keys() and all(abs(got[p] - 100 * n[p] / total[p]) < 1e-9 for p in total)
    for r in positions.per_base_content(df).collect():
        c = gatc[r["lower_base"]]
        four = sum(c[b] for b in "GATC")
        assert r["g_percent"] is None if not four else abs(r["g_percent"] - 100 * c["G"] / four) < 1e-9


@few
@given(st.lists(read, min_size=1, max_size=60))
def test_adapters_grow_with_the_reads(spark, rows):
    rows = [(("AGATCGGAAGAG" + s if i % 3 == 0 else s), q) for i, (s, q) in enumerate(rows)]
    counts: list[int] = []
    for s, _ in rows:
        counts += [0] * (len(s) - 12 - len(counts))
        at = s.find("AGATCGGAAGAG")
        if at >= 0:
            for p in range(at, len(counts)):
                counts[p] += 1
    got = {r["lower_base"]: r["enrichment"] for r in sequences.adapter_content(frame(spark, rows)).filter("adapter_ord = 0").collect()}
    assert got.keys() == set(range(1, len(counts) + 1))
    assert all(abs(got[p + 1] - 100 * c / len(rows)) < 1e-9 for p, c in enumerate(counts))


@few
@given(st.lists(st.sampled_from(["ACGT", "AAAA", "CCCC", "GGGG", "TTTT", "A" * 80 + "C", "A" * 80 + "G"]), min_size=1, max_size=40), st.integers(1, 6))
def test_tracked_sequences_stop_at_the_cap(spark, seqs, cap):
    counts, seen_at = {}, None
    for i, s in enumerate(seqs, 1):
        key = s[:50] if len(s) > 75 else s
        if key in counts:
            counts[key] += 1
        elif len(counts) < cap:
            counts[key] = 1
            seen_at = i if len(counts) == cap else seen_at
    rows = sequences.tracked_sequences(frame(spark, [(s, "I" * len(s)) for s in seqs]), QcConfig(unique_cap=cap)).collect()
    assert {r["seq"]: r["n"] for r in rows} == counts
    assert {r["seen_at"] for r in rows} == {seen_at or len(seqs)}


@pytest.mark.parametrize("distinct,cap", [(30, 3), (30, 29), (4, 3), (3, 3), (2, 3)])
def test_keys_of_a_part_of_the_reads_are_counted_over_all(spark, distinct, cap, monkeypatch):
    monkeypatch.setattr(sequences, "LOOK", 2)
    monkeypatch.setattr(sequences, "WIDER", 2)
    seqs = ["A" * (1 + (i * i // 7) % distinct) for i in range(200)]
    first = list(dict.fromkeys(seqs))[:cap]
    rows = sequences.tracked_sequences(frame(spark, [(s, "I" * len(s)) for s in seqs]), QcConfig(unique_cap=cap)).collect()
    assert {r["seq"]: (r["n"], r["first_idx"]) for r in rows} == {s: (seqs.count(s), seqs.index(s) + 1) for s in first}
    assert {r["total"] for r in rows} == {200}
    assert {r["seen_at"] for r in rows} == {seqs.index(first[-1]) + 1 if len(first) == cap else 200}


@few
@given(st.lists(st.integers(0, 130), min_size=1, max_size=20))
def test_gc_distribution(spark, lengths):
    rows = [("GCAT" * 40)[:n] for n in lengths]
    want = [0.0] * 101
    for s in rows:
        n = len(s)
        cut = s[: n // 100 * 100] if n > 100 else s
        spans = [(math.floor(100 * max(k - 0.5, 0) / n + 0.5), math.floor(100 * min(k + 0.5, n) / n + 0.5)) if n else (0, 0) for k in range(n + 1)]
        claims = Counter(p for lo, hi in spans for p in range(lo, hi + 1))
        lo, hi = spans[sum(c in "GC" for c in cut)]
        for p in range(lo, hi + 1):
            want[p] += 1 / claims[p]
    got = {r["gc_pct"]: r["count"] for r in by_read.gc_distribution(frame(spark, [(s, "I" * len(s)) for s in rows])).collect()}
    assert all(abs(got[p] - want[p]) < 1e-9 for p in range(101))


def test_depth_of_percentiles(spark):
    for n, shown in ((100, False), (101, True)):
        r = positions.per_base_quality(frame(spark, [("A", "5")] * n)).first()
        assert r["mean"] == 20 and (r["median"] is not None) == shown


def test_small_inputs(spark):
    one = frame(spark, [("ACGTACGTAC", "IIIIIIIIII")])
    assert positions.per_tile_quality(one).count() == 0 and sequences.kmer_enrichment(one).count() == 0
    assert sequences.adapter_content(one).count() == 0
    stats = by_read.basic_statistics(frame(spark, [("NN", "II"), ("", "")])).first()
    assert stats["gc_percent"] is None and stats["sequence_min_length"] == 0
    lengths = by_read.length_distribution(frame(spark, [("", "")])).collect()
    assert [(r["lower_length"], r["count"]) for r in sorted(lengths)] == [(0, 1), (1, 0)]
    with pytest.raises(QcError):
        build(spark.createDataFrame([], SCHEMA))


def test_tiles(spark):
    many = spark.createDataFrame([(i, f"@a:b:c:d:{i}:x:y", "A", "I") for i in range(10, 5030, 10)], SCHEMA)
    assert positions.per_tile_quality(many).count() == 0
    assert positions.per_tile_quality(many.filter("read_idx < 5020")).count() == 501
    assert positions.per_tile_quality(many.replace("@a:b:c:d:20:x:y", "@a:b:c:d:t:x:y")).count() == 0
    five = spark.createDataFrame([(10, "@a:b:7:d:e", "A", "I")], SCHEMA)
    assert positions.per_tile_quality(five).first()["tile"] == 7


def fastq(rows, end="\n"):
    return end.join(x for i, s, q in rows for x in (i, s, "+", q))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq(spark, tmp_path, end):
    rows = [(f"@r{i}", "ACGT" * (i % 50 + 1), "I" * (4 * (i % 50 + 1))) for i in range(3000)]
    path = tmp_path / "a.fastq"
    path.write_bytes((fastq(rows, end) + end).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = [tuple(r) for r in read_fastq(spark, str(path)).orderBy("read_idx").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i + 1, *r) for i, r in enumerate(rows)]
    register(spark)
    assert [tuple(r) for r in spark.read.format("fastq").load(str(path)).collect()] == got


def test_fastq_edges(spark, tmp_path):
    assert list(records(iter(["@a\n", "ACG\n", "x\n", "IIIII"]))) == [(1, "@a", "ACG", "III")]
    with pytest.raises(ValueError):
        list(records(iter(["@a\n", "ACG\n"])))
    path = tmp_path / "b.fastq"
    path.write_text("@a\nAC\n+\nII\n@b\nAC\n")
    with pytest.raises(Exception, match="incomplete"):
        read_fastq(spark, str(path)).collect()
    path.write_text("")
    assert read_fastq(spark, str(path)).count() == 0


def test_reports(spark):
    rows = [("ACGTACGTACGTACGTACGTACGTACGTACG", "I" * 31)] * 60 + [("A" * 31, "5" * 31)] * 60
    reports = build(frame(spark, rows))
    text, plain = to_text(reports), json.loads(to_json(reports))
    assert text.startswith(">>Basic Statistics\tPass\n") and text.count(">>END_MODULE") == len(reports) == 12
    assert len(plain) == 12 and len(json.loads(to_json(reports, compat_keys=True))) == 10
    assert {r["status"] for r in plain.values()} <= {"Pass", "Warn", "Fail"}
    sections = {x.split("\t")[0]: x.split("\n")[1:-1] for x in text.split(">>")[1:] if not x.startswith("END")}
    assert sections["Basic Statistics"] == ["Encoding\tSanger / Illumina 1.9", "Total Sequences\t120", "Filtered Sequences\t0", "Sequence length\t31", "%GC\t25"]
    assert sections["Per base sequence content"][:2] == ["#Base\tG\tA\tT\tC", "1\t0\t100\t0\t0"]
    assert sections["Sequence Length Distribution"] == ["#Length Count", "30\t0", "31\t120", "32\t0"]
    assert sections["Adapter Content"][0].startswith("#Position\tIllumina Universal Adapter\t") and len(sections["Adapter Content"]) == 20
    assert len(plain["Per sequence GC content"]["gc_distribution"]) == 101 and plain["Sequence Length Distribution"]["length_counts"][1]["value"] == 120
    assert len(plain["Adapter Content"]["enrichments"]) == 5 and plain["Overrepresented sequences"]["over_represented"][0]["count"] == 60
    assert len(plain["Per tile sequence quality"]["tiles"]) == len(plain["Per tile sequence quality"]["qualities"]) == 3


def test_ignored_reports(spark):
    cfg = QcConfig()
    cfg = QcConfig(limits={**cfg.limits, "kmer:ignore": 1.0, "gc_sequence:ignore": 1.0})
    names = [r.name for r in build(frame(spark, [("ACGTACGTAC", "IIIIIIIIII")] * 3), cfg)]
    assert "Kmer Content" not in names and "Per sequence GC content" not in names and "Basic Statistics" in names


def test_stream(spark, tmp_path):
    df = frame(spark, [("ACGT", "IIII"), ("AAAA", "5555")])
    df.write.parquet(str(tmp_path / "in"))
    query = start_histograms(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "hist", str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert spark.table("hist").exceptAll(positions.quality_counts(df)).count() == 0 and spark.table("hist").count() == 8
