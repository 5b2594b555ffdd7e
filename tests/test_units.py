"""Scalar functions, configuration and position grouping."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helixlens.cli import config, parse
from helixlens.config import GroupKind, QcConfig, parse_dictionary, parse_limits, split_by_space
from helixlens.functions.columns import group_bounds, length_step, reverse_complement
from helixlens.functions.contaminants import longest_run, match
from helixlens.functions.range_coder import decode, encode, range_decode, range_encode
from helixlens.functions.stats import binomial_cdf
from helixlens.operators.positions import least_percentile


def test_tokenizer():
    assert split_by_space("test1 test2  test3") == ["test1", "test2", "test3"]
    assert split_by_space(" test1 test2  ") == ["test1", "test2"]
    assert split_by_space("single") == []


def test_limits_overlay_and_stop():
    cfg = QcConfig()
    assert cfg.limit("duplication:warn") == 70 and cfg.limit("duplication:error") == 50
    over = parse_limits("# c\nkmer warn x\nkmer warn 9\nbad line\nkmer error 1\n", cfg.limits)
    assert over["kmer:warn"] == 9 and over["kmer:error"] == 5
    with pytest.raises(KeyError):
        cfg.limit("no:such")


def test_dictionaries():
    cfg = QcConfig()
    assert len(cfg.adapters) == 5 and {len(s) for _, s in cfg.adapters} == {12}
    assert len(cfg.contaminants) == 151 and len({s for _, s in cfg.contaminants}) == 117
    assert parse_dictionary("#x\n\nname\t\t\tACGT\nnone\n") == [("name", "ACGT")]


def naive_groups(kind, n):
    out, start, step = [], 1, 1
    if kind is GroupKind.LINEAR and n > 75:
        size = next(b * 10**e for e in range(8) for b in (2, 5, 10) if math.ceil((n - 9) / (b * 10**e)) < 66)
    while start <= n:
        if kind is GroupKind.LINEAR and n > 75:
            step = 1 if start < 10 else size
        if kind is GroupKind.EXPONENTIAL:
            for at, longer, size_ in ((10, 75, 5), (50, 200, 10), (100, 300, 50), (500, 1000, 100), (1000, 2000, 500)):
                step = size_ if start == at and n > longer else step
        out.append((start, min(start + step - 1, n)))
        start += step
    return out


@pytest.mark.parametrize("kind", list(GroupKind))
def test_groups(spark, kind):
    counts = {70: 70, 75: 75, 76: 43, 100: 55, 139: 74, 140: 36, 500: 59}
    for n in [*counts, 12, 301, 1001, 2500]:
        lower, upper = group_bounds(F.col("id") + 1, F.lit(n), kind)
        got = sorted({(r[0], r[1]) for r in spark.range(n).select(lower, upper).collect()})
        assert got == naive_groups(kind, n)
        if kind is GroupKind.LINEAR and n in counts:
            assert len(got) == counts[n]


def test_length_step(spark):
    rows = spark.createDataFrame([(10,), (90,), (900,)], "w long").select(length_step(F.col("w"))).collect()
    assert [r[0] for r in rows] == [1, 2, 20]


def test_longest_run():
    cases = [("AAAAAA", "BBBBBB", None), ("AAAAAA", "BBBBAA", (4, 2, 0)), ("AAAAAA", "AAABBB", (0, 3, 0)), ("A" * 9, "BBBBBAAAB", (5, 3, 0)),
             ("A" * 9, "BAABBAAAB", (5, 3, 0)), ("O" * 14, "OOOOXOOXOOOOOX", (5, 8, 1)), ("O" * 14, "OOOOXOOOOOOOOX", (0, 13, 1))]
    for a, b, want in cases:
        assert longest_run(a, b) == want


def test_contaminant_match():
    assert match("AGCTTCGA", "AGCTTCGA")[0] == 0 and match("TCGAAGCT", "AGCTTCGA")[0] == 1
    adapter = dict(QcConfig().contaminants)["Illumina Single End Adapter 1"]
    assert match("TT" + adapter + "GGG", adapter) == (0, 33, 100)
    assert match("ACGTACGTACG", adapter) is None


def test_reverse_complement(spark):
    row = spark.createDataFrame([("ACGTNacgtx",)], "s string").select(reverse_complement(F.col("s"))).first()
    assert row[0] == "NacgtNACGT"


def test_binomial():
    assert abs(binomial_cdf(20, 0.4, 9) - 0.755337203316395) < 1e-12
    for n, p in ((30, 0.02), (300, 0.3), (50, 0.9)):
        total = 0.0
        for x in range(n):
            total += math.comb(n, x) * p**x * (1 - p) ** (n - x)
            assert abs(binomial_cdf(n, p, x) - total) < 1e-11
    assert binomial_cdf(5, 0.5, -1) == 0 and binomial_cdf(5, 0.5, 5) == 1


def test_command_line(tmp_path):
    (tmp_path / "a").write_text("mine\tACGT\n")
    (tmp_path / "l").write_text("kmer warn 3\n")
    cfg = config(parse(["-a", str(tmp_path / "a"), "-l", str(tmp_path / "l"), "-g", "none", "x.fastq"]))
    assert cfg.adapters == [("mine", "ACGT")] and cfg.limit("kmer:warn") == 3 and cfg.grouping is GroupKind.NONE
    with pytest.raises(SystemExit):
        parse([])


def test_range_coder(spark):
    r = random.Random(4)
    for symbols, alphabet in (([], 5), ([ord(c) for c in "range coder round-tr"], 128), ([r.choice([1, 1, 1, 2, 60000]) for _ in range(3000)], 60_001), ([r.randrange(256) for _ in range(12_000)], 256), ([7] * 20_000, 256)):
        assert decode(encode(symbols, alphabet), alphabet, len(symbols)) == symbols
    assert len(encode([7] * 20_000, 256)) < 1000
    rows = spark.createDataFrame([(b"hello hello hello",), (b"",), (None,)], "x binary").select("x", range_decode(range_encode(F.col("x"))).alias("y")).collect()
    assert all(r["x"] == r["y"] for r in rows)


def test_least_percentile(spark):
    rows = spark.createDataFrame([(i, "@a", "AC", "5!" if i % 2 else "I+") for i in range(1, 202)], "read_idx long, id string, seq string, qual string")
    assert least_percentile(rows, 25).first()[0] == 0 and least_percentile(rows.limit(50), 25).first()[0] == 1000
