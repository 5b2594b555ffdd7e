"""The registered queries on reads derived from the orders table, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import reverse_complement
from ..operators import positions, reads as by_read, sequences
from ..config import QcConfig
from ..functions.contaminants import LEAST_RUN, reverse_complement as other_strand
from ..sources.derived import KINDS, derived_reads
from ..sources.fastq import read_fastq, write_fastq
from .report import statuses

#: Decimals that results are rounded to, since sums of doubles depend on their order.
DECIMALS = 6


def _rounded(df: DataFrame) -> DataFrame:
    of = lambda f: F.round(F.col(f.name).cast("double"), DECIMALS).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
    return df.select(*[of(f) for f in df.schema])


def _query(operator: Callable[[DataFrame], DataFrame], kind: str = "reads") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(operator(derived_reads(spark, sf_dir, kind)))


def _revcomp(reads: DataFrame) -> DataFrame:
    return reads.select("read_idx", reverse_complement(F.col("seq")).alias("revcomp"))


def _fastq_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived reads, written as one FASTQ file to the shared folder and read back."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder}/reads-{uuid.uuid4().hex}.fastq"
    write_fastq(derived_reads(spark, sf_dir, "spiked").coalesce(1).sortWithinPartitions("read_idx"), path)
    return read_fastq(spark, path)


#: A cap that the derived reads fill.
CAP = 1000

QUERIES = {
    "basic_statistics": _query(by_read.basic_statistics),
    "basic_statistics_long": _query(by_read.basic_statistics, "long"),
    "per_base_quality": _query(positions.per_base_quality),
    "per_base_quality_long": _query(positions.per_base_quality, "long"),
    "per_tile_quality": _query(positions.per_tile_quality),
    "per_sequence_quality": _query(by_read.per_sequence_quality),
    "per_base_content": _query(positions.per_base_content),
    "per_base_content_long": _query(positions.per_base_content, "long"),
    "n_content": _query(positions.n_content),
    "n_content_long": _query(positions.n_content, "long"),
    "gc_distribution": _query(by_read.gc_distribution),
    "gc_distribution_long": _query(by_read.gc_distribution, "long"),
    "gc_theoretical": _query(by_read.gc_theoretical),
    "length_distribution": _query(by_read.length_distribution),
    "length_distribution_long": _query(by_read.length_distribution, "long"),
    "duplication_levels": _query(sequences.duplication_levels),
    "overrepresented_seqs": _query(sequences.overrepresented),
    "contaminant_hits": _query(sequences.contaminant_hits, "spiked"),
    "duplication_levels_long": _query(sequences.duplication_levels, "long"),
    "duplication_levels_capped": _query(lambda reads: sequences.duplication_levels(reads, QcConfig(unique_cap=CAP))),
    "overrepresented_capped": _query(lambda reads: sequences.overrepresented(reads, QcConfig(unique_cap=CAP)), "spiked"),
    "per_tile_quality_short_ids": _query(positions.per_tile_quality, "spiked"),
    "gc_distribution_very_long": _query(by_read.gc_distribution, "very_long"),
    "kmer_obs_exp_very_long": _query(sequences.kmer_groups, "very_long"),
    "fastq_scan": _fastq_scan,
    "fastq_per_base_quality": lambda spark, sf_dir: _rounded(positions.per_base_quality(_fastq_scan(spark, sf_dir))),
    "adapter_content": _query(sequences.adapter_content),
    "adapter_content_long": _query(sequences.adapter_content, "long"),
    "kmer_obs_exp": _query(sequences.kmer_groups),
    "kmer_enrichment": _query(sequences.kmer_enrichment),
    "revcomp": _query(_revcomp),
    "module_status": _query(statuses),
}

_STEPS = "[" + ", ".join(str(b * 10**e) for e in range(8) for b in (2, 5, 10)) + "]"
_LENGTH_STEPS = "[" + ", ".join(str(b * 10**e) for e in range(9) for b in (1, 2, 5)) + "]"


def _with(body: str, kind: str = "reads") -> str:
    sql = KINDS[kind].format(orders="orders").replace(" div ", " // ")
    return f"WITH reads AS ({sql}), {body}"


def _lower(pos: str, n: str) -> str:
    step = f"list_filter({_STEPS}, lambda s: ceil(({n} - 9) / s) < 66)[1]"
    return f"CAST(CASE WHEN {n} <= 75 OR {pos} <= 9 THEN {pos} ELSE (({pos} - 10) // {step}) * {step} + 10 END AS BIGINT)"


def _upper(pos: str, n: str) -> str:
    step = f"list_filter({_STEPS}, lambda s: ceil(({n} - 9) / s) < 66)[1]"
    return f"CAST(CASE WHEN {n} <= 75 OR {pos} <= 9 THEN {pos} ELSE least({n}, (({pos} - 10) // {step}) * {step} + 9 + {step}) END AS BIGINT)"


def _basic(kind: str = "reads") -> str:
    return _with("""
a AS (SELECT count(*) AS n, sum(length(regexp_replace(seq, '[^GCgc]', '', 'g'))) AS gc, sum(length(regexp_replace(seq, '[^ATat]', '', 'g'))) AS att,
  arg_max(length(seq), read_idx) AS last_len, min(length(seq)) AS lo, max(length(seq)) AS hi FROM reads),
q AS (SELECT min(ascii(c)) AS least FROM (SELECT unnest(string_split(qual, '')) AS c FROM reads) WHERE c <> '')
SELECT CASE WHEN least < 32 THEN NULL WHEN least < 64 THEN 'Sanger / Illumina 1.9' WHEN least = 65 THEN 'Illumina 1.3' WHEN least <= 126 THEN 'Illumina 1.5' END AS encoding,
  n AS total_sequence, CAST(0 AS BIGINT) AS filtered_sequence, CAST(last_len AS BIGINT) AS sequence_min_length, CAST(lo AS BIGINT) AS sequence_max_length,
  CAST(100 * gc // (gc + att) AS BIGINT) AS gc_percent, CAST(lo AS BIGINT) AS true_min_length, CAST(hi AS BIGINT) AS true_max_length FROM a, q""", kind)


_POSITIONS = """
e AS (SELECT read_idx, id, seq, qual, unnest(range(1, length(seq) + 1)) AS pos FROM reads),
c AS (SELECT pos, substr(seq, pos, 1) AS base, count(*) AS n FROM e GROUP BY ALL),
m AS (SELECT max(pos) AS max_len FROM c)"""


def _quality(kind: str = "reads") -> str:
    at = lambda p: f"CASE WHEN max(total) > 100 THEN min(CASE WHEN running >= total * {p} // 100 THEN code END) - max(off) END"
    names = {"mean": "sum(n * (code - off)) / CAST(sum(n) AS DOUBLE)", "median": at(50), "lower_quartile": at(25), "upper_quartile": at(75), "percentile_10": at(10), "percentile_90": at(90)}
    return _with(f"""
e AS (SELECT qual, unnest(range(1, length(qual) + 1)) AS pos FROM reads),
h AS (SELECT pos, ascii(substr(qual, pos, 1)) AS code, count(*) AS n FROM e GROUP BY ALL),
m AS (SELECT max(pos) AS max_len, CASE WHEN min(code) < 64 THEN 33 ELSE 64 END AS off FROM h),
w AS (SELECT pos, code, CAST(n AS BIGINT) AS n, off, CAST(sum(n) OVER (PARTITION BY pos ORDER BY code) AS BIGINT) AS running, CAST(sum(n) OVER (PARTITION BY pos) AS BIGINT) AS total FROM h, m),
p AS (SELECT pos, {', '.join(f'{v} AS {k}' for k, v in names.items())} FROM w GROUP BY pos)
SELECT {_lower('pos', 'max_len')} AS lower_base, {_upper('pos', 'max_len')} AS upper_base, {', '.join(f'round(CAST(avg({k}) AS DOUBLE), 6) AS {k}' for k in names)}
FROM p, m GROUP BY 1, 2""", kind)


def _content(kind: str = "reads") -> str:
    of = lambda b: f"round(sum(CASE WHEN upper(base) = '{b}' THEN n ELSE 0 END) * 100.0::DOUBLE / sum(CASE WHEN upper(base) IN ('G','A','T','C') THEN n ELSE 0 END), 6) AS {b.lower()}_percent"
    return _with(f"{_POSITIONS} SELECT {_lower('pos', 'max_len')} AS lower_base, {_upper('pos', 'max_len')} AS upper_base, {', '.join(of(b) for b in 'GATC')} FROM c, m GROUP BY 1, 2", kind)


def _n(kind: str = "reads") -> str:
    return _with(f"{_POSITIONS} SELECT {_lower('pos', 'max_len')} AS lower_base, {_upper('pos', 'max_len')} AS upper_base, round(100.0::DOUBLE * sum(CASE WHEN base = 'N' THEN n ELSE 0 END) / sum(n), 6) AS percentage FROM c, m GROUP BY 1, 2", kind)


_TILE = f"""
s AS (SELECT *, string_split(id, ':') AS f FROM reads WHERE read_idx % 10 = 0),
k AS (SELECT CASE WHEN len(arg_min(f, read_idx)) >= 7 THEN 5 WHEN len(arg_min(f, read_idx)) >= 5 THEN 3 END AS k FROM s),
e AS (SELECT CAST(f[k] AS BIGINT) AS tile, qual, unnest(range(1, length(qual) + 1)) AS pos FROM s, k),
h AS (SELECT tile, pos, ascii(substr(qual, pos, 1)) AS code, count(*) AS n FROM e GROUP BY ALL),
m AS (SELECT max(pos) AS max_len, CASE WHEN min(code) < 64 THEN 33 ELSE 64 END AS off FROM h),
p AS (SELECT tile, pos, sum(n * (code - off)) / CAST(sum(n) AS DOUBLE) AS mean FROM h, m GROUP BY tile, pos),
g AS (SELECT tile, {_lower('pos', 'max_len')} AS lower_base, {_upper('pos', 'max_len')} AS upper_base, avg(mean) AS mean FROM p, m GROUP BY 1, 2, 3)
SELECT tile, lower_base, upper_base, round(mean - avg(mean) OVER (PARTITION BY lower_base), 6) AS deviation FROM g"""

_SCORES = """
r AS (SELECT qual, list_transform(string_split(qual, ''), lambda c: ascii(c)) AS codes FROM reads WHERE length(qual) > 0),
s AS (SELECT CAST(list_sum(codes) AS BIGINT) // length(qual) AS code, list_min(codes) AS least FROM r),
h AS (SELECT code, count(*) AS n FROM s GROUP BY code),
m AS (SELECT CASE WHEN min(least) < 64 THEN 33 ELSE 64 END AS off, min(code) AS lo, max(code) AS hi FROM s)
SELECT CAST(d.code - off AS BIGINT) AS score, coalesce(h.n, 0) AS count FROM (SELECT unnest(range(lo, hi + 1)) AS code, off FROM m) d LEFT JOIN h USING (code)"""

_GC = """
c AS (SELECT length(seq) AS len, length(regexp_replace(substr(seq, 1, CASE WHEN length(seq) > 1000 THEN length(seq) // 1000 * 1000 WHEN length(seq) > 100 THEN length(seq) // 100 * 100 ELSE length(seq) END), '[^GCgc]', '', 'g')) AS gc FROM reads),
n AS (SELECT len, gc, count(*) AS n FROM c GROUP BY ALL),
k AS (SELECT len, unnest(range(0, len + 1)) AS gc FROM (SELECT DISTINCT len FROM n)),
b AS (SELECT len, gc, unnest(range(CAST(floor(100 * greatest(gc - 0.5::DOUBLE, 0) / len + 0.5) AS BIGINT), CAST(floor(100 * least(gc + 0.5::DOUBLE, len) / len + 0.5) AS BIGINT) + 1)) AS pct FROM k),
i AS (SELECT len, pct, 1.0::DOUBLE / count(*) AS inc FROM b GROUP BY ALL),
d AS (SELECT pct, sum(n.n * inc) AS v FROM n JOIN b USING (len, gc) JOIN i USING (len, pct) GROUP BY pct),
dist AS (SELECT CAST(s.pct AS BIGINT) AS gc_pct, coalesce(v, 0.0::DOUBLE) AS v FROM (SELECT unnest(range(0, 101)) AS pct) s LEFT JOIN d USING (pct))"""

_THEORY = f"""{_GC},
pk AS (SELECT arg_max(gc_pct, v * 1000 + gc_pct * 1e-9) AS peak, max(v) AS top, sum(v) AS total FROM dist),
en AS (SELECT min(CASE WHEN gc_pct >= peak AND v <= top * 0.9 THEN gc_pct END) AS above, max(CASE WHEN gc_pct < peak AND v <= top * 0.9 THEN gc_pct END) AS below FROM dist, pk),
mo AS (SELECT total, CASE WHEN above IS NULL OR below IS NULL THEN top ELSE (above + below) / 2.0::DOUBLE END AS mode FROM pk, en),
sd AS (SELECT sqrt(sum((gc_pct - mode) * (gc_pct - mode) * v) / (max(total) - 1)) AS stddev FROM dist, mo),
th AS (SELECT gc_pct, v, exp(-((gc_pct - mode) * (gc_pct - mode)) / (2 * stddev * stddev)) / sqrt(2 * pi() * stddev * stddev) * total AS t, mode, stddev, total FROM dist, mo, sd)
SELECT gc_pct, round(v, 6) AS count, round(t, 6) AS theoretical, round(mode, 6) AS mode, round(stddev, 6) AS stddev, round(total, 6) AS total,
  round(100 * sum(abs(t - v)) OVER () / total, 6) AS deviation_percent FROM th"""


def _lengths(kind: str = "reads") -> str:
    return _with(f"""
c AS (SELECT length(seq) AS len, count(*) AS n FROM reads GROUP BY ALL),
e AS (SELECT greatest(min(len) - 1, 0) AS lo, max(len) + 1 AS hi FROM c),
s AS (SELECT *, list_filter({_LENGTH_STEPS}, lambda s: (hi - lo) // s <= 50)[1] AS step FROM e),
b AS (SELECT unnest(range(lo // step * step, hi + 1, step)) AS a, step, hi FROM s)
SELECT CAST(a AS BIGINT) AS lower_length, CAST(least(hi, a + step - 1) AS BIGINT) AS upper_length, CAST(coalesce(sum(n), 0) AS BIGINT) AS count
FROM b LEFT JOIN c ON len >= a AND len < a + step GROUP BY a, step, hi""", kind)


_TRACKED = """
k AS (SELECT CASE WHEN length(seq) > 75 THEN substr(seq, 1, 50) ELSE seq END AS seq, read_idx FROM reads),
g AS (SELECT seq, count(*) AS n, min(read_idx) AS first_idx FROM k GROUP BY seq),
t AS (SELECT * FROM g ORDER BY first_idx LIMIT 100000),
l AS (SELECT (SELECT count(*) FROM reads) AS total, CASE WHEN count(*) >= 100000 THEN max(first_idx) ELSE (SELECT count(*) FROM reads) END AS seen_at FROM t)"""

_DUPLICATION = f"""{_TRACKED},
v AS (SELECT n AS level, count(*) AS m FROM t GROUP BY n),
c AS (SELECT level, CASE WHEN seen_at = total OR total - m < seen_at THEN CAST(m AS DOUBLE) ELSE m * CAST(total - seen_at + 1 AS DOUBLE) / level END AS c FROM v, l),
lab AS (SELECT unnest([{', '.join(str(a) for a, _ in sequences.LEVELS)}]) AS above, unnest([{', '.join(repr(x) for _, x in sequences.LEVELS)}]) AS label, unnest(range(0, 16)) AS slot),
s AS (SELECT level, c, (SELECT max(slot) FROM lab WHERE level > above) AS slot FROM c)
SELECT CAST(lab.slot AS INTEGER) AS slot, label, round(coalesce(sum(c), 0) * 100.0::DOUBLE / (SELECT sum(c) FROM s), 6) AS deduplicated_percentage,
  round(coalesce(sum(c * level), 0) * 100.0::DOUBLE / (SELECT sum(c * level) FROM s), 6) AS total_percentage,
  round((SELECT sum(c) / sum(c * level) FROM s) * 100.0::DOUBLE, 6) AS total_dedup_percentage
FROM lab LEFT JOIN s ON lab.slot = s.slot GROUP BY lab.slot, label"""

_OVER = f"{_TRACKED} SELECT seq, n AS count, round(n * 100.0::DOUBLE / total, 6) AS percentage FROM t, l WHERE n * 100.0::DOUBLE / total > 0.1"


def _hits() -> str:
    """Best contaminant in SQL: islands of equal bases of each alignment that has enough of them, joined over single gaps."""
    strands = [(i, name, d, x) for i, (name, own) in enumerate(QcConfig().contaminants) for d, x in enumerate((own, other_strand(own)))]
    rows = ", ".join(f"""({i}, '{name.replace("'", "''")}', {d}, '{x}')""" for i, name, d, x in strands)
    return f"""{_OVER.replace("SELECT seq, n AS count", ", o AS (SELECT seq, n AS count", 1)}),
st(ord, name, d, s) AS (VALUES {rows}),
al AS (SELECT *, unnest(range({LEAST_RUN} - length(s), length(seq) - {LEAST_RUN})) AS off FROM o, st WHERE length(seq) >= {LEAST_RUN} OR length(seq) < 8),
lap AS (SELECT *, greatest(0, off) AS a, least(length(seq), length(s) + off) AS z FROM al),
few AS (SELECT * FROM lap WHERE z - a > {LEAST_RUN} AND z - a - hamming(substr(seq, CAST(a + 1 AS BIGINT), CAST(z - a AS BIGINT)), substr(s, CAST(a - off + 1 AS BIGINT), CAST(z - a AS BIGINT))) >= {LEAST_RUN}),
j AS (SELECT seq, ord, d, off, s, unnest(range(a, z)) AS j FROM few),
eq AS (SELECT seq, ord, d, off, j, j - row_number() OVER (PARTITION BY seq, ord, d, off ORDER BY j) AS island FROM j WHERE substr(seq, CAST(j + 1 AS BIGINT), 1) = substr(s, CAST(j - off + 1 AS BIGINT), 1)),
run AS (SELECT seq, ord, d, off, min(j) AS a, max(j) + 1 AS z FROM eq GROUP BY seq, ord, d, off, island),
two AS (SELECT *, lag(a) OVER w AS pa, lag(z) OVER w AS pz FROM run WINDOW w AS (PARTITION BY seq, ord, d, off ORDER BY a)),
hit AS (SELECT seq, ord, d, off, z, z - CASE WHEN a - pz = 1 THEN pa ELSE a END AS length, CASE WHEN a - pz = 1 THEN 1 ELSE 0 END AS off_by FROM two),
long AS (SELECT seq, ord, d, off, z, length, (length - off_by) * 100 // length AS pct FROM hit WHERE length > {LEAST_RUN}
         UNION ALL SELECT seq, ord, d, 0, 0, length(seq), 100 FROM o, st WHERE seq = s AND length(seq) BETWEEN 8 AND {LEAST_RUN - 1}),
own AS (SELECT * FROM long QUALIFY row_number() OVER (PARTITION BY seq, ord ORDER BY length DESC, d, off, z) = 1),
best AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY seq ORDER BY length DESC, ord DESC) = 1)
SELECT o.seq, o.count, o.percentage, coalesce(n.name || ' (' || best.pct || '% over ' || best.length || ' bp) ' || best.d, 'No Hit') AS possible_source
FROM o LEFT JOIN best USING (seq) LEFT JOIN (SELECT DISTINCT ord, name FROM st) n USING (ord)"""


def _adapters(kind: str = "reads") -> str:
    rows = ", ".join(f"""({i}, '{name.replace("'", "''")}', '{seq}')""" for i, (name, seq) in enumerate(QcConfig().adapters))
    return _with(f"""
a(adapter_ord, adapter, s) AS (VALUES {rows}),
r AS (SELECT read_idx, seq, max(length(seq) - 12) OVER (ORDER BY read_idx) AS room FROM reads),
h AS (SELECT adapter_ord, instr(seq, s) - 1 AS i, room, count(*) AS n FROM r, a WHERE instr(seq, s) > 0 GROUP BY ALL),
m AS (SELECT max(length(seq)) - 12 AS max_len, count(*) AS total FROM reads),
p AS (SELECT adapter_ord, adapter, unnest(range(0, max_len)) AS p, max_len, total FROM a, m),
c AS (SELECT p.adapter_ord, p.adapter, p.p + 1 AS pos, p.max_len, p.total, coalesce(sum(h.n), 0) AS n FROM p LEFT JOIN h ON h.adapter_ord = p.adapter_ord AND h.i <= p.p AND p.p < h.room GROUP BY ALL),
g AS (SELECT adapter_ord, adapter, {_lower('pos', 'max_len')} AS lower_base, {_upper('pos', 'max_len')} AS upper_base, sum(n) AS n, max(total) AS total FROM c GROUP BY 1, 2, 3, 4)
SELECT CAST(adapter_ord AS INTEGER) AS adapter_ord, adapter, lower_base, upper_base, round(n * 100.0::DOUBLE / total / (upper_base - lower_base + 1), 6) AS enrichment FROM g""", kind)


_KMERS = f"""
s AS (SELECT read_idx, substr(seq, 1, 500) AS s FROM reads WHERE read_idx % 50 = 0),
e AS (SELECT read_idx, length(s) - 6 AS slots, s, unnest(range(1, length(s) - 5)) AS pos FROM s),
k AS (SELECT read_idx, slots, pos, substr(s, pos, 7) AS kmer FROM e WHERE substr(s, pos, 7) NOT LIKE '%N%'),
mx AS (SELECT max(length(s)) - 6 AS max_len FROM s),
w AS (SELECT kmer, count(*) AS count, greatest(arg_min(slots, read_idx), max(pos)) AS own FROM k GROUP BY kmer),
t AS (SELECT pos, count(*) AS total FROM k GROUP BY pos),
g AS (SELECT kmer, {_lower('pos', 'max_len')} AS lower_base, {_upper('pos', 'max_len')} AS upper_base, count(*) AS hits FROM k, mx GROUP BY 1, 2, 3),
x AS (SELECT g.*, w.count, (SELECT sum(total) FROM t WHERE pos >= g.lower_base AND pos <= least(g.upper_base, w.own)) AS group_total, (SELECT sum(total) FROM t) AS everything FROM g JOIN w USING (kmer)),
y AS (SELECT *, CAST(CAST(count AS REAL) / CAST(everything AS REAL) AS REAL) AS proportion FROM x),
z AS (SELECT *, CAST(proportion * CAST(group_total AS REAL) AS REAL) AS predicted FROM y),
o AS (SELECT *, CAST(CAST(hits AS REAL) / predicted AS REAL) AS obs_exp FROM z)"""

_OBS_EXP = f"""{_KMERS} SELECT kmer, count, lower_base, upper_base, hits, CAST(group_total AS BIGINT) AS group_total, round(CAST(proportion AS DOUBLE), 6) AS proportion,
  round(CAST(predicted AS DOUBLE), 6) AS predicted, round(CAST(obs_exp AS DOUBLE), 6) AS obs_exp FROM o"""

_ENRICHED = f"""{_KMERS},
q AS (SELECT *, CAST(greatest(0, 1 - list_sum(list_transform(range(0, hits + 1), lambda i: exp(lgamma(group_total + 1) - lgamma(i + 1) - lgamma(group_total - i + 1)
  + i * ln(CAST(proportion AS DOUBLE)) + (group_total - i) * ln(1 - CAST(proportion AS DOUBLE)))))) * 16384 AS REAL) AS p FROM o WHERE obs_exp > 5),
f AS (SELECT kmer, min(p) AS p FROM q GROUP BY kmer HAVING min(p) < 0.01),
b AS (SELECT kmer, count, max(obs_exp) AS top, arg_max(lower_base, CAST(obs_exp AS DOUBLE) - lower_base * 1e-9) AS lo, arg_max(upper_base, CAST(obs_exp AS DOUBLE) - lower_base * 1e-9) AS hi FROM o GROUP BY kmer, count)
SELECT kmer AS sequence, count * 5 AS count, round(CAST(p AS DOUBLE), 6) AS p_value, round(CAST(top AS DOUBLE), 6) AS max_obs_exp, lo AS max_lower_position, hi AS max_upper_position
FROM b JOIN f USING (kmer) ORDER BY top DESC, kmer LIMIT 20"""

SQL = {
    "basic_statistics": _basic(),
    "basic_statistics_long": _basic("long"),
    "per_base_quality": _quality(),
    "per_base_quality_long": _quality("long"),
    "per_tile_quality": _with(_TILE),
    "per_sequence_quality": _with(_SCORES),
    "per_base_content": _content(),
    "per_base_content_long": _content("long"),
    "n_content": _n(),
    "n_content_long": _n("long"),
    "gc_distribution": _with(f"{_GC} SELECT gc_pct, round(v, 6) AS count FROM dist"),
    "gc_distribution_long": _with(f"{_GC} SELECT gc_pct, round(v, 6) AS count FROM dist", "long"),
    "gc_theoretical": _with(_THEORY),
    "length_distribution": _lengths(),
    "length_distribution_long": _lengths("long"),
    "duplication_levels": _with(_DUPLICATION),
    "overrepresented_seqs": _with(_OVER),
    "contaminant_hits": _with(_hits(), "spiked"),
    "duplication_levels_long": _with(_DUPLICATION, "long"),
    "duplication_levels_capped": _with(_DUPLICATION.replace("100000", str(CAP))),
    "overrepresented_capped": _with(_OVER.replace("100000", str(CAP)), "spiked"),
    "per_tile_quality_short_ids": _with(_TILE, "spiked"),
    "gc_distribution_very_long": _with(f"{_GC} SELECT gc_pct, round(v, 6) AS count FROM dist", "very_long"),
    "kmer_obs_exp_very_long": _with(_OBS_EXP, "very_long"),
    "fastq_scan": _with("x AS (SELECT 1) SELECT read_idx, id, seq, qual FROM reads", "spiked"),
    "fastq_per_base_quality": _quality("spiked"),
    "adapter_content": _adapters(),
    "adapter_content_long": _adapters("long"),
    "kmer_obs_exp": _with(_OBS_EXP),
    "kmer_enrichment": _with(_ENRICHED),
    "revcomp": _with("x AS (SELECT * FROM reads) SELECT read_idx, reverse(translate(regexp_replace(seq, '[^ACGTacgt]', 'N', 'g'), 'ACGTacgt', 'TGCAtgca')) AS revcomp FROM x"),
}


def _status_sql() -> str:
    """Verdicts from the rows of the other reports."""
    of = lambda i, name, fail, warn, key: f"SELECT {i} AS ord, '{name}' AS report, CASE WHEN {fail} THEN 'Fail' WHEN {warn} THEN 'Warn' ELSE 'Pass' END AS status FROM ({SQL[key]})"
    over = lambda x, fail, warn: (f"{x} > {fail}", f"{x} > {warn}")
    content = "greatest(max(abs(c_percent - g_percent)), max(abs(t_percent - a_percent)))"
    code = "max_by(score, count * 1000 - score) + 33"
    first = "arg_max(p_value, max_obs_exp)"
    strength = f"CASE WHEN count(*) = 0 THEN 1.0 WHEN {first} <= 0 THEN 1e9 ELSE -log10({first}) END"
    low = lambda a, b: f"coalesce(min(median) < {a}, false) OR coalesce(min(lower_quartile) < {b}, false)"
    return " UNION ALL ".join([
        of(0, "Basic Statistics", "false", "false", "basic_statistics"),
        of(1, "Per base sequence quality", low(20, 5), low(25, 10), "per_base_quality"),
        of(2, "Per tile sequence quality", *over("max(deviation)", 10, 5), "per_tile_quality"),
        of(3, "Per sequence quality scores", *over(code, 20, 27), "per_sequence_quality"),
        of(4, "Per base sequence content", *over(content, 20, 10), "per_base_content"),
        of(5, "Per sequence GC content", *over("max(deviation_percent)", 30, 15), "gc_theoretical"),
        of(6, "Per base N content", *over("max(percentage)", 20, 5), "n_content"),
        of(7, "Sequence Length Distribution", "max(true_min_length) = 0", "max(true_min_length) = max(true_max_length)", "basic_statistics"),
        of(8, "Sequence Duplication Levels", "false", "false", "basic_statistics"),
        of(9, "Overrepresented sequences", *over("coalesce(max(percentage), 0)", 1, 0.1), "overrepresented_seqs"),
        of(10, "Adapter Content", *over("coalesce(max(enrichment), 0)", 10, 5), "adapter_content"),
        of(11, "Kmer Content", *over(strength, 5, 2), "kmer_enrichment"),
    ])


SQL["module_status"] = _status_sql()
