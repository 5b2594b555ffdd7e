"""Reads derived from the orders table, for tables without sequencing reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

READS = """
SELECT o_orderkey + 1 AS read_idx,
       concat('@M0:1:FC:1:', cast(1101 + o_orderkey % 7 AS varchar(10)), ':', cast(o_orderkey AS varchar(20)), ':0') AS id,
       substring(CASE WHEN o_orderkey % 9 = 0 THEN concat(substring(h, 1, cast(o_orderkey % 8 AS int)), 'AGATCGGAAGAG', h)
                      WHEN o_orderkey % 50 = 49 THEN concat('GATTACA', h) ELSE h END, 1, n) AS seq,
       substring(q, 1, n) AS qual
FROM (SELECT o_orderkey, cast(24 + o_orderkey % 9 AS int) AS n,
             translate(md5(cast(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 40 ELSE o_orderkey END AS varchar(20))), '0123456789abcdef', 'ACGTACGTACGTACGN') AS h,
             translate(md5(concat('q', cast(o_orderkey AS varchar(20)))), '0123456789abcdef', '(+.147:=@ABCDEFG') AS q
      FROM {orders}) t
"""

LONG_READS = """
SELECT o_orderkey + 1 AS read_idx, concat('@L:', cast(o_orderkey AS varchar(20))) AS id,
       translate(hex, '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq, translate(hex, '0123456789abcdef', '(+.147:=@ABCDEFG') AS qual
FROM (SELECT o_orderkey, substring(concat(md5(k), md5(concat('b', k)), md5(concat('c', k)), md5(concat('d', k))), 1, cast(80 + o_orderkey % 41 AS int)) AS hex
      FROM (SELECT o_orderkey, cast(o_orderkey AS varchar(20)) AS k FROM {orders}) s) t
"""


#: One order in twenty as a read of 960 to 1440 bases.
VERY_LONG_READS = f"""
SELECT (read_idx - 1) div 20 + 1 AS read_idx, id, repeat(seq, 12) AS seq, repeat(qual, 12) AS qual FROM ({LONG_READS}) l WHERE (read_idx - 1) % 20 = 0
"""

#: Sequences of which reads are made that a dictionary should know: in full, reversed and complemented, and with one base changed.
SPIKES = (
    "AATGATACGGCGACCACCGAGATCTACACTCTTTCCCTACACGACGCTCTTCCGATCT", "AGATCGGAAGAGCGGTTCAGCAGGAATGCCGAG", "CTCGGCATTCCTGCTGAACCGCTCTTCCGATCT",
    "GATCGGAAGAGCACACGTCTGAACTCCAGTCACATCACGATCTCGTATGCCGTCTTCTGCTTG", "CAAGCAGAAGACGGCATACGAGATCGTGATGTGACTGGAGTTC", "AGATCGGAAGAGCACACGTCTGTACTCCAGTCA", "ACGTACGTACGTACGTACGTACGTACGT",
)

SPIKED_READS = f"""
SELECT o_orderkey + 1 AS read_idx, concat('@S:1:', cast(2101 + o_orderkey % 5 AS varchar(10)), ':7:', cast(o_orderkey AS varchar(20))) AS id, seq, substring(q, 1, length(seq)) AS qual
FROM (SELECT o_orderkey, concat(q, q) AS q, substring(CASE {' '.join(f"WHEN o_orderkey % 9 = {i} THEN concat(substring(h, 1, cast(o_orderkey % 4 AS int)), '{x}', h)" for i, x in enumerate(SPIKES))} ELSE h END, 1, cast(12 + o_orderkey % 45 AS int)) AS seq
      FROM (SELECT o_orderkey, translate(md5(cast(o_orderkey % 36 AS varchar(20))), '0123456789abcdef', 'ACGTACGTACGTACGN') AS h,
                   translate(md5(concat('q', cast(o_orderkey AS varchar(20)))), '0123456789abcdef', '(+.147:=@ABCDEFG') AS q FROM {{orders}}) s) t
"""

KINDS = {"reads": READS, "long": LONG_READS, "very_long": VERY_LONG_READS, "spiked": SPIKED_READS}


def derived_reads(spark: SparkSession, sf_dir: str, kind: str = "reads") -> DataFrame:
    """read_idx (1-based, contiguous), id, seq, qual."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return spark.sql(KINDS[kind], orders=orders)
