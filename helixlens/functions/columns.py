"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GroupKind

#: Encodings by least quality byte.
SANGER, ILLUMINA_13, ILLUMINA_15 = "Sanger / Illumina 1.9", "Illumina 1.3", "Illumina 1.5"


def encoding_name(least: Column) -> Column:
    """Encoding for the least quality byte; null where none fits."""
    return (
        F.when(least < 32, None).when(least < 64, SANGER).when(least == 65, ILLUMINA_13).when(least <= 126, ILLUMINA_15)
    )


def encoding_offset(least: Column) -> Column:
    return F.when((least >= 32) & (least < 64), 33).when((least >= 64) & (least <= 126), 64)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "N"), "ACGTacgt", "TGCAtgca"))


def count_of(seq: Column, symbols: str) -> Column:
    """How many characters of a sequence are among the symbols."""
    return (F.length(seq) - F.length(F.translate(seq, symbols, ""))).cast("long")


def gc_count(seq: Column) -> Column:
    return count_of(seq, "GCgc")


def least_code(qual: Column) -> Column:
    """Least quality byte of a read; null for an empty one."""
    return F.ascii(F.array_min(letters(qual)))


def gc_prefix(seq: Column) -> Column:
    n = F.length(seq)
    cut = F.when(n > 1000, F.floor(n / 1000) * 1000).when(n > 100, F.floor(n / 100) * 100).otherwise(n)
    return F.substring(seq, F.lit(1), cut.cast("int"))


def dedup_key(seq: Column) -> Column:
    return F.when(F.length(seq) > 75, F.substring(seq, 1, 50)).otherwise(seq)


def letters(text: Column) -> Column:
    """Characters of a text as an array; none for an empty one."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def _first_step(steps: list[int], fits) -> Column:
    return F.element_at(F.filter(F.array(*[F.lit(s).cast("long") for s in steps]), fits), 1)


def group_bounds(pos: Column, length: Column, kind: GroupKind) -> tuple[Column, Column]:
    """First and last position of the group of a 1-based position, of positions 1 to length.

    Linear: alone up to length 75; else positions 1 to 9 alone, then equal steps, the least of 2, 5, 10 times a power
    of ten that makes fewer than 66 groups. Exponential: steps that grow at fixed positions of long reads.
    """
    pos, length = pos.cast("long"), length.cast("long")
    if kind is GroupKind.NONE:
        return pos, pos
    if kind is GroupKind.LINEAR:
        step = _first_step([b * 10**e for e in range(8) for b in (2, 5, 10)], lambda s: F.ceil((length - 9) / s) < 66)
        lower = F.when((length <= 75) | (pos <= 9), pos).otherwise(F.floor((pos - 10) / step) * step + 10)
        return lower, F.when((length <= 75) | (pos <= 9), pos).otherwise(F.least(lower + step - 1, length))
    start, step = F.lit(1).cast("long"), F.lit(1).cast("long")
    for at, longer, size in ((10, 75, 5), (50, 200, 10), (100, 300, 50), (500, 1000, 100), (1000, 2000, 500)):
        here = (pos >= at) & (length > longer)
        start, step = F.when(here, F.lit(at)).otherwise(start), F.when(here, F.lit(size)).otherwise(step)
    lower = start + F.floor((pos - start) / step) * step
    return lower, F.least(lower + step - 1, length)


def length_step(width: Column) -> Column:
    """Least of 1, 2, 5 times a power of ten that makes at most about 50 bins of the width."""
    return _first_step([b * 10**e for e in range(9) for b in (1, 2, 5)], lambda s: F.floor(width / s) <= 50)


def verdict(fail: Column, warn: Column) -> Column:
    return F.when(fail, "Fail").when(warn, "Warn").otherwise("Pass")


def with_scalar(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a frame of one row."""
    return df.crossJoin(F.broadcast(one))
