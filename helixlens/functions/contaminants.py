"""Best contaminant of a sequence: the longest stretch that two strands share but for at most one base.

All alignments of a sequence with all strands of a dictionary are rows of one matrix of equal bases. Its maximal runs
are found at once; a stretch is a run, together with the one before it where exactly one base lies between them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HIT = "struct<name: string, direction: int, length: int, percent_id: int>"
#: A stretch must be longer than this; shorter queries (from EXACT_FROM on) must equal the contaminant.
LEAST_RUN, EXACT_FROM = 20, 8
#: Contaminants that are aligned at a time.
AT_A_TIME = 256
_COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")


def reverse_complement(seq: str) -> str:
    return "".join(c if c in "ACGTacgt" else "N" for c in seq).translate(_COMPLEMENT)[::-1]


def stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, mismatches) of the stretches of each row of a boolean matrix, by row and end."""
    rows, width = equal.shape
    padded = np.zeros((rows, width + 3), np.int8)  # runs of different rows are further apart than one base
    padded[:, 1 : width + 1] = equal
    edge = np.diff(padded.ravel(), prepend=np.int8(0))
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    joined = np.zeros(len(first), bool)
    joined[1:] = first[1:] - after[:-1] == 1
    start = np.where(joined, np.roll(first, 1), first)
    return start // (width + 3), start % (width + 3) - 1, after - start, joined.astype(np.int64)


def longest_run(a: str, b: str) -> tuple[int, int, int] | None:
    """(start, length, mismatches) of the first longest stretch of two strings of one length; None if it has under two positions."""
    codes = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (a, b)]
    _, start, length, mismatches = stretches((codes[0] == codes[1])[None, :])
    if not len(length) or length.max() < 2:
        return None
    k = int(length.argmax())
    return int(start[k]), int(length[k]), int(mismatches[k])


def _aligned(query: str, strands: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Equal bases of the query with each strand at each offset from LEAST_RUN - |strand| up to, not including, |query| - LEAST_RUN; and each row's strand."""
    sizes = np.array([len(s) for s in strands])
    offsets = [np.arange(LEAST_RUN - n, len(query) - LEAST_RUN) for n in sizes]
    of = np.repeat(np.arange(len(strands)), [len(x) for x in offsets])
    table = np.zeros((len(strands), max(1, sizes.max(initial=0))), np.uint32)
    for row, s in zip(table, strands, strict=True):
        row[: len(s)] = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    at = np.arange(len(query)) - np.concatenate([*offsets, np.zeros(0, np.int64)])[:, None]
    inside = (at >= 0) & (at < sizes[of][:, None])
    return inside & (table[of[:, None], np.where(inside, at, 0)] == np.frombuffer(query.encode("utf-32-le"), np.uint32)), of


def match_all(query: str, contaminants: list[tuple[str, str]]) -> tuple[int, int, int, int] | None:
    """(number, direction, length, percent identity) of the longest hit, of equals the last contaminant's.

    Of one contaminant's longest stretches the first counts: forward before reverse strand, then by offset.
    """
    best = None
    for lo in range(0, len(contaminants), AT_A_TIME):
        own = [s for _, s in contaminants[lo : lo + AT_A_TIME]]
        strands = [x for s in own for x in (s, reverse_complement(s))]
        if EXACT_FROM <= len(query) < LEAST_RUN:
            found = [(k // 2, k % 2, len(query), 100) for k, s in enumerate(strands) if s == query]
            number, length = np.array([f[0] for f in found], np.int64), np.full(len(found), len(query))
        else:
            equal, of = _aligned(query, strands)
            row, _, length, off = stretches(equal)
            long = np.flatnonzero(length > LEAST_RUN)
            strand, length, off = of[row[long]], length[long], off[long]
            number = strand // 2
            found = list(zip(number.tolist(), (strand % 2).tolist(), length.tolist(), ((length - off) * 100 // np.maximum(length, 1)).tolist(), strict=True))
        if found and (best is None or length.max() >= best[2]):
            last = number[length == length.max()].max()
            k = int(np.flatnonzero((length == length.max()) & (number == last))[0])
            best = (lo + found[k][0], *found[k][1:])
    return best


def match(query: str, forward: str) -> tuple[int, int, int] | None:
    """(direction, length, percent identity) of the best hit of one contaminant."""
    hit = match_all(query, [("", forward)])
    return hit and hit[1:]


def best_contaminant(seq: Column, contaminants: list[tuple[str, str]]) -> Column:
    """Longest hit over the dictionary, the last of equals; null if there is none."""

    @F.pandas_udf(HIT)
    def search(s: pd.Series) -> pd.DataFrame:
        found = [match_all(query, contaminants) for query in s]
        rows = [(contaminants[x[0]][0], *x[1:]) if x else (None, None, None, None) for x in found]
        out = pd.DataFrame(rows, columns=["name", "direction", "length", "percent_id"])
        return out.astype({"direction": "Int32", "length": "Int32", "percent_id": "Int32"})

    return search(seq)
