"""Adaptive range coding of symbol sequences, and a pair of column functions over binary columns.

Frequencies adapt alike on both sides: a coded symbol gains GAIN; when the total passes LIMIT all are halved (none
below one); every BUBBLE symbols the coded one moves a place forward if it has become more frequent.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GAIN, LIMIT, BUBBLE = 8, 65_504, 16
_TOP, _BOTTOM, _MASK = 1 << 24, 1 << 16, (1 << 32) - 1


class FrequencyModel:
    """Symbols in an order that adapts, with their frequencies."""

    def __init__(self, symbols: int):
        self.order, self.freq, self.total, self.coded = list(range(symbols)), [1] * symbols, symbols, 0

    def update(self, at: int) -> None:
        self.freq[at] += GAIN
        self.total += GAIN
        if self.total > LIMIT:
            self.freq = [f - (f >> 1) for f in self.freq]
            self.total = sum(self.freq)
        self.coded += 1
        if self.coded % BUBBLE == 0 and at and self.freq[at] > self.freq[at - 1]:
            for x in (self.order, self.freq):
                x[at - 1], x[at] = x[at], x[at - 1]


def encode(symbols: list[int], alphabet: int) -> bytes:
    """Code of symbols in 0 .. alphabet - 1. Carries never travel: a range that straddles a byte for too long is cut short."""
    model, low, width, out = FrequencyModel(alphabet), 0, _MASK, bytearray()
    for s in symbols:
        at = model.order.index(s)
        width //= model.total
        low = (low + sum(model.freq[:at]) * width) & _MASK
        width *= model.freq[at]
        model.update(at)
        while True:
            if (low ^ (low + width)) >= _TOP:
                if width >= _BOTTOM:
                    break
                width = -low & (_BOTTOM - 1)
            out.append(low >> 24)
            low, width = low << 8 & _MASK, width << 8 & _MASK
    return bytes(out) + low.to_bytes(4, "big")


def decode(code: bytes, alphabet: int, count: int) -> list[int]:
    """The count symbols of a code."""
    model, low, width, out = FrequencyModel(alphabet), 0, _MASK, []
    value, at = int.from_bytes(code[:4].ljust(4, b"\0"), "big"), 4
    for _ in range(count):
        width //= model.total
        target, i, below = min((value - low & _MASK) // width, model.total - 1), 0, 0
        while below + model.freq[i] <= target:
            below += model.freq[i]
            i += 1
        low = (low + below * width) & _MASK
        width *= model.freq[i]
        out.append(model.order[i])
        model.update(i)
        while True:
            if (low ^ (low + width)) >= _TOP:
                if width >= _BOTTOM:
                    break
                width = -low & (_BOTTOM - 1)
            value = (value << 8 | (code[at] if at < len(code) else 0)) & _MASK
            at += 1
            low, width = low << 8 & _MASK, width << 8 & _MASK
    return out


def range_encode(data: Column) -> Column:
    """Binary to binary: its length in four bytes, then the code of its bytes."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else len(x).to_bytes(4, "big") + encode(list(x), 256))

    return run(data)


def range_decode(data: Column) -> Column:
    """What range_encode coded."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else bytes(decode(x[4:], 256, int.from_bytes(x[:4], "big"))))

    return run(data)
