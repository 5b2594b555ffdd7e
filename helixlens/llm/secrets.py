"""Operator 10: secret scans with a recursive decoding worklist.

A document is the first layer. Each layer is scanned, then unwrapped in every way that changes it: percent escapes,
\\uXXXX and \\xXX escapes, base64 runs and what zlib or gzip made of their bytes. The results are new layers, until
none is left. Every layer knows, for each of its characters, the span of the document that it came from. A layer
that was met before at the same span is not followed again, which ends cycles such as archives that hold themselves.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import mmap
import re
import tempfile
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice
from urllib.parse import unquote_to_bytes

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows, text_of

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: Without one of these no assignment is there; finding them is much cheaper than the pattern.
KEYWORDS = ("passw", "secret", "token", "api")
#: A run of 16 (32) has its length from its first character on, so the length can be in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 wrapped into lines, whose ends may themselves be escaped.
LINE_END = r"(?:\r?\n|\r|(?:\\r)?\\n)[\x20\t]*"
WRAPPED = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}(?:{LINE_END}[A-Za-z0-9+/_-]+)+={{0,2}}")
LINE_ENDS = re.compile(LINE_END)
#: The shortest secret is 14 characters of ASCII, and encoded ones are longer: bytes without such a run hold none.
ASCII_TEXT = re.compile(rb"[\x20-\x7e\t\r\n]{14}")
#: Where compressed bytes begin: in bytes, and written with percent or backslash escapes, which leave some bytes as they are.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
PACKED_PERCENT = re.compile(r"%1[Ff]%8[Bb]%08|(?:x|%78)(?:%01|%5[Ee]|\^|%9[Cc]|%[Dd][Aa])")
PACKED_ESCAPE = re.compile(r"\\(?:x|u00)1[Ff]\\(?:x|u00)8[Bb]\\(?:b|(?:x|u00)08)|(?:x|\\(?:x|u00)78)(?:\^|\\(?:x|u00)(?:01|5[Ee]|9[Cc]|[Dd][Aa]))")
PERCENT_BYTE = re.compile(r"%[0-9A-Fa-f]{2}|[!-$&-~]")
ESCAPE_BYTE = re.compile(r"""\\(?:x|u00)([0-9A-Fa-f]{2})|\\([abfnrtv0'"/\\])|[\x20-\[\]-~]""")
ESCAPED = dict(zip("abfnrtv0", "\a\b\f\n\r\t\v\0", strict=True))
#: Inflated bytes that are held in memory, more are in a temporary file; what is found does not depend on it.
IN_PLACE = 1 << 24
#: Bytes of a chunk at least; it ends where no pattern's match can go on, so chunks hold all that their layer holds.
CHUNK = 1 << 20
#: What no match contains, and line ends that no wrapped run contains.
CUT = re.compile(rb"[^\x20-\x7e\t\r\n]|(?<![A-Za-z0-9+/_=\r-])\r?\n|\n(?![A-Za-z0-9+/_\x20\t-])")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets of one layer, leftmost and non-overlapping per kind, in that order."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _replaced(text: str, pattern: re.Pattern, decode) -> tuple[str, np.ndarray, np.ndarray] | None:
    """text with each match decoded, and the span in text of each new character; None: nothing changed."""
    out, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(text):
        got = decode(m)
        if got is None:
            continue
        out += [text[at : m.start()], got]
        plain = np.arange(at, m.start())
        starts += [plain, np.full(len(got), m.start())]
        ends += [plain + 1, np.full(len(got), m.end())]
        at = m.end()
    if not at:
        return None
    plain = np.arange(at, len(text))
    return "".join([*out, text[at:]]), np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1])


def _percent(m: re.Match) -> str:
    return unquote_to_bytes(m[0]).decode("utf-8", "replace")


def _escape(m: re.Match) -> str:
    run = m[0]
    if run[1] == "x":
        return bytes.fromhex(run.replace("\\x", "")).decode("utf-8", "replace")
    return bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "replace")


def _packed(head: bytes) -> bool:
    return head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0


def _members(blocks: Iterable[bytes], left: list | None = None) -> Iterator[bytes]:
    """What all zlib and gzip members at the head of blocks unfold to; a damaged one up to the damage.

    left: gets the number of bytes taken from blocks that belong to no member, unless there is damage.
    """
    blocks, own, held = iter(blocks), None, b""
    while True:
        while len(held) < 3 and (more := next(blocks, None)) is not None:
            held += more
        if own and not held:
            held = own.flush()
            if held:
                yield held
            return
        if not own and not _packed(held):
            if left is not None:
                left.append(len(held))
            return
        own = own or zlib.decompressobj(47)
        try:
            out = own.decompress(held, CHUNK)
        except zlib.error:
            return
        if out:
            yield out
        held = own.unconsumed_tail
        if own.eof:
            own, held = None, own.unused_data.lstrip(b"\0")  # gzip files may be padded


def _chunks(blocks: Iterable[bytes]) -> Iterator[bytes]:
    """The same bytes, cut only where CUT allows."""
    held, tried = b"", 1
    for block in blocks:
        held += block
        if len(held) >= CHUNK:
            at = max((m.start() for m in CUT.finditer(held, tried) if m.end() < len(held)), default=0)
            if at:
                yield held[:at]
                held = held[at:]
            tried = max(1, len(held) - 2)
    if held:
        yield held


def _whole(blocks: Iterable[bytes]) -> bytes | mmap.mmap:
    """All bytes of blocks."""
    blocks, held, size = iter(blocks), [], 0
    for block in blocks:
        held.append(block)
        size += len(block)
        if size > IN_PLACE:
            with tempfile.TemporaryFile() as f:
                f.writelines(chain(held, blocks))
                f.flush()
                return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    return b"".join(held)


def _inflated(raw: bytes | mmap.mmap) -> bytes | mmap.mmap:
    """Bytes out of all their wrappings."""
    seen = set()
    while _packed(raw[:3]) and (mark := hashlib.sha256(raw).digest()) not in seen:
        seen.add(mark)
        inner = _whole(_members(_blocks(raw, 0)))
        if not len(inner):
            break
        raw = inner
    return raw


def _counted(blocks: Iterable[bytes]) -> int:
    """Bytes at the head of blocks that are compressed members, the first three of a damaged one; 0: none unfolds to anything."""
    taken, left, any_out = 0, [], False

    def fed():
        nonlocal taken
        for block in blocks:
            taken += len(block)
            yield block

    for _ in _members(fed(), left):
        any_out = True
    return (max(taken - left[0], 3) if left else 3) if any_out else 0


def _blocks(raw: bytes | mmap.mmap, start: int) -> Iterator[bytes]:
    return (raw[at : at + (1 << 16)] for at in range(start, len(raw), 1 << 16))


def _texts(raw: bytes | mmap.mmap, seen: frozenset = frozenset()) -> Iterator[bytes]:
    """Chunks of all ASCII text in raw: its own, and that of compressed members wherever they stand in it. seen: what holds raw."""
    if (mark := hashlib.sha256(raw).digest()) in seen:
        return
    if ASCII_TEXT.search(raw):
        yield from _chunks(_blocks(raw, 0))
    at = 0
    while m := PACKED.search(raw, at):
        size = _counted(_blocks(raw, m.start()))
        at = max(m.end(), m.start() + size)
        if size:
            yield from _texts(_inflated(_whole(_members(_blocks(raw, m.start())))), seen | {mark})


def _percent_bytes(layer: str, start: int) -> Iterator[bytes]:
    run = re.compile(f"(?:{PERCENT_BYTE.pattern}){{1,4096}}")
    while m := run.match(layer, start):
        yield unquote_to_bytes(m[0].replace("+", " "))
        start = m.end()


def _escape_bytes(layer: str, start: int) -> Iterator[bytes]:
    run = re.compile(f"(?:{ESCAPE_BYTE.pattern}){{1,4096}}")
    one = lambda m: chr(int(m[1], 16)) if m[1] else ESCAPED.get(m[2], m[2]) if m[2] else m[0]
    while m := run.match(layer, start):
        yield ESCAPE_BYTE.sub(one, m[0]).encode("latin-1")
        start = m.end()


def _packed_runs(layer: str) -> Iterator[tuple[int, int, Iterator[bytes]]]:
    """(start, end, chunks) of compressed bytes written with percent or backslash escapes."""
    for head, unit, decoded, mark in ((PACKED_PERCENT, PERCENT_BYTE, _percent_bytes, "%"), (PACKED_ESCAPE, ESCAPE_BYTE, _escape_bytes, "\\")):
        at = 0
        while mark in layer and (m := head.search(layer, at)):
            at = m.end()
            if size := _counted(decoded(layer, m.start())):
                at = max(at, next(islice(unit.finditer(layer, m.start()), size - 1, None)).end())
                yield m.start(), at, _texts(_inflated(_whole(_members(decoded(layer, m.start())))))


def _plain(raw: bytes | mmap.mmap) -> bool:
    """Whether bytes look like text."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        plain = all(re.sub("[\t\n\r]", "", decoder.decode(block)).isprintable() for block in _blocks(raw, 0))
        return plain and len(raw) > 0 and not decoder.decode(b"", True)
    except UnicodeDecodeError:
        return False


def _between(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """All chunks but the first and the last."""
    next(chunks, None)
    held = next(chunks, None)
    for chunk in chunks:
        yield held
        held = chunk


def _edges(raw: bytes | mmap.mmap, alone: list) -> str:
    """The text of raw that takes the place of its run: a match that goes on outside is in the first or the last chunk; the others go to alone."""
    if len(raw) <= IN_PLACE:
        return raw.decode("utf-8")
    chunks = _chunks(_blocks(raw, 0))
    first, last = next(chunks), b""
    for last in chunks:
        pass
    alone.append(_between(_chunks(_blocks(raw, 0))))
    return (first + last).decode("utf-8", "replace")


def _unwrapped(run: str, alone: list) -> str | None:
    """The text in a base64 run, through any compression of its bytes.

    Chunks of what is no plain text, but may hold some, go to alone: in each of the four alignments, as the run may begin
    with characters that belong to the text before it.
    """
    body = run.rstrip("=").replace("-", "+").replace("_", "/")

    def aligned(at):
        own = body[at : len(body) - ((len(body) - at) % 4 == 1)]
        return base64.b64decode(own + "=" * (-len(own) % 4))

    raw = aligned(0)
    inner = _inflated(raw)
    if len(body) % 4 == 1 or not _plain(inner):
        alone += [_texts(aligned(at)) for at in range(4)]
        return None
    if inner != raw and ASCII_TEXT.search(raw):
        alone.append(_chunks([raw]))
    return _edges(inner, alone)


def _layers(layer: str, starts, ends) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The layers that one holds, and the span in the document of each of their characters."""
    within = lambda lo, hi: (lo, hi) if starts is None else (starts[lo], ends[hi - 1])
    alone = []

    def unwrapped(m):
        found = []
        got = _unwrapped(LINE_ENDS.sub("", m[0]), found)
        alone.extend((m.start(), m.end(), x) for x in found)
        return got

    for pattern, decode, mark in ((PERCENT, _percent, "%"), (ESCAPE, _escape, "\\"), (WRAPPED, unwrapped, "\n"), (WRAPPED, unwrapped, "\r"), (WRAPPED, unwrapped, "\\n"), (BASE64, unwrapped, "")):
        if mark in layer and (got := _replaced(layer, pattern, decode)):
            yield got[0], *within(*got[1:])
    for start, end, chunks in chain(alone, _packed_runs(layer)):
        lo, hi = (x[0] for x in within(np.array([start]), np.array([end])))
        for chunk in chunks:
            text = chunk.decode("utf-8", "replace")
            yield text, np.broadcast_to(lo, len(text)), np.broadcast_to(hi, len(text))


def find_secrets(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans with those of the decoded layers: each (start, kind, end) in code points of text."""
    base = scan(text)
    mark = lambda new, lo, hi: (hashlib.sha256(new.encode("utf-8", "surrogatepass")).digest(), lo, hi)
    spans, seen = set(base), {mark(text, 0, len(text))}
    work = [_layers(text, None, None)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        new, lo, hi = layer
        if not new or (key := mark(new, int(lo[0]), int(hi[-1]))) in seen:
            continue
        seen.add(key)
        spans.update((int(lo[s:e].min()), kind, int(hi[s:e].max())) for s, kind, e in scan(new))
        work.append(_layers(new, lo, hi))
    return base, sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base and spans, arrays of (kind, start, end) in code points, end exclusive.

    Null and empty texts have no spans. Both arrays are ordered by start, then kind as in KINDS, then end.
    """
    kind = f"array<struct<kind: string, start: long, `end`: long>>"

    def make():
        def one(batch):
            got = [find_secrets(t) for t in batch.column(1).to_pylist()]
            rows = [[[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans] for spans in x] for x in got]
            yield {"doc_id": batch.column(0), "base": [x[0] for x in rows], "spans": [x[1] for x in rows]}

        return one

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return map_rows(rows, make, f"doc_id long, base {kind}, spans {kind}")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return secret_spans(documents(spark, sf_dir)).select("doc_id", *map(n, KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


SQL = None
