"""Vectorised views of Arrow text columns: bytes, words, hashes of runs and anchors of windows.

Helpers that run inside Spark tasks. Spark cuts, moves and groups the rows; these functions look
at one Arrow batch (or a slice of it) at a time, so memory is bounded by `SLICE` bytes of text, or by
one text where a text is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_RNG = np.random.default_rng(20260101)
#: A random 64-bit value for each byte; it stands for the byte in rolling sums.
BYTE_VALUE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Space and U+0009 to U+000D separate words; nothing else does.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    return _powers(1 << max(12, (n - 1).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after the other, and where each row begins (and the last ends). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return data[first : offsets[-1] if len(offsets) else 0], offsets - first


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(lengths, dtype=np.int64), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of some texts.

    value: a 64-bit hash of each word; row: its text; begin, end: its bytes in data; first: index of each
    text's first word, with the number of all words at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = LOWER[data]
        self.data, self.offsets, n = data, offsets, len(data)
        space = IS_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        self.begin = np.flatnonzero(~space & (before | edge[:-1]))
        self.end = np.flatnonzero(~space & (after | edge[1:])) + 1
        total, down = prefix(BYTE_VALUE[data])
        self.value = mix(_run(total, down, self.begin, self.end) + (self.end - self.begin).astype(np.uint64))
        self.first = np.searchsorted(self.begin, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.begin)


def prefix(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums with which run() hashes any run of symbols, and the powers it needs."""
    up, down = powers(len(symbols) + 1)
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=total[1:])
    return total, down


def _run(total, down, begin, end):
    return (total[end] - total[begin]) * down[begin]


def run(prefixes: tuple[np.ndarray, np.ndarray], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of symbols begin to end; equal runs have equal hashes wherever they stand."""
    return mix(_run(*prefixes, begin, end))


#: Symbols that anchors() looks at together.
BLOCK = 1 << 22
#: Low bits of a gram's rank hold its place, so one minimum gives both.
_PLACE = np.uint64((1 << 24) - 1)


def anchors(symbols: np.ndarray, doc_end: np.ndarray, gram: int, window: int):
    """For every window of so many symbols inside one text, the gram that represents it.

    The gram with the smallest hash, the leftmost among equals, represents a window; equal windows thus have
    equal grams at equal distances. doc_end[i] is where the text of symbol i ends. Returns, for each run of
    neighbouring windows with one gram, in order: key (hash of the gram), context (hash of all symbols under
    the run's windows and of the gram's place), lo (start of the first window), place (of the gram from lo), count (of windows).
    """
    size = len(symbols)
    empty = np.zeros(0, np.int64)
    if size < window:
        return empty, empty, empty, empty, empty
    if size > BLOCK + window:  # a very long text: blocks that overlap by a window less one
        parts = []
        for b in range(0, size - window + 1, BLOCK):
            to = min(size, b + BLOCK + window - 1)
            key, context, lo, place, count = anchors(symbols[b:to], np.minimum(doc_end[b:to], to) - b, gram, window)
            parts.append((key, context, lo + b, place, count))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    total, down = prefix(symbols)
    at = np.arange(size - gram + 1)
    grams = mix((total[gram:] - total[: size - gram + 1]) * down[: size - gram + 1])
    low = (grams & ~_PLACE) | at.astype(np.uint64)
    width, span = window - gram + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    starts = np.flatnonzero(np.arange(size - window + 1) + window <= doc_end[: size - window + 1])
    if not len(starts):
        return empty, empty, empty, empty, empty
    anchor = (low[starts] & _PLACE).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(new)
    lo, anchor = starts[begin], anchor[begin]
    count = np.diff(np.append(begin, len(starts)))
    place = anchor - lo
    context = (total[lo + count - 1 + window] - total[lo]) * down[lo]
    context = mix(mix(context) + (place * 65537 + count).astype(np.uint64))
    return grams[anchor].view(np.int64), context.view(np.int64), lo, place, count


def merged_spans(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The union of half-open spans, clipped to size, in order, touching ones joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        e = min(e, size)
        if s >= e:
            continue
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
