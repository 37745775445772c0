"""Patterns over many texts at once, inside a task: Arrow's engine (RE2) takes time in proportion to a text, whatever a pattern's alternatives are.

A text is made plain first: each code point becomes one ASCII character that all patterns take for what it is (a letter beyond ASCII is an underscore, other signs are a control
character), so positions stay and ASCII word boundaries are Unicode ones. That holds for patterns of ASCII characters without underscores, negated classes of letters or named classes,
read as functions.intervals reads them (any case, Unicode words, a dot that stops at line feeds only). Texts for which it wouldn't hold stand `apart`, to be read as they are: they
have combining marks, numerals beyond ASCII, letters that are another case of an ASCII one, letters younger than Unicode 3.2, format or line-separating characters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SIGN, _SPACE, _APART = 3, "\u0004", 255
_OPEN, _CLOSE = "\u0001", "\u0002"
#: Letters that are another case of i, s and k.
_FOLDED = (0x130, 0x131, 0x17F, 0x212A)
#: Circled and squared letters: signs that count as alphabetic.
_LETTER_SIGNS = ((0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189))
#: Windows that are searched together.
_TOGETHER = 20_000


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """What each code point becomes."""
    table = np.full(0x110000, _APART, np.uint8)
    table[:128] = np.arange(128)
    table[[1, 2, _SIGN + 1]] = _APART
    table[0x0B] = 0x0C  # white space in both engines
    for c in range(128, 0x20000):
        now, then = unicodedata.category(chr(c)), unicodedata.ucd_3_2_0.category(chr(c))
        if now[0] == "L" and then[0] == "L" and c not in _FOLDED:
            table[c] = ord("_")
        elif now in ("Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So", "No") and then[0] in "PSNC" and then not in ("Pc", "Nd", "Nl"):
            table[c] = _SIGN
        elif now == then == "Zs":
            table[c] = ord(_SPACE)
    for first, last in _LETTER_SIGNS:
        table[first : last + 1] = _APART
    return table


def plain(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Plain texts, and which of them stand apart (null is empty); white space beyond ASCII is still told from ASCII's, see `spaced`."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not len(texts):
        return texts, np.zeros(0, bool)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    try:
        codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    except UnicodeDecodeError:  # no text at all: as it is
        parts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return plain(pa.array([p if "\ufffd" not in p else "\u0001" for p in parts], pa.string()))
    at = offsets - np.searchsorted(np.flatnonzero((raw & 0xC0) == 0x80), offsets)
    mapped = _table()[codes]
    strange = np.flatnonzero(mapped == _APART)
    mapped[strange] = _SIGN
    apart = np.zeros(len(texts), bool)
    apart[np.searchsorted(at, strange, "right") - 1] = True
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(mapped)), apart


def spaced(texts: pa.Array) -> pa.Array:
    """Plain texts with white space beyond ASCII as such, as patterns with Unicode classes see it."""
    return pc.replace_substring(texts, _SPACE, "\f")


def _bools(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(bool)


def found(texts: pa.Array, pattern: str) -> np.ndarray:
    """Where a pattern occurs in any case; one that looks ahead is tried again where it occurs without looking."""
    if "(?!" not in pattern:
        return _bools(pc.match_substring_regex(texts, pattern, ignore_case=True))
    hit = found(texts, re.sub(r"\(\?![^()]*\)", "", pattern))
    exact = re.compile(pattern, re.IGNORECASE | re.ASCII)
    for k in np.flatnonzero(hit):
        hit[k] = exact.search(texts[int(k)].as_py()) is not None
    return hit


def without(texts: pa.Array, *patterns: str, flags: str = "(?i)") -> pa.Array:
    """texts with all matches of each pattern in turn cut out."""
    for pattern in patterns:
        hit = pc.match_substring_regex(texts, flags + pattern)
        if pc.any(hit).as_py():
            texts = pc.replace_with_mask(texts, hit, pc.replace_substring_regex(texts.filter(hit), flags + pattern, ""))
    return texts


def marked(texts: pa.Array, pattern: str, shown: str = "\\0", flags: str = "(?i)") -> Iterator[tuple[int, str, list[str]]]:
    """Each text that has a match: its place, the text, and the text cut where matches begin; `shown` of a match and a mark after it begin each part but the first."""
    hit = pc.match_substring_regex(texts, flags + pattern)
    some = texts.filter(hit)
    cut = pc.replace_substring_regex(some, f"{flags}(?:{pattern})", f"{_OPEN}{shown}{_CLOSE}")
    for place, text, parts in zip(np.flatnonzero(_bools(hit)).tolist(), some.to_pylist(), cut.to_pylist(), strict=True):
        yield place, text, parts.split(_OPEN)


def intervals(parts: list[str]) -> list[tuple[int, int]]:
    """(start, end) of every match, half-open, in characters from 0."""
    at, out = len(parts[0]), []
    for part in parts[1:]:
        out.append((at, at + part.index(_CLOSE)))
        at += len(part) - 1
    return out


def groups(parts: list[str]) -> list[str]:
    return [part[: part.index(_CLOSE)] for part in parts[1:]]


def any_window(texts: pa.Array, pattern: str, context: str, reach: int) -> np.ndarray:
    """Whether context occurs in the window of some match of pattern, see functions.intervals.any_window."""
    out, of, windows = np.zeros(len(texts), bool), [], []

    def search() -> None:
        out[np.array(of, np.int64)[found(pa.array(windows, pa.string()), context)]] = True
        of.clear()
        windows.clear()

    for place, text, parts in marked(texts, pattern):
        for start, end in intervals(parts):
            of.append(place)
            windows.append(text[max(start - reach, 0) : end + reach])
            if len(windows) >= _TOGETHER:
                search()
    search()
    return out


def concepts_near(texts: pa.Array, first: str, second: str, most: int) -> np.ndarray:
    """Whether matches of both patterns start within most characters of each other."""
    out = np.zeros(len(texts), bool)
    rows = np.flatnonzero(found(texts, first) & found(texts, second))
    some = texts.take(pa.array(rows))
    pairs = zip(marked(some, first), marked(some, second), strict=True)
    for (place, _, a), (_, _, b) in pairs:
        starts = [s for s, _ in intervals(b)]
        for s, _ in intervals(a):
            k = bisect_left(starts, s - most)
            if k < len(starts) and starts[k] <= s + most:
                out[rows[place]] = True
                break
    return out
