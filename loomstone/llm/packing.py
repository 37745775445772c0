"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best-fit: a packer keeps a fixed number of open sequences in a bitset keyed by free
space, puts each piece where it leaves least room, and closes the fullest sequence first when too many are
open. Each Spark task packs the rows of its own partition in one pass, so nothing is shuffled; what a task
keeps is bounded by `open_bins` sequences. When a task ends, the pieces of its open sequences are packed anew, longest
first, which costs nothing and closes the gaps that an online packer leaves.

Defined results: a null or empty text is one piece holding only the end token; repeated rows are packed each; an empty table gives
no rows; other columns are ignored; null doc_id is kept as null.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomstone.llm.textual import BYTE_VALUE, LOWER, _run, mix, prefix, slices, text_buffers

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
#: Kinds of bytes of lowered text; a byte after 0xC3 (the letters of Latin-1, and two signs) is looked up in the second table.
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _OTHER
_KIND[48:58] = _DIGIT
_KIND[97:123] = _LETTER
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND_C3 = np.full(256, _LETTER, np.uint8)
_KIND_C3[[0x97, 0xB7]] = _OTHER
_LOWER_C3 = np.arange(256, dtype=np.uint8)
_LOWER_C3[[b for b in range(0x80, 0x9F) if b != 0x97]] += 32
#: Second letters of what the pre-tokenizer takes with an apostrophe (fixed values of the tokenizer's file).
_SHORT, _LONG = b"stmd", (b"re", b"ve", b"ll")
_NONE = np.int32(1 << 30)


def _ragged(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0] .. begin[0] + length[0] - 1, begin[1] .. and so on."""
    stop = np.cumsum(length)
    return np.repeat(begin - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)


class PairMerges:
    """Byte-pair merges with an end-of-word mark for many short pieces at once."""

    def __init__(self, model: dict):
        ids, end = model["vocab"], model["end_of_word_suffix"]
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in letters} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(letters)))}
        self.inner = np.array([ids[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([ids[letters[b] + end] for b in range(256)], np.int32)
        pairs = {(ids[a] << 20) | ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[p][0] for p in self.pairs.tolist()], np.int32)
        self.merged = np.array([token for _, token in pairs.values()], np.int32)  # by rank
        # Ranks of pairs of bytes, of which the second may be the last one of its piece.
        at = np.arange(256)
        self.first_ranks = np.concatenate([self._ranks(self.inner[at[:, None]], right[at[None, :]]) for right in (self.inner, self.last)], 1)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens; _NONE if they don't merge."""
        pair = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.rank[at], _NONE)

    def encode(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pieces of one length (a row of bytes each), one after the other, and how many each has."""
        n, size = grid.shape
        tokens = np.concatenate([self.inner[grid[:, :-1]], self.last[grid[:, -1:]]], 1)
        count = np.full(n, size)
        out = tokens.copy()
        live = np.arange(n)
        right = grid[:, 1:].astype(np.int64)
        right[:, -1:] += 256
        rank = self.first_ranks[grid[:, :-1], right]
        while len(live) and rank.shape[1]:
            best = rank.argmin(1)
            lowest = rank[np.arange(len(live)), best]
            some = lowest < _NONE
            if not some.all():
                done = ~some
                out[live[done], : tokens.shape[1]] = tokens[done]
                live, tokens, rank, best, lowest = live[some], tokens[some], rank[some], best[some], lowest[some]
                if not len(live):
                    break
            tokens[np.arange(len(live)), best] = self.merged[lowest]
            count[live] -= 1
            # What stands behind the merged pair moves up.
            behind = np.arange(tokens.shape[1] - 1)[None, :] > best[:, None]
            tokens = np.where(behind, tokens[:, 1:], tokens[:, :-1])
            rank = np.where(behind[:, :-1], rank[:, 1:], rank[:, :-1])
            for side in (best - 1, best):
                at = np.flatnonzero((side >= 0) & (side < rank.shape[1]))
                where = side[at]
                rank[at, where] = self._ranks(tokens[at, where], tokens[at, where + 1])
        out[live, : tokens.shape[1]] = tokens
        return out[np.arange(size)[None, :] < count[:, None]], count


class TokenIds:
    """Token ids of texts.

    The tokenizer lowers text, cuts it into pieces (letters, one digit, other signs, contractions) and never joins across them. In printable ASCII and
    the letters of Latin-1, pieces are found, hashed and looked up in arrays; a hash's bytes are compared, so ids are exact. New pieces are merged many at a time. Words (between white space) with other
    characters or special tokens, and long pieces, go to the library. `most` bounds what is kept; beyond it, what was used longest ago is forgotten.
    """

    def __init__(self, path: str, most: int = 2_000_000, longest: int = 32):
        from tokenizers import Tokenizer

        self.library, self.most, self.longest = Tokenizer.from_file(path), most, longest
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            self.merges = PairMerges(json.load(f)["model"])
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.now = 0
        # Known pieces, by hash: where their ids and bytes stand in the pools, and when they were used last.
        self.hash = np.zeros(0, np.uint64)
        self.used, self.ids_at, self.ids_n, self.bytes_at, self.bytes_n = (np.zeros(0, np.int64) for _ in range(5))
        self.ids, self.bytes = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def _learn(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray, whole: np.ndarray) -> None:
        """Take in new pieces; of `whole` ones (words), the library makes ids as it would in a text."""
        size = end - begin
        by_library = whole | (size > self.longest)
        order = np.concatenate([np.flatnonzero(by_library), *(np.flatnonzero(~by_library & (size == n)) for n in np.unique(size[~by_library]))]).astype(np.int64)
        ids, counts = [], []
        if by_library.any():
            raw = data.tobytes()
            texts = [raw[b:e].decode("utf-8", "replace") for b, e in zip(begin[by_library].tolist(), end[by_library].tolist(), strict=True)]
            found = self.library.encode_batch_fast(texts, add_special_tokens=False)
            ids.append(np.array([i for x in found for i in x.ids], np.uint32))
            counts.append(np.array([len(x.ids) for x in found], np.int64))
        for n in np.unique(size[~by_library]).tolist():
            at = np.flatnonzero(~by_library & (size == n))
            for k in range(0, len(at), 1 << 16):
                one, count = self.merges.encode(data[begin[at[k : k + (1 << 16)], None] + np.arange(n)])
                ids.append(one.astype(np.uint32))
                counts.append(count)
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        at = np.searchsorted(self.hash, hashes[order])
        by = np.argsort(hashes[order])
        starts, stops = np.cumsum(counts) - counts + len(self.ids), np.cumsum(size[order]) - size[order] + len(self.bytes)
        put = lambda old, new: np.insert(old, at[by], new[by])
        self.used, self.ids_at, self.ids_n = put(self.used, np.full(len(order), self.now)), put(self.ids_at, starts), put(self.ids_n, counts)
        self.bytes_at, self.bytes_n = put(self.bytes_at, stops), put(self.bytes_n, size[order])
        self.hash = put(self.hash, hashes[order])
        self.ids, self.bytes = np.append(self.ids, ids), np.append(self.bytes, data[_ragged(begin[order], size[order])])

    def _forget(self) -> None:
        keep = self.used > np.median(self.used)
        self.ids, self.bytes = self.ids[_ragged(self.ids_at[keep], self.ids_n[keep])], self.bytes[_ragged(self.bytes_at[keep], self.bytes_n[keep])]
        self.hash, self.used, self.ids_n, self.bytes_n = (x[keep] for x in (self.hash, self.used, self.ids_n, self.bytes_n))
        self.ids_at, self.bytes_at = np.cumsum(self.ids_n) - self.ids_n, np.cumsum(self.bytes_n) - self.bytes_n

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lowered data (odd words stay as they are), begin and end of each piece, and whether it is an odd word as a whole."""
        size = len(data)
        edge = np.zeros(size + 1, bool)
        edge[offsets] = True
        low = LOWER[data]
        kind = _KIND[low]
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        low[after] = _LOWER_C3[low[after]]
        kind[after] = kind[after - 1] = _KIND_C3[low[after]]
        for token in self.special:
            at = np.flatnonzero(data[: max(0, size - len(token) + 1)] == token[0])
            for k, byte in enumerate(token):
                at = at[data[at + k] == byte]
            kind[at] = _ODD
        begin = np.ones(size, bool)
        begin[1:] = kind[1:] != kind[:-1]
        begin |= edge[:-1] | (kind == _DIGIT)
        begin[after[edge[after] == 0]] = False
        space = kind == _SPACE
        # Contractions: an apostrophe that begins a piece takes one or two letters with it.
        quote = np.flatnonzero(begin & (data == 0x27))
        if len(quote):
            padded = np.append(low, np.zeros(2, np.uint8))
            until = offsets[np.searchsorted(offsets, quote, side="right")]
            one, two = padded[quote + 1], padded[quote + 2]
            length = np.where(np.isin(one, np.frombuffer(_SHORT, np.uint8)), 2, 0)
            for a, b in _LONG:
                length = np.where((one == a) & (two == b), 3, length)
            length = np.where(quote + length <= until, length, 0)
            quote, length = quote[length > 0], length[length > 0]
            begin[quote + 1] = begin[quote + length - 1] = False
            begin[(quote + length)[quote + length < size]] = True
        begin &= ~space
        # Words with odd characters are pieces as a whole.
        whole = np.zeros(0, np.int64)
        odd = np.flatnonzero(kind == _ODD)
        if len(odd):
            word = ~space & (edge[:-1] | np.append(True, space[:-1]))
            words = np.flatnonzero(word)
            number = np.unique(np.searchsorted(words, odd, side="right") - 1)
            stop = np.flatnonzero(~space & (edge[1:] | np.append(space[1:], True))) + 1
            whole = words[number]
            inside = _ragged(whole, stop[number] - whole)
            begin[inside] = False
            begin[whole] = True
            low[inside] = data[inside]
        start = np.flatnonzero(begin)
        follows = space | begin | edge[:-1]
        breaks = np.append(np.flatnonzero(follows), size)
        end = breaks[np.searchsorted(breaks, start, side="right")] if len(start) else start
        return low, start, end, np.isin(start, whole)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by end_id, and where each text's begin (and the last one's end)."""
        texts = len(offsets) - 1
        low, begin, end, whole = self._pieces(data, offsets) if len(data) else (data, *(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0, bool))
        self.now += 1
        total, down = prefix(BYTE_VALUE[low])
        value = mix(_run(total, down, begin, end) + (end - begin).astype(np.uint64) * np.uint64(2) + whole.astype(np.uint64))
        distinct, sample, of = np.unique(value, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, distinct)
        new = np.append(self.hash, np.uint64(0))[at] != distinct if len(self.hash) else np.ones(len(distinct), bool)
        new |= at == len(self.hash)
        if new.any():
            if len(self.hash) + new.sum() > self.most and len(self.hash):
                self._forget()
                at = np.searchsorted(self.hash, distinct)
                new = np.append(self.hash, np.uint64(0))[at] != distinct
                new |= at == len(self.hash)
            one = sample[new]
            self._learn(low, begin[one], end[one], distinct[new], whole[one])
            at = np.searchsorted(self.hash, distinct)
        self.used[at] = self.now
        entry = at[of]
        size = end - begin
        wrong = self.bytes_n[entry] != size
        fine = np.flatnonzero(~wrong)
        unequal = low[_ragged(begin[fine], size[fine])] != self.bytes[_ragged(self.bytes_at[entry[fine]], size[fine])]
        if unequal.any():
            wrong[fine[np.repeat(np.arange(len(fine)), size[fine])[unequal]]] = True
        count = self.ids_n[entry]
        source = self.ids[_ragged(self.ids_at[entry], count)]
        first = np.append(0, np.cumsum(count))[np.searchsorted(begin, offsets)]
        out = np.full(len(source) + texts, end_id, "<u4")
        out[np.arange(len(source)) + np.repeat(np.arange(texts), np.diff(first))] = source
        starts = first + np.arange(texts + 1)
        # Two pieces of one hash: whatever text has the one that isn't kept goes to the library.
        return self._by_library(data, offsets, np.unique(np.searchsorted(offsets, begin[wrong], side="right") - 1), out, starts, end_id) if wrong.any() else (out, starts)

    def _by_library(self, data: np.ndarray, offsets: np.ndarray, texts: np.ndarray, ids: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and starts with those of some texts taken from the library instead."""
        parts = [ids[b:e] for b, e in zip(starts[:-1], starts[1:], strict=True)]
        for t in texts.tolist():
            text = data[offsets[t] : offsets[t + 1]].tobytes().decode("utf-8", "replace")
            parts[t] = np.array([*self.library.encode(text, add_special_tokens=False).ids, end_id], "<u4")
        return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))


@lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    """One for each Python worker, which thus learns a piece once for all its tasks."""
    return TokenIds(path)


class Packer:
    """The open sequences of one task."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.count = 0, 0
        self.free: list[list] = [[] for _ in range(capacity + 1)]  # open sequences by free space: [pieces]

    def _take(self, space: int) -> list:
        pieces = self.free[space].pop()
        if not self.free[space]:
            self.bits ^= 1 << space
        self.count -= 1
        return pieces

    def _put(self, space: int, pieces: list) -> None:
        self.free[space].append(pieces)
        self.bits |= 1 << space
        self.count += 1

    @staticmethod
    def _lowest(bits: int) -> int:
        return (bits & -bits).bit_length() - 1

    def add(self, piece: tuple, length: int) -> Iterator[list]:
        """Place a piece; yields sequences that this closes, as lists of (piece, length)."""
        fits = self.bits >> length
        if fits:
            space = length + self._lowest(fits)
            pieces = self._take(space)
        else:
            if self.count >= self.open_bins:
                yield self._take(self._lowest(self.bits))
            space, pieces = self.capacity, []
        pieces.append((piece, length))
        if space == length:
            yield pieces
        else:
            self._put(space - length, pieces)

    def finish(self) -> Iterator[list]:
        """Pack what is still open anew, longest piece first."""
        pieces = [p for bins in self.free for b in bins for p in b]
        last = Packer(self.capacity, len(pieces) + 1)
        for piece, length in sorted(pieces, key=lambda p: -p[1]):
            yield from last.add(piece, length)
        for bins in last.free:
            yield from bins


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, open_bins: int = 512) -> DataFrame:
    """Tokenise every text (column text), end it with end_id, and pack all pieces of at most capacity ids.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Documents are cut only where
    they are longer than a sequence.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = token_ids(tokenizer_path), Packer(capacity, open_bins)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        rows: list[tuple] = []

        def close(pieces: list) -> None:
            nonlocal number
            at = 0
            for piece, length in pieces:
                rows.append((*piece, number, at))
                at += length
            number += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

        for batch in slices(batches):
            ids, first = tokens.encode(*text_buffers(batch.column("text")), end_id)
            data = memoryview(ids.tobytes())
            for doc, begin, end in zip(batch.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                for k, start in enumerate(range(0, end - begin, capacity)):
                    length = min(capacity, end - begin - start)
                    piece = (doc, k, start, length, zlib.crc32(data[(begin + start) * 4 : (begin + start + length) * 4]))
                    if length == capacity:
                        close([(piece, length)])
                    else:
                        for pieces in packer.add(piece, length):
                            close(pieces)
            if len(rows) > 5000:
                yield out()
        for pieces in packer.finish():
            close(pieces)
        if rows:
            yield out()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(work, SCHEMA)
