"""Exact token counts from a tokenizer compiled to a deterministic finite-state transducer.

States say what part of a word a tokenizer still has to remember, transitions say how many tokens more the text up to here
has. The pre-tokenizer is the outer machine (letters, numbers, other characters, white space and contractions); inside a word, the byte-pair merges are
followed by the last token of each prefix: a token may follow another if merging the two from scratch gives both back, and exactly one
token ending at a place may follow the last token before it. A state holds those places from which a token of the vocabulary can still
grow, so states are finite and are numbered when first met; tables of states and symbols hold the transitions.

Characters up to U+024F are one symbol each; others are their bytes, the first of which says what the pre-tokenizer takes the character for, so
the alphabet is small and every text takes this path.

Texts are cut into chunks that all run at once, one symbol a step. What a chunk does is a map of states: white space and numbers take every state to
the first one, so the map is a short head to run from the true state and a constant for the rest. The map of a chunk without either is known at single states: at
first at the one to which the end of the chunk before leads. Maps compose by a prefix scan over all chunks; where a composition isn't known, the chunks
concerned learn their maps at the states that now reach them, all at once, until it is known throughout.

Defined results: null and empty texts have no tokens; special tokens in a text count one each, as the library reads them by default; repeated rows are
counted each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.textual import slices

#: What the pre-tokenizer takes a character for; and the later bytes of a character.
LETTER, NUMBER, OTHER, SPACE, MORE = range(5)
#: Kinds of states: between words, in letters, in other characters, after an apostrophe that begins a piece, after its first letter, and in a number of several symbols.
_START, _LETTERS, _OTHERS, _QUOTE, _QUOTE_LETTER, _NUMBER = range(6)
#: What the pre-tokenizer takes with an apostrophe (fixed values of the tokenizer's file).
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points below are symbols; others are several.
DENSE = 0x250
CHUNK = 512
#: So many symbols of the chunk before give the state at which a chunk's map is known first.
WARM = 48


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """Byte-pair merges with an end-of-word mark, as steps over bytes. Symbols are bytes, and 256 + byte at the end of a word."""

    def __init__(self, model: dict):
        end, letters = model["end_of_word_suffix"], _byte_letters()
        ids = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        symbols: dict[int, tuple[int, ...]] = {}
        for token, i in ids.items():
            if token in letters:
                symbols[i] = (letters[token],)
            elif token.endswith(end) and token[: -len(end)] in letters:
                symbols[i] = (256 + letters[token[: -len(end)]],)
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, both = ids[a], ids[b], ids[a + b]
            self.rank[left, right] = rank
            if both not in self.parts:
                self.parts[both] = (left, right, rank)
                symbols[both] = symbols[left] + symbols[right]
        self.last_spine, self.first_spine, self.follows = {}, {}, {}
        # A trie of the tokens that merging from scratch can give.
        self.child: dict[tuple[int, int], int] = {}
        self.token, self.grows = [-1], [False]
        for i, string in symbols.items():
            if i in self.parts and not self.may_follow(*self.parts[i][:2], below=self.parts[i][2]):
                continue
            node = 0
            for s in string:
                self.grows[node] = True
                if (node, s) not in self.child:
                    self.child[node, s] = len(self.token)
                    self.token.append(-1)
                    self.grows.append(False)
                node = self.child[node, s]
            self.token[node] = i
        # Tokens that end further down from each node.
        self.below: list[list[int]] = [[] for _ in self.token]
        for i, string in symbols.items():
            node, path = 0, []
            for s in string:
                path.append(node)
                node = self.child.get((node, s), -1)
                if node < 0:
                    break
            if node >= 0 and self.token[node] == i:
                for above in path[1:]:
                    self.below[above].append(i)
        self.rests: dict[tuple, int | tuple] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge while token is built, each with the rank at which it is merged away."""
        known = self.first_spine if side == 0 else self.last_spine
        if token not in known:
            spine, until, at = [(token, float("inf"))], None, token
            while at in self.parts:
                until = self.parts[at][2]
                at = self.parts[at][side]
                spine.append((at, until))
            known[token] = spine
        return known[token]

    def may_follow(self, left: int, right: int, below: float = float("inf")) -> bool:
        """No merge joins a token at the right edge of left with one at the left edge of right, before rank below."""
        key = (left, right)
        if below == float("inf") and key in self.follows:
            return self.follows[key]
        fine = True
        for x, gone_x in self._spine(left, 1):
            for y, gone_y in self._spine(right, 0):
                rank = self.rank.get((x, y))
                if rank is not None and rank < gone_x and rank <= gone_y and rank < below:
                    fine = False
        if below == float("inf"):
            self.follows[key] = fine
        return fine

    def _fits(self, before: int | tuple, token: int) -> bool:
        """Whether a token may come next: before is the last token (-1: none), or all tokens that may come."""
        return token in before if isinstance(before, tuple) else before < 0 or self.may_follow(before, token)

    def _rest(self, node: int, before: int | tuple) -> int | tuple:
        """What of before still matters at a node: the tokens further down that may come; before itself, where very many may. States that differ in no more are one."""
        key = (node, before)
        if key not in self.rests:
            below = self.below[node]
            if isinstance(before, int) and (before < 0 or len(below) > 8):
                self.rests[key] = before
            else:
                self.rests[key] = tuple(t for t in below if self._fits(before, t))
        return self.rests[key]

    #: Before a word: nothing but a place where the first token begins, with no token before it.
    EMPTY = ((0, -1, 0),)

    def step(self, places: tuple, symbol: int) -> tuple[tuple, int]:
        """Places after one more byte, and how many tokens more the prefix has."""
        grown, last, more = [], None, 0
        for node, before, count in places:
            child = self.child.get((node, symbol))
            if child is None:
                continue
            token = self.token[child]
            if last is None and token >= 0 and self._fits(before, token):
                last, more = token, count + 1
            if self.grows[child] and (rest := self._rest(child, before)) != ():
                grown.append((child, rest, count))
        return (*((n, b, c - more) for n, b, c in grown), (0, last, 0)), more

    def finish(self, places: tuple, byte: int) -> int:
        """How many tokens more the word has that ends with this byte."""
        for node, before, count in places:
            child = self.child.get((node, 256 + byte))
            if child is not None and (token := self.token[child]) >= 0 and self._fits(before, token):
                return count + 1
        raise AssertionError("no token ends here")


class Transducer:
    """The tables of one tokenizer."""

    def __init__(self, path: str, most_cells: int = 48_000_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec["model"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.kinds: dict[str, int] = {}
        self.most_cells = most_cells
        # Symbols: characters below DENSE, then first bytes by what their character is, then later bytes. Each is (what, bytes, character, if it is one).
        self.symbol = np.full(DENSE + 5 * 256, -1, np.int32)
        self.chars: list[tuple[int, bytes, str]] = []
        self.alike: dict[tuple | int, int] = {}
        self.width = 128
        self._reset()

    def _reset(self) -> None:
        self.ids, self.states = {(_START,): 0}, [(_START,)]
        self.ends: dict[tuple, int] = {}
        self.next = np.full((1024, self.width), -1, np.int32)  # the next state, above 8 bits for the tokens more (or fewer, as merges go on) plus 128

    def kind(self, char: str) -> int:
        """How the library's pre-tokenizer takes a character."""
        if char not in self.kinds:
            cut = self.library.pre_tokenizer.pre_tokenize_str
            together = len(cut(f"a{char}a"))
            twice = len(cut(char * 2))
            self.kinds[char] = LETTER if together == 1 else SPACE if twice == 0 else OTHER if twice == 1 else NUMBER
        return self.kinds[char]

    # The machine itself: states are tuples (kind, places, last byte); the last byte waits, since a word's end changes it.

    def _feed(self, places: tuple, pending: int | None, data: bytes) -> tuple[tuple, int, int]:
        more = 0
        for byte in ([] if pending is None else [pending]) + list(data[:-1]):
            places, n = self.merges.step(places, byte)
            more += n
        return places, data[-1], more

    def _end(self, state: tuple) -> int:
        """Tokens that a state still owes when its word ends."""
        if state[0] == _START:
            return 0
        if state not in self.ends:
            if state[0] in (_QUOTE, _QUOTE_LETTER):
                self.ends[state] = self.whole("'") + (self.whole(state[1]) if state[0] == _QUOTE_LETTER else 0)
            else:
                self.ends[state] = self.merges.finish(state[1], state[2])
        return self.ends[state]

    def whole(self, piece: str) -> int:
        places, last, more = self._feed(Merges.EMPTY, None, piece.encode())
        return more + self.merges.finish(places, last)

    def move(self, state: tuple, what: int, data: bytes, char: str) -> tuple[tuple, int]:
        """The next state, and how many tokens more there are."""
        kind = state[0]
        if what == MORE and kind == _START:
            return state, 0
        if what == MORE or kind == _LETTERS and what == LETTER or kind == _OTHERS and what == OTHER:
            places, last, more = self._feed(state[1], state[2], data)
            return (kind, places, last), more
        if kind == _QUOTE:
            if char in _CONTRACTIONS:
                return (_START,), self.whole("'" + char)
            if what == LETTER and char and any(c[0] == char for c in _CONTRACTIONS):
                return (_QUOTE_LETTER, char), 0
            if what == OTHER:
                places, last, more = self._feed(Merges.EMPTY, None, b"'" + data)
                return (_OTHERS, places, last), more
        if kind == _QUOTE_LETTER:
            if state[1] + char in _CONTRACTIONS:
                return (_START,), self.whole("'" + state[1] + char)
            if what == LETTER:
                places, last, more = self._feed(Merges.EMPTY, None, state[1].encode() + data)
                return (_LETTERS, places, last), self.whole("'") + more
        owed = self._end(state)
        if what == SPACE:
            return (_START,), owed
        if what == NUMBER and char:
            return (_START,), owed + self.whole(char)
        if char == "'":
            return (_QUOTE,), owed
        places, last, more = self._feed(Merges.EMPTY, None, data)
        return ({LETTER: _LETTERS, NUMBER: _NUMBER}.get(what, _OTHERS), places, last), owed + more

    # Tables and chunks.

    def _symbols(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of characters, and where each character's begin (and the last one's end)."""
        many = 1 + (codes >= DENSE) + (codes >= 0x800) * (codes >= DENSE) + (codes >= 0x10000)
        first = np.append(0, np.cumsum(many))
        slots = np.zeros(first[-1], np.int64)
        slots[first[:-1]] = codes
        rare = np.flatnonzero(codes >= DENSE)
        if len(rare):
            distinct, of = np.unique(codes[rare], return_inverse=True)
            kinds = np.array([self.kind(chr(c)) for c in distinct.tolist()])[of]
            for k in range(4):
                at = rare[many[rare] > k]
                shift = 6 * (many[at] - 1 - k)
                byte = np.where(k == 0, np.select([many[at] == 2, many[at] == 3], [0xC0, 0xE0], 0xF0), 0x80) | ((codes[at] >> shift) & 0x3F)
                slots[first[at] + k] = DENSE + 256 * (kinds[many[rare] > k] if k == 0 else MORE) + byte
        symbols = self.symbol[slots]
        if len(symbols) and symbols.min() < 0:
            for slot in np.unique(slots[symbols < 0]).tolist():
                what = self.kind(chr(slot)) if slot < DENSE else (slot - DENSE) >> 8
                # White space is one symbol, and so are numbers of as many tokens.
                same = (what, self.whole(chr(slot)) if what == NUMBER else 0) if slot < DENSE and what in (SPACE, NUMBER) else slot
                if same not in self.alike:
                    self.alike[same] = len(self.chars)
                    self.chars.append((what, chr(slot).encode(), chr(slot)) if slot < DENSE else (what, bytes([(slot - DENSE) & 255]), ""))
                self.symbol[slot] = self.alike[same]
            if len(self.chars) > self.width:
                while len(self.chars) > self.width:
                    self.width *= 2
                self._reset()
            symbols = self.symbol[slots]
        return symbols, first

    def _fill(self, state: int, symbol: int) -> None:
        after, more = self.move(self.states[state], *self.chars[symbol])
        at = self.ids.get(after)
        if at is None:
            at = self.ids[after] = len(self.states)
            self.states.append(after)
            if at >= len(self.next):
                old, self.next = self.next, np.full((2 * len(self.next), self.width), -1, np.int32)
                self.next[: len(old)] = old
        self.next[state, symbol] = at << 8 | (more + 128)

    def _advance(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = self.next[state, symbol]
        if len(after) and after.min() < 0:
            lost = after < 0
            for pair in np.unique(state[lost].astype(np.int64) * self.width + symbol[lost]).tolist():
                self._fill(*divmod(pair, self.width))
            after = self.next[state, symbol]
        return after >> 8, (after & 255) - 128

    def _run(self, state: np.ndarray, grid: np.ndarray) -> np.ndarray:
        """The states that chunks (columns of grid) lead to."""
        for symbols in grid:
            state, _ = self._advance(state, symbols)
        return state

    def _entered(self, grid: np.ndarray, leave: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """The state in which each chunk is entered, by composing the chunks' maps.

        leave is where a chunk leads whatever it is entered in; those in open_ have no such state.
        """
        lanes = grid.shape[1]
        tried = np.zeros(lanes, np.int32)  # a state at which an open chunk's map is known, and where it leads
        leave = leave.copy()
        todo = np.flatnonzero(open_)
        before = todo[todo > 0]
        tried[before] = self._run(np.zeros(len(before), np.int32), grid[-WARM:, before - 1])
        while len(todo):
            leave[todo] = self._run(tried[todo], grid[:, todo])
            # Prefix scan: the composition up to a chunk is known if each open chunk since the last constant one is known at what it is given.
            given = np.append(np.int32(0), leave[:-1])
            todo = np.flatnonzero(open_ & (given != tried))
            tried[todo] = given[todo]
        return np.append(np.int32(0), leave[:-1])

    def emitted(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens emitted at each symbol of a text that ends with white space."""
        lanes = -(-len(symbols) // CHUNK)
        space = self._symbols(np.array([32]))[0][0]
        padded = np.full(lanes * CHUNK, space, np.int32)
        padded[: len(symbols)] = symbols
        grid = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
        syncs = np.array([what == SPACE or what == NUMBER and char != "" for what, _, char in self.chars])[grid]
        head = np.where(syncs.any(0), syncs.argmax(0) + 1, CHUNK)  # symbols until every state is the first
        out = np.zeros((CHUNK, lanes), np.int8)
        # Constant parts, all chunks at once, from the first state.
        state = np.zeros(lanes, np.int32)
        for t in range(int(head.min()), CHUNK):
            live = t >= head
            if live.all():
                state, out[t] = self._advance(state, grid[t])
            else:
                at = np.flatnonzero(live)
                state[at], out[t, at] = self._advance(state[at], grid[t, at])
        state = self._entered(grid, state, ~syncs.any(0))
        # Heads, all chunks at once, from the true states.
        order = np.flatnonzero(head > 0)
        for t in range(int(head.max(initial=0))):
            order = order[head[order] > t]
            state[order], out[t, order] = self._advance(state[order], grid[t, order])
        return out.T.ravel()[: len(symbols)]

    def count(self, texts: list[str]) -> list[int]:
        totals, parts, owners = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            if self.special.search(text):
                totals[i] += len(self.special.findall(text))
                pieces = self.special.split(text)
            else:
                pieces = [text]
            for piece in pieces:
                if not piece:
                    continue
                try:
                    piece.encode("latin-1")
                    piece = piece.lower()  # the library's normaliser does no more in this range
                except UnicodeEncodeError:
                    piece = self.library.normalizer.normalize_str(piece)
                parts.append(piece)
                owners.append(i)
        if parts:
            if len(self.states) * self.width > self.most_cells:
                self._reset()
            codes = np.frombuffer((" ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            symbols, first = self._symbols(codes)
            totals_at = np.append(0, np.cumsum(self.emitted(symbols), dtype=np.int64))
            ends = first[np.cumsum([len(p) + 1 for p in parts])]
            for i, n in zip(owners, np.diff(totals_at[np.append(0, ends)]).tolist(), strict=True):
                totals[i] += n
        return totals


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One for each Python worker."""
    return Transducer(path)


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer_path)
        for batch in slices(batches):
            totals = machine.count([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    own = docs.select(docs["doc_id"], docs["text"], F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long").alias("n_bytes"))
    return own.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
