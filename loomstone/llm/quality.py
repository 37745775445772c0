"""Document quality: histogram gradient-boosted trees over statistics of the text alone.

Statistics are computed in vectorised slices of Arrow batches. The trees are fitted on at most `most_labels` labelled
documents (those with the smallest hashes of their ids, so the choice doesn't change with partitioning); that table of statistics is
the only thing that comes to the driver, bounded by that parameter. Scoring runs on every document: all trees lie flattened
in a few arrays, and each step moves all rows of a slice one level down in all trees.

Defined results: a null or empty text has all statistics zero and gets a score like any other; unlabelled and null-labelled rows
aren't learnt from; with labels of one kind or none, every score is that share (0.5 without labels); other columns
are never read, labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.textual import IS_SPACE, Words, mix, prefix, run, slices, text_buffers


def _table(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return out


_UPPER, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(48, 58)))
_LETTER = _UPPER | _table(bytes(range(97, 123))) | _table(bytes(range(128, 256)))
_STOP, _SYMBOL, _BAR, _BANG = _table(".,;:?"), _table("#$%&*+/<=>@\\^_`~{}[]()"), _table("|"), _table("!")
_LINE, _HIGH = _table("\n"), _table(bytes(range(128, 256)))

FEATURES = (
    "log_bytes log_words upper digit letter stop symbol bar bang line high accent_upper word_length long_word short_word symbol_end bang_end all_upper "
    "distinct_words top_word same_next distinct_shingles distinct_pairs words_per_line capital_start no_letter"
).split()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    some = np.maximum(size, 1)
    share = lambda mask: np.diff(np.append(0, np.cumsum(mask))[offsets]) / some
    words = Words(data, offsets)
    count = np.diff(words.first)
    many = np.maximum(count, 1)
    per_word = lambda x: np.diff(np.append(0, np.cumsum(x))[words.first]) / many
    upper = _UPPER[data]
    accent = np.zeros(len(data), bool)
    if len(data) > 1:
        accent[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    letters = np.append(0, np.cumsum(_LETTER[data] & ((data & 0xC0) != 0x80)))
    uppers = np.append(0, np.cumsum(upper | accent))
    letters, uppers = letters[words.end] - letters[words.begin], uppers[words.end] - uppers[words.begin]
    length = words.end - words.begin
    last, head = (data[words.end - 1], data[words.begin]) if len(words) else (data, data)

    def distinct(values: np.ndarray, rows: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of distinct values of each text, and of its most frequent one."""
        keys = np.sort((mix(values) & np.uint64((1 << 44) - 1)) | (rows.astype(np.uint64) << np.uint64(44)))
        if not len(keys):
            return np.zeros(n), np.zeros(n)
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        owner = (keys[new] >> np.uint64(44)).astype(np.int64)
        most = np.zeros(n)
        np.maximum.at(most, owner, np.diff(np.append(new, len(keys))))
        return np.bincount(owner, minlength=n) / np.maximum(of, 1), most / np.maximum(of, 1)

    words_distinct, top = distinct(words.value, words.row, count)
    pre = prefix(words.value)

    def grams(width: int) -> np.ndarray:
        have = np.maximum(count - width + 1, 0)
        row = np.repeat(np.arange(n), have)
        begin = words.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(have) - have, have)
        return np.where(have > 0, distinct(run(pre, begin, begin + width), row, have)[0], 1.0)

    same = np.zeros(len(words), bool)
    if len(words) > 1:
        same[1:] = (words.value[1:] == words.value[:-1]) & (words.row[1:] == words.row[:-1])
    lines = np.diff(np.append(0, np.cumsum(_LINE[data]))[offsets]) + 1
    columns = [
        np.log1p(size), np.log1p(count), share(upper), share(_DIGIT[data]), share(_LETTER[data]), share(_STOP[data]), share(_SYMBOL[data]), share(_BAR[data]), share(_BANG[data]), share(_LINE[data]), share(_HIGH[data]),
        share(accent), per_word(length), per_word(length > 12), per_word(length <= 3), per_word(_SYMBOL[last]), per_word(_BANG[last]), per_word((uppers == letters) & (letters > 1)), words_distinct, top, per_word(same),
        grams(5), grams(2), count / lines, per_word(_UPPER[head]), per_word(letters == 0),
    ]
    assert IS_SPACE[32]
    return np.column_stack(columns).astype(np.float64) if n else np.zeros((0, len(FEATURES)))


@dataclass
class Trees:
    """All trees flattened: node i asks whether feature[i] <= threshold[i]; leaves point at themselves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.repeat(self.roots[None, :], len(x), 0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 4.0, ridge: float = 2.0) -> Trees:
    """Boosted trees on the logistic loss; splits are searched on histograms of quantile bins."""
    mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
        offset = binned + np.arange(x.shape[1]) * bins
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)

            def grow(rows: np.ndarray, level: int) -> int:
                at = len(nodes)
                gs, hs = g[rows].sum(), h[rows].sum()
                nodes.append([0, np.inf, at, at, -rate * gs / (hs + ridge)])  # noqa: B023
                if level < depth and len(rows) > 1:
                    flat = offset[rows].ravel()
                    shape = (x.shape[1], bins)
                    gl = np.bincount(flat, np.repeat(g[rows], x.shape[1]), bins * x.shape[1]).reshape(shape).cumsum(1)  # noqa: B023
                    hl = np.bincount(flat, np.repeat(h[rows], x.shape[1]), bins * x.shape[1]).reshape(shape).cumsum(1)  # noqa: B023
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(hl < least / 4) | (hs - hl < least / 4)] = -1
                    f, b = np.unravel_index(int(gain.argmax()), shape)
                    if gain[f, b] > 1e-6 and b < len(cuts[f]):
                        goes = binned[rows, f] <= b
                        if goes.any() and not goes.all():
                            left, right = grow(rows[goes], level + 1), grow(rows[~goes], level + 1)
                            nodes[at][:4] = [int(f), float(cuts[f][b]), left, right]
                            return at
                margin[rows] += nodes[at][4]
                return at

            roots.append(grow(np.arange(len(y)), 0))
    if not roots:
        nodes.append([0, np.inf, 0, 0, 0.0])
        roots.append(0)
    feature, threshold, left, right, value = zip(*nodes, strict=True)
    return Trees(base, np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = statistics(*text_buffers(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(rows), pa.list_(pa.float64()))], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_labels: int = 12_000) -> Trees:
    """Fit on labels (doc_id, label), at most most_labels of them, and as many of the documents that have them."""
    chosen = labels.select(labels["doc_id"], labels[label].cast("double").alias("label")).filter("doc_id is not null and label is not null")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most_labels)
    texts = docs.select(docs["doc_id"], docs["text"]).join(F.broadcast(chosen), "doc_id")  # bounded by most_labels
    texts = texts.orderBy(F.xxhash64("doc_id"), "doc_id", "label", F.xxhash64("text")).limit(most_labels)  # documents may share an id
    rows = texts.select("text", "label").mapInArrow(_features, "label double, x array<double>").toPandas()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    y = rows["label"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the same trees whatever order the rows came in
    return fit(x[order], y[order])


def _scored(docs: DataFrame, model: Trees) -> DataFrame:
    """row (docs' columns as one struct, so that none can clash) and score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = model.score(statistics(*text_buffers(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores)], names=["row", "score"])

    wide = docs.select(F.struct(*(docs[c].alias(c) for c in docs.columns)).alias("row"), docs["text"].alias("text"))
    return wide.mapInArrow(work, wide.select("row").schema.add("score", "double"))


def _own(docs: DataFrame) -> list[Column]:
    return [F.col("row").getField(c).alias(c) for c in docs.columns]


def with_score(docs: DataFrame, model: Trees, column: str = "score") -> DataFrame:
    """docs with the probability of label 1 as another column; one of that name that docs has is replaced."""
    return _scored(docs, model).select(*(c for name, c in zip(docs.columns, _own(docs), strict=True) if name != column), F.col("score").alias(column))


def at_least(docs: DataFrame, model: Trees, least: float) -> DataFrame:
    """The rows of docs whose score is at least that."""
    return _scored(docs, model).filter(F.col("score") >= least).select(*_own(docs))
