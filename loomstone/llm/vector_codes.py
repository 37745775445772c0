"""Vector codes: a codebook for each of a few consecutive parts of a vector, learnt in rounds, all in whole numbers.

The codebooks, at most entries x parts short integer vectors whatever the data, are broadcast. In each round tasks
compute the distances of an Arrow batch's parts to all entries as |x|^2 - 2 x c + |c|^2 with 64-bit matrix products, take the first smallest,
and add up parts and counts by entry, so a task sends one row for each entry it used, whatever entry is frequent. A grouped shuffle merges
those rows, and the new entries come to the driver: entries x parts rows. Two more passes assign codes and add up errors by label.

Defined results: rows with a null id, and vectors that are null or hold null or non-finite components, are left out; vectors whose length isn't that of
most (ties: the shorter) can't be cut like the others and raise an error, as a length that parts don't divide does; components (floors) beyond 2**26 in size raise one as well, so
that no distance of up to 2**9 components overflows; with repeated ids the smaller vector comes first among the first entries; fewer vectors than entries give fewer entries;
ties go to the lower entry; unused entries stay; null labels are one label; other columns never take part, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.vectors import floored, matrix
from loomstone.session import materialized

#: Components beyond this aren't taken: squared distances of 512 of them still fit 64 bits.
MOST = 1 << 26
#: Vectors that are compared with all entries at a time.
ROWS = 4096


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact in 64 bits."""
    return (rows * rows).sum(1)[:, None] - 2 * (rows @ entries.T) + (entries * entries).sum(1)


def nearest_entries(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row, and its squared distance."""
    d = distances(rows, entries)
    at = d.argmin(1)
    return at, d[np.arange(len(rows)), at]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            yield piece, matrix(piece.column("v"))


def _sums(books):
    """Sums and counts of the parts by entry, over all of a task's rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = books.value
        parts, entries, width = codebooks.shape
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for _, vectors in _pieces(batches):
            for p in range(parts):
                rows = vectors[:, p * width : (p + 1) * width]
                at, _ = nearest_entries(rows, codebooks[p])
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                total[p, used] += np.add.reduceat(rows[order], first, axis=0) if width else 0
                count[p] += np.bincount(at, minlength=entries)
        part, entry = np.nonzero(count)
        if len(part):
            columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "total"])

    return work


def _codes(books):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = books.value
        parts, _, width = codebooks.shape
        for piece, vectors in _pieces(batches):
            found = [nearest_entries(vectors[:, p * width : (p + 1) * width], codebooks[p]) for p in range(parts)]
            codes = np.stack([at for at, _ in found], 1)
            kind = pa.list_(pa.int32())
            columns = [piece.column("id"), piece.column("label"), pa.array(list(codes.astype(np.int32)), kind), pa.array(sum(e for _, e in found))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "entries", "error"])

    return work


def train_codebooks(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> np.ndarray | None:
    """Codebooks (parts, entries, width) of rows (id, v), or None if there are none."""
    spark = rows.sparkSession
    first = [r["v"] for r in rows.orderBy("id", "v").select("v").limit(entries).collect()]
    if not first:
        return None
    codebooks = np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    width = codebooks.shape[2]
    for _ in range(rounds):
        books = spark.sparkContext.broadcast(codebooks)
        kind = "part int, entry int, n long, total array<long>"
        sums = rows.select("v").mapInArrow(_sums(books), kind).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"c{i}") for i in range(width)))
        for r in sums.collect():  # at most parts x entries rows
            codebooks[r["part"], r["entry"]] = [r[f"c{i}"] // r["n"] for i in range(width)]
        books.destroy()
    return codebooks


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def _usable(vectors: DataFrame, scale: int, parts: int, id_column: str, column: str, label: str) -> DataFrame:
    rows = materialized(floored(vectors, scale, id_column, column, label=vectors[label]), "floors")
    lengths = rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))).alias("most"))
    # At most two lengths are looked at: more than one is an error already.
    found = lengths.orderBy(F.desc("n"), "length").limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"vectors of different lengths: {found[0]['length']} and {found[1]['length']}")
    if found and found[0]["length"] % parts:
        raise ValueError(f"{parts} equal parts can't be cut from {found[0]['length']} components")
    if found and not 0 <= (found[0]["most"] or 0) <= MOST:
        raise ValueError(f"components beyond {MOST}")
    return rows


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_column: str = "vec_id", column: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """Per usable vector: vec_id, label, entries (one index for each part), error (squared distances summed), label_error (error summed over the label); and the codebooks."""
    spark: SparkSession = vectors.sparkSession
    rows = _usable(vectors, scale, parts, id_column, column, label)
    codebooks = train_codebooks(rows, parts, entries, rounds)
    kind = f"id long, label {rows.schema['label'].dataType.simpleString()}, entries array<int>, error long"
    if codebooks is None:
        return spark.createDataFrame([], kind).select(F.col("id").alias("vec_id"), "label", "entries", "error", F.col("error").alias("label_error")), None
    coded = materialized(rows.mapInArrow(_codes(spark.sparkContext.broadcast(codebooks)), kind), "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(by_label, coded["label"].eqNullSafe(by_label["of"]), "left")
    return out.select(F.col("id").alias("vec_id"), "label", "entries", "error", "label_error"), codebooks


def code_string(entries: Column | str) -> Column:
    """Indexes as two hex digits each."""
    return F.array_join(F.transform(entries, lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
