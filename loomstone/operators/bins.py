"""Bins filled in order, with no group in one task.

Where a bin begins depends on the one before, but a bin that begins at a row ends at a place that prefix sums tell, whatever came before. A chunk of `chunk` rows, together with
the `most_items` rows after it, is so a map: from the row at which the first bin of its own begins (one of its first `most_items`) to the row of the next chunk at which
the following bin begins, and to how many bins begin in between. Maps are composed: chunks into spans of `span` chunks, spans into larger ones, until a group
has few enough; the entering rows then come down again level by level, and every chunk marks its bins on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from loomstone.operators.evidence import numbered
from loomstone.session import materialized


def next_starts(sizes: np.ndarray, most_items: int, most_size: int) -> np.ndarray:
    """For a bin that begins at each row, the row at which the next one begins."""
    total = np.append(0, np.cumsum(sizes))
    at = np.arange(len(sizes))
    return np.minimum(at + most_items, np.maximum(np.searchsorted(total, total[:-1] + most_size, side="right") - 1, at + 1))


def chunk_map(sizes: np.ndarray, rows: int, most_items: int, most_size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first most_items rows as the first beginning in a chunk of `rows` rows (sizes has more): where the next chunk's first bin begins, and how many begin here.

    Pointers are doubled until all leave the chunk.
    """
    n = max(rows, most_items)
    after = np.arange(n)  # beyond the chunk, rows stand for themselves
    after[:rows] = next_starts(sizes, most_items, most_size)[:rows]
    count = (np.arange(n) < rows).astype(np.int64)
    while len(inside := np.flatnonzero(after < rows)):
        count[inside] += count[after[inside]]
        after[inside] = after[after[inside]]
    return after[:most_items] - rows, count[:most_items]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole runs of rows with equal keys, of batches that come sorted by them."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        cuts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and values[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _one(table: pa.Table, **columns: list) -> pa.RecordBatch:
    """A row with the group of table's first row and other columns."""
    kinds = {"part": pa.int64(), "leave": pa.list_(pa.int64()), "bins": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([table.column("g").slice(0, 1).combine_chunks(), *(pa.array([v], kinds[c]) for c, v in columns.items())], names=["g", *columns])


def greedy_bins(rows: DataFrame, group: str, order: str, size: str, most_items: int = 30, most_size: int = 60_000, chunk: int = 8192, span: int = 1024) -> DataFrame:
    """Bins filled in order; a new one begins where the next row would be too many or too much: group, order, bin (from 1).

    A row that is too much by itself is a bin of its own. Null and negative sizes count as 0; a null group is a group; rows of equal order come in any order.
    """
    chunk = max(chunk, most_items)
    kind = StructField("g", rows.schema[group].dataType)
    own = numbered(rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("s")), ["g"], ["o"], "i")
    own = materialized(own.withColumn("part", F.floor(F.col("i") / chunk)), "numbered")  # numbers stay as they are
    # The first rows of a chunk are also the last ones of the chunk before.
    halo = own.filter((F.col("i") % chunk < most_items) & (F.col("part") > 0)).withColumn("part", F.col("part") - 1)
    meet = lambda df, *by: df.repartition("g", "part").sortWithinPartitions("g", "part", *by)
    maps_kind = StructType([kind, *StructType.fromDDL("part long, leave array<long>, bins array<long>").fields])

    def to_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["g", "part"]):
            part, here = t.column("part")[0].as_py(), t.column("i").to_numpy()
            leave, bins = chunk_map(t.column("s").to_numpy(), int((here // chunk == part).sum()), most_items, most_size)
            yield _one(t, part=part, leave=leave, bins=bins)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["g", "up"]):
            at, bins = np.arange(most_items), np.zeros(most_items, np.int64)
            for leave, more in zip(t.column("leave").to_pylist(), t.column("bins").to_pylist(), strict=True):
                bins, at = bins + np.array(more)[at], np.array(leave)[at]
            yield _one(t, part=t.column("up")[0].as_py(), leave=at, bins=bins)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where each part is entered, from where its span is."""
        for t in _groups(batches, ["g", "up"]):
            at, before = t.column("enter")[0].as_py(), t.column("before")[0].as_py()
            enters, befores = [], []
            for leave, bins in zip(t.column("leave").to_pylist(), t.column("bins").to_pylist(), strict=True):
                enters.append(at)
                befores.append(before)
                at, before = leave[at], before + bins[at]
            yield pa.RecordBatch.from_arrays([t.column("g").combine_chunks(), t.column("part").combine_chunks(), pa.array(enters, pa.int64()), pa.array(befores, pa.int64())], names=["g", "part", "enter", "before"])

    entered_kind = StructType([kind, *StructType.fromDDL("part long, enter long, before long").fields])

    def entered(maps: DataFrame) -> DataFrame:
        maps = materialized(maps, "maps").withColumn("up", F.floor(F.col("part") / span))
        top = (maps.agg(F.max("part")).first()[0] or 0) < span
        start = maps.select("g", "up", F.lit(0).cast("long").alias("enter"), F.lit(0).cast("long").alias("before")).distinct()
        if not top:
            composed = maps.repartition("g", "up").sortWithinPartitions("g", "up", "part").mapInArrow(compose, maps_kind)
            start = entered(composed).withColumnRenamed("part", "up")
        start = start.withColumnsRenamed({"g": "g_", "up": "up_"})
        both = maps.join(start, maps["g"].eqNullSafe(start["g_"]) & (maps["up"] == start["up_"])).drop("g_", "up_")
        return both.repartition("g", "up").sortWithinPartitions("g", "up", "part").mapInArrow(carry, entered_kind)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["g", "part"]):
            after = next_starts(t.column("s").to_numpy(), most_items, most_size).tolist()
            begins = np.zeros(t.num_rows, np.int64)
            at = t.column("enter")[0].as_py()
            while at < t.num_rows:
                begins[at] = 1
                at = after[at]
            bins = t.column("before")[0].as_py() + np.cumsum(begins)
            yield pa.RecordBatch.from_arrays([t.column("g").combine_chunks(), t.column("o").combine_chunks(), pa.array(bins.astype(np.int32))], names=["g", "o", "bin"])

    at = entered(meet(own.unionByName(halo), "i").mapInArrow(to_maps, maps_kind)).withColumnsRenamed({"g": "g_", "part": "part_"})
    wide = own.join(at, own["g"].eqNullSafe(at["g_"]) & (own["part"] == at["part_"])).drop("g_", "part_")
    out_kind = StructType([kind, StructField("o", rows.schema[order].dataType), *StructType.fromDDL("bin int").fields])
    return meet(wide, "i").mapInArrow(mark, out_kind).select(F.col("g").alias(group), F.col("o").alias(order), "bin")
