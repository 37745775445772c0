"""Vectors as rows of integers: the part that exact search and vector codes have in common."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floored(vectors: DataFrame, scale: int, id_column: str, column: str, **others: Column) -> DataFrame:
    """id and v, the vector's components as floor(scale * x) with x as double, and other columns by new names.

    Rows whose id or vector is null, and vectors that hold null or non-finite components, are left out. Components beyond 64 bits become the nearest long.
    """
    x = F.transform(vectors[column], lambda c: c.cast("double"))
    rows = vectors.select(vectors[id_column].cast("long").alias("id"), x.alias("x"), *(c.alias(name) for name, c in others.items()))
    rows = rows.filter("id is not null and x is not null and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    return rows.select("id", F.transform("x", lambda c: F.floor(c * F.lit(scale))).alias("v"), *others)


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """The lists of a column as rows of one matrix; missing components at the end are 0."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    width = int(lengths.max(initial=0)) if width is None else width
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def largest(rows: np.ndarray) -> float:
    return float(np.abs(rows.astype(np.float64)).max(initial=0))
