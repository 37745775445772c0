"""Sinks: overwriting and appending tables, nested documents, checksums and a guard on paths."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def guarded(path: str, root: str) -> str:
    """path, if it lies below root; else ValueError."""
    below = PurePosixPath(path).relative_to(PurePosixPath(root))
    if ".." in below.parts:
        raise ValueError(f"{path} leaves {root}")
    return path


def write_csv(rows: DataFrame, path: str, schema: str | None = None, mode: str = "overwrite", root: str | None = None) -> None:
    """CSV with header; with a schema, its columns in its order and no others; with a root, below it and nowhere else."""
    path = path if root is None else guarded(path, root)
    if schema is not None:
        schema = StructType.fromDDL(schema)
        if unknown := set(rows.columns) ^ set(schema.fieldNames()):
            raise ValueError(f"columns differ from the schema: {sorted(unknown)}")
        rows = rows.select(*schema.fieldNames())
    rows.write.mode(mode).options(header=True, escape='"', emptyValue="").csv(path)


def write_jsonl(rows: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "overwrite", root: str | None = None) -> None:
    """One object a line with keys in order, in a folder for each value of by; with a root, below it and nowhere else."""
    path = path if root is None else guarded(path, root)
    rows.select(*by, *sorted(set(rows.columns) - set(by))).write.mode(mode).partitionBy(*by).option("ignoreNullFields", False).json(path)


def nested_by_group(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """One row for each group: its other columns as a sorted list of structs, and their number."""
    others = [c for c in rows.columns if c != group]
    keys = [k.alias(f"k{i}") for i, k in enumerate(order)]
    items = F.sort_array(F.collect_list(F.struct(*keys, F.struct(*others).alias("item"))))
    return rows.groupBy(group).agg(F.transform(items, lambda x: x["item"]).alias("items"), F.count("*").alias("n"))


def response(**fields: Column) -> Column:
    """One JSON text of the fields."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


def checksum_lines(files: DataFrame) -> DataFrame:
    """`sha256  name` for each file of an inventory (path, sha256)."""
    return files.select(F.concat("sha256", F.lit("  "), F.regexp_extract("path", r"([^/]+)$", 1)).alias("value"))
