"""The trie of shared conversation beginnings, from globally sorted turn arrays.

A turn becomes 32 bytes (192 bits of its SHA-256 and its number of words), a conversation the string of its turns, so byte order of strings is the order of turn arrays
and a common beginning is a common prefix. The strings are range-sorted over all tasks, by conversation id among equals. Each task takes LCPs of neighbours on whole
Arrow batches and sweeps them with a stack of open nodes: a node opens where its first member begins and closes at the first lower LCP, and what it gathered goes to the node
below. Nodes on the path of a partition's first or last string may go on in its neighbours, so they leave as pieces. Pieces of all partitions, a path or two
for each, are stitched in order by one more stack over the partitions' borders; nothing else passes through that task. Conversations that are alike to the end share one node whose
list of members can be as long as the table: its digest is taken from the pieces' lists in order, in a task for each such node, as SHA-256 requires.

Defined results: rows with a null conv_id take no part; null roles and texts are empty; a null turn comes first; turns of one number are ordered by the digest of role and text; repeated
rows are repeated turns; other columns never take part, whatever their names; an empty table gives no rows. Remainders have the sign of conv_id. A conversation's turns (32 bytes each, whatever their
texts) are one row; Spark samples up to 100 of them for each partition to find the ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.session import materialized

TURN = 32
EMPTY = hashlib.sha256(b"").hexdigest()
#: kind 0: a closed node. Others, in the order of stitching, 1: first and last string of a partition; 2: a piece on the path of its first string; 3: one on that of its last string alone.
PIECES = "part int, kind int, depth long, slot long, parent_slot long, closed boolean, n_convs long, low long, parent_low long, n_children long, n_leaves long, saved long, words long, ends string, first binary, last binary"
STITCHED = "kind int, number long, part int, slot long, depth long, parent long, low long, n_convs long, n_children long, n_leaves long, saved long"


def turn_strings(turns: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """conv_id and string (hex, 64 characters a turn) of every conversation of turns (conv_id, turn, role, text), grouped by a shuffle on base = conv_id - conv_id % 20."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 48)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    cid = turns[id_column].cast("long")
    rows = turns.filter(cid.isNotNull()).select(cid.alias("conv_id"), (cid - cid % 20).alias("base"), F.struct(turns["turn"].alias("turn"), F.concat(digest, F.lpad(F.hex(words), 16, "0")).alias("hex")).alias("t"))
    whole = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select("base", "conv_id", F.array_join(F.transform("t", lambda t: t["hex"]), "").alias("string"))


def rebuilt(strings: DataFrame) -> DataFrame:
    """conv_id and string (binary) of conversations that take their first crc32(conv_id) % 4 turns from the conversation `base`, if there is one.

    At most 20 ids share a base (39 at base 0), so they are one small window, and the shuffle that grouped the turns serves it, too.
    """
    width = 2 * TURN
    lent = F.max(F.when(F.col("conv_id") == F.col("base"), F.substring("string", 1, 3 * width))).over(Window.partitionBy("base"))
    rows = strings.withColumn("lent", F.coalesce(lent, F.lit(""))).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int"))
    return rows.select("conv_id", F.unhex(F.concat(F.expr(f"substring(lent, 1, {width} * h)"), F.expr(f"substring(string, {width} * h + 1)"))).alias("string"))


def common_turns(strings: list[bytes]) -> np.ndarray:
    """For each string but the first, how many whole turns it has in common with the one before."""
    data = np.frombuffer(b"".join(strings), np.uint64).reshape(-1, TURN // 8)
    length = np.array([len(x) // TURN for x in strings], np.int64)
    begin = np.cumsum(length) - length
    both = np.minimum(length[1:], length[:-1])
    pair = np.repeat(np.arange(len(both)), both)
    at = np.arange(int(both.sum())) - np.repeat(np.cumsum(both) - both, both)
    differ = (data[begin[pair] + at] != data[begin[pair + 1] + at]).any(1)
    out = both.copy()
    np.minimum.at(out, pair[differ], at[differ])
    return out


class _Open:
    """A node that is still open in the sweep of a partition."""

    __slots__ = ("children", "convs", "ends", "first_path", "leaves", "low", "parent", "saved", "slot", "words")

    def __init__(self, slot: int, parent: int, words: int, first_path: bool):
        self.slot, self.parent, self.words, self.first_path = slot, parent, words, first_path
        self.convs = self.children = self.leaves = self.saved = 0
        self.low = (1 << 63) - 1
        self.ends: list[int] = []

    def row(self, depth: int, closed: bool) -> dict:
        ends = ",".join(map(str, self.ends))
        return {"depth": depth, "slot": self.slot, "parent_slot": self.parent, "closed": closed, "n_convs": self.convs, "low": self.low, "n_children": self.children, "n_leaves": self.leaves, "saved": self.saved, "words": self.words, "ends": ends}


def _sweep(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Closed nodes and pieces of one partition of sorted strings."""
    part = TaskContext.get().partitionId()
    stack: list[_Open] = []
    rows: list[dict] = []
    slots = 0
    first = last = None

    def close() -> None:
        node = stack.pop()
        below = stack[-1] if stack else None
        if not node.first_path:  # all its members are here
            node.leaves += node.children == 0
            node.saved += (node.convs - 1) * node.words
            below.leaves += node.leaves
            below.saved += node.saved
        if below:
            below.convs += node.convs
            below.low = min(below.low, node.low)
        row = node.row(len(stack), True)
        rows.append(row | ({"kind": 2} if node.first_path else {"kind": 0, "ends": hashlib.sha256(row["ends"].encode()).hexdigest()}))

    for batch in batches:
        if not batch.num_rows:
            continue
        strings, ids = batch.column("string").to_pylist(), batch.column("conv_id").to_pylist()
        common = common_turns([last if last is not None else b"", *strings]).tolist()
        if first is None:
            first, common[0] = strings[0], -1
        last = strings[-1]
        for cid, string, shared in zip(ids, strings, common, strict=True):
            while len(stack) - 1 > shared:
                close()
            for depth in range(shared + 1, len(string) // TURN + 1):
                words = int.from_bytes(string[depth * TURN - 8 : depth * TURN], "big") if depth else 0
                path = shared < 0
                if stack and not path:
                    stack[-1].children += 1
                stack.append(_Open(slots, stack[-1].slot if stack else -1, words, path))
                slots += 1
            top = stack[-1]
            top.convs += 1
            top.low = min(top.low, cid)
            top.ends.append(cid)
    if first is None:
        return
    for below, node in zip(stack[-2::-1], stack[:0:-1], strict=True):
        below.convs += node.convs
        below.low = min(below.low, node.low)
    rows += [node.row(depth, False) | {"kind": 2 if node.first_path else 3} for depth, node in enumerate(stack)]
    low = {r["slot"]: r["low"] for r in rows if r["kind"] == 0}  # ids of pieces aren't known yet
    rows.append({"kind": 1, "first": first, "last": last})
    for at in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_pylist([r | {"part": part, "parent_low": low.get(r.get("parent_slot"))} for r in rows[at : at + 10_000]], schema=schema)


def _stitch(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Whole nodes (kind 0) and the node of each piece (kind 1), from all partitions' pieces sorted by part, kind and depth."""
    stack: list[dict] = []
    out: list[dict] = []
    numbers = 0
    last, part, to_close, shared = b"", None, 0, -1

    def close() -> None:
        node = stack.pop()
        node["n_leaves"] += node["n_children"] == 0
        node["saved"] += (node["n_convs"] - 1) * node.pop("words")
        if stack:
            stack[-1]["n_leaves"] += node["n_leaves"]
            stack[-1]["saved"] += node["saved"]
        out.append(node | {"kind": 0, "depth": len(stack), "parent": stack[-1]["number"] if stack else None})

    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == 1:
                for _ in range(to_close):
                    close()
                to_close = 0
                shared = int(common_turns([last, r["first"]])[0]) if part is not None else -1
                part, last = r["part"], r["last"]
                while len(stack) - 1 > shared:
                    close()
                continue
            if r["kind"] == 3:
                for _ in range(to_close):
                    close()
                to_close = 0
            if r["kind"] == 2 and r["depth"] <= shared:
                node = stack[r["depth"]]
                for c in ("n_convs", "n_children", "n_leaves", "saved"):
                    node[c] += r[c]
                node["low"] = min(node["low"], r["low"])
            else:
                if r["kind"] == 2 and stack:
                    stack[-1]["n_children"] += 1
                stack.append({"number": numbers} | {c: r[c] for c in ("n_convs", "n_children", "n_leaves", "saved", "low", "words")})
                numbers += 1
            to_close += r["kind"] == 2 and r["closed"]
            out.append({"kind": 1, "number": stack[r["depth"]]["number"], "part": part, "slot": r["slot"]})
        yield pa.RecordBatch.from_pylist(out, schema=schema)
        out = []
    while stack:
        close()
    yield pa.RecordBatch.from_pylist(out, schema=schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each number's lists of ids, which come sorted by number and part."""
    number, digest = None, None
    for batch in batches:
        done: list[tuple] = []
        for own, ends in zip(batch.column("number").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if own != number:
                done += [(number, digest.hexdigest())] if digest else []
                number, digest = own, hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([x for _, x in done])], names=["number", "ends_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([digest.hexdigest()])], names=["number", "ends_sha256"])


def _arrow(kind: str) -> pa.Schema:
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, types[t]) for name, t in (x.split() for x in kind.split(", "))])


def trie(strings: DataFrame, per_partition: int = 200_000) -> DataFrame:
    """The nodes of strings (conv_id, string): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    per_partition is about how many turns (and so nodes) a task holds.
    """
    spark = strings.sparkSession
    strings = materialized(strings, "strings")
    turns = strings.agg(F.coalesce(F.sum(F.octet_length("string") / TURN + 1), F.lit(0))).first()[0]
    parts = int(max(1, turns // per_partition + 1, min(spark.sparkContext.defaultParallelism, turns // 4_000)))
    ordered = strings.repartitionByRange(parts, "string", "conv_id").sortWithinPartitions("string", "conv_id")
    pieces_schema, stitched_schema = _arrow(PIECES), _arrow(STITCHED)
    swept = materialized(ordered.mapInArrow(lambda b: _sweep(b, pieces_schema), PIECES), "swept")
    pieces = swept.filter("kind > 0")
    # A path or two for each partition: the one task that sees all borders in order.
    stitched = pieces.drop("ends").repartition(1).sortWithinPartitions("part", "kind", "depth").mapInArrow(lambda b: _stitch(b, stitched_schema), STITCHED)
    stitched = materialized(stitched, "stitched")
    whole, of_piece = stitched.filter("kind = 0"), stitched.filter("kind = 1").select("part", "slot", "number")
    lists = pieces.filter("ends <> ''").select("part", "slot", "ends").join(of_piece, ["part", "slot"])
    digests = lists.select("number", "part", "ends").repartition("number").sortWithinPartitions("number", "part").mapInArrow(_digests, "number long, ends_sha256 string")
    above = whole.select(F.col("number").alias("parent"), F.col("low").alias("parent_low"))
    columns = ["low", "depth", "parent_low", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    of_borders = whole.drop("part", "slot").join(above, "parent", "left").join(digests, "number", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))).select(columns)
    parents = of_piece.join(whole.select("number", F.col("low").alias("piece_low")), "number").select("part", F.col("slot").alias("parent_slot"), "piece_low")
    inner = swept.filter("kind = 0").join(parents, ["part", "parent_slot"], "left").withColumn("parent_low", F.coalesce("parent_low", "piece_low")).withColumnRenamed("ends", "ends_sha256").select(columns)
    return inner.unionByName(of_borders).select(F.col("low").alias("conv_id"), "depth", F.col("parent_low").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


def conversation_trie(turns: DataFrame, per_partition: int = 200_000) -> DataFrame:
    """The trie of rebuilt conversations (see rebuilt) of turns (conv_id, turn, role, text)."""
    return trie(rebuilt(turn_strings(turns)), per_partition)
