"""Nearest neighbours with one vantage-point tree for each shard of vectors.

Vectors are dealt to shards by a hash of their id, each shard's vectors become one packed row (`shard_size` vectors on average), and
queries are packed into blocks. A shard goes to one task, where its tree is built once, and the blocks stream past it, sorted behind it. Each query
first goes down to its leaf for a radius to start with, then all queries walk the tree together, and a side is skipped by those for
which `factor` times the gap that the triangle inequality proves exceeds the radius. Factor one is exact; larger
ones skip more. The nearest of all shards are the answer. Distances are taken in double precision on the original vectors.

Defined results: vectors that are null or zero, or hold null or non-finite numbers, or whose length isn't that of most, take no part; a repeated id is two
candidates, neither found for itself; ties go to the smaller id; with fewer candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.session import materialized


class Tree:
    """A vantage-point tree in flat arrays. Inner nodes have a vantage point and the radius of its inner half; leaves have rows."""

    def __init__(self, points: np.ndarray, leaf: int = 48, seed: int = 11):
        self.points = points
        self.norms = np.einsum("ij,ij->i", points, points)
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []  # (vantage row, radius, inner, outer) or (rows,)

        def build(rows: np.ndarray) -> int:
            at = len(self.nodes)
            self.nodes.append((rows,))
            if len(rows) > leaf:
                vantage = int(rows[rng.integers(len(rows))])
                d = np.sqrt(((points[rows] - points[vantage]) ** 2).sum(1))
                radius = float(np.median(d))
                near = d <= radius
                if 0 < near.sum() < len(rows):
                    self.nodes[at] = (vantage, radius, build(rows[near]), build(rows[~near]))
            return at

        if len(points):
            build(np.arange(len(points)))

    def search(self, queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Distances and ids of the k nearest of each query (infinite and -1 where there are fewer), and how many distances that took."""
        n = len(queries)
        best = np.full((n, k), np.inf)
        found = np.full((n, k), -1, np.int64)
        seen = np.zeros((n, len(self.nodes)), bool)
        taken = 0

        def leaf(at: int, rows: np.ndarray, who: np.ndarray) -> None:
            nonlocal taken
            who = who[~seen[who, at]]
            if not len(who):
                return
            seen[who, at] = True
            taken += len(who) * len(rows)
            d = np.sqrt(((queries[who, None, :] - self.points[None, rows, :]) ** 2).sum(2))
            d[query_ids[who, None] == ids[None, rows]] = np.inf
            all_d = np.concatenate([best[who], d], 1)
            all_i = np.concatenate([found[who], np.broadcast_to(ids[rows], d.shape)], 1)
            all_i[np.isinf(all_d)] = np.iinfo(np.int64).max
            order = np.lexsort((all_i, all_d), axis=1)[:, :k]
            best[who] = np.take_along_axis(all_d, order, 1)
            found[who] = np.take_along_axis(all_i, order, 1)

        def distance(vantage: int, who: np.ndarray) -> np.ndarray:
            nonlocal taken
            taken += len(who)
            return np.sqrt(((queries[who] - self.points[vantage]) ** 2).sum(1))

        def descend(at: int, who: np.ndarray) -> None:
            node = self.nodes[at]
            for start in range(0, len(who), 256) if len(node) == 1 else ():
                leaf(at, node[0], who[start : start + 256])
            if len(node) == 4 and len(who):
                inner = distance(node[0], who) <= node[1]
                descend(node[2], who[inner])
                descend(node[3], who[~inner])

        def walk(at: int, who: np.ndarray) -> None:
            node = self.nodes[at]
            for start in range(0, len(who), 256) if len(node) == 1 else ():
                leaf(at, node[0], who[start : start + 256])
            if len(node) == 4 and len(who):
                gap = distance(node[0], who) - node[1]
                reach = best[who, -1] + 1e-9 * (1 + np.abs(gap))
                walk(node[2], who[factor * gap <= reach])
                gap, reach = -gap, best[who, -1] + 1e-9 * (1 + np.abs(gap))
                walk(node[3], who[factor * gap <= reach])

        if self.nodes:
            who = np.arange(n)
            descend(0, who)
            walk(0, who)
        found[np.isinf(best)] = -1
        return best, found, taken


def _usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    v = F.transform(vectors[column], lambda x: x.cast("double"))
    rows = vectors.select(vectors[id_column].cast("long").alias("id"), v.alias("v"))
    return rows.filter("id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8")


def _pack(size: int):
    """Rows of one group, which come together, as packed rows of at most size vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        group = None

        def out() -> pa.RecordBatch:
            ids = np.array([x for x, _ in held], "<i8").tobytes()
            vectors = np.array([v for _, v in held], "<f8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([len(held)], pa.int32()), pa.array([ids]), pa.array([vectors])], names=["part", "n", "ids", "vectors"])

        for batch in batches:
            for part, i, v in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "v")), strict=True):
                if held and (part != group or len(held) >= size):
                    yield out()
                    held = []
                group = part
                held.append((i, v))
        if held:
            yield out()

    return work


def _search(k: int, factor: float):
    """Rows come sorted by part, in each its shard (kind 0, one row or two) before the blocks of queries (kind 1)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, trees = None, []
        for batch in batches:
            for at, kind, ids, vectors in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "ids", "vectors")), strict=True):
                if at != part:
                    part, trees = at, []
                own = np.frombuffer(ids, "<i8")
                points = np.frombuffer(vectors, "<f8").reshape(len(own), -1)
                if kind == 0:
                    trees.append((own, Tree(points)))
                for there, tree in trees if kind else ():
                    best, found, _ = tree.search(points, own, there, k, factor)
                    row, rank = np.nonzero(np.isfinite(best))
                    yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(found[row, rank]), pa.array(best[row, rank])], names=["query_id", "vec_id", "score"])

    return work


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, id_column: str = "vec_id", column: str = "embedding", shard_size: int = 4096, block: int = 512) -> DataFrame:
    """The k nearest vectors of every query, but for the one with its own id: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows, asked = _usable(vectors, id_column, column), _usable(queries, id_column, column)
    width = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = (x.filter(F.size("v") == width["width"]) for x in (rows, asked))
    shards = max(1, -(-width["count"] // shard_size))
    kind = "part long, n int, ids binary, vectors binary"
    deal = lambda x, n: x.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n)))
    packed = deal(rows, shards).repartition("part").sortWithinPartitions("part", "id").mapInArrow(_pack(2 * shard_size), kind)
    packed = materialized(packed, "shards")
    blocks = max(1, -(-asked.count() // block))
    queries_packed = deal(asked, blocks).repartition("part").sortWithinPartitions("part", "id").mapInArrow(_pack(2 * block), kind)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("part")
    # Every block of queries against every shard, the stated job; a row here is a whole block or shard.
    blocks_out = queries_packed.select(every, F.lit(1).alias("kind"), "ids", "vectors")
    meeting = packed.select("part", F.lit(0).alias("kind"), "ids", "vectors").unionByName(blocks_out).repartition("part").sortWithinPartitions("part", "kind")
    found = meeting.mapInArrow(_search(k, factor), "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
