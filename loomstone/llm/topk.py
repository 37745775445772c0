"""Exact top-k inner products over an impact-ordered index, one score at a time.

Vectors are dealt to shards by a hash of their id. A shard is one row of the written index: its integer vectors and, for every dimension, its postings
in order of falling impact, cut into segments of equal quantised impact. A query meets a shard's segments by falling contribution: for a negative weight
the smallest impacts come first. Every vector has an accumulator of what its processed postings contribute above the dimension's least,
and a count of them, so after any segment no vector exceeds base + accumulator + (unseen dimensions) * (contribution of the next segment).
The k-th best of exactly scored vectors is the bar. Processing stops only when every vector that isn't scored exactly is proven to stay below the bar,
and all that might reach it are few; these are rescored exactly from their vectors. If no proof comes, all segments are
processed and the rest is rescored.

A block of queries first meets one shard, another for each block in turn, and takes the bars from there to all other shards, which mostly
end with a proof at once. The stated query set meets all shards in blocks; a shard answers with k rows for a query at most.

Defined results: rows with a null id, and vectors that are null or hold null or non-finite components, take no part; missing components of shorter vectors count as 0, so
an empty vector scores 0 everywhere; all rows with the query's id are its own; a repeated candidate id is two candidates; a repeated query
with the same vector is answered once, with another vector apart; ties go to the smaller id; with fewer candidates than k all are returned; other columns never
take part, whatever their names; an empty table gives no rows. Scores beyond 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.vectors import floored, largest, matrix
from loomstone.session import materialized

#: Shares of all postings after which the bounds are looked at.
LOOKS = (0.3, 0.55, 0.7, 0.8, 0.9, 1.0)
INDEX = "part long, n int, width int, ids binary, vectors binary, postings binary, begins binary, tops binary, lows binary"
BLOCK = "part long, n int, width int, ids binary, copies binary, vectors binary"


class Shard:
    """Vectors of one shard with their impact-ordered postings.

    postings: rows of dimension 0 by falling impact, then those of dimension 1, and so on. Segment s holds postings begins[s] to begins[s + 1] of one
    dimension, whose impacts lie between lows[s] and tops[s].
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, postings: np.ndarray, begins: np.ndarray, tops: np.ndarray, lows: np.ndarray):
        self.ids, self.vectors, self.postings, self.begins, self.tops, self.lows = ids, vectors, postings, begins, tops, lows
        self.dimension = begins[:-1] // max(1, len(ids))
        self.sizes = np.diff(begins)
        self.largest = largest(vectors)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, levels: int) -> Shard:
        n, width = vectors.shape
        order = np.argsort(-vectors, axis=0, kind="stable").T if width else np.zeros((0, n), np.int64)
        impact = np.take_along_axis(vectors.T, order, 1)
        span = impact[:, :1].astype(np.float64) - impact[:, -1:]
        step = np.maximum(1, np.ceil((span + 1) / levels))
        level = np.floor((impact.astype(np.float64) - impact[:, -1:]) / step)
        new = np.ones((width, n), bool)
        new[:, 1:] = level[:, 1:] != level[:, :-1]
        begins = np.append(np.flatnonzero(new.ravel()), width * n)
        flat = impact.ravel()
        return cls(ids, vectors, order.ravel().astype(np.int32), begins, flat[begins[:-1]], flat[begins[1:] - 1])

    def _exact(self, query: np.ndarray, rows: np.ndarray, safe: bool) -> np.ndarray:
        width = min(len(query), self.vectors.shape[1])
        own = self.vectors[rows, :width]
        return own @ query[:width] if safe else own.astype(object) @ query[:width].astype(object)

    def search(self, query: np.ndarray, query_id: int, k: int, bar: int | None) -> tuple[np.ndarray, np.ndarray, float]:
        """Ids and scores of the shard's k best for the query, without those that are proven to score less than bar; the share of postings processed."""
        n, width = len(self.ids), min(len(query), self.vectors.shape[1])
        safe = largest(query) * self.largest * max(1, width) < 1 << 51
        other = self.ids != query_id
        processed = 0
        if safe:
            possible, processed = self._possible(query[:width], other, k, bar)
        else:  # no bounds in doubles: everything is scored
            possible = np.flatnonzero(other)
        score = self._exact(query, possible, safe)
        best = np.lexsort((self.ids[possible], -score)) if safe else np.array(sorted(range(len(possible)), key=lambda i: (-score[i], self.ids[possible[i]])), np.int64)
        best = best[:k]
        return self.ids[possible[best]], score[best], processed / max(1, len(self.postings))

    def _possible(self, query: np.ndarray, other: np.ndarray, k: int, bar: int | None) -> tuple[np.ndarray, int]:
        """Rows that might be among the k best, with the number of postings processed."""
        n, used = len(self.ids), np.flatnonzero(query)
        weight = np.zeros(self.vectors.shape[1], np.float64)
        weight[: len(query)] = query
        # The most that a segment contributes, above the dimension's least segment.
        w = weight[self.dimension]
        most = np.where(w > 0, w * self.tops, w * self.lows)
        least = np.full(len(weight), np.inf)
        np.minimum.at(least, self.dimension, most)
        gain = most - least[self.dimension]
        base = float(least[used].sum())
        segments = np.flatnonzero(w != 0)
        segments = segments[np.argsort(-gain[segments], kind="stable")]
        ends = np.cumsum(self.sizes[segments])
        total = int(ends[-1]) if len(ends) else 0
        reached, few, at = np.zeros(n), max(4 * k, n // 32), 0
        seen = np.zeros(n)
        first = np.searchsorted(self.dimension, np.arange(len(weight) + 1))
        done = np.zeros(len(weight), np.int64)
        possible = np.flatnonzero(other)
        for look in LOOKS if total else ():
            to = min(int(np.searchsorted(ends, look * total)) + 1, len(segments))
            # By falling contribution, a dimension's segments go from its largest impact down, or from its smallest up.
            after = np.bincount(self.dimension[segments[:to]], minlength=len(weight))
            lo, hi = np.where(weight > 0, (first[:-1] + done, first[:-1] + after), (first[1:] - after, first[1:] - done))
            moved = np.flatnonzero(lo < hi)
            done, at = after, to
            if len(moved):
                rows = np.concatenate([self.postings[b:e] for b, e in zip(self.begins[lo[moved]].tolist(), self.begins[hi[moved]].tolist(), strict=True)])
                now = np.concatenate([np.arange(b, e) for b, e in zip(lo[moved].tolist(), hi[moved].tolist(), strict=True)])
                reached += np.bincount(rows, np.repeat(gain[now], self.sizes[now]), n)
                seen += np.bincount(rows, minlength=n)
            following = gain[segments[at]] if at < len(segments) else 0.0
            bound = base + reached + (len(used) - seen) * following
            if len(possible) > k:  # the most promising ones raise the bar
                lead = possible[np.argpartition(-bound[possible], k - 1)[:k]]
                own = int(self._exact(query, lead, True).min())
                bar = own if bar is None else max(bar, own)
            if bar is not None:
                possible = possible[bound[possible] >= bar]
            if len(possible) <= few or at == len(segments):
                break
        return possible, int(ends[at - 1]) if at else 0


def _shards(levels: int):
    """Rows come sorted by part; each part is packed into one row of the index."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, _, vectors in _groups(batches):
            s = Shard.build(ids, vectors, levels)
            values = [part, len(ids), vectors.shape[1], *(x.tobytes() for x in (ids, vectors, s.postings, s.begins, s.tops, s.lows))]
            types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["part", "n", "width", "ids", "vectors", "postings", "begins", "tops", "lows"])

    return work


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, ids, copies, vectors in _groups(batches):
        values = [part, len(ids), vectors.shape[1], ids.tobytes(), copies.tobytes(), vectors.tobytes()]
        types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["part", "n", "width", "ids", "copies", "vectors"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """part, ids, copies and vectors of each part of rows (part, id, copy, v) that come sorted by part."""
    held: list[pa.RecordBatch] = []

    def out(rows: list[pa.RecordBatch]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        whole = pa.Table.from_batches(rows).combine_chunks()
        ids, copies = (whole.column(c).to_numpy().astype(np.int64) for c in ("id", "copy"))
        return whole.column("part")[0].as_py(), ids, copies, matrix(whole.column("v").combine_chunks())

    for batch in batches:
        while batch.num_rows:
            parts = batch.column("part").to_numpy()
            if held and held[-1].column("part")[0].as_py() != parts[0]:
                yield out(held)
                held = []
            to = int(np.searchsorted(parts, parts[0], side="right"))
            held.append(batch.slice(0, to))
            batch = batch.slice(to)
    if held:
        yield out(held)


def _meet(k: int):
    """Rows come sorted by part, in each the shard (kind 0) before the blocks of queries (kind 1)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = None, None
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                vectors = np.frombuffer(row["vectors"], np.int64).reshape(row["n"], row["width"])
                if row["kind"] == 0:
                    rest = (np.frombuffer(row[c], kind) for c, kind in (("postings", np.int32), ("begins", np.int64), ("tops", np.int64), ("lows", np.int64)))
                    shard, at = Shard(ids, vectors, *rest), row["part"]
                    continue
                if at != row["part"]:
                    continue
                copies = np.frombuffer(row["copies"], np.int64)
                bars = np.frombuffer(row["bars"], np.int64) if row["bars"] else None
                known = np.frombuffer(row["known"], bool) if row["known"] else None
                out: list[tuple] = []
                for i, query in enumerate(vectors):
                    found, scores, share = shard.search(query, int(ids[i]), k, int(bars[i]) if bars is not None and known[i] else None)
                    out += [(int(ids[i]), int(copies[i]), int(v), int(s), share) for v, s in zip(found, scores, strict=True)]
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                types = [*[pa.int64()] * 4, pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query_id", "copy", "vec_id", "score", "share"])

    return work


def _with_bars(k: int):
    """Blocks with what their first shard gave (rows of query_id, copy and score, a list): bars, and which queries have one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bars, known = [], []
            for row in batch.select(["ids", "copies", "bar"]).to_pylist():
                bar = {(x["query_id"], x["copy"]): x["score"] for x in row["bar"] or ()}
                keys = list(zip(np.frombuffer(row["ids"], np.int64).tolist(), np.frombuffer(row["copies"], np.int64).tolist(), strict=True))
                bars.append(np.array([bar.get(x, 0) for x in keys], np.int64).tobytes())
                known.append(np.array([x in bar for x in keys], bool).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "n", "width", "ids", "copies", "vectors")), pa.array(bars, pa.binary()), pa.array(known, pa.binary())], names=["part", "n", "width", "ids", "copies", "vectors", "bars", "known"])

    return work


def build_index(vectors: DataFrame, scale: int = 256, id_column: str = "vec_id", column: str = "embedding", shard_size: int = 4096, levels: int = 64) -> DataFrame:
    """The written index of all usable vectors, one row for each shard of about shard_size vectors. Empty if there are none."""
    rows = floored(vectors, scale, id_column, column)
    shards = max(1, -(-rows.count() // shard_size))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("part"), "id", F.lit(0).cast("long").alias("copy"), "v")
    packed = dealt.repartition("part").sortWithinPartitions("part", "id").mapInArrow(_shards(levels), INDEX)
    return materialized(packed, "impacts")


def _query_blocks(queries: DataFrame, scale: int, id_column: str, column: str, block: int) -> tuple[DataFrame, int]:
    rows = floored(queries, scale, id_column, column)
    rows = rows.select("id", F.xxhash64("v").alias("copy"), "v").dropDuplicates(["id", "copy"])
    blocks = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    return materialized(dealt.repartition("part").sortWithinPartitions("part", "id", "copy").mapInArrow(_blocks, BLOCK), "blocks"), blocks


def search(index: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_column: str = "vec_id", column: str = "embedding", block: int = 256) -> DataFrame:
    """The k highest inner products of every query with the vectors of an index: query_id, rank, vec_id, score.

    scale must be the index's own. Rows with the query's id aren't its candidates.
    """
    asked, _ = _query_blocks(queries, scale, id_column, column, block)
    shards = index.agg(F.coalesce(F.max("part") + 1, F.lit(1))).first()[0]
    of_index = index.select("part", F.lit(0).alias("kind"), "n", "width", "ids", "vectors", "postings", "begins", "tops", "lows", *(F.lit(None).cast("binary").alias(c) for c in ("copies", "bars", "known")))
    none = [F.lit(None).cast("binary").alias(c) for c in ("postings", "begins", "tops", "lows")]
    kind = "query_id long, copy long, vec_id long, score long, share double"

    def met(blocks: DataFrame) -> DataFrame:
        rows = of_index.unionByName(blocks.select("part", F.lit(1).alias("kind"), "n", "width", "ids", "vectors", *none, "copies", "bars", "known"))
        return rows.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_meet(k), kind)

    first = F.pmod("part", F.lit(shards))
    unknown = [F.lit(None).cast("binary").alias(c) for c in ("bars", "known")]
    pilot = materialized(met(asked.select(first.alias("part"), "n", "width", "ids", "copies", "vectors", *unknown)), "pilot")
    place = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    # A query's k-th best so far; a block has few queries, so its bars are one short list.
    bars = pilot.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") == k)
    blocks = asked.agg(F.coalesce(F.max("part") + 1, F.lit(1))).first()[0]
    bars = bars.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("part")).agg(F.collect_list(F.struct("query_id", "copy", "score")).alias("bar"))
    armed = asked.join(bars, "part", "left").mapInArrow(_with_bars(k), BLOCK + ", bars binary, known binary")
    armed = materialized(armed, "armed")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("to")
    # Every block of the stated queries against every other shard; a row is a whole block or a whole shard.
    rest = armed.select("*", every).filter(F.col("to") != first).select(F.col("to").alias("part"), "n", "width", "ids", "copies", "vectors", "bars", "known")
    found = pilot.unionByName(met(rest)) if shards > 1 else pilot
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
