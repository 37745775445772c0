"""Exact removal of repeated byte strings, with suffixes ordered by bucket-pointer refinement.

Every byte under a string of `length` bytes that also starts elsewhere is removed. All suffixes of a corpus
don't fit a shuffle, so Spark first brings together only suffixes that can agree: each window of `length` bytes is represented by its
smallest `gram` (see textual.anchors), equal windows by equal grams at equal distances. A run of windows with one gram is one
row of some thirty bytes, and neighbouring runs that say the same (a text that repeats one word) are one row together; grams that occur once are
done with. Where all bytes around a gram agree as well (by 128 bits of hash, so with a chance of error that no corpus reaches), all its windows
repeat, and rows meet as counts that Spark combines before it shuffles, however many copies there are. Only for
one copy each of differing surroundings the bytes are fetched, and their suffixes are refined in the tasks (see refine): buckets of
8-byte prefixes are sorted by the bucket pointers of later offsets, which are updated at once and used again for what follows. A gram with more than
`most` differing surroundings is split by whole windows in Spark instead, with the same result.

Defined results: a null text is empty; rows with equal doc_id and text are separate documents (so they repeat each
other); texts shorter than `length` keep all bytes; an empty table gives no rows; other columns never take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomstone.llm.textual import anchors, merged_spans, slices, text_buffers
from loomstone.session import materialized

#: Bytes of surroundings that a task refines together, unless one gram has more; refining takes about fifty times that memory.
TOGETHER = 500_000
#: Blocks of buckets that are refined one after the other.
BLOCKS = 4


def refine(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Starts of all strings of length bytes that occur at least twice, by bucket-pointer refinement.

    ends[p] is where the text of byte p ends; strings lie inside one text. rank[p] points at the bucket of suffix p, in suffix order, and deep
    says how many bytes its suffixes agree in. Buckets are refined in blocks, each to the end before the next one: a bucket is
    sorted by the pointers that stand as many bytes later as it agrees in, and what comes of that is written to rank at once, so that the rest of the
    block, its own next round and all later blocks sort by the finer pointers.
    """
    size, q = len(data), 8
    if size < length:
        return np.zeros(0, np.int64)
    # Memory is what bounds a task here: places are as small as size allows, and what is done with goes.
    place = np.int32 if size + length < 1 << 31 else np.int64
    padded = np.append(data, np.zeros(length + q, np.uint8))
    head = np.zeros(size + length, np.uint64)
    for k in range(q):
        head <<= np.uint64(8)
        head |= padded[k : size + length + k]
    del padded
    order = np.argsort(head[:size]).astype(place)
    new = np.ones(size, bool)
    ordered = head[order]
    new[1:] = ordered[1:] != ordered[:-1]
    del ordered
    first = np.flatnonzero(new).astype(place)
    many = np.diff(np.append(first, place(size)))
    start = np.repeat(first, many)
    rank = np.full(size + length, -1, place)  # beyond the end: before all others
    rank[order] = start
    deep = np.full(size, q, place)
    several = np.repeat(many > 1, many)
    waiting = order[several]
    # Blocks of whole buckets.
    cut = np.flatnonzero(np.diff(start[several] // max(1, size // BLOCKS))) + 1
    del order, new, first, many, start, several
    for members in np.split(waiting, cut):
        while len(members):
            own = rank[members]
            later = rank[members + np.minimum(deep[own], length)]
            by = own.astype(np.int64)
            by *= size + 1
            by += later
            by = np.argsort(by)
            members, own, later = members[by], own[by], later[by]
            del by
            bucket = np.append(True, own[1:] != own[:-1])
            part = bucket | np.append(True, later[1:] != later[:-1])
            at = np.arange(len(members), dtype=place)
            begin = np.flatnonzero(part).astype(place)
            count = np.diff(np.append(begin, place(len(members))))
            now = own[begin] + begin - np.maximum.accumulate(np.where(bucket, at, place(0)))[begin]
            until = np.minimum(deep[own[begin]] + np.where(later[begin] >= 0, deep[later[begin]], place(length)), length)
            deep[now] = until
            rank[members] = np.repeat(now, count)
            members = members[np.repeat((count > 1) & (until < length), count)]
    del waiting, members, deep
    # In suffix order, strings that are equal are neighbours; pointers may tell them apart by bytes beyond them, so the bytes decide.
    starts = np.flatnonzero(np.arange(length, size + length, dtype=place) <= ends).astype(place)
    starts = starts[np.argsort(rank[starts])]
    same = rank[starts[1:]] == rank[starts[:-1]]
    open_ = np.flatnonzero(~same)
    for offset in [*range(0, length - q, q), length - q]:
        open_ = open_[head[starts[open_] + offset] == head[starts[open_ + 1] + offset]]
    same[open_] = True
    twice = np.zeros(len(starts), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return np.sort(starts[twice])


def _anchor_rows(length: int, gram: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomstone.llm.textual import BYTE_VALUE

        for batch in slices(batches):
            data, offsets = text_buffers(batch.column("text"))
            ends = np.repeat(offsets[1:], np.diff(offsets))
            key, context, lo, _, count = anchors(BYTE_VALUE[data], ends, gram, length)
            row = np.searchsorted(offsets, lo, side="right") - 1
            # Neighbours that agree in gram and surroundings repeat each other; a text that says one thing over and over is one row.
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (context[1:] == context[:-1]) & (row[1:] == row[:-1]) & (lo[1:] == lo[:-1] + count[:-1])
            first = np.flatnonzero(~again)
            repeats = np.diff(np.append(first, len(key)))
            key, context, row, lo, count = (x[first] for x in (key, context, row, lo, count))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(context), batch.column("rid").take(take), batch.column("tag").take(take), pa.array(lo - offsets[row]), pa.array(count.astype(np.int32)), pa.array(repeats)],
                names=["key", "context", "rid", "tag", "lo", "count", "repeats"],
            )

    return work


def _fetch(length: int):
    """The bytes around the grams wanted from each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_buffers(batch.column("text"))
            raw, wanted = data.tobytes(), batch.column("wanted")
            row = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
            flat = wanted.flatten()
            lo, count = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("lo", "count"))
            begin = offsets[row] + lo
            end = begin + count - 1 + length
            take = pa.array(row)
            around = pa.array([raw[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [flat.field("key"), batch.column("rid").take(take), batch.column("tag").take(take), flat.field("lo"), flat.field("count"), flat.field("copies"), around],
                names=["key", "rid", "tag", "lo", "count", "copies", "around"],
            )

    return work


def _refine_groups(length: int):
    """Rows come sorted by key; whole groups are refined together. Returns repeated spans of texts that are alone with their surroundings."""

    def repeated(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(rows).combine_chunks()
        around = table.column("around").combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(around.buffers()[1], np.int64)[around.offset : around.offset + len(around) + 1]
        data, offsets = np.frombuffer(around.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
        starts = refine(data, np.repeat(offsets[1:].astype(np.int32) if len(data) < 1 << 31 else offsets[1:], np.diff(offsets)), length)
        if not len(starts):
            return None
        row = np.searchsorted(offsets, starts, side="right") - 1
        new = np.ones(len(starts), bool)
        new[1:] = (starts[1:] != starts[:-1] + 1) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(starts)) - 1
        row = row[begin]
        alone = table.column("copies").to_numpy()[row] == 1
        row, begin, last = row[alone], begin[alone], last[alone]
        lo = table.column("lo").to_numpy()[row]
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [table.column("rid").take(take).combine_chunks(), table.column("tag").take(take).combine_chunks(), pa.array(lo + starts[begin] - offsets[row]), pa.array(lo + starts[last] - offsets[row] + length)],
            names=["rid", "tag", "s", "e"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in slices(batches, "around", TOGETHER):
            if held and size + batch.column("around").nbytes > TOGETHER:
                split = int(np.searchsorted(batch.column("key").to_numpy(), held[-1].column("key")[-1].as_py(), side="right"))
                if split < batch.num_rows:
                    if split:
                        held.append(batch.slice(0, split))
                    if (found := repeated(held)) is not None:
                        yield found
                    held, size, batch = [], 0, batch.slice(split)
            held.append(batch)
            size += batch.column("around").nbytes
        if held and (found := repeated(held)) is not None:
            yield found

    return work


def _spans_of(spans: pa.Array) -> list[list[tuple[int, int]]]:
    return [[(x["s"], x["e"]) for x in row] if row else [] for row in spans.to_pylist()]


def _whole(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without bytes of characters that reach beyond them."""
    inner = []
    for s, e in spans:
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        inner.append((s, e))
    return [x for x in inner if x[0] < x[1]]


def _removed(batches: Iterator[pa.RecordBatch], whole_characters: bool) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in slices(batches):
        data, offsets = text_buffers(batch.column("text"))
        raw, kept, spans = data.tobytes(), [], []
        for i, found in enumerate(_spans_of(batch.column("spans"))):
            text = raw[offsets[i] : offsets[i + 1]]
            found = merged_spans(found, len(text))
            found = _whole(text, found) if whole_characters else found
            at, parts = 0, []
            for s, e in found:
                parts.append(text[at:s])
                at = e
            parts.append(text[at:])
            kept.append(b"".join(parts))
            spans.append([{"start": s, "end": e} for s, e in found])
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.diff(offsets)), pa.array(kept, pa.binary()), pa.array(spans, kind)], names=["row", "n_bytes", "kept", "spans"])


def _repeated_spans(texts: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """Spans of bytes to remove (rid, tag, spans) of texts (rid, tag, text)."""
    kind = "key long, context long, rid long, tag int, lo long, count int, repeats long"
    rows = materialized(texts.mapInArrow(_anchor_rows(length, gram), kind), "anchors")
    # Grams that occur once represent windows that occur once.
    often = rows.groupBy("key").agg(F.sum("repeats").alias("n")).filter("n > 1").select("key")
    found = materialized(rows.join(often, "key"), "repeated")
    same = found.groupBy("key", "context").agg(F.sum("repeats").alias("copies"), F.min(F.struct("rid", "tag", "lo", "count")).alias("one"))
    same = materialized(same, "surroundings")
    copies = found.filter("repeats = 1").join(same.filter("copies > 1").select("key", "context"), ["key", "context"], "left_semi").unionByName(found.filter("repeats > 1"))
    whole = copies.select("rid", "tag", F.col("lo").alias("s"), (F.col("lo") + F.col("repeats") * F.col("count") - 1 + length).alias("e"))
    differing = same.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    wanted = same.join(differing, "key").select("key", "copies", "one.*", "n")
    by_text = wanted.groupBy("rid", "tag").agg(F.collect_list(F.struct("key", "copies", "lo", "count")).alias("wanted"))
    around = texts.join(by_text, ["rid", "tag"]).mapInArrow(_fetch(length), "key long, rid long, tag int, lo long, count int, copies long, around binary")
    around = materialized(around.dropDuplicates(["key", "rid", "tag", "lo"]), "around")
    huge = differing.filter(F.col("n") > most).select("key")
    few = around.join(huge, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    refined = few.mapInArrow(_refine_groups(length), "rid long, tag int, s long, e long")
    windows = around.join(huge, "key").select("*", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("at"))
    windows = windows.withColumn("string", F.md5(F.expr(f"substring(around, at + 1, {length})")))
    twice = windows.groupBy("key", "string").agg(F.count("*").alias("n")).filter("n > 1").select("key", "string")
    split = windows.filter("copies = 1").join(twice, ["key", "string"]).select("rid", "tag", (F.col("lo") + F.col("at")).alias("s"), (F.col("lo") + F.col("at") + length).alias("e"))
    return whole.unionByName(refined).unionByName(split).groupBy("rid", "tag").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _cut(docs: DataFrame, row: Column, length: int, gram: int, most: int, whole_characters: bool) -> DataFrame:
    """row (a struct, whatever the columns' names), n_bytes, kept and spans of each document."""
    own = docs.select(row.alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("rid"), F.hash(docs["text"]).alias("tag"), docs["text"].alias("text"))
    spans = _repeated_spans(own.select("rid", "tag", "text"), length, gram, most)
    wide = own.join(spans, ["rid", "tag"], "left").select("row", "text", "spans")
    kind = StructType([wide.schema["row"], *StructType.fromDDL("n_bytes long, kept binary, spans array<struct<start:long,end:long>>").fields])
    return wide.mapInArrow(lambda batches: _removed(batches, whole_characters), kind)


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 32, most: int = 8192, whole_characters: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, kept (the bytes left), spans (removed bytes, maximal and in order).

    With whole_characters, bytes of characters that a span cuts are kept, so that what is left is valid text.
    """
    out = _cut(docs, F.struct(docs["doc_id"].alias("doc_id")), length, gram, most, whole_characters)
    return out.select("row.doc_id", "n_bytes", "kept", "spans")


def without_repeats(docs: DataFrame, length: int = 200, gram: int = 32, most: int = 8192) -> DataFrame:
    """docs with their columns as they are, but for text, from which repeats are gone, and n_chars, if there is one. A null text stays null."""
    others = [c for c in docs.columns if c != "text"]
    out = _cut(docs, F.struct(docs["text"].isNull().alias("text"), *(docs[c].alias(c) for c in others)), length, gram, most, True)
    text = F.when(~F.col("row.text"), F.col("kept").cast("string"))
    counted = {"text": text, "n_chars": F.length(F.col("kept").cast("string")).cast("long")}
    return out.select(*(counted[c].alias(c) if c in counted else F.col("row").getField(c).alias(c) for c in docs.columns))
