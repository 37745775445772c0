"""Incremental removal of repeated word windows with a log-structured fingerprint index.

Words under a window of `window` words that starts earlier, in a smaller doc_id or further up in the same text, are removed. The index
is a list of immutable runs: tables bucketed and sorted by fingerprint, one file a bucket. A batch of documents is fingerprinted, rows that
repeat as a whole become one, these are merge-joined with each run on the fingerprint (the run isn't moved), matches are verified (see below), and they become another
run; when there are more than `most_runs`, all are merged into one by a merge join, for which they are shuffled.

A fingerprint is the hash of the smallest gram of a window (textual.anchors); a row stands for the neighbouring
windows that one gram represents and holds a hash of all words under them (64 bits), and another, independent one (64 bits) by which a match is verified. Rows that
agree in all three repeat as a whole, and only the first of each is looked at further, so a passage may have any number of copies. First rows that agree in
the gram alone are verified window by window, on words read again. Inside one gram the 128 bits of the two hashes tell surroundings apart: n of them
give about n * n / 2**129 false agreements. Neighbouring rows that agree in all three (a text that says one thing over and over) are one row.

Defined results: a null or empty text has no words; texts shorter than a window keep all; rows with one doc_id and text count as the same place, so
neither is earlier; those with one doc_id and other texts are ordered by a hash of the text; null doc_ids come first; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.textual import Words, anchors, merged_spans, mix, prefix, run, signed, slices, text_buffers
from loomstone.session import drop_scratch, materialized, scratch_path

FIRST = -(1 << 63)


def _checked(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of words for hashes independent of the fingerprints."""
    return prefix(mix(words.value ^ np.uint64(0xD6E8FEB86659FD93)))


def _fingerprints(window: int, gram: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(*text_buffers(batch.column("text")))
            key, context, lo, _, count = anchors(words.value, np.repeat(words.first[1:], np.diff(words.first)), gram, window)
            row = words.row[lo]
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (context[1:] == context[:-1]) & (row[1:] == row[:-1]) & (lo[1:] == lo[:-1] + count[:-1])
            first = np.flatnonzero(~again)
            repeats = np.diff(np.append(first, len(key)))
            key, context, row, lo, count = (x[first] for x in (key, context, row, lo, count))
            check = signed(run(_checked(words), lo, lo + count - 1 + window))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(context), pa.array(check), batch.column("rid").take(take), batch.column("tag").take(take), pa.array((lo - words.first[row]).astype(np.int32)), pa.array(count.astype(np.int16)), pa.array(repeats.astype(np.int32))],
                names=["key", "context", "check", "rid", "tag", "lo", "count", "repeats"],
            )

    return work


_KIND = "key long, context long, check long, rid long, tag int, lo int, count short, repeats int"
#: What rows that repeat as a whole agree in.
_SAME = ["key", "context", "check"]


def _verified_windows(window: int):
    """A hash of the words of each window that is to be verified."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, wanted = Words(*text_buffers(batch.column("text"))), batch.column("wanted")
            each = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
            flat = wanted.flatten()
            lo, count = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("lo", "count"))
            of = np.repeat(np.arange(len(count)), count)
            start = lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            row = each[of]
            begin = words.first[row] + start
            hashes = run(_checked(words), begin, begin + window)
            take, rows = pa.array(of), pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [flat.field("key").take(take), pa.array(signed(hashes)), batch.column("rid").take(rows), batch.column("tag").take(rows), pa.array(start.astype(np.int32)), flat.field("fresh").take(take)], names=["key", "hash", "rid", "tag", "start", "fresh"]
            )

    return work


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, offsets = text_buffers(batch.column("text"))
        raw, total, removed, kept = data.tobytes(), [], [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            words = raw[offsets[i] : offsets[i + 1]].split()
            total.append(len(words))
            if spans:
                at, parts = 0, []
                for s, e in merged_spans([(x["s"], x["e"]) for x in spans], len(words)):
                    parts += words[at:s]
                    at = e
                words = parts + words[at:]
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"], F.coalesce(docs["doc_id"].cast("long"), F.lit(FIRST)).alias("rid"), F.hash(docs["text"]).alias("tag"), docs["text"])


class FingerprintIndex:
    """The runs of all documents taken in so far."""

    def __init__(self, spark: SparkSession, window: int = 20, gram: int = 4, most_runs: int = 4, buckets: int | None = None):
        self.spark, self.window, self.gram, self.most_runs = spark, window, gram, most_runs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[str, DataFrame]] = []

    def _write(self, rows: DataFrame) -> None:
        name = f"loomstone_run_{uuid.uuid4().hex}"
        # One file for each bucket: dealt otherwise, every task would write a file for nearly every bucket.
        rows.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy(*_SAME).option("path", scratch_path(self.spark, "run")).saveAsTable(name)
        self.runs.append((name, self.spark.table(name)))

    def compact(self) -> None:
        """Merge all runs into one by a merge join of what they hold; its rows are dealt out by fingerprint again, one file a bucket."""
        if len(self.runs) < 2:
            return
        old = self.runs
        merged = old[0][1]
        for _, other in old[1:]:
            one, two = (F.struct(*(F.col(f"{x}.{c}") for c in ("rid", "tag", "lo", "count"))) for x in "ab")
            first = F.least(F.when(F.col("a.key").isNotNull(), one), F.when(F.col("b.key").isNotNull(), two))
            merged = merged.alias("a").join(other.alias("b"), F.expr(" and ".join(f"a.{c} = b.{c}" for c in _SAME)), "full_outer")
            merged = merged.select(*(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in _SAME), first.alias("first")).select(*_SAME, "first.*")
        self.runs = []
        self._write(merged)
        for name, table in old:
            drop_scratch(table)
            self.spark.sql(f"drop table {name}")

    def take_in(self, batch: DataFrame, source: DataFrame, remember: bool = True) -> DataFrame:
        """Spans of words (rid, tag, s, e) of the batch that occur earlier; source has the texts of this and all earlier batches."""
        if len(self.runs) > self.most_runs:
            self.compact()
        texts = _texts(batch)
        rows = materialized(texts.select("rid", "tag", "text").mapInArrow(_fingerprints(self.window, self.gram), _KIND), "fingerprints")
        first = F.min(F.struct("rid", "tag", "lo", "count", F.lit(True).alias("fresh"))).alias("first")
        fresh = firsts = materialized(rows.groupBy(*_SAME).agg(first, F.count("*").alias("n")), "fresh")
        if self.runs:
            keys = fresh.select("key").distinct()
            for _, past in self.runs:
                before = F.struct("rid", "tag", "lo", "count", F.lit(False).alias("fresh")).alias("first")
                firsts = firsts.unionByName(past.join(keys, "key", "left_semi").select(*_SAME, before, F.lit(1).cast("long").alias("n")))
            firsts = materialized(firsts.groupBy(*_SAME).agg(F.min("first").alias("first"), F.sum("n").alias("n")), "firsts")
        later = rows.join(firsts.filter("n > 1").select(*_SAME, "first"), _SAME).filter(F.struct("rid", "tag", "lo") > F.struct("first.rid", "first.tag", "first.lo"))
        until = (F.col("lo") + F.col("repeats") * F.col("count") - 1 + self.window).alias("e")
        whole = later.select("rid", "tag", F.col("lo").alias("s"), until)
        # Of rows that repeat themselves all but the first occurs earlier in any case.
        whole = whole.unionByName(rows.filter("repeats > 1").select("rid", "tag", (F.col("lo") + F.col("count")).alias("s"), until))
        mixed = firsts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
        wanted = firsts.join(mixed, "key").select("key", "first.*").groupBy("rid", "tag").agg(F.collect_list(F.struct("key", "lo", "count", "fresh")).alias("wanted"))
        windows = _texts(source).select("rid", "tag", "text").join(wanted, ["rid", "tag"]).mapInArrow(_verified_windows(self.window), "key long, hash long, rid long, tag int, start int, fresh boolean")
        windows = materialized(windows, "windows")
        first = windows.groupBy("key", "hash").agg(F.count("*").alias("n"), F.min(F.struct("rid", "tag", "start")).alias("first")).filter("n > 1").select("key", "hash", "first")
        single = windows.filter("fresh").join(first, ["key", "hash"]).filter(F.struct("rid", "tag", "start") > F.col("first"))
        single = single.select("rid", "tag", F.col("start").alias("s"), (F.col("start") + self.window).alias("e"))
        spans = materialized(whole.unionByName(single).groupBy("rid", "tag").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
        if remember:
            self._write(fresh.select(*_SAME, "first.*").drop("fresh"))
        for table in (rows, fresh, firsts, windows):
            drop_scratch(table)
        return spans


def remove_seen_words(docs: DataFrame, batches: int = 3, window: int = 20, gram: int = 4, most_runs: int = 1) -> DataFrame:
    """Take docs in by ranges of doc_id: doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark, window, gram, most_runs)
    steps = [(k + 1) / batches for k in range(batches - 1)]
    cuts = sorted(set(docs.agg(F.percentile_approx(docs["doc_id"].cast("long"), F.array(*map(F.lit, steps)), 10_000)).first()[0] or [])) if steps else []
    spans, low = None, None
    for high in [*cuts, None]:
        ids = docs["doc_id"].cast("long")
        upto = F.lit(True) if high is None else F.coalesce(ids, F.lit(FIRST)) <= high
        above = F.lit(True) if low is None else ids > low
        found = index.take_in(docs.filter(upto & above), docs.filter(upto), remember=high is not None)
        spans = found if spans is None else spans.unionByName(found)
        low = high
    own = _texts(docs)
    return own.join(spans, ["rid", "tag"], "left").select("doc_id", "text", "spans").mapInArrow(_kept, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string")
