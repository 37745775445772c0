"""Benchmark decontamination by canonical templates.

Numbers, units and names are replaced by typed placeholders, so a question re-asked with other values has the
same template. Windows of `width` template words of every document are hash-joined with those of the benchmark items. Matches on one
alignment of a document with an item are kept where their slots are consistent: each value of the item stands for
one value of the document and the other way round; of values that contradict each other the most frequent pairs count, and only windows with others are
dropped. A document is contaminated by an item of whose windows, or of whose words under windows, it has at least `share`, or that it agrees with in `run_words`
words in a row.

A capitalised word that begins a text, line or sentence may be a name or not: windows are hashed in both readings. Windows with less than
half literal words say too little as templates; they match where all their words are equal.

Only windows that occur in the benchmark leave a document's task: the hashes of its windows, if at most `most_windows` of them,
are sent to the tasks; of a larger benchmark none are, and the join sorts out the rest, with the same result.

Defined results: null and empty texts match nothing; an item of fewer than `width` words is one window as a whole, and one of fewer than `least_words`
words, which any text may hold by chance, is found only in documents that say nothing else; windows with less than half literal
words count among an item's windows only where it has no others; repeated items count each; repeated rows are judged each; a null doc_id is kept as null.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.textual import BYTE_VALUE, IS_SPACE, LOWER, Words, _run, mix, prefix, run, signed, slices, text_buffers
from loomstone.session import materialized

#: Words that are units after a number (fixed values).
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l gal s sec min h hr ms day days week weeks month months year years hour hours minute minutes second seconds "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles gram grams kilogram kilograms liter liters litre litres "
    "dollar dollars euro euros cent cents percent usd eur gbp tag tage stunde stunden jahr jahre meile meilen heure heures jour jours an ans hora horas dia dias"
).split()
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))
_CORE = np.zeros(256, bool)
_CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[list(b".!?:;\n\"")] = True


def _hash_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total, down = prefix(BYTE_VALUE[data])
    return mix(_run(total, down, begin, end) + (end - begin).astype(np.uint64))


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    end = np.cumsum([len(u) + 1 for u in UNITS]) - 1
    return np.sort(_hash_words(data, end - [len(u) for u in UNITS], end))


@lru_cache(maxsize=1)
def _capitals() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c)) in ("Lu", "Lt") for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _heads(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a word begins with a capital letter of any script, and the bytes of its first character."""
    byte = [data[np.minimum(begin + k, len(data) - 1)].astype(np.int64) for k in range(4)]
    low = [b & 0x3F for b in byte]
    size = np.select([byte[0] < 0x80, byte[0] < 0xE0, byte[0] < 0xF0], [1, 2, 3], 4)
    two = (byte[0] & 0x1F) << 6 | low[1]
    three = (byte[0] & 0x0F) << 12 | low[1] << 6 | low[2]
    four = (byte[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3]
    code = np.select([size == 1, size == 2, size == 3], [byte[0], two, three], four)
    return _capitals()[np.minimum(code, sys.maxunicode)], size


def templates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template words of each text: symbol, value (the hash of what stands there), is a slot, where each text's begin, and may be a name (begins a sentence)."""
    words = Words(data, offsets)
    if not len(words):
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, bool), words.first, np.zeros(0, bool)
    core = _CORE[data]
    at = np.arange(len(data))
    after = np.minimum.accumulate(np.where(core, at, len(data))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(core, at, -1))
    begin, end = after[words.begin], before[words.end - 1] + 1
    real = begin < words.end
    row, raw_begin, raw_end, begin, end = (x[real] for x in (words.row, words.begin, words.end, begin, end))
    first = np.searchsorted(row, np.arange(len(offsets)))
    if not len(row):
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, bool), first, np.zeros(0, bool)
    lowered = LOWER[data]
    value = _hash_words(lowered, begin, end)
    head = data[begin]
    number = (head >= 48) & (head < 58)
    capital, character = _heads(data, begin)
    capital &= end - begin > character
    start = np.ones(len(row), bool)  # of a sentence
    lines = np.append(0, np.cumsum(data == 10))
    start[1:] = (row[1:] != row[:-1]) | _END[data[raw_end[:-1] - 1]] | (lines[raw_begin[1:]] != lines[raw_end[:-1]])
    name = capital & ~start
    unit = np.zeros(len(row), bool)
    unit[1:] = number[:-1] & (row[1:] == row[:-1])
    unit[unit] = np.isin(value[unit], _unit_hashes())
    symbol = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    return symbol, value, number | unit | name, first, capital & start & ~unit


def _windows(symbol, value, slot, maybe, first, width: int, whole: bool):
    """For each reading: starts, rows, hashes, slots and whether words must be equal, of windows of width words; of whole texts of that many words only, if whole."""
    count = np.diff(first)
    have = np.where(count == width, 1, 0) if whole else np.maximum(count - width + 1, 0)
    row = np.repeat(np.arange(len(count)), have)
    begin = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(have) - have, have)
    inside = lambda x: (sums := np.append(0, np.cumsum(x)))[begin + width] - sums[begin]
    either, open_ = slot | maybe, inside(maybe) > 0
    heavy, heavier = 2 * inside(slot) > width, 2 * inside(either) > width
    readings = [(symbol, slot, ~heavy, False), (np.where(maybe, NAME, symbol), either, open_ & ~heavier, False), (value, np.zeros(len(slot), bool), heavier, True)]
    for symbols, slots, take, exact in readings:
        yield begin[take], row[take], run(prefix(symbols), begin[take], begin[take] + width), slots, exact


def _rows(width: int, whole_lengths: list[int], whole: bool, wanted: np.ndarray | None, least: int):
    """Windows as rows: the text's number, the window's hash, its place, the values in its slots, and whether its words must be equal."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_buffers(batch.column("text"))
            symbol, value, slot, first, maybe = templates(data, offsets)
            for size in [width, *whole_lengths]:
                for begin, row, hashes, slot_here, exact in _windows(symbol, value, slot, maybe, first, size, (whole or size < least) and size != width):
                    hashes = signed(hashes)
                    if wanted is not None:
                        at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                        hit = wanted[at] == hashes
                        begin, row, hashes = begin[hit], row[hit], hashes[hit]
                    if not len(begin):
                        continue
                    slots = np.append(0, np.cumsum(slot_here))
                    lo, hi = slots[begin], slots[begin + size]
                    inside = np.repeat(lo - np.append(0, np.cumsum(hi - lo))[:-1], hi - lo) + np.arange((hi - lo).sum())
                    values = signed(value[slot_here])[inside]
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id").take(take), batch.column("tag").take(take), pa.array(hashes), pa.array((begin - first[row]).astype(np.int64)),
                            pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(hi - lo)).astype(np.int32)), pa.array(values)), pa.array(np.full(len(begin), exact)),
                        ],
                        names=["id", "tag", "hash", "place", "slots", "exact"],
                    )

    return work


_KIND = "id long, tag int, hash long, place long, slots array<long>, exact boolean"


def _lengths(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            count = np.diff(templates(*text_buffers(batch.column("text")))[3])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(count[(count > 0) & (count < width)]).astype(np.int64))], names=["length"])

    return work


def _covered(places, width: int):
    """Words under windows at sorted places (of whole shorter items, one window counts as width words)."""
    return F.aggregate(places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).cast("long").alias("last")), lambda s, p: F.struct((s.n + F.least(p - s.last, F.lit(width).cast("long"))).alias("n"), p.alias("last")), lambda s: s.n)


def _longest(places):
    """The most windows in a row at sorted places."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("best"), zero.alias("now"), F.lit(-9).cast("long").alias("last"))

    def step(s, p):
        now = F.when(p == s.last + 1, s.now + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(F.greatest(s.best, now).alias("best"), now.alias("now"), p.alias("last"))

    return F.aggregate(places, start, step, lambda s: s.best)


def _consistent(hits: DataFrame) -> DataFrame:
    """The windows of each alignment whose slots agree with the most frequent value on either side."""
    line = ["doc_id", "tag", "item_id", "shift"]
    lines = hits.groupBy(*line).agg(F.collect_set(F.struct("place", "slots")).alias("found"))
    slots = F.flatten(F.transform("found", lambda w: w.slots))
    lines = lines.withColumn("all", slots).withColumn("pairs", F.array_distinct("all"))
    # The more frequent pairs first, so that the first one of a value is its best.
    often = F.transform("pairs", lambda p: F.struct((-F.size(F.filter("all", lambda q: q == p))).alias("minus"), p.a.alias("a"), p.b.alias("b")))
    sides = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    fine = (sides("a") == F.size("pairs")) & (sides("b") == F.size("pairs"))
    lines = lines.withColumn("fine", fine).withColumn("often", F.when(~F.col("fine"), F.array_sort(often)))
    # Pairs are taken in that order if neither value is taken yet.
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    free = lambda taken, p: ~F.exists(taken, lambda q: (q.a == p.a) | (q.b == p.b))
    taken = F.aggregate("often", none, lambda t, p: F.when(free(t, p), F.concat(t, F.array(F.struct(p.a.alias("a"), p.b.alias("b"))))).otherwise(t))
    lines = lines.withColumn("pairs", F.when(F.col("fine"), F.col("pairs")).otherwise(taken))
    lines = lines.withColumn("found", F.when(F.col("fine"), F.col("found")).otherwise(F.filter("found", lambda w: F.forall(w.slots, lambda q: F.array_contains("pairs", q)))))
    differs = F.exists("found", lambda w: F.exists(w.slots, lambda q: q.a != q.b))
    return lines.select(*line, F.array_sort(F.array_distinct(F.transform("found", lambda w: w.place))).alias("places"), differs.alias("differs"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, share: float = 0.5, most_windows: int = 2_000_000, run_words: int = 13, least_words: int = 4) -> DataFrame:
    """Pairs of documents (doc_id, text) and items (item_id, text) that contaminate them.

    doc_id, tag (a hash of the text), item_id, windows (of the item), matched (of those in the document), share, reparameterised (some slot differs).
    """
    items = benchmark.select(benchmark["item_id"].cast("long").alias("id"), F.lit(0).alias("tag"), benchmark["text"])
    own = docs.select(docs["doc_id"].cast("long").alias("id"), F.hash(docs["text"]).alias("tag"), docs["text"])
    # At most width - 1 numbers.
    short = [r.length for r in items.select("text").mapInArrow(_lengths(width), "length long").distinct().orderBy("length").collect()]
    known = materialized(items.mapInArrow(_rows(width, short, True, None, least_words), _KIND).dropDuplicates(["id", "hash", "place", "slots"]), "templates")
    wanted = None
    if known.count() <= most_windows:
        wanted = np.sort(known.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64))
        if not len(wanted):
            wanted = np.zeros(1, np.int64)
    found = own.mapInArrow(_rows(width, short, False, wanted, least_words), _KIND)
    # Windows that must be equal word by word count where an item has no others; elsewhere they only make runs longer.
    totals = known.groupBy(F.col("id").alias("item_id")).agg(F.collect_set(F.when(~F.col("exact"), F.col("place"))).alias("light"), F.collect_set("place").alias("every"))
    totals = totals.select("item_id", F.array_sort(F.when(F.size("light") > 0, F.col("light")).otherwise(F.col("every"))).alias("counted"))
    hits = found.alias("d").join(known.alias("i"), F.expr("d.hash = i.hash")).select(
        F.col("d.id").alias("doc_id"), F.col("d.tag").alias("tag"), F.col("i.id").alias("item_id"), F.expr("d.place - i.place").alias("shift"), F.col("i.place").alias("place"), F.arrays_zip(F.col("i.slots").alias("a"), F.col("d.slots").alias("b")).alias("slots")
    )
    lines = _consistent(hits).filter(F.size("places") > 0)
    pairs = lines.groupBy("doc_id", "tag", "item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"), F.max(_longest(F.col("places"))).alias("longest"), F.max("differs").alias("reparameterised"))
    pairs = pairs.join(totals, "item_id").withColumn("matched_places", F.array_sort(F.array_intersect("places", "counted")))
    pairs = pairs.withColumn("windows", F.size("counted").cast("long")).withColumn("matched", F.size("matched_places").cast("long")).withColumn("share", F.col("matched") / F.col("windows"))
    words = _covered(F.col("matched_places"), width) / _covered(F.col("counted"), width)
    enough = (F.col("share") >= share) | (words >= share) | (F.col("longest") + width - 1 >= run_words)
    return pairs.filter(enough).select("doc_id", "tag", "item_id", "windows", "matched", "share", "reparameterised")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that an item contaminates."""
    bad = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("bad_id"), F.col("tag").alias("bad_tag")).distinct()
    # The columns travel as one struct, so that none can clash.
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), F.hash(docs["text"]).alias("tag"), F.struct(*(docs[c].alias(c) for c in docs.columns)).alias("row"))
    kept = rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("tag") == F.col("bad_tag")), "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
