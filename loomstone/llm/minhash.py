"""Near-duplicate documents: minhash with tensored banding, confirmed on full shingle sets.

Two small collections of hashes are made, each of `groups` groups of `rows` minhashes; a table's key is a pair of one group
of either collection, so groups * groups tables cost only 2 * groups * rows minhashes. Two sets of similarity s meet in no table
with probability of at most 2 * (1 - s**rows)**groups; unless given, groups is the least number for which that is below 1e-4 at the threshold (at
0.9 it then is about 1e-6).
Copies are one set from the start. Groups of either collection that one set alone has are dropped before pairs are
formed. Each set is
compared with a center, the most typical set of its buckets (see _assigned). Two sets of one center that aren't in one component by that are linked only if they have in common
enough of what they add to the center or lack of it (see _compared); they are brought together by these shingles and confirmed. So no links
inside a group of near copies are enumerated. Then the buckets are looked at whose sets still lie in different components: sets that have had no center in
common get one and meet in the same way (see _rest). So of the links between sets of one bucket that would join two components none is left out.

Defined results: a null or empty text has no shingles and is linked with nothing; fewer words than a shingle are one shingle;
rows with equal doc_id are kept as rows; a null doc_id never represents a group; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.components import connected_components
from loomstone.llm.textual import Words, mix, prefix, run, signed, slices, text_buffers
from loomstone.session import materialized

#: Bits of a shingle's hash; the row of a slice is kept above them while shingles are sorted.
BITS = np.uint64(52)
MASK = np.uint64((1 << 52) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as numbers below 2**52, sorted, one text after the other, and where each text's begin."""
    words = Words(data, offsets, lower=True)
    count = np.diff(words.first)
    shingles = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), shingles)
    first = np.cumsum(shingles) - shingles
    begin = words.first[row] + np.arange(len(row)) - first[row]
    hashes = run(prefix(words.value), begin, np.minimum(begin + width, words.first[row + 1]))
    keys = np.sort((hashes & MASK) | (row.astype(np.uint64) << BITS))
    if len(keys):
        keys = keys[np.append(True, keys[1:] != keys[:-1])]
    starts = np.searchsorted(keys, np.arange(len(count) + 1, dtype=np.uint64) << BITS)
    return keys & MASK, starts


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for at in range(0, batch.num_rows, 4095):
            yield batch.slice(at, 4095)


def _signatures(width: int, groups: int, rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        many = 2 * groups * rows
        factor = rng.integers(0, 1 << 62, many, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shift = rng.integers(0, 1 << 63, many, dtype=np.uint64)
        for batch in _rows(batches):
            ids, starts = shingle_sets(*text_buffers(batch.column("text")), width)
            count = np.diff(starts)
            full = np.flatnonzero(count)
            low = np.zeros((many, batch.num_rows), np.uint64)
            s1, s2 = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            if len(full):
                at, scrambled = starts[full], mix(ids)
                for k in range(many):
                    low[k, full] = np.minimum.reduceat((scrambled * factor[k] + shift[k]) >> np.uint64(32), at)
                s1[full] = np.add.reduceat(scrambled, at)
                s2[full] = np.add.reduceat(mix(scrambled ^ np.uint64(0x5851F42D4C957F2D)), at)
            bands = np.zeros((2 * groups, batch.num_rows), np.uint64)
            for k in range(many):
                bands[k // rows] = mix(bands[k // rows] + low[k] + np.uint64(k + 1))
            lists = lambda x, kind: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x.T).ravel()).cast(kind), x.shape[0]).cast(pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(signed(s1)), pa.array(signed(s2)), lists(bands.view(np.int64), pa.int64()), lists((low & np.uint64(0x7FFFFFFF)).astype(np.int32), pa.int32())],
                names=["doc_id", "n", "s1", "s2", "bands", "low"],
            )

    return work


def _sets(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows(batches):
            ids, starts = shingle_sets(*text_buffers(batch.column("text")), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.view(np.int64)))], names=["doc_id", "tag", "ids"])

    return work


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, groups: int | None = None, rows: int = 3) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id linked to it, directly or not).

    Two documents are linked where 100 * (common shingles) >= percent * (shingles of either).
    """
    groups = groups or math.ceil(math.log(1e-4 / 2) / math.log(1 - (percent / 100) ** rows))
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    kind = "doc_id long, n long, s1 long, s2 long, bands array<long>, low array<int>"
    signed_docs = materialized(own.mapInArrow(_signatures(width, groups, rows), kind), "signatures")
    full = signed_docs.filter("n > 0 and doc_id is not null")
    # One representative for all copies of a set.
    sets = full.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "bands", "low")).alias("one"))
    sets = materialized(sets.select("s1", "s2", "n", F.col("one.doc_id").alias("rep"), "one.bands", "one.low"), "sets")
    # Groups of hashes that at least two sets have, then pairs of one group from each collection.
    bands = sets.select("rep", F.posexplode("bands").alias("place", "band"))
    shared = bands.groupBy("place", "band").agg(F.count("*").alias("c")).filter("c > 1").select("place", "band")
    left = bands.join(shared, ["place", "band"]).groupBy("rep").agg(
        F.collect_list(F.when(F.col("place") < groups, F.struct("place", "band"))).alias("us"), F.collect_list(F.when(F.col("place") >= groups, F.struct("place", "band"))).alias("vs")
    )
    keys = left.select("rep", "vs", F.explode("us").alias("u")).select("rep", "u", F.explode("vs").alias("v")).select("rep", F.xxhash64("u", "v").alias("key"))
    keys = materialized(keys, "keys")
    buckets = keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    members = materialized(keys.join(buckets, "key"), "members")
    facts = materialized(sets.select("rep", "n", "low").join(members.groupBy("rep").agg(F.sum("c").alias("weight")), "rep"), "facts")
    stars = materialized(_assigned(members.select("key", "rep"), facts), "stars")
    compared = materialized(_compared(stars, own, percent, width), "compared")
    links = compared.filter("linked").select("a", "b")
    found = materialized(connected_components(links), "components")
    pairs = materialized(_met(compared, found, facts, percent), "pairs")
    more = materialized(_compared(pairs, own, percent, width).filter("linked").select("a", "b"), "more")
    if not more.isEmpty():
        links = materialized(links.unionByName(more), "links")
        found = materialized(connected_components(links), "components")
    # Sets of a bucket that lie in different components and have had no center in common.
    rest = materialized(_rest(members.select("key", "rep"), stars, facts, found), "rest")
    if not rest.isEmpty():
        again = materialized(_compared(rest, own, percent, width), "compared_rest")
        links = materialized(links.unionByName(again.filter("linked").select("a", "b")), "links")
        found = materialized(connected_components(links), "components")
        of_these = compared.unionByName(again).join(rest.select("a").distinct(), "a", "left_semi")
        pairs = materialized(_met(of_these, found, facts, percent), "pairs_rest")
        more = materialized(_compared(pairs, own, percent, width).filter("linked").select("a", "b"), "more_rest")
        if not more.isEmpty():
            found = connected_components(links.unionByName(more))
    by_set = sets.select("s1", "s2", "n", "rep").join(found.select(F.col("v").alias("rep"), "component"), "rep", "left")
    by_set = by_set.select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    return signed_docs.select("doc_id", "n", "s1", "s2").join(by_set, ["s1", "s2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id stands for its group; of rows with one doc_id, one; rows with a null doc_id all stay."""
    found = near_duplicates(docs, **options)
    keep = found.filter("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    # The columns travel as one struct, so that none can clash.
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), F.struct(*(docs[c].alias(c) for c in docs.columns)).alias("row"))
    kept = rows.join(keep, "id", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("row.text")))
    kept = kept.filter("place = 1").select("row").unionByName(rows.filter("id is null").select("row"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def _alike(n_a: str, n_b: str, low_a: str, low_b: str, percent: float):
    """Sizes allow the similarity, and minhashes agree as they do for it but for a chance below 1e-9."""
    sizes = F.expr(f"100 * least({n_a}, {n_b}) >= {percent} * greatest({n_a}, {n_b})")
    p = percent / 100
    size = F.size(low_a)
    return sizes & (_agreement(low_a, low_b) * size >= size * p - 6.2 * F.sqrt(size * p * (1 - p)) - 1)


def _agreement(low_a: str, low_b: str):
    return F.aggregate(F.zip_with(low_a, low_b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(low_a)


def _assigned(members: DataFrame, facts: DataFrame, least: float = 0.4, close: float = 0.7) -> DataFrame:
    """One center (a) for each set (b), or two if the first is not close: the heaviest ones that are like it.

    A set's weight is the size of all its buckets together: of a text and its edited copies, the text itself or one hardly edited is heaviest. Each
    bucket's heaviest set is a candidate; then each bucket proposes the heaviest center that any of its sets has, so that the sets of a bucket
    come to the same center though it is missing from the bucket.
    """
    weights = facts.select("rep", "weight")
    rows = members.join(weights, "rep")

    def candidates(proposed: DataFrame) -> DataFrame:
        pairs = members.join(proposed, "key").filter("rep != center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
        for side in "ab":
            pairs = pairs.join(facts.select(F.col("rep").alias(side), F.col("low").alias(f"low_{side}"), F.col("weight").alias(f"w_{side}")), side)
        like = pairs.withColumn("like", _agreement("low_a", "low_b")).filter(F.col("like") >= least)
        return like.filter("w_a > w_b or w_a = w_b and a < b").select("a", "b", "like", F.col("w_a").alias("weight"))

    heaviest = rows.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("center"))
    first = materialized(candidates(heaviest), "candidates")
    own = first.groupBy("b").agg(F.max(F.struct("weight", (-F.col("a")).alias("minus"))).alias("best"))
    rows = rows.join(own, rows["rep"] == own["b"], "left").select("key", F.coalesce("best", F.struct("weight", (-F.col("rep")).alias("minus"))).alias("best"))
    proposed = rows.groupBy("key").agg(F.max("best").alias("top")).select("key", (-F.col("top.minus")).alias("center"))
    both = first.unionByName(candidates(proposed)).distinct()
    order = Window.partitionBy("b").orderBy(F.desc("weight"), "a")
    ranked = both.withColumn("place", F.row_number().over(order)).withColumn("best", F.first("like").over(order))
    return ranked.filter((F.col("place") == 1) | (F.col("place") == 2) & (F.col("best") < close)).select("a", "b")


def _met(compared: DataFrame, found: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets that have a center in common, lie in different components and could be linked (see _compared)."""
    # A set that isn't linked to its center (y), against the others of that center (x).
    apart = compared.filter("not linked").select(F.col("a").alias("center"), F.col("b").alias("y"), F.col("d").alias("d_y"), F.col("e").alias("e_y"), F.explode("tokens").alias("token"))
    others = compared.join(apart.select(F.col("center").alias("a")).distinct(), "a")
    others = others.select(F.col("a").alias("center"), "n", F.col("b").alias("x"), F.col("d").alias("d_x"), F.col("e").alias("e_x"), "linked", "least", F.explode("tokens").alias("token"))
    # All but `least - 1` of x's tokens must meet those of y: added shingles first, and of these the ones that fewest others have.
    held = apart.groupBy("center", "token").agg(F.count("*").alias("held"), F.sum(F.xxhash64("y").cast("decimal(20,0)")).alias("by"))
    order = Window.partitionBy("center", "x").orderBy((F.col("token") < 0), "others", "token")
    others = others.join(held, ["center", "token"], "left").withColumn("others", F.coalesce("held", F.lit(0)) - F.when(F.col("linked"), 0).otherwise(1))
    others = others.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= F.col("d_x") + F.col("e_x") - F.col("least") + 1).filter("others > 0")
    # Tokens that the same others have are one.
    others = others.groupBy("center", "n", "x", "d_x", "e_x", "held", "by", (F.col("token") >= 0).alias("added")).agg(F.min("token").alias("token"))
    could = F.least("d_x", "d_y") + F.when(F.col("token") >= 0, F.least("e_x", "e_y")).otherwise(0)
    enough = (100 + percent) * could >= 100 * (F.col("d_x") + F.col("d_y")) + percent * (F.col("e_x") + F.col("e_y")) - (100 - percent) * F.col("n")
    pairs = others.join(apart, ["center", "token"]).filter((F.col("x") != F.col("y")) & enough)
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    of = lambda side: found.select(F.col("v").alias(side), F.col("component").alias(f"component_{side}"))
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter("coalesce(component_a, a) != coalesce(component_b, b)").select("a", "b")
    return _plausible(pairs, facts, percent)


def _rest(members: DataFrame, stars: DataFrame, facts: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of a center (a) and a set (b) still to be compared.

    Sets of a bucket that lie in different components must have a center in common, or one must be the other's. Where no center is that of all sets of
    such a bucket, the one that most of them have (a set is its own, too) becomes that of all, whatever their similarity; so none of the bucket's pairs is left out.
    """
    rows = members.join(found.select(F.col("v").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    split = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    rows = materialized(rows.select("key", "rep").join(split.select("key", "size"), "key"), "split")
    weights = facts.select(F.col("rep").alias("center"), "weight")
    centers = stars.select(F.col("b").alias("rep"), F.col("a").alias("center")).join(weights, "center").unionByName(weights.withColumn("rep", F.col("center")))
    votes = rows.join(centers, "rep").groupBy("key", "center").agg(F.count("*").alias("votes"), F.first("weight").alias("weight"), F.first("size").alias("size"))
    hubs = votes.groupBy("key").agg(F.max(F.struct("votes", "weight", (-F.col("center")).alias("minus"))).alias("top"), F.first("size").alias("size"))
    hubs = hubs.filter(F.col("top.votes") < F.col("size")).select("key", (-F.col("top.minus")).alias("a"))
    pairs = rows.join(hubs, "key").select("a", F.col("rep").alias("b")).filter("a != b").distinct()
    return pairs.join(stars, ["a", "b"], "left_anti")


def _plausible(pairs: DataFrame, facts: DataFrame, percent: float) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(facts.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("low").alias(f"low_{side}")), side)
    return pairs.filter(_alike("n_a", "n_b", "low_a", "low_b", percent)).select("a", "b")


def _compared(pairs: DataFrame, own: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs with whether their full sets reach the similarity t, and the tokens by which b is to meet others of its center.

    Let b lack d of a's shingles and add e of its own; a token is one of either. Sets x and y that have s tokens in common share
    |a| - d(x) - d(y) + s shingles. If y isn't linked to a, x and y are linked only if s > (d(x) + t * e(x)) / (1 + t), whatever y is; `least` is the least such s.
    So any choice of all but least - 1 of x's tokens meets those of y; where d <= e, added shingles alone suffice.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = own.join(wanted, "doc_id").select("doc_id", "text", F.hash("text").alias("tag"))
    ids = materialized(texts.mapInArrow(_sets(width), "doc_id long, tag int, ids array<long>").dropDuplicates(["doc_id", "tag"]).select("doc_id", "ids"), "shingles")
    both = pairs.join(ids.select(F.col("doc_id").alias("b"), F.col("ids").alias("ids_b")), "b").join(ids.select(F.col("doc_id").alias("a"), F.col("ids").alias("ids_a")), "a")
    both = both.select("a", "b", F.size("ids_a").cast("long").alias("n"), F.array_except("ids_a", "ids_b").alias("lack"), F.array_except("ids_b", "ids_a").alias("add"))
    d, e = F.size("lack").cast("long"), F.size("add").cast("long")
    least = F.floor((100 * d + percent * e) / (100 + percent)) + 1
    linked = 100 * (F.col("n") - d) >= percent * (F.col("n") + e)
    return both.select("a", "b", "n", d.alias("d"), e.alias("e"), linked.alias("linked"), least.alias("least"), F.concat("add", F.transform("lack", lambda x: -1 - x)).alias("tokens"))
