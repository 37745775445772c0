"""Checkpoints of whole batches, bins by composed carries, and intersected postings."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.functions.text import flagged
from loomstone.operators import lookup
from loomstone.operators.bins import chunk_map, greedy_bins, next_starts
from loomstone.streaming.checkpoint import Checkpoint, follow

KIND = "batch_id string, id int, v string"


def rows(spark, *x):
    return spark.createDataFrame(list(x), KIND)


def there(checkpoint):
    return sorted((r["batch_id"], r["id"], r["v"], r["commit"]) for r in checkpoint.read().collect())


def test_batches_are_added_whole_or_refused(spark, tmp_path):
    c = Checkpoint(spark, f"{tmp_path}/state")
    assert c.read() is None and c.runs() is None
    one, two = [("a", 1, "x"), ("a", 2, None)], [("b", 3, "z")]
    assert c.append(rows(spark, *one), ["id"]) == {"rows": 2, "batches": 1}
    assert c.append(rows(spark, *one), ["id"]) == {"rows": 0, "batches": 0}
    assert c.append(rows(spark, *one, *two), ["id"]) == {"rows": 1, "batches": 1}
    whole = [("a", 1, "x", 1), ("a", 2, None, 1), ("b", 3, "z", 2)]
    assert there(c) == whole
    runs = {r["batch_id"]: (r["row_count"], r["commit"]) for r in c.runs().collect()}
    assert runs == {"a": (2, 1), "b": (1, 2)}
    bad = {
        "in part": [("c", 2, None), ("c", 4, "new")],
        "other values": [("a", 1, "x"), ("a", 2, "y")],
        "null for a value": [("a", 1, None), ("a", 2, None)],
        "known batch, other rows": [("b", 9, "z")],
        "twice": [("d", 5, "x"), ("d", 5, "x")],
        "twice in two batches": [("d", 5, "x"), ("e", 5, "x")],
        "a good batch beside a bad one": [("f", 6, "x"), ("c", 3, "z"), ("c", 7, "q")],
    }
    for what, batch in bad.items():
        with pytest.raises(ValueError):
            c.append(rows(spark, *batch), ["id"])
        assert there(c) == whole, what
    assert c.append(rows(spark), ["id"]) == {"rows": 0, "batches": 0}


def test_a_crash_before_the_manifest_leaves_nothing_and_a_faster_writer_is_noticed(spark, tmp_path):
    path = f"{tmp_path}/state"
    c = Checkpoint(spark, path)
    claim = c._claim
    c._claim = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        c.append(rows(spark, ("a", 1, "x")), ["id"])
    assert Checkpoint(spark, path).read() is None
    other = Checkpoint(spark, path)

    def beaten(number, manifest):
        c._claim = claim
        other.append(rows(spark, ("b", 2, "y")), ["id"])
        return claim(number, manifest)

    c._claim = beaten
    assert c.append(rows(spark, ("a", 1, "x")), ["id"]) == {"rows": 1, "batches": 1}
    assert there(c) == [("a", 1, "x", 2), ("b", 2, "y", 1)]
    assert [json.dumps(m["number"]) for m in c.commits()] == ["1", "2"]


def test_a_stream_that_is_replayed_adds_nothing(spark, tmp_path):
    rows(spark, ("a", 8, "x"), ("b", 9, "y")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(KIND).parquet(f"{tmp_path}/in")
    for state in ("cp", "cp", "lost"):  # the third run has lost its stream state and sends all batches again
        follow(stream, f"{tmp_path}/out", ["id"], f"{tmp_path}/{state}").awaitTermination()
    assert there(Checkpoint(spark, f"{tmp_path}/out")) == [("a", 8, "x", 1), ("b", 9, "y", 1)]


def bins_in_order(sizes, most_items, most_size):
    out, number, items, total = [], 1, 0, 0
    for s in sizes:
        if items and (items >= most_items or total + s > most_size):
            number, items, total = number + 1, 0, 0
        items, total = items + 1, total + s
        out.append(number)
    return out


def test_maps_of_chunks_follow_the_bins():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = rng.integers(0, 12, int(rng.integers(1, 60)))
        most = int(rng.integers(1, 6))
        after = next_starts(sizes, most, 20)
        begin, at = [0], int(after[0])
        while at < len(sizes):
            begin.append(at)
            at = int(after[at])
        marks = bins_in_order(sizes.tolist(), most, 20)
        assert begin == [i for i in range(len(sizes)) if i == 0 or marks[i] != marks[i - 1]]
        n = max(most, len(sizes) // 2)
        if n < len(sizes):
            leave, bins = chunk_map(sizes[: n + most], n, most, 20)
            first = next(i for i in [*begin, len(sizes)] if i >= n)
            assert bins[0] == sum(i < n for i in begin) and (leave[0] + n == first or n + most > len(sizes))


@pytest.mark.parametrize(("chunk", "span"), [(4, 2), (7, 3), (8192, 1024)])
def test_bins_equal_filling_in_order(spark, chunk, span):
    rng = np.random.default_rng(4)
    data = [("hot", i, int(x)) for i, x in enumerate(rng.integers(0, 40, 400))] + [(None, 5, 3), (None, 6, None), ("one", 1, 500), ("big", 1, 90), ("big", 2, 91), ("big", 3, -4)]
    df = spark.createDataFrame(data, "g string, o int, s int")
    got = {(r["g"], r["o"]): r["bin"] for r in greedy_bins(df, "g", "o", "s", 4, 60, chunk, span).collect()}
    want = {}
    for g in {x[0] for x in data}:
        own = sorted((o, max(s or 0, 0)) for x, o, s in data if x == g)
        want |= {(g, o): b for (o, _), b in zip(own, bins_in_order([s for _, s in own], 4, 60), strict=True)}
    assert got == want
    assert greedy_bins(df.filter("o < 0"), "g", "o", "s").count() == 0


def test_intersected_postings_equal_a_scan(spark):
    axes = {"two": F.col("id") % 2 == 0, "three": F.col("id") % 3 == 0, "high": F.col("id") >= 700}
    df = spark.range(1000).withColumn("lang", F.when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("l"), (F.col("id") % 4).cast("string"))))
    bridge = df.select("lang", "id", F.explode(flagged(axes)).alias("axis"))
    index = lookup.postings(bridge, "lang", "id", 64)
    for asked in (["two"], ["two", "three"], ["two", "three", "high"]):
        want = {(r["lang"], r["id"]) for r in lookup.conjunctive(df, {a: axes[a] for a in asked}).collect()}
        got = [tuple(r) for r in lookup.intersect_postings(index, "lang", asked).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert lookup.intersect_postings(index, "lang", ["two", "absent"]).count() == 0
