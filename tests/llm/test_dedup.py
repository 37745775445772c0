"""op2, op3, op10 and the decontamination against brute force, with nulls, empty and repeated rows."""

import random
from collections import Counter

import pytest
from tests_llm_brute import components

from loomstone.llm import minhash
from loomstone.llm.decontam import contaminated, decontaminated
from loomstone.llm.fingerprint_index import FingerprintIndex, remove_seen_words
from loomstone.llm.minhash import near_duplicates, without_near_duplicates
from loomstone.llm.suffix_dedup import refine, remove_repeats

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(k))
    passages = [text(60) for _ in range(4)]
    bases = [text(90) for _ in range(4)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.25:
            t = text(rng.randint(0, 80))
        elif kind < 0.45:
            t = f"{text(rng.randint(0, 20))} {rng.choice(passages)} {text(rng.randint(0, 20))}"
        elif kind < 0.95:
            words = rng.choice(bases).split()
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 2)] = text(rng.randint(0, 3)).split()
            t = " ".join(words)
        else:
            t = "Und " * rng.randint(1, 90)
        rows.append((i, t))
    rows += [(n, None), (n + 1, ""), (n + 2, "é" * 150 + "ü" + "é" * 150), (n + 3, "x " + "é" * 150 + "ü" + "é" * 120), (n + 4, rows[0][1]), (n + 5, "one two")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kept string").repartition(3)


@pytest.mark.parametrize("most", [8192, 0])
def test_repeats(spark, most):
    rows, n = corpus(), 40
    counts = Counter(b[i : i + n] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - n + 1))
    got = {r.doc_id: r for r in remove_repeats(frame(spark, rows), length=n, gram=12, most=most).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        b = (t or "").encode()
        mask = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if counts[b[s : s + n]] > 1:
                mask[s : s + n] = b"\1" * n
        assert bytes(got[i].kept) == bytes(x for x, m in zip(b, mask, strict=True) if not m), i
        assert got[i].n_bytes == len(b) and sum(s.end - s.start for s in got[i].spans) == sum(mask)


def test_whole_characters(spark):
    rows = [(1, "ab" + "é" * 60), (2, "xyz" + "é" * 60), (3, None)]
    for r in remove_repeats(frame(spark, rows), length=41, gram=12, whole_characters=True).collect():
        bytes(r.kept or b"").decode()


def test_refine_matches_counts():
    import numpy as np

    data = np.frombuffer(b"abracadabra abracadabra xyz abracadabra" * 3, np.uint8)
    ends = np.full(len(data), len(data))
    for n in (8, 11, 16, 23):
        raw = data.tobytes()
        counts = Counter(raw[i : i + n] for i in range(len(raw) - n + 1))
        assert refine(data, ends, n).tolist() == [i for i in range(len(raw) - n + 1) if counts[raw[i : i + n]] > 1]


def test_refining_many_groups_takes_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from loomstone.llm.suffix_dedup import _refine_groups

    rng = np.random.default_rng(4)
    rows = []  # 60 grams of 180 surroundings: the second half of each repeats the first but for its last byte
    for key in range(60):
        texts = rng.integers(97, 123, (90, 360), np.uint8)
        rows += [(key, k * 10 + key, t.tobytes()) for k, t in enumerate(texts)] + [(key, (90 + k) * 10 + key, t[:-1].tobytes() + b"#") for k, t in enumerate(texts)]
    n = len(rows)
    columns = [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, 161, np.int32)), pa.array(np.ones(n, np.int64)), pa.array([r[2] for r in rows], pa.binary())]
    whole = pa.RecordBatch.from_arrays(columns, names=["key", "rid", "tag", "lo", "count", "copies", "around"])
    tracemalloc.start()
    found = list(_refine_groups(200)(iter([whole.slice(0, 5000), whole.slice(5000)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in found) == n
    assert all(b.column("s").to_pylist() == [0] * b.num_rows and b.column("e").to_pylist() == [359] * b.num_rows for b in found)
    assert peak < 60e6  # it was over 200 MB while two million bytes were refined together


@pytest.mark.parametrize("batches", [1, 4])
def test_seen_words(spark, batches):
    rows, n = corpus(5), 8
    got = {r.doc_id: r for r in remove_seen_words(frame(spark, rows), batches=batches, window=n, gram=3).collect()}
    seen = set()
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        mask = [False] * len(w)
        for s in range(len(w) - n + 1):
            if (k := tuple(w[s : s + n])) in seen:
                mask[s : s + n] = [True] * n
            seen.add(k)
        assert got[i].kept.encode() == b" ".join(x for x, m in zip(w, mask, strict=True) if not m), i
        assert (got[i].n_words, got[i].n_removed) == (len(w), sum(mask))


def test_seen_words_tells_contexts_apart_by_more_than_32_bits(spark):
    # One gram represents both texts; the hashes of their words agree in the low 32 bits and in no window.
    gram = "w810353 w983164 w844778 w699328 "
    one = gram + "v326659 v931151 v197838 v921751 v13380 v805529 v606889 v270946 v645203 v364580 v474507 v95606 v148570 v790996 v65133 v647957"
    two = gram + "v748528 v502168 v549862 v488086 v376688 v241949 v948902 v715396 v252766 v485387 v508114 v73543 v666641 v396902 v38497 v954054"
    got = {r.doc_id: r.n_removed for r in remove_seen_words(frame(spark, [(1, one), (2, two), (3, two)]), batches=1).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_compaction_keeps_the_index(spark):
    rows = sorted(corpus(7))
    docs = frame(spark, rows)
    index = FingerprintIndex(spark, window=8, gram=3, most_runs=10)
    for low in range(0, 120, 40):
        index.take_in(docs.filter(f"doc_id >= {low} and doc_id < {low + 40}"), docs)
    before = {(r.key, r.context, r.check) for _, t in index.runs for r in t.collect()}
    index.compact()
    assert len(index.runs) == 1 and {(r.key, r.context, r.check) for r in index.runs[0][1].collect()} == before


def test_a_run_has_one_file_for_each_bucket(spark):
    rows = sorted(corpus(7))
    docs = frame(spark, rows)
    index = FingerprintIndex(spark, window=8, gram=3, most_runs=10, buckets=8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for low in range(0, 120, 60):
            index.take_in(docs.filter(f"doc_id >= {low} and doc_id < {low + 60}"), docs)
        index.compact()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 4 <= len(index.runs[0][1].inputFiles()) <= 8  # every task of the merge wrote a file for each bucket


@pytest.mark.parametrize(("percent", "seed"), [(85, 3), (80, 11)])
def test_near_duplicates(spark, percent, seed):
    rows = corpus(seed, 160)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows), percent=percent).collect()}
    assert got == components(rows, percent)


def test_near_duplicates_of_sets_with_different_centers(spark, monkeypatch):
    # The first assignment of centers may keep sets apart that share buckets; here it gives none, or x and y different ones.
    rows = corpus(3, 60)
    monkeypatch.setattr(minhash, "_assigned", lambda members, facts: spark.createDataFrame([], "a long, b long"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows), percent=85).collect()}
    assert got == components(rows, 85)
    words = [f"w{i}" for i in range(400)]
    x, y = words[:100], words[8:108]
    h, m = words[:54] + words[200:246], words[22:108] + words[300:314]
    rows = [(1, " ".join(h)), (2, " ".join(m)), (3, " ".join(x)), (4, " ".join(y))]
    monkeypatch.setattr(minhash, "_assigned", lambda members, facts: spark.createDataFrame([(1, 3), (2, 4)], "a long, b long"))
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), percent=85, width=1).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}


def test_near_duplicates_edge_rows(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (7, None), (8, "  ")]
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 3), (5, 3), (3, 3), (3, 3), (7, 7), (8, 8)], key=repr)
    kept = without_near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == [3, 7, 8, None]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_contamination(spark):
    item = "a train leaves Paris with Anna at 40 km per hour and meets Bert after 3 hours on the way to the northern coast of the island"
    other = item.replace("Anna", "Clara").replace("Bert", "Dora").replace("40", "72").replace("3", "9").replace("Paris", "Oslo")
    mixed = "a train leaves Paris with Anna at 40 km per hour and nobody ever meets anyone else in this other story"
    items = spark.createDataFrame([(1, item), (2, "short one here"), (3, None), (4, "7 8 9")], "item_id long, text string")
    rows = [(1, f"Well. {item} Yes."), (2, f"Intro text. {other} End."), (3, mixed), (4, None), (5, ""), (6, "Short one here"), (7, "nothing to see at all in here, friend"), (8, item + " " + other)]
    docs = frame(spark, rows)
    got = {(r.doc_id, r.item_id): r.reparameterised for r in contaminated(docs, items).collect()}
    assert got == {(1, 1): False, (2, 1): True, (6, 2): False, (8, 1): True}
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items, most_windows=0).collect()} == set(got)
    assert sorted(r.doc_id for r in decontaminated(docs, items).collect()) == [3, 4, 5, 7]
    assert contaminated(docs.limit(0), items).count() == 0


def test_contamination_in_part(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(66)]
    long, short = words[:50], words[50:]
    asked = "they sold 3 pears and then bought 5 more plums before lunch so that 3 children got a plum"
    items = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short)), (3, asked)], "item_id long, text string")
    edited = short[:8] + ["other"] + short[9:]
    rows = [
        (1, "So " + " ".join(long[10:35]) + " it ends"), (2, " ".join(edited)), (3, asked.replace("3", "4").replace("5", "4")), (4, asked[::-1].replace("3", "7")[::-1].replace("got 3", "got 8")),
        (5, " ".join(long[10:22])), (6, "they sold 3 pears and then bought 5 more plums before lunch so that 9 children got a plum"),
    ]
    got = {(r.doc_id, r.item_id) for r in contaminated(frame(spark, rows), items).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 3), (6, 3)}


def test_contamination_with_names_at_the_beginning(spark):
    asked = "Tom has 3 apples. Tom buys 5 more. How many does Tom have?"
    greek = "on the way home from the market Ωμέγα gave Иван some pears and plums for lunch"
    items = spark.createDataFrame([(1, asked), (2, greek), (3, "Compute 48 + 27 - 13")], "item_id long, text string")
    rows = [
        (1, asked.replace("Tom", "Ann").replace("3", "4").replace("5", "8")), (2, greek.replace("Ωμέγα", "Σίγμα").replace("Иван", "Пётр")),
        (3, "We say: Compute 48 + 27 - 13 now"), (4, "We say: Compute 49 + 27 - 13 now"), (5, "Tom has 3 apples. Nobody else has any fruit at all, neither here nor there."), (6, asked),
    ]
    docs = frame(spark, rows)
    got = {(r.doc_id, r.item_id): r.reparameterised for r in contaminated(docs, items).collect()}
    assert got == {(1, 1): True, (2, 2): True, (3, 3): False, (6, 1): False}
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items, most_windows=0).collect()} == set(got)
