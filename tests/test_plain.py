"""Patterns on Arrow batches of plain texts against the same patterns as columns."""

import random
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomstone.functions import plain
from loomstone.operators import classify as C
from loomstone.operators import screening_patterns as P
from loomstone.plans.classified import KINDS, PHRASES

ODD = ("é", "ß", " Größe ", "’", "–", "\u00a0", "\u3000", "\x0b", "\r\n", "\f", "\U0001f600", "²", "中", "e\u0301", "\u0131", "\u0130", "\u017f", "\u212a", "\u0663", "\u2028", "\u0085", "\u200d", "\u2167", "\u24d0", "\u203f", "\u0001", "\u0002", "\u0004", "\ufffd", "_")
KNOWN = (
    "Gan Mai Da Zao Decoction (GMD) is old", "Xiao Yao San (XYS)", "with GMD and XYS", "n = 12 patients", "RAT and rats were treated", "DHA", "dha", "SAMe", "SAME", "AT supplementation", "at supplementation", "gestational  age", "gestational weeks", "dietary supplement intake", "dietary iron or zinc intake",
    "vitamin\u00a0K reversal", "evidence summary of TCM", "cirrhosis of the liver", "without any liver disease", "a 24 h recall", "hepatitis B",
)
SCHEMA = "question_id string, record_id string, title string, abstract string, publication_types string, n int"


def test_what_a_character_becomes_is_what_patterns_as_columns_take_it_for(spark):
    points = [c for c in range(128, 0x20000) if not 0xD800 <= c < 0xE000]
    texts, apart = plain.plain(pa.array([chr(c) for c in points]))
    c = F.col("c")
    seen = spark.createDataFrame([(k, chr(p)) for k, p in enumerate(points)], "k int, c string").select(
        "k", c.rlike(r"(?iUd)[\x00-\x7f]"), c.rlike(r"(?U)\w"), c.rlike(r"(?U)\s"), c.rlike(r"(?U)\d"), F.concat(F.lit("a"), c).rlike(r"(?U)a\b"), F.concat(F.lit("a"), c).rlike(r"a\b"), c.rlike(r"\s"), c.rlike("^.$")
    )
    expected = {"_": (False, True, False, False, False, False, False, True), "\u0003": (False, False, False, False, True, True, False, True), "\u0004": (False, False, True, False, True, True, False, True)}
    wrong = [hex(points[k]) for k, *is_ in seen.collect() if not apart[k] and tuple(is_) != expected[texts[k].as_py()]]
    assert not wrong
    assert not apart[[points.index(ord(x)) for x in "éßñÇ中’–²\u00a0\u3000\U0001f600"]].any() and apart[[points.index(ord(x)) for x in "\u0131\u0130\u017f\u212a\u0301\u0663\u2028\u0085"]].all()


def test_plain_texts_keep_their_places():
    texts = pa.array(["x", "né\x0b\u00a0\U0001f600", None, "", "\u0131a", "中 iron"]).slice(1)
    got, apart = plain.plain(texts)
    assert got.to_pylist() == ["n_\f\u0004\u0003", "", "", "\u0003a", "_ iron"] and apart.tolist() == [False, False, False, True, False]
    assert plain.spaced(got)[0].as_py() == "n_\f\f\u0003"
    broken = pa.StringArray.from_buffers(2, pa.py_buffer(np.array([0, 2, 4], np.int32)), pa.py_buffer(b"a\xffok"))
    assert plain.plain(broken)[1].tolist() == [True, False] and plain.plain(broken)[0][1].as_py() == "ok"
    assert plain.plain(pa.array([], pa.string()))[1].tolist() == []


def records(n, most=12):
    draw = random.Random(5)
    words = PHRASES + KNOWN
    say = lambda k: "".join(draw.choice(words) + draw.choice((" ", " ", ". ", "; ", "\n", "-", " " + draw.choice(ODD[:13]), draw.choice(ODD) if k % 4 == 0 else " ")) for _ in range(draw.randint(0, most)))
    parts = lambda k: "".join(draw.choice(("BACKGROUND: ", "\nMETHODS: ", "\r\nRESULTS: ", "\nCLINICAL CHARACTERISTICS: ")) + say(k) for _ in range(3))
    return [(draw.choice((*P.QUESTIONS, *P.QUESTIONS, None)), str(k), say(k), draw.choice((None, "", say(k), parts(k), parts(k))), draw.choice(KINDS), k) for k in range(n)]


def test_flags_of_tasks_are_those_of_columns(spark, monkeypatch):
    rows = spark.createDataFrame(records(400), SCHEMA)

    def flags():
        found, s = C._signals(rows)
        got = found.select("n", F.col("__found")[0].alias("apart"), *(getattr(s, f).alias(f) for f in C.FLAGS)).collect()
        return {r["n"]: r["apart"] for r in got}, {r["n"]: {f for f in C.FLAGS if r[f]} for r in got}

    apart, ours = flags()
    width = 1 + len(C.FLAGS)

    def all_apart(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(b[0]) + 1) * width, pa.int32()), pa.array(np.ones(len(b[0]) * width, bool)))

    monkeypatch.setattr(C, "_in_tasks", all_apart)
    every, columns = flags()
    assert all(every.values()) and 10 < sum(apart.values()) < 200
    assert {n: ours[n] ^ columns[n] for n in ours if ours[n] != columns[n]} == {}
    assert len(set().union(*ours.values())) > 100


def test_long_texts_take_little_time(spark):
    """9 MB in one task: 2 s where this was written, 41 s when alternatives were tried at each word."""
    draw = random.Random(1)
    words = ["".join(draw.choice("abcdefghinoprstu") for _ in range(draw.randint(2, 9))) for _ in range(5000)]
    long = [(P.QUESTIONS[k % 5], str(k), "Iron supplementation", "METHODS: " + " ".join(draw.choices(words, k=15_000)), "", k) for k in range(90)]
    classify = lambda rows: C.classify(spark.createDataFrame(rows, SCHEMA).coalesce(1)).select("decision", "reason_codes").collect()
    classify(long[:1])
    began = time.time()
    classify(long[:1])
    fixed = time.time() - began
    began = time.time()
    assert len(classify(long)) == 90
    assert time.time() - began - fixed < 20
