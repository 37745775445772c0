"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns for every operator and stage; brute force where SQL can't say it."""

import itertools
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests_llm_brute import components
from tokenizers import Tokenizer

from loomstone.llm import quality
from loomstone.llm.ann import nearest
from loomstone.llm.chat import format_conversations, read_back
from loomstone.llm.decontam import contaminated, decontaminated
from loomstone.llm.fingerprint_index import remove_seen_words
from loomstone.llm.minhash import near_duplicates, without_near_duplicates
from loomstone.llm.packing import PairMerges, TokenIds, pack_documents
from loomstone.llm.suffix_dedup import remove_repeats, without_repeats
from loomstone.llm.textual import text_buffers
from loomstone.llm.token_count import Transducer, count_tokens
from loomstone.llm.url_filter import method_verdicts, rule_verdicts

PATH = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"
#: Names that the operators use inside; as extra columns they must come through as they are.
CLASHING = "kept spans n_bytes row rid tag key context lo count repeats copies id place component_id n score label x __place kept_id bad_id bad_tag wanted n_chars".split()


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))


PLAIN = [(1, "the quick brown fox jumps over the lazy dog by the river at noon"), (2, None), (3, ""), (4, "one"), (None, "a row without an id that says some words"), (1, "the quick brown fox jumps over the lazy dog by the river at noon"), (5, "page " * 40_000)]


def own(df):
    return all(all(r[c] == f"own {c}" for c in CLASHING if c != "n_chars") for r in df.collect())


def test_filters_keep_columns_of_any_name(spark):
    docs = documents(spark, PLAIN)
    items = spark.createDataFrame([(1, "a row without an id that says some words")], "item_id long, text string")
    model = quality.fit(np.array([[0.0] * 26, [1.0] * 26] * 10), np.array([0.0, 1.0] * 10))
    for out in (without_near_duplicates(docs), without_repeats(docs, length=20, gram=8), decontaminated(docs, items), quality.at_least(docs, model, 0.0)):
        assert out.columns == docs.columns and own(out)
    assert sorted((r.doc_id for r in without_near_duplicates(docs).collect()), key=repr) == sorted([1, 2, 3, 4, 5, None], key=repr)
    assert [r.text for r in without_repeats(docs, length=20, gram=8).filter("doc_id = 2").collect()] == [None]
    assert decontaminated(docs, items).count() == len(PLAIN) - 1
    assert {c for c in remove_repeats(docs, length=20, gram=8).columns} == {"doc_id", "n_bytes", "kept", "spans"}
    assert quality.with_score(docs, model).columns.count("score") == 1


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = documents(spark, PLAIN)
    for rows in (docs, docs.limit(0)):
        out = stage(spark, rows, DATA)
        assert name == "packing" or out.columns == docs.columns
        assert out.count() <= (10**6 if name == "packing" else rows.count())


def test_operators_on_empty_tables(spark):
    docs = documents(spark, PLAIN).limit(0)
    for out in (remove_repeats(docs), remove_seen_words(docs), near_duplicates(docs), pack_documents(docs, PATH), count_tokens(docs, PATH), contaminated(docs, docs.withColumnRenamed("doc_id", "item_id"))):
        assert out.count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(format_conversations(turns)).count() == 0


def test_repeated_rows(spark):
    docs = documents(spark, [(7, "the same words stand here twice, in two rows of one id"), (7, "the same words stand here twice, in two rows of one id"), (None, None), (None, None)])
    got = sorted(((r.doc_id, len(r.kept)) for r in remove_repeats(docs, length=20, gram=8).collect()), key=repr)
    assert got == sorted([(7, 0), (7, 0), (None, 0), (None, 0)], key=repr)
    assert sorted(r.n_removed for r in remove_seen_words(docs, window=5, gram=2).collect()) == [0, 0, 0, 0]
    assert sum(r.length for r in pack_documents(docs, PATH).collect()) == 2 * (len(Tokenizer.from_file(PATH).encode("the same words stand here twice, in two rows of one id", add_special_tokens=False).ids) + 1) + 2
    assert len({r.n_tokens for r in count_tokens(docs, PATH).filter("doc_id = 7").collect()}) == 1
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in nearest(vectors, vectors.filter("vec_id = 2"), k=5).orderBy("rank").collect()] == [(2, 1, 1), (2, 2, 1)]


def test_texts_that_say_one_thing_over_and_over(spark):
    rows = [(1, "und " * 900), (2, "x y " * 500 + "end"), (3, "und " * 30 + "other words"), (4, "a b c d e f g h " * 60), (5, "nothing of this kind")]
    n = 60
    counts = Counter(b[i : i + n] for _, t in rows for b in [t.encode()] for i in range(len(b) - n + 1))
    for r in remove_repeats(documents(spark, rows), length=n, gram=12).collect():
        b = dict(rows)[r.doc_id].encode()
        mask = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if counts[b[s : s + n]] > 1:
                mask[s : s + n] = b"\1" * n
        assert bytes(r.kept) == bytes(x for x, m in zip(b, mask, strict=True) if not m), r.doc_id
    seen, n = set(), 8
    got = {r.doc_id: r.kept for r in remove_seen_words(documents(spark, rows), batches=2, window=n, gram=3).collect()}
    for i, t in rows:
        w = t.split()
        mask = [False] * len(w)
        for s in range(len(w) - n + 1):
            if (k := tuple(w[s : s + n])) in seen:
                mask[s : s + n] = [True] * n
            seen.add(k)
        assert got[i] == " ".join(x for x, m in zip(w, mask, strict=True) if not m), i


def test_chains_of_near_duplicates(spark):
    rng, rows = random.Random(5), []
    new = lambda k: [f"w{rng.randrange(10**7)}" for _ in range(k)]
    for _ in range(12):
        words = new(120)
        for k in range(28):
            rows.append((len(rows), " ".join(words)))
            words[(k * 9) % 120 : (k * 9) % 120 + 2] = new(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(spark, rows), percent=85).collect()}
    assert got == components(rows, 85)
    assert len({c for _, c in got.values()}) == 12


def test_token_counts_of_long_texts_without_white_space():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(20_000)), "x" * 50_000, "é" * 9_000, "“" * 700 + "’s", "日本" * 2_000, "a’b “c” d—e…", "٣٤ Ⅷ x², y"]
    expected = [len(x.ids) for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert Transducer(PATH).count(texts) == expected


def test_ids_of_forgotten_pieces():
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["".join(rng.choice("aestrvld'' .É×÷ßÿÀñ9“") for _ in range(rng.randint(0, 60))) for _ in range(600)] + ["<|endoftext|>x don't I'll 're ''s", None]
    small, library = TokenIds(PATH, most=200), Tokenizer.from_file(PATH)
    for k in range(0, len(texts), 50):
        ids, first = small.encode(*text_buffers(pa.array(texts[k : k + 50], pa.string())), 0)
        for i, t in enumerate(texts[k : k + 50]):
            assert ids[first[i] : first[i + 1]].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 0]
    assert PairMerges and len(small.hash) < 2000


def test_packing_of_small_cases_is_nearly_optimal(spark):
    rng = random.Random(9)
    for _ in range(3):
        sizes = [rng.randint(2, 9) for _ in range(9)]
        rows = [(i, " ".join(["the"] * (n - 1))) for i, n in enumerate(sizes)]
        used = len({r.sequence_id for r in pack_documents(documents(spark, rows).coalesce(1), PATH, capacity=12).collect()})

        def fits(bins, sizes=sizes):
            return any(all(sum(s for s, b in zip(sizes, deal, strict=True) if b == k) <= 12 for k in range(bins)) for deal in itertools.product(range(bins), repeat=len(sizes)))

        assert used <= next(k for k in range(1, 10) if k**9 > 3_000_000 or fits(k)) + 1


def test_scores_follow_the_trees():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 26))
    y = (x[:, 3] + x[:, 7] > 0).astype(float)
    trees = quality.fit(x, y)

    def one(row):
        total = trees.base
        for root in trees.roots:
            at = root
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x), [one(r) for r in x])
    assert ((trees.score(x) >= 0.5) == (y == 1)).mean() > 0.97


def test_statistics_of_texts_one_by_one():
    texts = ["The Quick fox!! fox fox.", "", None, "ÀB c123 | #x\nline two", "word " * 50]
    import pyarrow as pa

    together = quality.statistics(*text_buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        b, w = (t or "").encode(), (t or "").split()
        alone = quality.statistics(*text_buffers(pa.array([t], pa.string())))[0]
        assert np.allclose(together[i], alone)
        f = dict(zip(quality.FEATURES, alone, strict=True))
        assert np.isclose(f["log_words"], np.log1p(len(w))) and np.isclose(f["digit"], sum(48 <= c < 58 for c in b) / max(len(b), 1))
        assert np.isclose(f["distinct_words"], len(set(w)) / len(w) if w else f["distinct_words"])


def test_slots_against_brute_force(spark):
    """Every document is an item with other values: contaminated exactly if one value stands for one value both ways."""
    item = "the shop sold {} pears and then {} plums before {} more children came for {} cakes at the fair in the old town"
    values = ("3", "5", "3", "8")
    items = spark.createDataFrame([(1, item.format(*values))], "item_id long, text string")
    rows, expected = [], {}
    for k, other in enumerate(itertools.product("479", repeat=4)):
        rows.append((k, item.format(*other)))
        pairs = set(zip(values, other, strict=True))
        expected[k] = len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
    found = {r.doc_id: r.share for r in contaminated(documents(spark, rows), items, share=1.0, run_words=99).collect()}
    assert all((found.get(k, 0.0) == 1.0) == fine for k, fine in expected.items())


def test_purity_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), f"/{rng.choice(['en', 'fr'])}/{rng.choice(['p', 'q', 'r'])}", rng.choice([0, 1, None])) for _ in range(80)]
    judged = spark.createDataFrame(rows, "host string, path string, bad int")
    from loomstone.llm.url_filter import template_tree

    nodes = {(r.host, r.node): r for r in template_tree(judged).select("host", "level", "node", "n", "judged", "bad", "purity").distinct().collect()}
    all_bad = [b for *_, b in rows if b is not None]
    for (host, node), r in nodes.items():
        if node == "":
            part = [b for h, _, b in rows if host in (h, "*")]
            assert (r.n, r.judged, r.bad) == (len(part), sum(b is not None for b in part), sum(b or 0 for b in part))
            assert abs(r.purity - (r.bad + 4 * sum(all_bad) / len(all_bad)) / (r.judged + 4)) < 1e-9
        else:
            parent = nodes[host, node.rsplit("/", 1)[0]]
            assert abs(r.purity - (r.bad + 4 * parent.purity) / (r.judged + 4)) < 1e-9
            assert parent.n == sum(x.n for (h, v), x in nodes.items() if h == host and v.rsplit("/", 1)[0] == parent.node and v != "")


def test_urls_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.net/es/1", "x", "y", "z", "w"), (2, None, "x", "y", "z", "w")], "page_id long, url string, host string, rule string, __shape string, template string")
    ruled = rule_verdicts(pages, [("net/es/", True)])
    assert {r.page_id: (r.host, r.rule) for r in ruled.collect()} == {1: ("a.net", "net/es/"), 2: ("", None)}
    out = method_verdicts(ruled, ruled.selectExpr("host", "path", "cast(blocked as int) bad"))
    assert out.columns.count("template") == 1 and {r["__shape"] for r in out.collect()} == {"z"}


def test_recall_with_production_parameters(spark):
    from loomstone.llm.queries import VP_FACTOR

    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in nearest(table, table.filter("vec_id % 20 = 0"), factor=VP_FACTOR, shard_size=400, block=16).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in got:
        d = np.sqrt(((v - v[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len(got[q] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert len(got) == (ids % 20 == 0).sum() and hits >= 0.97 * 10 * len(got)


def test_short_items_are_found_alone(spark):
    items = spark.createDataFrame([(1, "yes"), (2, "is it so"), (3, "Compute forty and two")], "item_id long, text string")
    rows = [(1, "yes"), (2, "oh yes it is"), (3, "Is it so?"), (4, "and is it so then"), (5, "now compute forty and two")]
    assert {(r.doc_id, r.item_id) for r in contaminated(documents(spark, rows), items).collect()} == {(1, 1), (3, 2), (5, 3)}


def test_pieces_of_one_hash_go_to_the_library(monkeypatch):
    from loomstone.llm import packing

    monkeypatch.setattr(packing, "mix", lambda x: x & np.uint64(31))
    ids, library = packing.TokenIds(PATH), Tokenizer.from_file(PATH)
    texts = ["", "one two three", "some more words, and 12 numbers", "é à la carte", "x" * 50, "one two"]
    data = "".join(texts).encode()
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    for _ in range(2):
        got, starts = ids.encode(np.frombuffer(data, np.uint8), offsets, 0)
        assert [got[b:e].tolist() for b, e in zip(starts[:-1], starts[1:], strict=True)] == [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
