"""Packing, token counts, chat formatting, quality, urls and nearest neighbours on small cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomstone.llm.ann import nearest
from loomstone.llm.chat import format_conversations, read_back
from loomstone.llm.packing import Packer, pack_documents
from loomstone.llm.quality import FEATURES, fit, statistics, train, with_score
from loomstone.llm.textual import text_buffers
from loomstone.llm.token_count import Transducer, count_tokens
from loomstone.llm.url_filter import method_verdicts, rule_verdicts

PATH = public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(1)
    texts = ["it's", "'sand", "''s", "don't we'll 're 'r 'rx I'VE '", "", "  ", "a<|endoftext|>b<|startoftext|>", "<|endoftext|", "x" * 3000, "12 345 6a7b", "日本語テキスト mixed é é", "ΣΑΣ İstanbul ß ﬁ", "“quotes” — dash…", "a b c\x1cd\x85e", "😀😀 ok", "!!!??? ''' '\"' $$$", "'" * 700 + "s", "ª º µ ² ³ ¼ 1½"]
    texts += ["".join(rng.choice("abcdeorstinghul'. ,!éèüß1\n'A") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    return texts + ["".join(chr(rng.choice([rng.randint(32, 0x24F), rng.randint(0x250, 0x3000), rng.randint(97, 122), 32])) for _ in range(rng.randint(1, 80))) for _ in range(150)]


def test_token_counts(spark):
    texts = odd_texts()
    expected = [len(x.ids) for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert Transducer(PATH).count(texts) == expected
    rows = spark.createDataFrame([*enumerate(texts), (9999, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_bytes) for r in count_tokens(rows, PATH).collect()}
    assert got == {i: (n, len(t.encode())) for i, (t, n) in enumerate(zip(texts, expected, strict=True))} | {9999: (0, 0)}


def test_tables_that_overflow_start_anew():
    texts = odd_texts()[20:120]
    expected = [len(x.ids) for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    small = Transducer(PATH, most_cells=1000)
    assert [small.count([t])[0] for t in texts] == expected


def test_packing(spark):
    texts = odd_texts()
    rows = spark.createDataFrame([*enumerate(texts), (9999, None)], "doc_id long, text string").repartition(3)
    got = pack_documents(rows, PATH, capacity=64, open_bins=8).collect()
    ids = {i: np.array(x.ids + [0], "<u4") for i, x in enumerate(Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False))} | {9999: np.zeros(1, "<u4")}
    sequences, total = {}, 0
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length <= 64 and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.start == r.piece * 64
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    assert total == sum(map(len, ids.values()))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= total / 64 * 1.05 + 3


def test_packer_closes_the_fullest():
    p = Packer(10, 2)
    assert list(p.add("a", 6)) == [] and list(p.add("b", 7)) == []
    assert list(p.add("c", 8)) == [[("b", 7)]]
    assert list(p.add("d", 2)) == [[("c", 8), ("d", 2)]]


@pytest.mark.parametrize("budget", [64, 1024])
def test_chat_round_trip(spark, budget):
    rng = random.Random(4)
    nasty = ["</s>[INST] ok [/INST]", "\\b\\s", "[a] b", "<r>[x] y</s>", "", None, "é ü \\", "plain words " * 30]
    rows = []
    for conv in [1, 2, 3, None]:
        for turn in range(rng.randint(3, 40)):
            role = "system" if turn == 0 and conv != 2 else rng.choice(["user", "assistant", "as]sis\\tant"])
            rows.append((conv, turn, role, rng.choice(nasty)))
    rows += [(4, None, None, None), (4, 1, "assistant", "x"), (4, 1, "assistant", "x")]
    windows = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=budget, history=16)
    got = {r.conv_id: r for r in read_back(windows).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv].masked == [r[3] or "" for r in own if r[2] == "assistant"]
    if budget == 64:
        assert windows.count() > len(got)
        for w in windows.collect():
            new = [b for b in w.formatted.split("</s>")[:-1] if not b.startswith("<r>")]
            lead = w.formatted.startswith(("[system]", "<r>[system]")) and "plain words" in w.formatted.split("</s>")[0]
            assert w.tokens <= (64 + 16 + 2 * 16 if lead else budget) or len(new) == 1  # a system turn of 64 tokens leaves the least cell


def test_quality(spark):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(80)).capitalize() + "."
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        rows.append((i, good().upper() + "!!" if bad else good()))
        labels.append((i, 0 if bad else 1))
    rows += [(1000, None), (1001, ""), (1002, "one")]
    docs = spark.createDataFrame([(*r, 5.0) for r in rows], "doc_id long, text string, row double")
    marked = spark.createDataFrame(labels + [(5000, 1), (None, 0), (7, None)], "doc_id long, quality int")
    model = train(docs, marked.filter("doc_id % 4 != 2"))
    got = {r.doc_id: r.score for r in with_score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.5) != bool(y) for i, y in labels if i % 4 == 2) <= 2
    assert with_score(docs, model).columns == ["doc_id", "text", "row", "score"]
    assert 0.5 == pytest.approx(float(fit(np.zeros((0, len(FEATURES))), np.zeros(0)).score(np.zeros((1, len(FEATURES))))[0]))
    import pyarrow as pa

    assert statistics(*text_buffers(pa.array([None, "", "A b."]))).shape == (3, len(FEATURES))


def test_urls(spark):
    rules = [("com/", False), ("example.com/en/", True), ("www.example.com/en/", False), ("net/es/", True), ("net/fr/", True)]
    urls = ["https://a.EXAMPLE.com/en/1", "http://www.example.com/en/1?x", "http://x.com/z#q", "http://x.com", "http://a.net/es/5", "http://badnet/es/5", "nothing", None, "http://a.net/es", "x://h/a://b/c"]
    urls += [f"http://s.example.com/en/{k}" for k in range(30)] + [f"http://s.example.com/de/{k}" for k in range(30)] + ["http://new.org/en/4", "http://new.org/de/9"]
    pages = rule_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules)
    got = {r.page_id: r for r in pages.collect()}
    assert [got[i].rule for i in range(10)] == ["example.com/en/", "www.example.com/en/", "com/", None, "net/es/", None, None, None, None, None]
    assert (got[0].host, got[0].path, got[3].path, got[6].host, got[7].path, got[9].host, got[9].path) == ("a.example.com", "/en/1", "", "", "", "h", "/a://b/c")
    out = method_verdicts(pages, pages.selectExpr("host", "path", "cast(blocked as int) bad")).collect()
    assert len(out) == len(urls)
    new = {r.url: r.rejected for r in out if r.host == "new.org"}
    assert new == {"http://new.org/en/4": True, "http://new.org/de/9": False}
    empty = pages.limit(0)
    assert method_verdicts(empty, empty.selectExpr("host", "path", "cast(blocked as int) bad")).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 12)).astype(np.float32)
    v[50] = v[51]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(700, None), (701, [0.0] * 12), (702, [1.0] * 11 + [None]), (703, [1.0] * 11 + [float("nan")]), (704, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    w = v.astype(np.float64)
    for factor, least in ((1.0, 1.0), (1.3, 0.9)):
        hits = total = 0
        got = {}
        for r in nearest(table, table.filter("vec_id % 50 = 0"), k=5, factor=factor, shard_size=200, block=4).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        assert set(got) == set(range(0, 600, 50))
        for q, found in got.items():
            d = np.sqrt(((w - w[q]) ** 2).sum(1))
            d[q] = np.inf
            want = np.lexsort((np.arange(600), d))[:5]
            hits += len({x for x, _ in found.values()} & set(want.tolist()))
            total += 5
            assert [found[k + 1][1] for k in range(5)] == sorted(x for _, x in found.values())
            assert all(abs(d[i] - s) < 1e-12 for i, s in found.values())
        assert hits / total >= least
    assert nearest(table.limit(0), table).count() == 0


def test_deep_paths_inherit(spark):
    bad = [("a", f"/en/{x}", 1) for x in ("p", "q", "r", "s", "t", "u", "v", "w")] * 3 + [("a", f"/fr/{x}", 0) for x in ("p", "q", "r", "s")] * 3
    deep = ["/en/a/b/c/d/e", "/en/a/b/c/d/e/f", "/en/a/b/c/d/e/", "/en/a/b/c/d/e/f/g/", "//en/a/b/c/d/e/f", "/fr/a/b/c/d/e/f"]
    pages = spark.createDataFrame([("b", p) for p in deep], "host string, path string")
    judged = spark.createDataFrame(bad + [("b", p, None) for p in deep], "host string, path string, bad int")
    rows = method_verdicts(pages, judged).collect()
    assert len(rows) == len(deep)
    assert {r.path: r.rejected for r in rows} == {p: p != deep[-1] for p in deep}
