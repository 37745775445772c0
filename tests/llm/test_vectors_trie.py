"""Exact top-k, vector codes and the conversation trie against brute force, with odd rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import prefix_trie, topk, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int, id string, score string, part string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "y", "z") for i, v, lab in rows], VECTORS)


def brute_top(rows, k, asked):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in kept:
        if asked(q):
            found = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in kept if c != q)[:k]
            out |= {(q, rank + 1, c, -s) for rank, (s, c) in enumerate(found)}
    return out


ODD = [(None, [1.0, 2.0], 1), (900, None, 1), (901, [1.0, None], 1), (902, [float("nan"), 1.0], 2), (903, [float("inf"), 0.0], 2)]


@pytest.mark.parametrize("shape", ["plain", "ties", "short", "wide", "huge"])
def test_top_k_equals_brute_force(spark, shape):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 6).tolist(), i % 3) for i in range(240)]
    if shape == "ties":  # a third are one vector, another third its opposite or zero
        rows = [(i, [[0.5, -1.0], [0.5, -1.0], [0.0, 0.0], [-0.5, 1.0]][i % 4] if i % 7 else v[:2], y) for i, v, y in rows]
    if shape == "short":
        rows = [(i, v[: i % 7], y) for i, v, y in rows]
    if shape == "wide":
        rows = [(i, (rng.normal(0, 1, 400) * 10.0 ** rng.integers(-3, 4)).tolist(), y) for i, _, y in rows[:60]]
    if shape == "huge":  # beyond what doubles hold exactly
        rows = [(i, [x * 2.0**20 for x in v], y) for i, v, y in rows]
    rows += ODD
    table = vectors_of(spark, rows)
    index = topk.build_index(table, shard_size=50, levels=16)
    got = {tuple(r) for r in topk.search(index, table.filter("vec_id % 10 = 0"), k=5, block=7).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_top(rows, 5, lambda q: q % 10 == 0)


def test_top_k_stops_on_proof_and_has_small_tables(spark):
    rng = np.random.default_rng(6)
    points = rng.integers(-50, 50, (2000, 8)).astype(np.int64)
    points[:, 0] *= 40  # one dimension decides
    shard = topk.Shard.build(np.arange(2000), points, 64)
    for q in range(20):
        found, scores, share = shard.search(points[q], q, 5, None)
        want = sorted((-int(points[q] @ p), i) for i, p in enumerate(points) if i != q)[:5]
        assert [(-int(s), int(i)) for i, s in zip(found, scores)] == want
        assert share < 1
    few = vectors_of(spark, [(0, [1.0], 1), (50, [2.0], 1), (50, [2.0], 1), (50, [3.0], 1)])
    got = sorted(tuple(r) for r in topk.search(topk.build_index(few), few.filter("vec_id = 50")).collect())
    assert got == [(50, 1, 0, 256 * 512), (50, 1, 0, 256 * 768)]  # once for each different vector
    none = vectors_of(spark, [])
    assert topk.search(topk.build_index(none), few).count() == 0
    assert topk.search(topk.build_index(few), none).count() == 0


def brute_codes(rows, parts, entries, rounds, scale):
    kept = sorted((i, tuple(int(np.floor(scale * x)) for x in v), y) for i, v, y in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v))
    width = len(kept[0][1]) // parts
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(part(v, p), e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            at = [near(v, p)[1] for _, v, _ in kept]
            for e in set(at):
                own = [part(v, p) for (_, v, _), k in zip(kept, at) if k == e]
                new[p][e] = tuple(sum(x) // len(own) for x in zip(*own))
        books = new
    out = [(i, [near(v, p) for p in range(parts)], y) for i, v, y in kept]
    errors = {}
    for _, found, y in out:
        errors[y] = errors.get(y, 0) + sum(d for d, _ in found)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {(i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), errors[y]) for i, found, y in out}, digest


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(0, 1, 8) + i % 5).tolist() if i % 3 else [0.25] * 8, None if i % 4 == 0 else i % 4) for i in range(1, 200)]
    table = vectors_of(spark, rows + ODD).repartition(7)
    coded, books = vector_codes.encode(table, parts=4, entries=16, rounds=4, scale=64)
    got = {tuple(r) for r in coded.select("vec_id", vector_codes.code_string("entries"), "error", "label_error").collect()}
    want, digest = brute_codes(rows, 4, 16, 4, 64)
    assert got == want and vector_codes.codebooks_digest(books) == digest
    few = vectors_of(spark, rows[:3])
    coded, books = vector_codes.encode(few, parts=2, entries=256, rounds=1, scale=1024)
    assert books.shape == (2, 3, 4) and {tuple(r) for r in coded.select("vec_id", vector_codes.code_string("entries"), "error", "label_error").collect()} == brute_codes(rows[:3], 2, 256, 1, 1024)[0]
    none, books = vector_codes.encode(vectors_of(spark, ODD))
    assert books is None and none.count() == 0


@pytest.mark.parametrize("rows", [[(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 6, 1)], [(1, [1e9] * 4, 1)]])
def test_codes_refuse_what_cannot_be_cut_or_summed(spark, rows):
    with pytest.raises(ValueError):
        vector_codes.encode(vectors_of(spark, rows))


def brute_trie(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in by.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seq = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append((c, len(seq)))
    words = lambda x: len([w for w in x.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w])
    kids = {}
    for node in nodes:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    out = set()
    for node, members in nodes.items():
        inside = [n for n in nodes if n[: len(node)] == node]
        saved = sum((len(nodes[n]) - 1) * words(n[-1][1]) for n in inside if n)
        ends = ",".join(str(c) for c in sorted(c for c, k in members if k == len(node)))
        parent = min(nodes[node[:-1]])[0] if node else None
        out.add((min(members)[0], len(node), parent, len(members), len(kids.get(node, [])), sum(n not in kids for n in inside), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


TURNS = "conv_id long, turn long, role string, text string, part string, number string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)


@pytest.mark.parametrize("per_partition", [3, 40, 200_000])
def test_trie_equals_brute_force(spark, per_partition):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(120):
        if c % 20 == 0 and c % 40:  # absent bases
            continue
        if c % 3 == 0:  # copies of one conversation
            rows += [(c, t, "user", f"same {t}") for t in range(4)]
        else:
            rows += [(c, t, ["user", "assistant"][t % 2], ["a b", "a", "", None, "x\ty\x0bz"][int(rng.integers(0, 5))]) for t in range(int(rng.integers(1, 6)))]
    rows += [(7, None, None, "first of all"), (500, 0, "user", "alone"), (None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(501, t, "user", "long " * 2000) for t in range(300)] + [(503, t, "user", "long " * 2000) for t in range(299)]
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_strings(turns_of(spark, rows))), per_partition)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_trie(rows)


def test_trie_of_one_hot_conversation_over_many_partitions(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(400) for t in range(3)] + [(c, 0, "user", "other") for c in range(400, 440)]
    found = [tuple(r) for r in prefix_trie.conversation_trie(turns_of(spark, rows), 50).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(turns_of(spark, [])).count() == 0
    assert prefix_trie.conversation_trie(turns_of(spark, [(None, 1, "a", "b")])).count() == 0
    # A base that is absent and a conversation that has fewer turns than it would borrow: no turns are left, it is a member of the root alone.
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    got = [tuple(r) for r in prefix_trie.conversation_trie(turns_of(spark, [(lone, 0, "a", "b")])).collect()]
    assert got == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_words_of_turns_are_counted_as_the_contract_says(spark):
    strings = prefix_trie.turn_strings(turns_of(spark, [(1, 0, "u", "a b  c\x0bd\x1ce")])).select(F.unhex("string").alias("s")).first()
    assert int.from_bytes(bytes(strings["s"])[-8:], "big") == 3
