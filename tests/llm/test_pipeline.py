"""The pipeline's stages against brute force, over the smallest tables."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
from tests_llm_brute import components
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality":
            wrong = [i for i, q in labels.items() if q is not None and (i in after) != bool(q)]
            assert len(wrong) <= 0.03 * len(labels)
        elif name == "near_duplicates":
            assert set(after) == {i for i, (_, c) in components(list(before.items()), 80).items() if i == c}
        elif name == "repeats":
            n = 200
            counts = Counter(b[i : i + n] for t in before.values() for b in [t.encode()] for i in range(len(b) - n + 1))
            for i, t in before.items():
                b = t.encode()
                mask = bytearray(len(b))
                for s in range(len(b) - n + 1):
                    if counts[b[s : s + n]] > 1:
                        mask[s : s + n] = b"\1" * n
                kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
                edges = 2 * bytes(mask).count(b"\0\1") + 2  # bytes of characters that a span cuts stay
                assert len(kept) <= len(after[i].encode()) <= len(kept) + edges
        elif name == "decontamination":
            assert set(before) - set(after) == {i for i, t in before.items() if any(x in t for x in items)}
        if name != "packing":
            before = after
    rows = docs.collect()
    texts = list(before.values())
    total = sum(len(x.ids) + 1 for x in Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode_batch(texts, add_special_tokens=False))
    assert sum(r.length for r in rows) == total
    assert len({r.sequence_id for r in rows}) <= total / 2048 * 1.03 + 2
