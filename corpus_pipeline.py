"""A training-data pipeline over documents: each stage reads what the one before it kept.

quality (drop what the classifier rejects), near_duplicates (one document of each group stays), repeats (repeated
passages are cut out), decontamination (documents that hold benchmark items go), packing (pieces of token sequences).

Defined results: a null text counts as empty in every stage and stays null; rows with a null doc_id stay unless rejected or contaminated; of rows with
one doc_id one stays; further columns, whatever their names, pass through all stages but the last; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomstone.llm.decontam import decontaminated
from loomstone.llm.minhash import without_near_duplicates
from loomstone.llm.packing import pack_documents
from loomstone.llm.quality import at_least, train
from loomstone.llm.suffix_dedup import without_repeats
from loomstone.session import importable, materialized, table

LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    return at_least(docs, model, LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return without_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontamination", decontamination), ("packing", packing)]

#: Trained trees, minhash, a suffix order and a tokenizer: SQL can't express them; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
