"""Verification of a build: rules over rows and stored tables against rebuilt ones make one table of violations, reported by rule.

Nothing stops at the first error: all violations are counted, and the first few of each rule are named.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.operators.evidence import violations

NONE = "rule string, key string"


def _named(key: list[str]) -> Column:
    """A key as text, with a null as its name."""
    return F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key))


def row_violations(table: str, rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(rule, key) for every rule (name: what must hold; null doesn't) that a row breaks, in one scan; rules are named `table: rule`."""
    return violations(rows, key, rules).select(_named(key).alias("key"), F.explode("errors").alias("r")).select(F.concat(F.lit(f"{table}: "), "r").alias("rule"), "key")


def rebuild_violations(table: str, stored: DataFrame, rebuilt: DataFrame, key: list[str]) -> DataFrame:
    """(rule, key) where a stored table isn't what is rebuilt: `missing`, `unexpected`, `repeated` and `differs` keys, from one scan of each.

    Rows are compared by a digest of all columns of rebuilt, so that only keys and digests are shuffled. Repeated keys aren't compared further.
    """
    values = [c for c in rebuilt.columns if c not in key]
    texts = (F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (F.col(c).cast("string") for c in values))
    digest = F.sha2(F.concat(F.lit(""), *texts), 256)
    side = lambda rows, name: rows.select(*key, F.lit(name == "s").cast("int").alias("s"), F.lit(name == "r").cast("int").alias("r"), digest.alias("d"))
    both = side(stored, "s").unionByName(side(rebuilt, "r")).groupBy(*key).agg(F.sum("s").alias("s"), F.sum("r").alias("r"), (F.min("d") != F.max("d")).alias("differs"))
    wrong = F.when(F.col("s") == 0, "missing").when(F.col("s") > 1, "repeated").when(F.col("r") == 0, "unexpected").when(F.col("differs"), "differs")
    return both.select(wrong.alias("w"), _named(key).alias("key")).filter("w is not null").select(F.concat(F.lit(f"{table}: "), "w").alias("rule"), "key")


def report(spark: SparkSession, found: list[DataFrame], rules: list[str] = (), first: int = 20) -> DataFrame:
    """By rule: n and the first keys in order. Rules that are given and never broken have 0 and no keys.

    A rule that all rows break is no large group: its count is added up before the shuffle and its first keys are taken in each task.
    """
    rows = reduce(lambda a, b: a.unionByName(b), found, spark.createDataFrame([], NONE))
    counts = rows.groupBy("rule").agg(F.count("*").alias("n"))
    if rules:
        named = spark.createDataFrame([(r,) for r in rules], "rule string")
        counts = named.join(counts, "rule", "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    place = Window.partitionBy("rule").orderBy("key")
    named = rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= first).groupBy("rule").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "key"))), lambda x: x["key"]).alias("keys"))
    return counts.join(named, "rule", "left").select("rule", "n", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))


def require(reported: DataFrame, named: int = 50) -> None:
    """Raises ValueError, with the first broken rules and their first keys, unless nothing was found."""
    broken = reported.filter("n > 0").orderBy("rule").limit(named).collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['n']} ({', '.join(r['keys'][:3])})" for r in broken))
