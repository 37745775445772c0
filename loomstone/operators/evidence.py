"""Deduplication, overlays, sampling, batches and integrity checks of record tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.text import canonical_hash
from loomstone.session import materialized


def deduplicate(rows: DataFrame, group: list[str], identity: Column, order: list[Column]) -> DataFrame:
    """The first row of each identity inside each group."""
    place = Window.partitionBy(*group, "__identity").orderBy(*order)
    return rows.withColumn("__identity", identity).withColumn("__place", F.row_number().over(place)).filter("__place = 1").drop("__identity", "__place")


def dedup_statistics(rows: DataFrame, group: str, identity: Column) -> DataFrame:
    """Rows, identities and removed rows of each group."""
    return rows.groupBy(group).agg(F.count("*").alias("rows"), F.count_distinct(identity).alias("identities")).withColumn("removed", F.col("rows") - F.col("identities"))


def cross_group_repeats(rows: DataFrame, group: str, identity: Column) -> DataFrame:
    """Identities in several groups, and the sum of their further groups."""
    each = rows.select(identity.alias("i"), group).distinct().groupBy("i").agg(F.count("*").alias("n")).filter("n > 1")
    return each.agg(F.count("*").alias("identities"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats"))


def overlay(base: DataFrame, over: DataFrame, key: list[str], column: str, source: str = "label_source", inside: bool = False) -> DataFrame:
    """base with column taken from over where it has the key; source says which. With inside, over may have no key that base hasn't: else ValueError."""
    if inside and (strange := over.join(base.select(*key), key, "left_anti").select(*key).limit(5).collect()):
        raise ValueError(f"keys that aren't in the base: {[tuple(r) for r in strange]}")
    marked = over.select(*key, F.col(column).alias("__over"), F.lit(True).alias("__has"))
    joined = base.join(marked, key, "left")
    value = F.when(F.col("__has"), F.col("__over")).otherwise(F.col(column))
    return joined.withColumn(column, value).withColumn(source, F.when(F.col("__has"), "overlay").otherwise("base")).drop("__over", "__has")


def stratified_sample(rows: DataFrame, stratum: list[str], key: list[str], seed: str, n: int) -> DataFrame:
    """The n rows of each stratum with the smallest SHA-256 of seed and key, with population, census and weight."""
    rank = Window.partitionBy(*stratum).orderBy(canonical_hash(F.lit(seed), *(F.col(k) for k in key)), *key)
    taken = rows.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= n)  # nothing else over this window, so tasks pass on n rows of a stratum
    sizes = rows.groupBy(*(F.col(c).alias(f"__{c}") for c in stratum)).agg(F.count("*").alias("population"))
    taken = taken.join(sizes, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in stratum))).drop(*(f"__{c}" for c in stratum))
    census = F.col("population") <= n
    return taken.withColumn("census", census).withColumn("weight", F.when(census, 1.0).otherwise(F.col("population") / n))


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], column: str) -> DataFrame:
    """rows numbered from 0 in each group, in two passes, so that a group is many tasks' work.

    Rows are dealt out by ranges of group and order; each range counts its rows of a group, and a range's numbers begin where those before it end.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *group, *order).withColumn("__range", F.spark_partition_id())
    dealt = materialized(dealt, "ranges")  # the ranges are drawn once
    counts = dealt.groupBy(*group, "__range").agg(F.count("*").alias("__rows"))  # a row for each group in each range
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).select(*(F.col(c).alias(f"__{c}") for c in group), F.col("__range").alias("__r"), "__before")
    inside = F.row_number().over(Window.partitionBy(*group, "__range").orderBy(*order)) - 1
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group), F.col("__range") == F.col("__r"))
    out = dealt.withColumn("__inside", inside).join(counts, same)
    return out.select(*rows.columns, (F.col("__before") + F.col("__inside")).alias(column))


def even_batches(rows: DataFrame, group: list[str], order: list[str], pieces: int) -> DataFrame:
    """Contiguous batches whose sizes differ by one at most, larger first."""
    out = numbered(rows, group, order, "__i")
    sizes = out.groupBy(*(F.col(c).alias(f"__{c}") for c in group)).agg(F.count("*").alias("__n"))
    out = out.join(sizes, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group)))
    small, larger = F.floor(F.col("__n") / pieces), F.col("__n") % pieces
    inside = F.when(F.col("__i") < larger * (small + 1), F.floor(F.col("__i") / (small + 1))).otherwise(larger + F.floor((F.col("__i") - larger * (small + 1)) / F.greatest(small, F.lit(1))))
    return out.select(*rows.columns, (inside + 1).cast("int").alias("batch"))


def chunk_numbers(rows: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """Batches of size rows, from 0."""
    return numbered(rows, group, order, "__i").select(*rows.columns, F.floor(F.col("__i") / size).alias("chunk"))


#: Tokens of the smaller side that are sent to all tasks at most.
SENT = 1_000_000


def overlapping(few: DataFrame, many: DataFrame, few_key: str, many_key: str, least: float) -> DataFrame:
    """Pairs whose arrays `tokens` (distinct) share at least that part of the smaller one: few_key, many_key, shared, overlap.

    Tokens that `few` lacks are only counted; the others are written once, a row each. Of a smaller side with n tokens all but least * n - 1, the ones that are rarest
    on the other side, are enough to meet it by; so frequent words bring nothing together, and common tokens are counted for candidates only. Rows that share a key, or have none, are rows of their own.
    """
    few = few.filter(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("__a"), F.col(few_key).alias("__key_a"), "tokens", F.size("tokens").alias("n_a"))
    few = materialized(few, "tokens")
    most, total = few.agg(F.coalesce(F.max("n_a"), F.lit(0)), F.coalesce(F.sum("n_a"), F.lit(0))).first()
    sent = F.broadcast if total <= SENT else lambda rows: rows
    of_few = few.select("__a", "n_a", F.explode("tokens").alias("token"))
    held = of_few.groupBy("token").agg(F.count("*").cast("int").alias("held"))
    many = many.filter(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("__b"), F.col(many_key).alias("__key_b"), "tokens", F.size("tokens").alias("n_b"))
    of_many = many.select("__b", "__key_b", "n_b", F.explode("tokens").alias("token"))  # numbered before: what stands beside explode() is computed after it
    hits = materialized(of_many.join(sent(held), "token"), "hits")
    seen = hits.groupBy("token").agg(F.count("*").alias("seen"))
    enough = lambda n: F.col(n) - F.greatest(F.ceil(F.col(n) * least - 1e-9), F.lit(1)) + 1
    # Tokens that the other side lacks come first and bring nothing together.
    place = F.row_number().over(Window.partitionBy("__a").orderBy(F.coalesce("seen", F.lit(0)), "token"))
    rare = of_few.join(seen, "token", "left").withColumn("place", place).filter((F.col("place") <= enough("n_a")) & F.col("seen").isNotNull()).select("__a", "n_a", "token")
    met = hits.join(sent(rare), "token").filter("n_a <= n_b").select("__a", "__b")
    own = Window.partitionBy("__b")
    short = hits.filter(F.col("n_b") < most).withColumn("lacking", F.col("n_b") - F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("held", "token")))
    short = short.filter(F.col("place") + F.col("lacking") <= enough("n_b"))
    met = materialized(met.unionByName(short.join(sent(of_few), "token").filter("n_b < n_a").select("__a", "__b")).distinct(), "met")
    whole = hits.join(met.select("__b").distinct(), "__b", "left_semi").groupBy("__b").agg(F.first("__key_b").alias("__key_b"), F.first("n_b").alias("n_b"), F.collect_list("token").alias("tokens_b"))
    both = met.join(sent(few), "__a").join(whole, "__b").withColumn("shared", F.size(F.array_intersect("tokens", "tokens_b")).cast("long"))
    out = both.withColumn("overlap", F.round(F.col("shared") / F.least("n_a", "n_b"), 9)).filter(F.col("overlap") >= least)
    return out.select(F.col("__key_a").alias(few_key), F.col("__key_b").alias(many_key), "shared", "overlap")


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def reconcile(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side."""
    return expected.exceptAll(observed).withColumn("only_in", F.lit("expected")).unionByName(observed.exceptAll(expected).withColumn("only_in", F.lit("observed")))


def key_reconciliation(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys only one side has, and both."""
    a = left.select(key).distinct().withColumn("__l", F.lit(1))
    b = right.select(key).distinct().withColumn("__r", F.lit(1))
    side = F.when(F.col("__l").isNull(), "right").when(F.col("__r").isNull(), "left").otherwise("both")
    return a.join(b, key, "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("keys"))


def exact_partition(parts: DataFrame, whole: DataFrame, part: str, key: str) -> DataFrame:
    """Whether parts' keys make up the whole without overlap: rows, distinct, expected, missing, foreign."""
    seen = parts.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("distinct_keys"), F.count_distinct(part).alias("parts"))
    missing = whole.select(key).join(parts.select(key), key, "left_anti").agg(F.count("*").alias("missing"))
    foreign = parts.select(key).join(whole.select(key), key, "left_anti").agg(F.count("*").alias("foreign"))
    return seen.crossJoin(missing).crossJoin(foreign).crossJoin(whole.agg(F.count("*").alias("expected")))


def violations(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of all they break; a null rule is broken."""
    broken = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), None).otherwise(F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return rows.select(*key, broken.alias("errors")).filter(F.size("errors") > 0)


def append_new(existing: DataFrame | None, batch: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a batch whose keys are not there yet; within the batch the first by all columns."""
    place = Window.partitionBy(*key).orderBy(*batch.columns)
    once = batch.withColumn("__place", F.row_number().over(place)).filter("__place = 1").drop("__place")
    return once if existing is None else once.join(existing.select(*key), key, "left_anti")
