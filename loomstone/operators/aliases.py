"""Approximate matching of names: pairs within a number of edits, from rare trigrams and, for short names, from deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.session import materialized


def trigrams(name: Column) -> Column:
    """Distinct numbered trigrams of a name with two marks at either end: a trigram that comes again counts again, by its number."""
    padded = F.concat(F.lit("\u0001\u0001"), name, F.lit("\u0002\u0002"))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    again = lambda g, i: F.concat(g, F.lit("\u0003"), F.size(F.filter(F.slice(grams, 1, i + 1), lambda x: x == g)).cast("string"))
    return F.transform(grams, again)


def deletions(name: Column, most: int) -> Column:
    """All texts that are left when up to most characters are taken out."""
    out = F.array(name)
    for _ in range(most):
        one = F.flatten(F.transform(out, lambda t: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i, t=t: i <= F.length(t)), lambda i, t=t: F.concat(F.left(t, i - 1), F.substring(t, i + 1, F.length(t))))))
        out = F.array_distinct(F.concat(out, one))
    return out


def within_edits(left: DataFrame, right: DataFrame, left_name: str, right_name: str, most: int = 2) -> DataFrame:
    """Pairs of different-or-equal names of two tables (left_name, right_name, edits) whose Levenshtein distance is most at most; names are distinct, null ones are left out.

    A name of n characters has n + 2 trigrams and an edit changes three of them at most, so of a pair both keep one of their 3 * most + 1 rarest trigrams in common if the longer one
    has more than 3 * most - 2. Pairs of shorter names have a text in common that most deletions from either leave. Candidates are verified; no pair is met otherwise.
    """
    sides = {"l": left.select(F.col(left_name).alias("n")), "r": right.select(F.col(right_name).alias("n"))}
    sides = {s: materialized(rows.filter("n is not null").distinct(), "names") for s, rows in sides.items()}
    short = 3 * most - 2  # so many characters or fewer: no trigram need be kept
    grams = {s: rows.select("n", F.explode(trigrams(F.col("n"))).alias("g")) for s, rows in sides.items()}
    held = grams["l"].unionByName(grams["r"]).groupBy("g").agg(F.count("*").alias("held"))
    place = Window.partitionBy("n").orderBy("held", "g")
    rare = {s: rows.join(held, "g").withColumn("p", F.row_number().over(place)).filter(F.col("p") <= 3 * most + 1).select(F.col("n").alias(s), "g") for s, rows in grams.items()}
    met = rare["l"].join(rare["r"], "g").filter(F.abs(F.length("l") - F.length("r")) <= most).select("l", "r")
    left_over = {s: rows.filter(F.length("n") <= short).select(F.col("n").alias(s), F.explode(deletions(F.col("n"), most)).alias("t")) for s, rows in sides.items()}
    met = met.unionByName(left_over["l"].join(left_over["r"], "t").select("l", "r")).distinct()
    edits = F.levenshtein("l", "r", most)
    return met.select(F.col("l").alias(left_name), F.col("r").alias(right_name), edits.alias("edits")).filter(F.col("edits").between(0, most))
