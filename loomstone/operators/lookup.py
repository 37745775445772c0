"""Lookups over evidence: presence filters with a trace, ranking, paging and filling up."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.text import content_tokens, rotation_key
from loomstone.operators.evidence import numbered


def axis_table(rows: DataFrame, key: list[str], axes: dict[str, Column]) -> DataFrame:
    """The bridge (key..., axis): one row for each axis that a row shows."""
    names = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in axes.items())), lambda x: x.isNotNull())
    return rows.select(*key, F.explode(names).alias("axis"))


def postings(bridge: DataFrame, group: str, key: str, block: int = 4096) -> DataFrame:
    """An inverted index: (group, axis, block) with its sorted keys and their number; a block holds a range of `block` numeric keys, so no row grows with the table."""
    return bridge.groupBy(group, "axis", F.floor(F.col(key) / block).alias("block")).agg(F.sort_array(F.collect_list(key)).alias("ids"), F.count("*").alias("n"))


def intersect_postings(index: DataFrame, group: str, axes: list[str]) -> DataFrame:
    """Keys that all axes (distinct, at least one) have, from the blocks of an index (see postings): group and key, as `id`; no text is read.

    Blocks that lack an axis are skipped before their keys are read: names and numbers of blocks alone are counted first. The others meet by block, a row for each axis, and are
    intersected from the shortest list on; a list that is empty ends it.
    """
    wanted = index.filter(F.col("axis").isin(*axes))
    full = wanted.groupBy(F.col(group).alias("__g"), F.col("block").alias("__b")).agg(F.count("*").alias("__n")).filter(F.col("__n") == len(set(axes)))
    met = wanted.join(full, F.col(group).eqNullSafe(F.col("__g")) & (F.col("block") == F.col("__b")), "left_semi")
    lists = met.groupBy(group, "block").agg(F.array_sort(F.collect_list(F.struct("n", "ids"))).alias("lists"))
    rest = F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(0)))
    both = F.aggregate(rest, F.col("lists")[0]["ids"], lambda held, x: F.when(F.size(held) > 0, F.array_intersect(held, x["ids"])).otherwise(held))
    return lists.select(group, F.explode(both).alias("id"))


def coverage(bridge: DataFrame, group: str, grid: DataFrame) -> DataFrame:
    """Rows of each (group, axis) of a grid; null, not 0, where there are none."""
    return grid.join(bridge.groupBy(group, "axis").agg(F.count("*").alias("n")), [group, "axis"], "left")


def conjunctive(rows: DataFrame, axes: dict[str, Column]) -> DataFrame:
    """Rows that show all axes."""
    return rows.filter(reduce(lambda a, b: a & b, axes.values(), F.lit(True)))


def filter_trace(rows: DataFrame, group: str, axes: dict[str, Column]) -> DataFrame:
    """How many rows of each group remain after each axis in turn, in one pass: group, step, axis, remaining."""
    steps, so_far = [], F.lit(True)
    for k, (name, shows) in enumerate(axes.items()):
        so_far = so_far & shows
        steps.append(F.struct(F.lit(k + 1).alias("step"), F.lit(name).alias("axis"), F.count_if(so_far).alias("remaining")))
    return rows.groupBy(group).agg(F.array(*steps).alias("steps")).select(group, F.inline("steps"))


def leave_one_out(rows: DataFrame, group: str, axes: dict[str, Column]) -> DataFrame:
    """For each axis, how many rows show all the others, where that is more than show all: group, axis, without, gain."""
    bits = reduce(lambda a, b: a + b, (F.when(c, 0).otherwise(1 << k) for k, c in enumerate(axes.values())))
    one_pass = rows.withColumn("__missing", bits).groupBy(group).agg(
        F.count_if(F.col("__missing") == 0).alias("all"), F.array(*(F.struct(F.lit(n).alias("axis"), F.count_if(F.col("__missing") == (1 << k)).alias("gain")) for k, n in enumerate(axes))).alias("g")
    )
    return one_pass.select(group, "all", F.inline("g")).filter("gain > 0").select(group, "axis", (F.col("all") + F.col("gain")).alias("without"), "gain")


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with rank; the order should end in a unique key."""
    place = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def core_then_top_up(core: DataFrame, extended: DataFrame, key: str, group: str, order: list[Column], most: int = 15) -> DataFrame:
    """Core rows first, then extended ones that aren't core, up to most for each group; tier is 0 or 1."""
    tiers = core.withColumn("tier", F.lit(0)).unionByName(extended.join(core.select(key), key, "left_anti").withColumn("tier", F.lit(1)))
    return top_k(tiers, [group], [F.col("tier"), *order], most)


def band_pages(rows: DataFrame, group: str, score: list[Column], seed: str | Column, key: str, page: int = 30) -> DataFrame:
    """An order for paging in which each page spans all scores: adds band, place (in the band) and page.

    Rows in score order are cut into `page` bands at floor((b + 1) * n / page); inside a band they stand by rotation
    key, largest first; page j takes the j-th of each band.
    """
    out = numbered(rows, [group], score, "__i")
    sizes = out.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"))
    out = out.join(sizes, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
    width = F.col("__n") / F.lit(float(page))
    bands = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(page - 1)), lambda k: (k == page - 1) | (F.floor((k + 1) * width) > F.col("__i"))))
    out = out.withColumn("band", F.when(F.col("__n") <= page, F.lit(0)).otherwise(bands))
    inside = Window.partitionBy(group, "band").orderBy(rotation_key(seed, F.col(key)).desc(), F.col(key))
    out = out.withColumn("place", F.row_number().over(inside) - 1)
    return out.withColumn("page", F.when(F.col("__n") <= page, F.lit(0)).otherwise(F.col("place"))).drop("__i", "__n")


def page_bounds(total: Column, offset: Column, page: int = 30) -> Column:
    """The first row of a page: offset floored and clamped to the last page's start."""
    last = F.floor((F.greatest(total, F.lit(1)) - 1) / page) * page
    return F.least(F.greatest(F.floor(offset), F.lit(0)), last)


def diverse_pages(rows: DataFrame, group: str, score: list[Column], seed: str | Column, key: str, text: str, page: int = 30) -> DataFrame:
    """The whole order of each group: pages as in band_pages, each diversified in itself. Returns group, key, page, place (from 1).

    A page is taken band by band, so best rows first; a group of no more than a page is one page in order of score.
    """
    return in_pages(band_pages(rows, group, score, seed, key, page), group, score, key, text)


def in_pages(paged: DataFrame, group: str, score: list[Column], key: str, text: str) -> DataFrame:
    """Rows of whole pages (see band_pages), each page diversified in itself: group, key, page, place (from 1)."""
    own = F.to_json(F.struct(F.col(group).alias("g"), F.col("page").alias("p")))
    inside = Window.partitionBy("__page").orderBy("band", *score, F.col(key))
    paged = paged.withColumn("__page", own).withColumn("__order", F.row_number().over(inside))
    kind = dict(paged.dtypes)[group]
    found = diversify(paged, "__page", "__order", key, text).withColumn("__page", F.from_json("__page", f"g {kind}, p int"))
    return found.select(F.col("__page.g").alias(group), key, F.col("__page.p").alias("page"), "place")


def diversify(rows: DataFrame, group: str, order: str, key: str, text: str, penalty: float = 2.5) -> DataFrame:
    """Greedy re-ordering of each (bounded) group: rows like those already taken stand back. Returns group, key, place (from 1).

    The choice of each row depends on all before it, so a group is one call; groups are pages of some thirty rows. A list of
    at most two stays as it is. The value of position i among those left is (n - i) / n less penalty times the largest overlap with a chosen row.
    """
    kinds = f"{group} {dict(rows.dtypes)[group]}, {key} {dict(rows.dtypes)[key]}, place int"

    def pick(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values([order, key])
        tokens = [set(t) for t in page["tokens"]]
        left, chosen, n = list(range(len(page))), [], len(page)
        worst = [0.0] * n
        while left and n > 2:
            at = max(range(len(left)), key=lambda i: ((n - i) / n - penalty * worst[left[i]], -i))
            one = left.pop(at)
            chosen.append(one)
            for other in left:
                least = min(len(tokens[one]), len(tokens[other]))
                worst[other] = max(worst[other], len(tokens[one] & tokens[other]) / least if least else 0.0)
        page = page.iloc[chosen + left]
        return pd.DataFrame({group: page[group], key: page[key], "place": range(1, len(page) + 1)})

    return rows.select(group, key, order, content_tokens(F.col(text)).alias("tokens")).groupBy(group).applyInPandas(pick, kinds)
