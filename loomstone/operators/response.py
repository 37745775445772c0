"""Lookups as one job: requests are checked, their axes applied or named unavailable, and answered with counts and evidence.

What a request is told in numbers follows from how many core and how many other records show each set of axes. Those counts, a row for each situation and set, are all that requests
meet, so a request costs no scan. Evidence is ordered once for each different query that is asked (a situation and a set of axes), however many requests ask it.

Defined results: a request with an unknown or null situation or an unknown axis is refused, says so, and gets nothing else; null axes mean that the fields decide; a repeated axis counts once;
an offset that is null, not a number or below 0 is 0; a situation without records gives zeros.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.text import is_blank
from loomstone.operators.lookup import band_pages, in_pages
from loomstone.session import materialized

#: Records of the first view, and of a page of the wider one (fixed values).
SELECTED, PAGE = 15, 30


def axis_bits(shows: dict[str, Column]) -> Column:
    """The axes that a record shows as bits, the first axis lowest."""
    return reduce(lambda a, b: a + b, (F.when(c, 1 << k).otherwise(0) for k, c in enumerate(shows.values())), F.lit(0))


def checked(requests: DataFrame, situations: tuple[str, ...], fields: dict[str, str]) -> DataFrame:
    """requests (request_id, situation, axes, inputs, expanded, offset) with error and wanted (bits): what they ask for.

    fields has the axes in order and the input field of each. A list of axes counts even if it is empty; only without one, fields that aren't blank ask for their axes.
    """
    known = F.array(*map(F.lit, fields))
    strange = F.size(F.array_except("axes", known)) > 0
    error = F.when(~F.coalesce(F.col("situation").isin(*situations), F.lit(False)), "unknown situation").when(F.col("axes").isNotNull() & strange, "unknown axis")
    bit = lambda k, axis, field: F.when(F.when(F.col("axes").isNotNull(), F.array_contains("axes", axis)).otherwise(~is_blank(F.try_element_at("inputs", F.lit(field)))), 1 << k).otherwise(0)
    wanted = reduce(lambda a, b: a + b, (bit(k, a, f) for k, (a, f) in enumerate(fields.items())), F.lit(0))
    return requests.withColumn("error", error).withColumn("wanted", F.when(error.isNull(), wanted))


def axis_counts(evidence: DataFrame, core: DataFrame, axes: int) -> DataFrame:
    """By situation and set of axes: core and all records that show at least those. evidence and core have situation and bits.

    Records are counted by their own set first; a set's count is added to all its subsets.
    """
    exact = evidence.select("situation", "bits", F.lit(0).alias("c"), F.lit(1).alias("e")).unionByName(core.select("situation", "bits", F.lit(1).alias("c"), F.lit(0).alias("e")))
    exact = exact.groupBy("situation", "bits").agg(F.sum("c").alias("c"), F.sum("e").alias("e"))
    subsets = F.filter(F.sequence(F.lit(0), F.lit((1 << axes) - 1)), lambda s: s.bitwiseAND(F.col("bits")) == s)
    return exact.select("situation", F.explode(subsets).alias("set"), "c", "e").groupBy("situation", "set").agg(F.sum("c").alias("core"), F.sum("e").alias("all"))


def respond(requests: DataFrame, evidence: DataFrame, core: DataFrame, situations: tuple[str, ...], fields: dict[str, str]) -> DataFrame:
    """Each request with error, applied and unavailable axes, trace (core records left after each applied axis, from the base on), totals, offset and how many of core and other records are shown.

    evidence and core: situation and bits (see axis_bits); core records are evidence, too. An axis that no core record of the situation shows is unavailable.
    """
    rows = checked(requests, situations, fields)
    counts = axis_counts(evidence, core, len(fields))
    every = counts.groupBy("situation").agg(F.map_from_entries(F.collect_list(F.struct("set", F.struct("core", "all")))).alias("n"))  # 2 ** axes entries for each situation
    rows = rows.join(every.withColumnRenamed("situation", "__s"), (F.col("situation") == F.col("__s")) & F.col("error").isNull(), "left").drop("__s")
    at = lambda bits, kind: F.coalesce(F.try_element_at("n", bits)[kind], F.lit(0).cast("long"))
    there = reduce(lambda a, b: a + b, (F.when(at(F.lit(1 << k), "core") > 0, 1 << k).otherwise(0) for k in range(len(fields))), F.lit(0))
    rows = rows.withColumn("applied", F.col("wanted").bitwiseAND(there)).withColumn("missing", F.col("wanted") - F.col("applied"))
    names = lambda bits: F.filter(F.array(*(F.when(F.col(bits).bitwiseAND(1 << k) != 0, a) for k, a in enumerate(fields))), lambda x: x.isNotNull())
    so_far = [F.when((F.col("applied").bitwiseAND(1 << k) != 0), F.col("applied").bitwiseAND((1 << (k + 1)) - 1)) for k in range(len(fields))]
    steps = F.filter(F.array(F.lit(0), *so_far), lambda x: x.isNotNull())
    narrowed, wide = F.col("applied") != 0, F.coalesce("expanded", F.lit(False))
    total, core_left = at(F.col("applied"), "all"), at(F.col("applied"), "core")
    last = F.floor((F.greatest(total, F.lit(1)) - 1) / PAGE) * PAGE
    offset = F.when(F.col("offset").isNotNull() & ~F.isnan("offset") & (F.col("offset") > 0) & (F.col("offset") < float("inf")), F.least(F.floor("offset"), last)).otherwise(0)
    core_shown = F.when(wide, 0).otherwise(F.least(core_left, F.lit(SELECTED)))
    others = F.when(wide, F.least(total - offset, F.lit(PAGE))).when(narrowed, F.least(F.lit(SELECTED) - core_shown, total - core_left)).otherwise(0)
    basis = F.when(wide & narrowed, "metadata_axis_presence_extended").when(wide, "expanded_question_corpus").when(narrowed, "metadata_axis_presence").otherwise("question_core_evidence")
    answer = {
        "applied_axes": names("applied"), "unavailable_axes": names("missing"), "trace": F.transform(steps, lambda s: at(s, "core")), "extended_total": total, "page_offset": F.when(wide, offset).otherwise(0).cast("long"),
        "core_shown": core_shown.cast("long"), "extended_shown": F.greatest(others, F.lit(0)).cast("long"), "matching_basis": basis,
    }
    return rows.select("request_id", "situation", "expanded", "error", "applied", *(F.when(F.col("error").isNull(), c).alias(n) for n, c in answer.items()))


def shown_evidence(answers: DataFrame, evidence: DataFrame, core: DataFrame, key: str, score: str, text: str) -> DataFrame:
    """The records shown to each answered request (see respond): request_id, place (from 1), key, tier (0 core, 1 other).

    evidence and core: situation, key (of one record each), bits, score and text. Core records stand in an order that pushes repeats back, others in pages that span all scores. Each different query is put
    in order once; a record's key and score are copied to the queries asked of its situation whose axes it shows. Texts follow for the pages that some request is shown, and these alone are put in order inside.
    """
    told = answers.filter("error is null").withColumn("wide", F.coalesce("expanded", F.lit(False)))
    queries = told.select("situation", "applied", "wide").distinct().withColumn("query", F.to_json(F.struct("situation", "applied", "wide")))
    seed = F.concat("situation", F.lit("|"), F.col("applied").cast("string"), F.when(F.col("wide"), "").otherwise("|topup"))

    def asked(rows: DataFrame, which: Column) -> DataFrame:
        met = rows.join(queries.filter(which), "situation").filter(F.col("bits").bitwiseAND(F.col("applied")) == F.col("applied"))
        return met.select("query", F.col(key), F.col(score), seed.alias("seed"))

    def paged(rows: DataFrame, tier: int) -> DataFrame:
        return band_pages(rows, "query", [F.col(score).desc(), F.col(key)], F.col("seed"), key, PAGE).select("query", key, F.col(score), "band", "page", F.lit(tier).alias("tier"))

    own = core.select("situation", F.col(key).alias("__k")).distinct()
    rest = evidence.join(own, (evidence["situation"] == own["situation"]) & (F.col(key) == F.col("__k")), "left_anti")
    tiers = paged(asked(core, ~F.col("wide")), 0).unionByName(paged(asked(rest, ~F.col("wide") & (F.col("applied") != 0)), 1)).unionByName(paged(asked(evidence, F.col("wide")), 1))
    told = told.withColumn("query", F.to_json(F.struct("situation", "applied", "wide")))
    # A full page spans all bands; only the last pages are shorter, so a record's place in the list needs the sizes of the pages before.
    tiers = materialized(tiers, "pages")  # counted first, then read where pages are shown
    sizes = tiers.groupBy("query", "tier", "page").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("query", "tier").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    asks = told.select("query", F.when(F.col("wide"), F.col("page_offset")).otherwise(0).alias("first"), "core_shown", "extended_shown").distinct()
    until = F.col("first") + F.when(F.col("tier") == 0, F.col("core_shown")).otherwise(F.col("extended_shown"))
    some = before.join(asks, "query").filter((F.col("before") < until) & (F.col("before") + F.col("n") > F.col("first"))).select("query", "tier", "page", "before").distinct()
    told_texts = evidence.select(key, text).unionByName(core.select(key, text)).groupBy(key).agg(F.first(text).alias(text))
    shown_pages = tiers.join(some, ["query", "tier", "page"]).join(told_texts, key).withColumn("list", F.to_json(F.struct("query", "tier")))
    placed = in_pages(shown_pages, "list", [F.col(score).desc(), F.col(key)], key, text)
    where = some.withColumn("list", F.to_json(F.struct("query", "tier")))
    met = told.select("request_id", "query", "wide", "page_offset", "core_shown", "extended_shown").join(placed.join(where, ["list", "page"]), "query").withColumn("at", F.col("before") + F.col("place"))
    first = F.when(F.col("wide"), F.col("page_offset")).otherwise(0)
    many = F.when(F.col("tier") == 0, F.col("core_shown")).otherwise(F.col("extended_shown"))
    shown = met.filter((F.col("at") > first) & (F.col("at") <= first + many))
    place = F.when(F.col("tier") == 0, F.col("at")).otherwise(F.when(F.col("wide"), F.col("at") - first).otherwise(F.col("core_shown") + F.col("at")))
    return shown.select("request_id", place.cast("int").alias("place"), key, "tier")
