"""Review of evidence: rules from core records, blinded cards, expectations, a referee for generated text, terminology and query checks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.intervals import any_window, intervals
from loomstone.functions.text import canonical_term, numbers_in


def rules_from_core(core: DataFrame, bridge: DataFrame, group: str, key: str, preview: int = 3) -> DataFrame:
    """For each (group, axis) of core records: how many show it, the first few by key, and all."""
    ids = F.sort_array(F.collect_list(key))
    return core.select(group, key).join(bridge, [group, key]).groupBy(group, "axis").agg(F.count("*").alias("n"), F.slice(ids, 1, preview).alias("preview"), ids.alias("all"))


def requested_axes(requests: DataFrame, rules: DataFrame, group: str) -> DataFrame:
    """Each requested axis with its rule's count, or marked unavailable; none is dropped."""
    return requests.join(rules.select(group, "axis", "n"), [group, "axis"], "left").select(group, "axis", "n", F.when(F.col("n").isNull(), "unavailable").otherwise("applied").alias("state"))


def with_core_marker(rows: DataFrame, core: DataFrame, key: str) -> DataFrame:
    return rows.join(core.select(key).distinct().withColumn("__core", F.lit(True)), key, "left").withColumn("in_core", F.coalesce("__core", F.lit(False))).drop("__core")


def leaks(cards: DataFrame, key: list[str], allowed: list[str], forbidden: str, label: Column) -> DataFrame:
    """Cards that give their label away: a forbidden pattern in a field, or a field that equals the label."""
    if set(cards.columns) - {"__label"} != set(allowed):
        raise ValueError(f"cards have other columns than {allowed}")
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in allowed if c not in key]
    pattern = F.exists(F.array(*texts), lambda t: t.rlike(forbidden))
    same = F.exists(F.array(*texts), lambda t: t == label.cast("string"))
    return cards.filter(pattern | same).select(*key, pattern.alias("by_pattern"), same.alias("by_value"))


def merged_expectations(built_in: DataFrame, filed: DataFrame, key: list[str], value: str) -> DataFrame:
    """The union of two expectation tables; a key that both have with other values is a conflict."""
    both = built_in.withColumnRenamed(value, "__a").join(filed.withColumnRenamed(value, "__b"), key, "full_outer")
    conflict = F.col("__a").isNotNull() & F.col("__b").isNotNull() & (F.col("__a") != F.col("__b"))
    return both.select(*key, F.coalesce("__a", "__b").alias(value), conflict.alias("conflict"))


def regression_problems(expected: DataFrame, observed: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Expected rows whose observation is missing or differs, with what is wrong."""
    joined = expected.alias("e").join(observed.withColumn("__seen", F.lit(True)).alias("o"), key, "left")
    found = [F.when(F.col("__seen").isNull(), F.lit("missing_record"))] + [F.when(F.col("__seen") & ~F.col(f"e.{c}").eqNullSafe(F.col(f"o.{c}")), F.lit(c)) for c in columns]
    return joined.select(*key, F.filter(F.array(*found), lambda x: x.isNotNull()).alias("problems")).filter(F.size("problems") > 0)


def referee(paragraphs: DataFrame, allowed_numbers: Column, banned: str, most_chars: int = 320) -> DataFrame:
    """paragraphs (text) with what stands against each: length, a question, banned wording, numbers that no source has."""
    against = {
        "too_long": F.length("text") > most_chars,
        "question": F.contains("text", F.lit("?")),
        "banned_wording": F.col("text").rlike(banned),
        "unsupported_number": F.size(F.array_except(numbers_in(F.col("text")), allowed_numbers)) > 0,
    }
    return paragraphs.withColumn("against", F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in against.items())), lambda x: x.isNotNull()))


# Wording that directs, wording that claims something of a person, and question marks.
DIRECTION = (
    r"복용을\s*(?:중단|시작|계속)",
    r"(?:끊|중단하|시작하)(?:으)?세요",
    r"용량을\s*(?:줄|늘)",
    r"(?:줄이|늘리|올리|낮추)세요",
    r"드시지\s*(?:마|말)",
    r"드세요|복용하세요|섭취하세요",
    r"권(?:장|고)합니다|권해\s*드립니다|추천(?:합니다|드립니다)",
    r"안전합니다|위험합니다|해롭습니다|괜찮습니다",
    r"피하(?:세요|셔야)",
    r"(?:상한|한도)(?:은|는|을|를)?\s*\d",
)
PERSONAL_CLAIM = (r"당신(?:의|에게|은|이)", r"환자분(?:께|에게|은)\s*(?:는|)\s*(?:안전|위험)", r"(?:틀림없|분명히|반드시)\s*")
QUESTION = "[?？]"
# End of fixed values.


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def _wording(text: Column) -> list[Column]:
    """Direction and personal claim: the first pattern of either that stands in text, by its name; else null."""
    return [F.concat(F.lit(f"{name}:"), F.coalesce(*(F.when(text.rlike(p), F.lit(p)) for p in patterns))) for name, patterns in (("direction", DIRECTION), ("personal_claim", PERSONAL_CLAIM))]


def _unsupported(text: Column, allowed: Column) -> Column:
    """The first number of text that isn't allowed; else null."""
    return F.concat(F.lit("unsupported_number:"), F.get(F.array_except(numbers_in(text), allowed), F.lit(0)))


def line_reason(line: Column, allowed_text: Column, most_chars: int = 150) -> Column:
    """Why a line about one record can't stand: the first reason, or null if there is none; a null line has no text."""
    text = _stripped(line)
    plain = (F.when(text == "", "empty"), F.when(F.length(text) > most_chars, "too_long"), F.when(text.rlike(QUESTION), "question"))
    return F.coalesce(*plain, *_wording(text), _unsupported(text, numbers_in(F.coalesce(allowed_text, F.lit("")))))


def cited_referee(paragraphs: DataFrame, records: DataFrame, key: str, most: int = 4, most_chars: int = 320, most_refs: int = 3) -> DataFrame:
    """For each response (key) what stands against it, in order of its paragraphs; none means that it can be shown.

    paragraphs has key, place, text, ids (of records) and shared, a text whose numbers each paragraph of the response may use; records has id and text. Numbers
    must stand in shared or in a record that the paragraph itself cites. Paragraphs without text don't count; a response of only such ones is `empty`.
    """
    text = _stripped(F.col("text"))
    inside = Window.partitionBy(key).orderBy(F.col("text") == "", "place")
    rows = paragraphs.select(key, "place", text.alias("text"), "shared", F.filter("ids", lambda i: i.isNotNull()).alias("ids"))
    rows = rows.withColumn("index", F.row_number().over(inside) - 1).withColumn("n", F.coalesce(F.size("ids"), F.lit(0)))
    cited = rows.select(key, "index", "text", "shared", "n", F.posexplode_outer("ids").alias("at", "id"))
    cited = cited.join(records.select("id", numbers_in(F.coalesce("text", F.lit(""))).alias("numbers")), "id", "left")
    unknown = F.min(F.when(F.col("id").isNotNull() & F.col("numbers").isNull(), F.struct("at", "id"))).alias("unknown")
    each = cited.groupBy(key, "index").agg(F.first("text").alias("text"), F.first("shared").alias("shared"), F.first("n").alias("n"), F.flatten(F.collect_list("numbers")).alias("numbers"), unknown)
    of = lambda name, *more: F.concat_ws(":", F.lit(name), F.col("index").cast("string"), *more)
    direction, claim = (F.regexp_replace(w, "^([a-z_]+):", F.concat(F.lit("$1:"), F.col("index").cast("string"), F.lit(":"))) for w in _wording(F.col("text")))
    number = F.array_except(numbers_in(F.col("text")), F.array_union(numbers_in(F.coalesce("shared", F.lit(""))), "numbers"))
    against = [
        F.when(F.length("text") > most_chars, of("too_long")),
        F.when(F.col("text").rlike(QUESTION), of("question")),
        direction,
        claim,
        F.when(F.col("unknown").isNotNull(), of("unknown_record", F.col("unknown.id").cast("string"))),
        F.when(F.col("n") > most_refs, of("too_many_refs", F.col("n").cast("string"))),
        F.when(F.size(number) > 0, of("unsupported_number", F.get(number, F.lit(0)))),
    ]
    some = F.col("text") != ""
    found = each.withColumn("against", F.filter(F.array(*against), lambda x: x.isNotNull()))
    found = found.groupBy(key).agg(F.count_if(some).alias("n"), F.flatten(F.transform(F.sort_array(F.collect_list(F.when(some, F.struct("index", "against")))), lambda s: s["against"])).alias("against"))
    many = F.when(F.col("n") > most, F.array(F.lit("too_many_paragraphs"))).otherwise(F.array().cast("array<string>"))
    return found.select(key, F.when(F.col("n") == 0, F.array(F.lit("empty"))).otherwise(F.concat(many, "against")).alias("rejections"))


def rows_digest(columns: list[str]) -> Column:
    """An aggregate: a digest of a set of rows that doesn't depend on their order or partitions, from sums of parts of each row's sha256.

    Each value stands with its length before it, a null as a minus, so that no two rows have one text. Repeated rows count.
    """
    texts = (F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (F.col(c).cast("string") for c in columns))
    row = F.sha2(F.concat(*texts), 256)
    parts = (F.coalesce(F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for at in (1, 16, 31, 46))
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), *parts), 256)


def lock_receipt(cards: DataFrame, labels: DataFrame, key: list[str], truth_opened: bool = False) -> DataFrame:
    """One row that fixes labels before the truth is opened: cards without a label (missing), labels without a card (extra), counts, digests of both and the time.

    With missing or extra keys the labels' digest is null, so that the receipt isn't accepted (see check_receipt).
    """
    keys = lambda rows, a, b: rows.select(*key).distinct().withColumn("c", F.lit(a)).withColumn("l", F.lit(b))
    sides = keys(cards, 1, 0).unionByName(keys(labels, 0, 1)).groupBy(*key).agg(F.max("c").alias("c"), F.max("l").alias("l"))
    counts = sides.agg(F.count_if((F.col("c") == 1) & (F.col("l") == 0)).alias("missing"), F.count_if((F.col("c") == 0) & (F.col("l") == 1)).alias("extra"))
    both = labels.agg(F.count("*").alias("scored_rows"), rows_digest(sorted(labels.columns)).alias("labels_digest")).crossJoin(cards.agg(rows_digest(sorted(cards.columns)).alias("cards_digest"))).crossJoin(counts)
    closed = F.when((F.col("missing") == 0) & (F.col("extra") == 0), F.col("labels_digest"))
    return both.withColumn("labels_digest", closed).withColumn("locked_at", F.current_timestamp()).withColumn("truth_opened", F.lit(truth_opened))


def check_receipt(receipt: DataFrame) -> None:
    """Raises unless the receipt is one row with no null in it and the truth wasn't opened before."""
    rows = receipt.limit(2).collect()
    empty = [c for r in rows for c, v in r.asDict().items() if v is None]
    if len(rows) != 1 or empty or rows[0].truth_opened:
        raise ValueError(f"no valid receipt: {len(rows)} rows, without {empty}" + (", truth opened before the lock" if rows and rows[0].truth_opened else ""))


def terms_in_documents(rows: DataFrame, key: str, json: str, forbidden: str, exempt: tuple[str, ...] = ()) -> DataFrame:
    """Fields of JSON documents in which a forbidden term stands, but for exempt ones."""
    fields = rows.select(key, F.explode(F.from_json(json, "map<string,string>")).alias("field", "value"))
    return fields.filter(~F.col("field").isin(*exempt) & F.col("value").rlike(forbidden)).select(key, "field", "value")


def near_context(text: Column, concept: str, context: str, reach: int) -> Column:
    """Some match of concept has a match of context in its window: the match itself and reach characters before and after it, whatever else stands there."""
    return any_window(text, intervals(text, concept), context, reach)


def located(text: Column) -> tuple[Column, Column]:
    """Locator and sentence of `NAME_n: sentence`, both empty where there is no locator; all after the colon and its space is the sentence, line ends too, and it may be empty."""
    parts = r"(?s)^([A-Z_]+_-?[0-9]+): ?(.*)\z"
    return F.regexp_extract(text, parts, 1), F.regexp_extract(text, parts, 2)


def any_of(terms: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(terms, " OR "), F.lit(")"))


# Parts of a query that limit designs, languages, kinds of publication or species, and what warnings of cut-off variants say.
SPECIES_LIMITS = ("humans[mesh]", "humans[mh]")
PUBLICATION_LIMITS = ("[language]", "[lang]", "[publication type]", "[pt]")
DESIGN_LIMITS = ("randomized controlled trial", "randomised controlled trial", "clinical trial[", "cohort[", "case-control[", "case report[")
CUT_OFF = ("600", "truncat", "wildcard")
# End of fixed values.


def base_query(p_terms: Column, i_terms: Column) -> Column:
    return F.concat(any_of(p_terms), F.lit(" AND "), any_of(i_terms))


def date_clause(first: Column, last: Column) -> Column:
    return F.format_string('("%s"[Date - Publication] : "%s"[Date - Publication])', first, last)


def query_lint(specs: DataFrame, key: str, least: int = 25) -> DataFrame:
    """Per key and rule (1 to 9) whether a search keeps it.

    specs has p_terms and i_terms (lists), query, first, last (dates as text), not_found and errors (lists), warnings (list: the query's and those of its
    terms with a wildcard). A null list is empty; a null query keeps no rule on what must stand in it and all on what must not.
    """
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("p_terms", "i_terms", "not_found", "errors", "warnings")}
    specs = specs.select(key, "first", "last", F.coalesce("query", F.lit("")).alias("query"), *(v.alias(c) for c, v in lists.items()))
    text, base = F.lower("query"), base_query(F.col("p_terms"), F.col("i_terms"))
    says = lambda where, parts: reduce(or_, (F.contains(where, F.lit(p)) for p in parts))
    both = lambda rule: rule(F.col("p_terms")) & rule(F.col("i_terms"))
    tagged = lambda terms, *tags: F.exists(terms, lambda t: says(t, tags))
    no_errors = (F.size("errors") == 0) & (F.size("not_found") == 0)
    rules = [
        F.startswith("query", base),
        ~says(text, SPECIES_LIMITS),
        ~says(text, SPECIES_LIMITS + PUBLICATION_LIMITS + DESIGN_LIMITS),
        ~says(text, PUBLICATION_LIMITS),
        F.contains("query", date_clause(F.col("first"), F.col("last"))),
        both(lambda terms: tagged(terms, "[Mesh]") & tagged(terms, "[tiab]")) & no_errors,
        both(lambda terms: F.forall(terms, lambda t: says(t, ("[Mesh]", "[tiab]", "[tw]")))),
        both(lambda terms: F.size(F.array_distinct(F.transform(terms, canonical_term))) >= least),
        ~F.exists("warnings", lambda w: says(F.lower(w), CUT_OFF)),
    ]
    return specs.select(key, F.posexplode(F.array(*(F.coalesce(r, F.lit(False)) for r in rules))).alias("rule", "kept")).withColumn("rule", F.col("rule") + 1)


def hit_comparison(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Counts (key, hits) of two searches: difference and ratio to six digits, null where the old one found nothing."""
    both = old.withColumnRenamed("hits", "old").join(new.withColumnRenamed("hits", "new"), key, "full_outer").select(key, F.coalesce("old", F.lit(0)).alias("old"), F.coalesce("new", F.lit(0)).alias("new"))
    return both.withColumn("difference", F.col("new") - F.col("old")).withColumn("ratio", F.round(F.when(F.col("old") != 0, F.col("new") / F.col("old")), 6))
