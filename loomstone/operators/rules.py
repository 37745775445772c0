"""Threshold rules with three outcomes, and the strictest of several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Severities from the gravest on, and what a request comes to by the first outcome that it has.
SEVERITIES = ("critical", "high", "moderate", "low", "info")
OUTCOMES = ("definitely_matched", "possibly_relevant", "needs_more_info", "excluded")


def evaluate(rows: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """Each row (size, price) against each of a few limits (least_size, most_price): a missing value never excludes.

    Whether limits are small enough to be sent to all tasks is left to Spark, which knows their size.
    """
    fits = (F.col("size") >= F.col("least_size")) & (F.col("price") <= F.col("most_price"))
    missing = F.col("size").isNull() | F.col("price").isNull()
    outcome = F.when(missing, "needs_more_info").when(fits, "definitely_matched").otherwise("excluded")
    return rows.crossJoin(limits).select(key, "rule", "jurisdiction", outcome.alias("outcome"))


def conditions(applies_when: Column) -> Column:
    """The fields of a JSON object as (field, allowed, least, most): a list or a single value is what is allowed, an object has bounds `min` and `max`."""
    return F.transform(F.map_entries(F.from_json(applies_when, "map<string,string>")), lambda e: F.struct(
        e["key"].alias("field"),
        F.when(F.startswith(e["value"], F.lit("[")), F.from_json(e["value"], "array<string>")).when(~F.startswith(e["value"], F.lit("{")), F.array(e["value"])).alias("allowed"),
        F.when(F.startswith(e["value"], F.lit("{")), F.get_json_object(e["value"], "$.min").cast("double")).alias("least"),
        F.when(F.startswith(e["value"], F.lit("{")), F.get_json_object(e["value"], "$.max").cast("double")).alias("most"),
    ))


def holds(condition: Column, profile: Column) -> Column:
    """Whether a condition holds for a profile (field to JSON text); null where the profile doesn't say, or says what can't be compared.

    A field with several values holds if one of them is allowed, and an allowed field that is missing inside a list is no answer but a no.
    """
    said = F.try_element_at(profile, condition["field"])
    values = F.when(F.startswith(said, F.lit("[")), F.from_json(said, "array<string>")).otherwise(F.array(said))
    number = said.try_cast("double")
    inside = (number >= F.coalesce(condition["least"], F.lit(float("-inf")))) & (number <= F.coalesce(condition["most"], F.lit(float("inf"))))
    return F.when(said.isNull(), None).when(condition["allowed"].isNotNull(), F.arrays_overlap(values, condition["allowed"])).otherwise(inside)


def apply_rules(items: DataFrame, rules: DataFrame) -> DataFrame:
    """items (request_id, item_id, ingredient_id, profile, amount, unit, scope) against the rules of their ingredient: items' ids, rule_id, severity, priority, outcome.

    rules: rule_id, ingredient_id, severity, priority, applies_when (JSON object), threshold_operator, threshold_value, threshold_unit, threshold_scope. profile is a JSON object. A condition that
    fails, or a threshold that isn't passed, excludes. Otherwise whatever is missing, or given in another unit, needs more information: an absent answer never excludes. A rule whose conditions
    hold but whose threshold is for another scope is possibly relevant, as scopes are never compared; a rule without threshold rests on its conditions alone.
    """
    named = rules.withColumn("conditions", conditions(F.coalesce("applies_when", F.lit("{}"))))
    asked = items.withColumn("said", F.from_json("profile", "map<string,string>"))
    met = asked.join(named, "ingredient_id")
    checked = F.transform("conditions", lambda c: holds(c, F.coalesce(F.col("said"), F.create_map().cast("map<string,string>"))))
    refused, unknown = F.exists(checked, lambda h: ~h), F.exists(checked, lambda h: h.isNull())
    refused = F.coalesce(refused, F.lit(False))
    over = F.col("amount") - F.col("threshold_value")
    operator = F.col("threshold_operator")
    passes = F.when(operator == ">", over > 0).when(operator == ">=", over >= 0).when(operator == "<", over < 0).when(operator == "<=", over <= 0).when(operator == "=", over == 0)
    limit = operator.isNotNull() & F.col("threshold_value").isNotNull()
    other_scope = limit & F.coalesce(F.col("scope") != F.col("threshold_scope"), F.lit(False))
    passes = F.when(~limit, True).when(other_scope, True).when(F.col("unit") == F.col("threshold_unit"), passes)
    outcome = F.when(refused | (passes == F.lit(False)), "excluded").when(unknown | passes.isNull(), "needs_more_info").when(other_scope, "possibly_relevant").otherwise("definitely_matched")
    return met.select("request_id", "item_id", "ingredient_id", "rule_id", "severity", "priority", outcome.alias("outcome"))


def responses(applied: DataFrame, severities: tuple[str, ...] = SEVERITIES) -> DataFrame:
    """A row for each request: overall (the gravest severity that is matched for certain, else the first outcome there is) and ingredients, each with its results.

    Results are in order of severity (unknown ones last), priority from the largest on, and rule; ingredients in order of their gravest result and name. Excluded rules are left out.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, severities)), F.col("severity")), F.lit(0)), F.lit(len(severities) + 1))
    told = applied.filter("outcome != 'excluded'").withColumn("rank", rank.cast("int")).withColumn("o", F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome")))
    result = F.struct("rank", (-F.col("priority")).alias("order"), "rule_id", "item_id", "severity", "outcome")
    each = told.groupBy("request_id", "ingredient_id").agg(F.sort_array(F.collect_list(result)).alias("results"), F.min(F.struct("o", "rank", "severity")).alias("first"))
    results = F.transform("results", lambda r: F.struct(r["rule_id"].alias("rule_id"), r["item_id"].alias("item_id"), r["severity"].alias("severity"), r["outcome"].alias("outcome")))
    one = F.struct(F.col("results")[0]["rank"].alias("rank"), "ingredient_id", results.alias("results"))
    whole = each.groupBy("request_id").agg(F.sort_array(F.collect_list(one)).alias("i"), F.min("first").alias("first"))
    requests = applied.select("request_id").distinct()
    ingredients = F.transform("i", lambda x: F.struct(x["ingredient_id"].alias("ingredient_id"), x["results"].alias("results")))
    overall = F.when(F.col("first.o") == 1, F.col("first.severity")).otherwise(F.element_at(F.array(*map(F.lit, OUTCOMES)), F.col("first.o").cast("int")))
    return requests.join(whole, "request_id", "left").select("request_id", F.coalesce(overall, F.lit("excluded")).alias("overall"), ingredients.alias("ingredients"))


def strictest(rows: DataFrame, group: list[str], value: str, ties: list[str]) -> DataFrame:
    """The row of each group with the lowest value."""
    best = rows.groupBy(*group).agg(F.min(F.struct(value, *ties)).alias("b"))
    return best.select(*group, *(F.col(f"b.{c}").alias(c) for c in (*ties, value)))
