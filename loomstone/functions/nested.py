"""Values anywhere in nested JSON as rows: a document is a variant that is taken apart level by level, in the JVM, and everything asked of it is a column expression over flat rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.session import materialized

# Words that generated fields must not claim, in fields that don't quote a source, and where fields that do may stand.
GENERATED_TERM = r"(?<![A-Za-z0-9])(?:sensitivity|specificity|accuracy|gold_standard|validated|include|exclude)(?![A-Za-z0-9])"
QUOTING = (
    "title", "abstract", "authors", "venue", "publication_types", "doi", "url", "locator", "locator_text", "dose", "outcome", "key_finding", "population",
    "raw_source_path", "raw_source_sha256", "source_text",
)
VERBATIM = {
    "none": {},
    "bundle": dict.fromkeys(QUOTING, r"^\$\[\d+\]$"),
    "translations": {"source_text": r"^\$\.translations\[\d+\]$"},
    "rules": dict.fromkeys(QUOTING, r"\.(?:evidence|all_evidence)\[\d+\]$"),
}
#: What stands in a path for a name that claims something.
HIDDEN = "<generated_field>"
# End of fixed values.


def flattened(rows: DataFrame, key: str, json: str) -> DataFrame:
    """A row for every value in JSON documents: key, steps (name, or null in lists, and place), kind (object, array or the type) and text (of values that aren't objects or lists).

    One pass for each level of nesting over what is nested deeper; a null document has no rows, one that isn't JSON is an error. Names of a field come in order of the alphabet.
    """
    spark = rows.sparkSession
    level = rows.select(F.col(key).alias("key"), F.parse_json(json).alias("v"), F.array().cast("array<struct<name:string,place:int>>").alias("steps")).filter("v is not null")
    found = []
    while True:
        kind = F.lower(F.regexp_extract(F.schema_of_variant("v"), r"^\w+", 0))
        level = materialized(level.withColumn("kind", kind), "level")
        inner = F.col("kind").isin("object", "array")
        found.append(level.select("key", "steps", "kind", F.when(~inner, F.col("v").cast("string")).alias("text")))
        deeper = level.filter(inner)
        if deeper.isEmpty():
            break
        level = spark.sql("select d.key, e.value as v, array_append(d.steps, named_struct('name', e.key, 'place', e.pos)) as steps from {d} d, lateral variant_explode(d.v) e", d=deeper)
    return reduce(lambda a, b: a.unionByName(b), found).withColumnRenamed("key", key)


def path_to(steps: Column, depth: Column, pattern: str | None = None) -> Column:
    """The path of the first `depth` steps; names in which pattern occurs are hidden."""
    named = lambda s: F.when(s["name"].rlike(f"(?i){pattern}"), f".{HIDDEN}").otherwise(F.concat(F.lit("."), s["name"])) if pattern else F.concat(F.lit("."), s["name"])
    piece = lambda s: F.when(s["name"].isNull(), F.concat(F.lit("["), s["place"].cast("string"), F.lit("]"))).otherwise(named(s))
    return F.concat(F.lit("$"), F.array_join(F.transform(F.slice(steps, 1, depth), piece), ""))


def claimed_terms(rows: DataFrame, key: str, json: str, pattern: str, verbatim: dict[str, str] | None = None) -> DataFrame:
    """(key, path) wherever pattern occurs in a text or, as `path:name`, in a field's name. In any case.

    verbatim: by field, what the path of the field's parent must match for the field to quote a source; what stands in such a field isn't looked at, its name is.
    """
    steps, depth = F.col("steps"), F.size("steps")
    by_place: dict[str, list[str]] = {}
    for name, place in (verbatim or {}).items():
        by_place.setdefault(place, []).append(name)
    quotes = lambda k: reduce(or_, (F.element_at(steps, k)["name"].isin(*names) & path_to(steps, k - 1, pattern).rlike(place) for place, names in by_place.items()), F.lit(False))
    quoted = lambda until: F.exists(F.filter(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda k: k <= until), lambda k: F.coalesce(quotes(k), F.lit(False)))
    path = path_to(steps, depth, pattern)
    says = lambda c: F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))
    in_name = (depth > 0) & says(F.get(steps, depth - 1)["name"]) & ~quoted(depth - 1)
    in_text = (F.col("kind") == "string") & says(F.col("text")) & ~quoted(depth)
    where = F.filter(F.array(F.when(in_name, F.concat(path, F.lit(":name"))), F.when(in_text, path)), lambda p: p.isNotNull())
    return flattened(rows, key, json).select(key, F.explode(where).alias("path"))


def said(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, text): every field's name and every value but null, objects and lists."""
    name = F.get("steps", F.size("steps") - 1)["name"]
    return flattened(rows, key, json).select(key, F.explode(F.filter(F.array(name, "text"), lambda t: t.isNotNull())).alias("text"))
