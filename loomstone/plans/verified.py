"""Verification, names within edits, and rules: tables that Spark derives from parts and documents, with faults planted by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from loomstone.operators import clinical as C
from loomstone.operators import rules, verify
from loomstone.operators.aliases import within_edits
from loomstone.plans.classified import RECORDS_SQL, records
from loomstone.session import materialized, table

KEY = ["question_id", "record_id"]
RULE_NAMES = [f"{t}: {w}" for t in ("gate", "bundle") for w in ("missing", "unexpected", "repeated", "differs")] + ["corpus: hash", "corpus: title", "core: rank", "core: missing", "core: unexpected", "core: repeated", "core: differs"]


def build_violations(spark: SparkSession, d: str) -> DataFrame:
    """A gate, a bundle and a core as stored, with planted faults, against what the corpus gives."""
    text = F.concat("title", F.lit("|"), "abstract")
    corpus = records(spark, d).withColumn("hash", F.sha2(text, 256)).withColumn("axes", F.array_join(C.observed_axes(F.col("title"), F.col("abstract")), "|"))
    n = F.col("record_id")
    stored = corpus.withColumn("hash", F.when(n % 79 == 6, "0").otherwise(F.col("hash")))
    # Ten scans read the corpus, but none its abstracts: patterns are matched, and stored hashes held against texts, once.
    corpus = materialized(stored.select(*KEY, "title", "axes", (F.col("hash") == F.sha2(text, 256)).alias("intact")), "corpus")
    gate = corpus.select(*KEY, (F.col("axes") != "").alias("passed"))
    bundle = corpus.filter((F.col("axes") != "") & (n % 3 != 0)).select(*KEY, "title", "axes")
    stored_gate = gate.filter(n % 97 != 5).withColumn("passed", F.when(n % 89 == 3, ~F.col("passed")).otherwise(F.col("passed")))
    stored_bundle = bundle.withColumn("axes", F.when(n % 53 == 1, F.concat("axes", F.lit("?"))).otherwise(F.col("axes"))).withColumn("copies", F.when(n % 61 == 2, 2).otherwise(1))
    stored_bundle = stored_bundle.select(*KEY, "title", "axes", F.explode(F.sequence(F.lit(1), "copies"))).drop("col").unionByName(bundle.filter(n % 71 == 4).withColumn("record_id", n + 10_000_000))
    core = bundle.select(*KEY, F.row_number().over(_first(["question_id"])).alias("rank")).filter("rank <= 15")
    stored_core = core.withColumn("rank", F.when(F.col("rank") == 15, 16).otherwise(F.col("rank")))
    found = [
        verify.row_violations("corpus", corpus, KEY, {"hash": F.col("intact"), "title": F.length("title") < 400}),
        verify.rebuild_violations("gate", stored_gate, gate, KEY),
        verify.rebuild_violations("bundle", stored_bundle, bundle, KEY),
        verify.row_violations("core", stored_core, KEY, {"rank": F.col("rank") <= 15}),
        verify.rebuild_violations("core", stored_core, core, KEY),
    ]
    return verify.report(spark, found, RULE_NAMES, 3).select("rule", "n", F.array_join("keys", ",").alias("keys"))


def _first(group: list[str]) -> WindowSpec:

    return Window.partitionBy(*group).orderBy("record_id")


def alias_matches(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts against names with a letter left out or a word added, within two edits."""
    part = table(spark, d, "part")
    at = (F.col("p_partkey") % F.length("p_name") + 1).cast("int")
    cut = F.concat(F.left("p_name", at - 1), F.substring(F.col("p_name"), at + 1, F.length("p_name")))
    aliases = part.select(F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" "), F.col("p_size") % 10)).otherwise(cut).alias("alias"))
    return within_edits(part.select("p_name"), aliases, "p_name", "alias", 2)


#: id, ingredient, severity, priority, condition, operator, value, unit, scope.
RULES = [
    ("size-floor", "i0", "high", 50, '{"size": {"min": 20}}', ">", 950.0, "eur", "retail"), ("brand-list", "i0", "critical", 20, '{"brand": ["Brand#11", "Brand#12", "Brand#13"]}', None, None, None, None), ("cheap", "i1", "low", 70, "{}", "<=", 930.0, "eur", "retail"),
    ("wholesale", "i1", "moderate", 60, '{"size": {"max": 40}}', ">=", 905.0, "eur", "wholesale"), ("dollars", "i2", "high", 40, '{"size": {"min": 5, "max": 45}}', ">", 900.0, "usd", "retail"), ("both", "i2", "critical", 30, '{"size": {"min": 10}, "brand": ["Brand#21", "Brand#31"]}', "<", 1900.0, "eur", "retail"),
]


def _applied(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    size = F.when(n % 7 != 0, F.col("p_size"))
    profile = F.to_json(F.struct(size.alias("size"), F.when(n % 11 != 0, F.col("p_brand")).alias("brand")))
    items = table(spark, d, "part").select(F.floor(n / 5).alias("request_id"), n.alias("item_id"), F.concat(F.lit("i"), n % 4).alias("ingredient_id"), profile.alias("profile"), F.when(n % 13 != 0, F.col("p_retailprice")).alias("amount"), F.lit("eur").alias("unit"), F.lit("retail").alias("scope"))
    kind = "rule_id string, ingredient_id string, severity string, priority int, applies_when string, threshold_operator string, threshold_value double, threshold_unit string, threshold_scope string"
    return rules.apply_rules(items, spark.createDataFrame(RULES, kind))


def applied_rules(spark: SparkSession, d: str) -> DataFrame:
    return _applied(spark, d).select("request_id", "item_id", "rule_id", "outcome")


def rule_responses(spark: SparkSession, d: str) -> DataFrame:
    result = lambda r: F.concat_ws(":", r["rule_id"], r["item_id"].cast("string"), r["outcome"])
    told = F.array_join(F.transform("ingredients", lambda i: F.concat(i["ingredient_id"], F.lit("="), F.array_join(F.transform(i["results"], result), ","))), ";")
    return rules.responses(_applied(spark, d)).select("request_id", "overall", F.coalesce(told, F.lit("")).alias("results"))


_AXES = "array_to_string([x for x in [" + ", ".join(f"case when regexp_matches(title || ' ' || abstract, '(?i){p}') then '{n}' end" for n, p in C.AXES.items()) + "] if x is not null], '|')"
_APPLIED = """(with p as (select p_partkey n, p_partkey // 5 request_id, case when p_partkey % 7 <> 0 then p_size end size, case when p_partkey % 11 <> 0 then p_brand end brand, case when p_partkey % 13 <> 0 then p_retailprice end price from part),
    c as (select *, 'size-floor' rule_id, 'i0' ing, 2 rank, 50 priority, 'high' severity, size < 20 or price <= 950 no, size is null or price is null unsure, false possible from p where n % 4 = 0
        union all select *, 'brand-list', 'i0', 1, 20, 'critical', brand not in ('Brand#11', 'Brand#12', 'Brand#13'), brand is null, false from p where n % 4 = 0
        union all select *, 'cheap', 'i1', 4, 70, 'low', price > 930, price is null, false from p where n % 4 = 1
        union all select *, 'wholesale', 'i1', 3, 60, 'moderate', size > 40, size is null, true from p where n % 4 = 1
        union all select *, 'dollars', 'i2', 2, 40, 'high', size < 5 or size > 45, true, false from p where n % 4 = 2
        union all select *, 'both', 'i2', 1, 30, 'critical', size < 10 or brand not in ('Brand#21', 'Brand#31') or price >= 1900, size is null or brand is null or price is null, false from p where n % 4 = 2)
    select *, case when coalesce(no, false) then 'excluded' when unsure then 'needs_more_info' when possible then 'possibly_relevant' else 'definitely_matched' end outcome from c)"""
SQL = {
    "build_violations": f"""with c as (select *, record_id n, {_AXES} axes from {RECORDS_SQL}), b as (select *, row_number() over (partition by question_id order by record_id) r from c where axes <> '' and n % 3 <> 0),
        v as (select 'gate: missing' as rule, question_id, n from c where n % 97 = 5 union all select 'gate: differs', question_id, n from c where n % 89 = 3 and n % 97 <> 5
        union all select 'bundle: repeated', question_id, n from b where n % 61 = 2 union all select 'bundle: differs', question_id, n from b where n % 53 = 1 and n % 61 <> 2 union all select 'bundle: unexpected', question_id, n + 10000000 from b where n % 71 = 4
        union all select 'corpus: hash', question_id, n from c where n % 79 = 6 union all select 'corpus: title', question_id, n from c where length(title) >= 400 union all select 'core: rank', question_id, n from b where r = 15 union all select 'core: differs', question_id, n from b where r = 15),
        k as (select rule, question_id || '|' || n as key from v), g as (select rule, count(*) n, array_to_string(list(key order by key)[1:3], ',') keys from k group by 1)
        select rule, coalesce(n, 0) n, coalesce(keys, '') keys from (select unnest([{', '.join(repr(r) for r in RULE_NAMES)}]) as rule) left join g using (rule)""",
    "alias_matches": """with a as (select distinct case when p_partkey % 5 = 0 then p_name || ' ' || p_size % 10 else left(p_name, (p_partkey % length(p_name))::int) || substr(p_name, (p_partkey % length(p_name))::int + 2) end alias from part)
        select p_name, alias, levenshtein(p_name, alias)::int edits from (select distinct p_name from part), a where levenshtein(p_name, alias) <= 2""",
    "applied_rules": f"select request_id, n item_id, rule_id, outcome from {_APPLIED}",
    "rule_responses": f"""with a as (select *, list_position(['definitely_matched', 'possibly_relevant', 'needs_more_info', 'excluded'], outcome) o from {_APPLIED}), t as (select * from a where o < 4),
        i as (select request_id, ing, min(rank) rank, ing || '=' || string_agg(rule_id || ':' || n || ':' || outcome, ',' order by rank, priority desc, rule_id, n) told from t group by 1, 2),
        w as (select request_id, string_agg(told, ';' order by rank, ing) results from i group by 1), f as (select request_id, min(o) o from t group by 1), s as (select request_id, min_by(severity, rank) severity from t where o = 1 group by 1)
        select r.request_id, case when f.o = 1 then s.severity when f.o = 2 then 'possibly_relevant' when f.o = 3 then 'needs_more_info' else 'excluded' end overall, coalesce(results, '') results from (select distinct request_id from a) r left join w using (request_id) left join f using (request_id) left join s using (request_id)""",
}
QUERIES = {name: globals()[name] for name in SQL}
