"""Queries of the review operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.functions.nested import GENERATED_TERM, VERBATIM, claimed_terms
from loomstone.operators import evidence, lookup, review
from loomstone.plans.documents import _SQL_BRIDGE, AXES, axes
from loomstone.plans.classified import _windows
from loomstone.session import table

CONCEPT, VERB = "with|von|para|des", T.word_pattern("the|der|el|le")


def _core(spark: SparkSession, d: str) -> DataFrame:
    return lookup.top_k(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 15)


def _rules(spark: SparkSession, d: str) -> DataFrame:
    bridge = lookup.axis_table(table(spark, d, "documents"), ["lang", "doc_id"], axes())
    return review.rules_from_core(_core(spark, d), bridge, "lang", "doc_id")


def rule_rebuild(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), "|").alias(c)
    return _rules(spark, d).select("lang", "axis", "n", ids("preview"), ids("all"))


def applied_axes(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "documents").select("lang").distinct().withColumn("axis", F.explode(F.array(*map(F.lit, (*AXES, "genetics")))))
    return review.requested_axes(asked, _rules(spark, d), "lang")


def in_core_marker(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return review.with_core_marker(docs, _core(spark, d), "doc_id").groupBy("lang", "in_core").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def card_leaks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("title"), F.regexp_extract("source", "([0-9]+)", 1).alias("place"))
    cards = table(spark, d, "labels").select("doc_id", F.col("quality").alias("__label")).join(docs, "doc_id")
    return review.leaks(cards, ["doc_id"], ["doc_id", "title", "place"], "retain|deprioritize", F.col("__label"))


def expectation_merge(spark: SparkSession, d: str) -> DataFrame:
    """What is good is expected to stay, what is toxic to go; both at once is a conflict."""
    labels = table(spark, d, "labels")
    stay, go = (labels.filter(f"{c} = 1").select("doc_id", F.lit(v).alias("expected")) for c, v in (("quality", "retain"), ("toxic", "deprioritize")))
    return review.merged_expectations(stay, go, ["doc_id"], "expected")


def regression_problems(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    observed = docs.filter("n_chars > 400").select("doc_id", F.when(F.contains("text", F.lit("!!")), 0).otherwise(1).alias("quality"), F.when(F.col("text").rlike("idiot|moron"), 1).otherwise(0).alias("toxic"))
    return review.regression_problems(table(spark, d, "labels"), observed, ["doc_id"], ["quality", "toxic"]).select("doc_id", F.array_join("problems", ",").alias("problems"))


def referee_check(spark: SparkSession, d: str) -> DataFrame:
    allowed = T.numbers_in(T.first_line(F.col("text")))
    out = review.referee(table(spark, d, "documents").select("doc_id", "text"), allowed, "idiot|moron", 5000)
    return out.filter(F.size("against") > 0).select("doc_id", F.array_join("against", ",").alias("against"))


LINE = """concat('  ', p_name, case p_partkey % 9 when 0 then ' 복용을 중단' when 1 then ' 드세요' when 2 then ' 당신은' when 3 then '？' when 4 then concat(' 5 ', cast(p_size as varchar(4))) when 5 then repeat(' long', 40) when 6 then ' 반드시 안전합니다' when 7 then ' 1,5' else '' end)"""


def line_reasons(spark: SparkSession, d: str) -> DataFrame:
    reason = review.line_reason(F.expr(LINE), F.expr("concat(p_name, ' 5 15 7')"))
    return table(spark, d, "part").select("p_partkey", F.coalesce(reason, F.lit("ok")).alias("reason"))


def label_locks(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return review.lock_receipt(docs, labels, ["doc_id"]).drop("locked_at")


def terminology_gate(spark: SparkSession, d: str) -> DataFrame:
    return review.terms_in_documents(table(spark, d, "events"), "event_id", "props", "[13579]$", ("exempt",))


#: A nested text of each event: the same expression makes it in Spark and in SQL.
_NOTE = "concat(event_type, case event_id % 3 when 0 then ' validated' when 1 then ' invalidated' else ' is INCLUDE' end)"
NESTED = f"""concat('{{"translations": [{{"source_text": "', {_NOTE}, '", "note": "', {_NOTE}, '"}}], "sensitivity": {{"notes": ["', {_NOTE}, '", null, 7]}}}}')"""


def nested_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.expr(NESTED).alias("body"))
    return claimed_terms(rows, "event_id", "body", GENERATED_TERM, VERBATIM["translations"])


P_TERM = "concat(p_type, '-', cast(p_size as varchar(4)), case when p_size = 5 then '' when p_size % 3 = 0 then '[Mesh]' when p_size % 3 = 1 then '[tiab]' else '[tw]' end)"
I_TERM = """concat('"', p_name, '"', case when p_partkey % 2 = 0 then '[Mesh]' else '[tiab]' end)"""
KIND = "cast(right(p_brand, 1) as int)"
DATES = """'("2000/01/01"[Date - Publication] : "2024/12/31"[Date - Publication])'"""
SEARCH = f"case {KIND} when 2 then concat(base, ' AND humans[Mesh] AND ', {DATES}) when 3 then concat(base, ' AND english[lang]') when 4 then concat('x AND ', base, ' AND ', {DATES}, ' AND Cohort[pt]') else concat(base, ' AND ', {DATES}) end"


def query_lint(spark: SparkSession, d: str) -> DataFrame:
    lists = (F.sort_array(F.collect_set(F.expr(e))).alias(n) for n, e in (("p_terms", P_TERM), ("i_terms", I_TERM)))
    specs = table(spark, d, "part").groupBy("p_brand").agg(*lists).withColumn("base", review.base_query(F.col("p_terms"), F.col("i_terms")))
    only = lambda k, text: F.expr(f"case when {KIND} = {k} then array('{text}') end")
    specs = specs.select("p_brand", "p_terms", "i_terms", F.expr(SEARCH).alias("query"), F.lit("2000/01/01").alias("first"), F.lit("2024/12/31").alias("last"), only(4, "phrase").alias("not_found"), F.lit(None).cast("array<string>").alias("errors"), only(5, "Truncated at 600").alias("warnings"))
    return review.query_lint(specs, "p_brand")


def context_window(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", review.near_context(F.col("text"), CONCEPT, VERB, 90).alias("in_context"))


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    term = T.canonical_term(F.concat(F.lit('"'), "p_type", F.lit("-"), F.col("p_size").cast("string"), F.lit('"[tiab]')))
    terms = table(spark, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set(term)).alias("terms"))
    return terms.select("p_brand", F.size("terms").cast("long").alias("n_terms"), (F.size("terms") >= 25).alias("enough"), review.any_of(F.slice("terms", 1, 5)).alias("query"))


def search_comparison(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    hits = lambda x: x.groupBy("event_type").agg(F.count("*").alias("hits"))
    return review.hit_comparison(hits(events.filter("value > 50")), hits(events), "event_type")


def batch_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 25 records of each language, numbered through all languages."""
    batches = evidence.chunk_numbers(table(spark, d, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"], 25).groupBy("lang", "chunk").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first_id"))
    offsets = batches.groupBy("lang").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.lpad((F.col("before") + F.col("chunk") + 1).cast("string"), 4, "0")
    return batches.join(offsets.select("lang", "before"), "lang").select(F.concat(F.lit("batch-"), number).alias("batch_id"), "lang", "rows", "first_id")


def coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id").distinct().withColumn("seen", F.lit(1))
    out = docs.join(labels, "doc_id", "left").groupBy("lang").agg(F.count("seen").alias("seen"), F.count("*").alias("expected"))
    return out.withColumn("ratio", F.round(F.when(F.col("expected") == 0, 1.0).otherwise(F.col("seen") / F.col("expected")), 9))


def overview_lines(spark: SparkSession, d: str) -> DataFrame:
    """A sentence for each language from counts alone."""
    c = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") >= 2000).alias("long"), F.max("n_chars").alias("most"))
    return c.select("lang", F.concat(F.format_number("n", 0), F.lit(" records, "), F.round(100 * F.col("long") / F.col("n")).cast("int").cast("string"), F.lit(" % long, the longest of "), F.format_number("most", 0), F.lit(" characters")).alias("line"))


def located_findings(spark: SparkSession, d: str) -> DataFrame:
    """A locator `NAME_n: sentence` taken apart; the sentence's role by its beginning.

    White space is what the SQL's engine takes for it, and an end is the very end: Java's `\\s` has a vertical tab too, its `.` stops at line ends of any kind and its `$` before a last one.
    """
    first = F.trim(F.regexp_replace(F.substring_index("text", ".", 1), "[ \\t\\n\\f\\r]+", " "))
    raw = F.concat(F.lit("DOC_"), F.coalesce(F.col("doc_id").cast("string"), F.lit("0")), F.lit(": "), F.coalesce(first, F.lit("")))
    locator, sentence = review.located(raw)
    role = T.first_match(sentence, [(r"^(The|Der|Le|El)( |\z)", "result"), (r"^(And|Und|Et|Y)( |\z)", "method")], "other")
    given = lambda column, value: F.when(F.col(column).isNotNull(), value)
    return table(spark, d, "documents").select("doc_id", given("doc_id", locator).alias("locator"), given("text", F.length(sentence)).cast("long").alias("characters"), role.alias("role"))


_CORE = "(select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by n_chars desc, doc_id) r from documents) where r <= 15)"
_RULES = f"select lang, axis, count(*) n, list(doc_id order by doc_id) ids from ({_SQL_BRIDGE}) join {_CORE} using (lang, doc_id) group by lang, axis"
_NUMBERS = "list_transform(regexp_extract_all({0}, '" + T.NUMBER + "', 1), lambda x: replace(x, ',', ''))"
_HAS = lambda *parts: "(" + " or ".join(f"contains(lower(query), '{p}')" for p in parts) + ")"
_TAG = lambda c, t: f"len(list_filter({c}, lambda x: contains(x, '{t}'))) > 0"
_TAGGED = lambda c: f"len(list_filter({c}, lambda x: contains(x, '[Mesh]') or contains(x, '[tiab]') or contains(x, '[tw]'))) = len({c})"
_LEXICAL = lambda c: f"""len(list_distinct(list_transform({c}, lambda x: trim(regexp_replace(replace(replace(lower(regexp_replace(x, '\\[[^\\]]*\\]', '', 'g')), '"', ''), '-', ' '), '\\s+', ' ', 'g'))))) >= 25"""
_LINT = ", ".join([
    "starts_with(query, base)", f"not {_HAS(*review.SPECIES_LIMITS)}", f"not {_HAS(*review.SPECIES_LIMITS, *review.PUBLICATION_LIMITS, *review.DESIGN_LIMITS)}", f"not {_HAS(*review.PUBLICATION_LIMITS)}", f"contains(query, {DATES})",
    f"{KIND} <> 4 and " + " and ".join(_TAG(c, t) for c in ("p_terms", "i_terms") for t in ("[Mesh]", "[tiab]")), f"{_TAGGED('p_terms')} and {_TAGGED('i_terms')}", f"{_LEXICAL('p_terms')} and {_LEXICAL('i_terms')}", f"{KIND} <> 5",
])
_WORDING = ", ".join(f"case when regexp_matches(t, '{p}') then '{n}:{p}' end" for n, ps in (("direction", review.DIRECTION), ("personal_claim", review.PERSONAL_CLAIM)) for p in ps)
_DIGEST = lambda *columns: "sha256(concat_ws('|', count(*)::varchar, " + ", ".join(f"coalesce(sum(cast('0x' || substr(sha256(concat({', '.join(_SIZED.format(c) for c in columns)})), {at}, 15) as bigint)), 0)::varchar" for at in (1, 16, 31, 46)) + "))"
_SIZED = "coalesce(length({0}::varchar) || ':' || {0}::varchar, '-')"
SQL = {
    "label_locks": f"""select missing, extra, scored_rows, cards_digest, case when missing + extra = 0 then digest end labels_digest, false truth_opened from (select count(*) filter (l.doc_id is null) missing, count(*) filter (d.doc_id is null) extra from (select distinct doc_id from documents) d full outer join (select distinct doc_id from labels) l on d.doc_id = l.doc_id),
        (select count(*) scored_rows, {_DIGEST('doc_id', 'quality', 'toxic')} digest from labels), (select {_DIGEST('doc_id', 'n_chars')} cards_digest from documents)""",
    "line_reasons": f"""select p_partkey, coalesce(case when t = '' then 'empty' when length(t) > 150 then 'too_long' when regexp_matches(t, '{review.QUESTION}') then 'question' end, {_WORDING},
        'unsupported_number:' || list_filter({_NUMBERS.format('t')}, lambda y: not list_contains({_NUMBERS.format('a')}, y))[1], 'ok') reason from (select p_partkey, trim({LINE}) t, p_name || ' 5 15 7' a from part)""",
    "query_lint": f"""with t as (select p_brand, list_sort(list_distinct(list({P_TERM}))) p_terms, list_sort(list_distinct(list({I_TERM}))) i_terms from part group by 1),
        b as (select *, '(' || array_to_string(p_terms, ' OR ') || ') AND (' || array_to_string(i_terms, ' OR ') || ')' base from t), q as (select *, {SEARCH} query from b)
        select p_brand, unnest(range(1, 10))::integer as rule, unnest([{_LINT}]) kept from q""",
    "nested_terms": "select event_id, unnest([p for p in [case when event_id % 3 <> 1 then '$.translations[0].note' end, '$.<generated_field>:name', case when event_id % 3 <> 1 then '$.<generated_field>.notes[0]' end] if p is not null]) path from events",
    "rule_rebuild": f"select lang, axis, n, array_to_string(ids[1:3], '|') preview, array_to_string(ids, '|') \"all\" from ({_RULES})",
    "applied_axes": f"select a.lang, a.axis, r.n, case when r.n is null then 'unavailable' else 'applied' end state from (select lang, unnest([{', '.join(repr(a) for a in (*AXES, 'genetics'))}]) axis from (select distinct lang from documents)) a left join ({_RULES}) r using (lang, axis)",
    "in_core_marker": f"select d.lang, c.doc_id is not null in_core, count(*) n, sum(n_chars)::bigint chars from documents d left join {_CORE} c using (doc_id) group by 1, 2",
    "card_leaks": "select doc_id, p by_pattern, v by_value from (select doc_id, regexp_matches(text, 'retain|deprioritize') p, (text = quality::varchar or regexp_extract(source, '([0-9]+)', 1) = quality::varchar) v from labels join documents using (doc_id)) where p or v",
    "expectation_merge": "select doc_id, case when quality = 1 then 'retain' else 'deprioritize' end expected, coalesce(quality = 1 and toxic = 1, false) conflict from labels where quality = 1 or toxic = 1",
    "regression_problems": "select doc_id, array_to_string(p, ',') problems from (select l.doc_id, [x for x in [case when o.doc_id is null then 'missing_record' end, case when o.q is distinct from l.quality and o.doc_id is not null then 'quality' end, case when o.t is distinct from l.toxic and o.doc_id is not null then 'toxic' end] if x is not null] p from labels l left join (select doc_id, case when contains(text, '!!') then 0 else 1 end q, case when regexp_matches(text, 'idiot|moron') then 1 else 0 end t from documents where n_chars > 400) o using (doc_id)) where len(p) > 0",
    "referee_check": f"select doc_id, array_to_string(a, ',') against from (select doc_id, [x for x in [case when length(text) > 5000 then 'too_long' end, case when contains(text, '?') then 'question' end, case when regexp_matches(text, 'idiot|moron') then 'banned_wording' end, case when len([y for y in {_NUMBERS.format('text')} if not list_contains({_NUMBERS.format('split_part(text, chr(10), 1)')}, y)]) > 0 then 'unsupported_number' end] if x is not null] a from documents) where len(a) > 0",
    "terminology_gate": "select event_id, field, value from (select event_id, unnest(map_keys(m)) field, unnest(map_values(m)) value from (select event_id, cast(cast(props as json) as map(varchar, varchar)) m from events)) where field <> 'exempt' and regexp_matches(value, '[13579]$')",
    "context_window": f"select doc_id, {_windows('text', CONCEPT, VERB, 90)} in_context from documents",
    "query_terms": "select p_brand, len(t)::bigint n_terms, len(t) >= 25 enough, '(' || array_to_string(t[1:5], ' OR ') || ')' as query from (select p_brand, list_sort(list_distinct(list(trim(regexp_replace(replace(lower(p_type || '-' || p_size), '-', ' '), '\\s+', ' ', 'g'))))) t from part group by p_brand)",
    "search_comparison": "select event_type, o \"old\", n \"new\", n - o difference, round(case when o <> 0 then n / o::double end, 6) ratio from (select event_type, count(*) filter (value > 50) o, count(*) n from events group by 1)",
    "batch_sequence": "with b as (select lang, (row_number() over (partition by lang order by doc_id) - 1) // 25 c, doc_id from documents), g as (select lang, c, count(*) n, min(doc_id) f from b group by 1, 2) select 'batch-' || lpad((row_number() over (order by lang, c))::varchar, 4, '0') batch_id, lang, n as rows, f first_id from g",
    "coverage_ratio": "select lang, count(l.doc_id) seen, count(*) expected, round(count(l.doc_id) / count(*)::double, 9) ratio from documents d left join (select distinct doc_id from labels) l using (doc_id) group by lang",
    "overview_lines": "select lang, format('{:,}', count(*)) || ' records, ' || round(100 * count(*) filter (n_chars >= 2000) / count(*)::double)::int || ' % long, the longest of ' || format('{:,}', max(n_chars)) || ' characters' as line from documents group by lang",
    "located_findings": "select doc_id, 'DOC_' || doc_id as locator, length(s)::bigint as characters, case when regexp_matches(s, '^(The|Der|Le|El)( |$)') then 'result' when regexp_matches(s, '^(And|Und|Et|Y)( |$)') then 'method' else 'other' end as role from (select doc_id, trim(split_part(regexp_replace(text, '\\s+', ' ', 'g'), '.', 1), ' ') s from documents)",
}
QUERIES = {
    name: f
    for name, f in list(globals().items())
    if callable(f) and not name.startswith("_") and name in SQL
}
