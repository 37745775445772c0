"""Queries of the clinical operators over synthetic records made of parts: the same expressions make the records in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import clinical as C
from loomstone.session import table


def _case(column: str, *values: str) -> str:
    return f"case {column} % {len(values)} " + " ".join(f"when {k} then {v}" for k, v in enumerate(values)) + " end"


#: Columns of the records, as expressions that Spark and other engines read alike.
RECORDS = {
    "record_id": "p_partkey",
    "question_id": "concat('q', cast(p_size % 5 as varchar(2)))",
    "title": _case("p_partkey", "concat('Calcium and ', p_name, ' in older women')", "concat('Re: ', p_name, ' and warfarin')", "'Vitamin K antagonists and fish oil in kidney disease'", "concat('Vitamin K2 at ', cast(p_size as varchar(4)), ' mg/day in rats')", "'Perspective on vitamin D'", "concat('Retracted: ', p_name)", "p_name"),
    "abstract": _case("p_size", "''", "concat('BACKGROUND: Ascorbic acid is known.\nMETHODS: We enrolled 40 patients.\nRESULTS: 5 to 10 mg/day and ', cast(p_size as varchar(4)), ' IU reduced risk.')", "concat('Men aged 60 years took 2.5 g / day, then 2.5 g / day of ', p_name)", "'The Chinese herbal medicine (CHM) is old.\nOBJECTIVE: CHM was compared.'", "'INTRODUCTION: only this'", "'Gan Mai Da Zao Tang (GMDZT) was given; no effect. Age and sex did not matter.'"),
    "publication_types": _case("p_partkey", "'Meta-Analysis|Review'", "'Letter|Comment'", "'Randomized Controlled Trial|Clinical Trial'", "'Case Reports'", "'Letter'", "'Retracted Publication'", "'Observational Study'", "''"),
    "decision": _case("p_partkey", "'retain'", "'deprioritize'", "'retain'", "'uncertain'", "'retain'"),
    "priority": "cast(floor(p_retailprice) as integer)",
}
#: Records from laboratory and clinic, in the same way.
LAB_RECORDS = {
    "record_id": "p_partkey",
    "title": _case("p_partkey", "concat('Effect of ', p_name, ' in mice')", "concat('RAT found by ', p_name)", "'Nanoparticles in a clinical trial'", "'Hydroxyapatite fabrication'", "'Outcomes of patients with stones'", "'Patients with scaffolds'", "p_name"),
    "abstract": _case("p_size", "''", "'Rats were fed calcium.'", "'We enrolled 40 patients; HepG2 cells were cultured.'", "concat('HepG2 cells with ', p_name)", "'RAT was confirmed in 3 of 5'", "'Rabbits of either kind, and then later, were divided.'"),
}
_LAB = "(select " + ", ".join(f"{e} as {c}" for c, e in LAB_RECORDS.items()) + " from part)"
_SQL = "(select " + ", ".join(f"{e} as {c}" for c, e in RECORDS.items()) + " from part)"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(*(F.expr(e.replace("\n", "\\n")).alias(c) for c, e in RECORDS.items()))


def observed_axes(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("record_id", F.array_join(C.observed_axes(F.col("title"), F.col("abstract")), "|").alias("axes"))


def clinical_doses(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("record_id", F.array_join(C.doses(F.concat_ws(" ", "title", "abstract")), " | ").alias("dose")).filter("dose != ''")


def study_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).groupBy(C.study_kind(F.col("publication_types")).alias("kind")).agg(F.count("*").alias("n"))


def sentence_roles(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("record_id", C.sentence_role(F.col("abstract")).alias("role"))


def foreground_texts(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("record_id", C.foreground(F.col("abstract")).alias("foreground"))


def publication_gates(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("record_id", C.publication_gate(F.col("title"), F.col("publication_types"), F.col("abstract")).alias("gated"))


def nonclinical_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(*(F.expr(e).alias(c) for c, e in LAB_RECORDS.items()))
    return rows.select("record_id", C.nonclinical_gate(F.col("title"), F.col("abstract")).alias("gated"))


def carried_acronyms(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("record_id", C.acronym_carried(F.col("abstract"), C.foreground(F.col("abstract"))).alias("carried"))


def alias_rules(spark: SparkSession, d: str) -> DataFrame:
    named = _records(spark, d).withColumn("aliases", C.alias_matches(F.concat_ws(" ", "title", "abstract")))
    rules = C.alias_rules(named, "question_id", "record_id", [-F.col("priority"), F.col("record_id")])
    return rules.select("question_id", "alias", "n", "status", F.array_join(F.transform("preview", lambda i: i.cast("string")), "|").alias("preview"))


def _gated(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d)
    return C.evidence_gate(rows, F.size(C.observed_axes(F.col("title"), F.col("abstract"))) > 0)


def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).groupBy("question_id", "regex_passed", "decision", "kept").agg(F.count("*").alias("n"))


def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    return C.evidence_rows(_gated(spark, d))


def normalized_dashes(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("  5–"), F.col("p_size").cast("string"), F.lit("\n −3  "), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", C.normalized_dashes(raw).alias("text"))


def term_cards(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).select("record_id", "title")
    terms = table(spark, d, "lineitem").filter("l_quantity > 49").groupBy(F.col("l_partkey").alias("record_id")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ";").alias("terms"))
    selected = _records(spark, d).filter("decision = 'retain'")
    return C.cards(selected, rows, terms, ["record_id"])


def adjudicated_decisions(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d)
    observed = rows.select("record_id", F.when(F.col("record_id") % 2 == 0, F.array(F.lit("outcome"), F.lit("population"))).otherwise(F.array(F.lit("off_topic"))).alias("codes"), F.lit("low").alias("confidence"))
    none = F.array().cast("array<string>")
    expected = rows.filter("decision != 'uncertain'").select("record_id", "decision", F.when(F.col("decision") == "retain", "high").alias("confidence"), F.when(F.col("decision") == "retain", F.array(F.lit("exposure"))).otherwise(none).alias("required"), F.array(F.lit("off_topic")).alias("forbidden"))
    return C.adjudicated(expected, observed, ["record_id"]).select("record_id", "decision", F.array_join("reason_codes", "|").alias("reason_codes"), "confidence")


def rebuilt_strata(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).withColumn("label_source", F.when(F.col("priority") % 4 == 0, "adjudication").otherwise("worker"))
    design = spark.createDataFrame([("S4_adjudication", 5), ("S1_worker_retain|q1", 7), ("S9_unknown", 3)], "stratum string, sample_n long")
    return C.rebuilt_strata(rows, design)


def translated_core(spark: SparkSession, d: str) -> DataFrame:
    core = _records(spark, d).filter("decision = 'retain'").select("record_id", "question_id")
    translations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("record_id"), F.col("s_name").alias("translation"))
    return C.translated(core, translations, ["record_id"]).groupBy("question_id", "missing").agg(F.count("*").alias("n"))


def _has(text: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_matches({text}, '(?i){quoted}')"


def _cases(text: str, cases: list[tuple[str, str]], default: str) -> str:
    return "case " + " ".join(f"when {_has(text, p)} then '{n}'" for p, n in cases) + f" else '{default}' end"


def _named(pairs: dict[str, str]) -> str:
    return "[x for x in [" + ", ".join(f"case when {c} then '{n}' end" for n, c in pairs.items()) + "] if x is not null]"


_TEXT = "title || ' ' || abstract"
_AXES = _named({n: _has(_TEXT, p) for n, p in C.AXES.items()})
_DOSES = f"array_to_string((select list_filter(l, lambda x, i: list_position(l, x) = i) from (select regexp_extract_all({_TEXT}, '(?i){C.DOSE}') l))[1:8], ' | ')"
_FOREGROUND = f"""(select record_id, abstract, case when len(b) > 0 then array_to_string(b, chr(10)) else abstract end f from (select *, list_filter(list_transform(list_filter(s[2:], lambda x: not regexp_matches(upper(x), '^(?:{C.BACKGROUND_SECTIONS})')), lambda x: regexp_replace(split_part(x, chr(2), 2), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') b
    from (select *, string_split(regexp_replace(abstract, '(?im)^[ \\t]*({C.SECTION})\\s*:\\s*', chr(1) || '\\1' || chr(2), 'g'), chr(1)) s from {_SQL})))"""
_TYPES = "list_transform(string_split(lower(publication_types), '|'), lambda x: trim(x))"
_ANY = lambda *names: f"list_has_any({_TYPES}, [{', '.join(repr(n) for n in names)}])"
_GATE = (
    f"{_ANY(*C.TERMINAL_TYPES)} or {_has('title', C.EDITORIAL_TITLE)} or {_has('title', C.COMMENTARY_TITLE)} or {_ANY('editorial', 'news')} or ({_ANY('comment')} and not (trim(abstract) <> '' and ({_has('abstract', C.HUMAN_ENROLLMENT)} or {_has('abstract', C.DIRECT_SECTION)})))"
    f" or ({_ANY('letter')} and ({_has('title', C.OPINION_TITLE)} or {_has('title', C.LETTER_TITLE)}))"
)
_LAB_BODY = " or ".join(_has("b", p) for p in (C.PRECLINICAL_METHOD, C.LAB_BODY, C.TREATED_SPECIES, C.SPECIES_BODY))
_NONCLINICAL = f"""{_has('t', C.SPECIES_TITLE)} or {_has('t', C.BENCH_TITLE)} or ({_has('t', C.LAB_TITLE)} and not {_has('t', C.HUMAN_ENROLLMENT)} and not {_has('t', C.TRIAL_TITLE)})
    or ((not {_has('t', C.PATIENTS_TITLE)} or {_has('t', C.LAB_TITLE)}) and ({_LAB_BODY}) and not {_has('b', C.HUMAN_ENROLLMENT)})"""
_BARE = f"regexp_replace({_TEXT}, '(?i){C.ANTAGONISTS}', ' ', 'g')"
_ALIASES = _named({a: _has(_BARE if a == "A1" else _TEXT, p) for a, p in C.ALIASES.items()})
_KEPT = f"(select *, len({_AXES}) > 0 regex_passed, len({_AXES}) > 0 and decision = 'retain' kept from {_SQL})"
SQL = {
    "observed_axes": f"select record_id, array_to_string({_AXES}, '|') axes from {_SQL}",
    "clinical_doses": f"select * from (select record_id, {_DOSES} dose from {_SQL}) where dose <> ''",
    "study_kind_counts": f"select {_cases('publication_types', C.STUDY_KINDS, C.OTHER_STUDY)} kind, count(*) n from {_SQL} group by 1",
    "sentence_roles": f"select record_id, {_cases('abstract', C.SENTENCE_ROLES, 'unclassified')} as role from {_SQL}",
    "foreground_texts": f"select record_id, f foreground from {_FOREGROUND}",
    "publication_gates": f"select record_id, {_GATE} gated from {_SQL}",
    "nonclinical_gates": f"select record_id, {_NONCLINICAL} gated from (select record_id, regexp_replace(title, '{C.NO_ANIMAL}', '', 'g') t, regexp_replace(abstract, '{C.NO_ANIMAL}', '', 'g') b from {_LAB})",
    "carried_acronyms": f"select record_id, len(list_filter(list_concat(regexp_extract_all(abstract, '(?i){C.DEFINED}', 1), regexp_extract_all(abstract, '" + C.NAMED_FORMULA.replace("'", "''") + f"', 1)), lambda a: regexp_matches(f, '\\b' || a || '\\b'))) > 0 carried from {_FOREGROUND}",
    "alias_rules": f"""with n as (select question_id, record_id, priority, unnest({_ALIASES}) alias from {_SQL}), c as (select question_id, alias, count(*) n, list(record_id order by priority desc, record_id) ids from n group by 1, 2)
        select g.question_id, g.alias, coalesce(n, 0)::bigint n, case when n > 0 then 'direct_evidence' else 'no_direct_evidence' end status, coalesce(array_to_string(ids[1:3], '|'), '') preview from (select question_id, unnest([{', '.join(repr(a) for a in C.ALIASES)}]) alias from (select distinct question_id from {_SQL})) g left join c using (question_id, alias)""",
    "evidence_gate": f"select question_id, regex_passed, decision, kept, count(*) n from {_KEPT} group by all",
    "evidence_rows": f"select question_id, record_id, case when trim(abstract) <> '' then 'abstract_only' else 'title_only' end source_scope, {_DOSES} dose, '' extracted_effect_value, 'not_observed' extracted_effect_status, 'ai_screened_regex_confirmed' status from {_KEPT} where kept",
    "normalized_dashes": "select p_partkey, trim(regexp_replace(translate('  5–' || p_size || chr(10) || ' −3  ' || p_name, '−–', '--'), '\\s+', ' ', 'g')) as text from part",
    "term_cards": f"select r.record_id, title, coalesce(terms, '') terms from {_SQL} r left join (select l_partkey record_id, array_to_string(list_sort(list_distinct(list(l_returnflag))), ';') terms from lineitem where l_quantity > 49 group by 1) t on t.record_id = r.record_id where decision = 'retain'",
    "adjudicated_decisions": f"""select record_id, decision, case when record_id % 2 = 0 then case when decision = 'retain' then 'population|exposure|outcome' else 'population|outcome' end when decision = 'retain' then 'exposure' else 'off_topic' end reason_codes,
        case when decision = 'retain' then 'high' else 'low' end confidence from {_SQL} where decision <> 'uncertain'""",
    "rebuilt_strata": f"""with b as (select case when priority % 4 = 0 then 'S4_adjudication' when decision = 'uncertain' then 'S3_worker_uncertain' else case when decision = 'retain' then 'S1_worker_retain' else 'S2_worker_deprioritize' end || '|' || question_id end stratum, count(*) n from {_SQL} group by 1),
        s(stratum, k) as (values ('S4_adjudication', 5), ('S1_worker_retain|q1', 7), ('S9_unknown', 3))
        select coalesce(b.stratum, s.stratum) stratum, coalesce(n, 0)::bigint rebuilt, coalesce(k, 0)::bigint design from b full outer join s on b.stratum = s.stratum where coalesce(n, 0) <> coalesce(k, 0)""",
    "translated_core": f"select question_id, s_suppkey is null missing, count(*) n from {_SQL} left join supplier on s_suppkey = record_id where decision = 'retain' group by 1, 2",
}
QUERIES = {name: globals()[name] for name in SQL}
