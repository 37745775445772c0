"""The screening classifier over records made of documents: whole texts with clinical phrases planted in title and abstract.

A record's phrases follow from its doc_id; its own text stands between them. The SQL states the classifier's branches one after the other, over the same fixed patterns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.intervals import concepts_near
from loomstone.functions.text import first_line
from loomstone.operators import clinical as C
from loomstone.operators import lookup
from loomstone.operators import screening_patterns as P
from loomstone.operators.classify import SIGNALS, classify, exposure_linked, nutrient_in_use, with_adjudications
from loomstone.operators.screening import decision_errors
from loomstone.session import dealt, materialized, table

PHRASES = (
    "dietary vitamin D supplementation", "bleeding after hip surgery", "patients with chronic kidney disease", "serum magnesium status", "pregnant women in the third trimester", "cirrhosis of the liver", "users of warfarin and ginkgo",
    "no adverse events were observed", "postoperative complication and readmission", "hyperkalemia on dialysis", "preterm birth and congenital anomalies", "herb-induced liver injury due to kava extract", "INR and major bleeding with apixaban",
    "efficacy of curcumin", "rats were treated with garlic", "a survey of practice among physicians", "intravenous iron infusion", "oral zinc tablets were given daily", "acupuncture and massage", "a systematic review of safety",
    "healthy volunteers took ginseng", "lupus anticoagulant assay", "non-vitamin K oral anticoagulants", "vitamin K for reversal of overdose", "prenatal genetic testing", "postpartum women and breastfeeding", "newborn infants", "calcium to prevent preeclampsia",
    "dietary patterns and food intake", "cinacalcet therapy", "nutritional status of children", "the hospital of traditional Chinese medicine", "Liu Wei Di Huang Wan", "patients received Xiao Yao San", "supplementary data", "progesterone supplementation",
    "a randomized controlled trial of folic acid", "prospective cohort of 120 patients", "case report", "adults without liver disease", "Silymarin protects against hepatotoxicity", "training of medical students", "patients underwent elective surgery",
    "non-surgical care", "plasma choline concentrations", "quality of life and recovery", "safety was assessed", "risk of bleeding", "warfarin versus rivaroxaban", "antithrombin supplementation", "dietary supplement use, diet and lifestyle factors",
    "autosomal recessive polycystic kidney disease", "HepG2 cells were cultured", "a hard-to-place remark", "potassium intake", "gestational age at birth", "gestational diabetes", "mechanism of action and oxidative stress", "isoniazid", "blood pressure during anesthesia",
    "the objective was the effectiveness of probiotics",
)
KINDS = ("Journal Article", "Review|Journal Article", "Letter", "Randomized Controlled Trial", "", "Comment|Journal Article", "Case Reports", "Editorial", "Meta-Analysis", "Journal Article")


def _pick(a: int, b: int):
    return F.element_at(F.array(*map(F.lit, PHRASES)), ((F.col("doc_id") * a + b) % len(PHRASES) + 1).cast("int"))


def records(spark: SparkSession, d: str) -> DataFrame:
    """question_id, record_id, title, abstract and publication_types of a record for each document; dealt out, as all that reads them matches patterns."""
    text = F.coalesce("text", F.lit(""))
    kind = F.col("doc_id") % 6
    plain = F.concat(_pick(19, 4), F.lit(". "), text, F.lit(". "), _pick(23, 9))
    short = F.concat(_pick(19, 4), F.lit(" and "), _pick(23, 9), F.lit("."))
    labelled = F.concat(F.lit("BACKGROUND: "), _pick(29, 5), F.lit(" (Gan Mai Da Zao Decoction (GMD) is old).\nMETHODS: "), _pick(19, 4), F.lit(". "), text, F.lit("\nRESULTS: "), _pick(23, 9), F.when(F.col("doc_id") % 5 == 0, " with GMD").otherwise(""), F.lit("; "), _pick(31, 2))
    return dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select(
        F.element_at(F.array(*map(F.lit, P.QUESTIONS)), (F.col("doc_id") % 5 + 1).cast("int")).alias("question_id"), F.col("doc_id").alias("record_id"),
        F.concat(_pick(7, 1), F.lit(" and "), _pick(11, 3), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(": "), first_line(text))).otherwise("")).alias("title"),
        F.when(kind == 0, "").when(kind == 1, plain).when(kind == 2, short).otherwise(labelled).alias("abstract"),
        F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 10 + 1).cast("int")).alias("publication_types"),
    )


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return classify(records(spark, d))


def classified_records(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("record_id", "question_id", "decision", "confidence", "evidence_basis", F.array_join("reason_codes", "|").alias("reason_codes"))


def classified_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Decisions, bases and confidences of each question's batch, as its audit has them."""
    rows = _classified(spark, d)
    sides = F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("value")) for c in ("decision", "evidence_basis", "confidence"))))
    return rows.select("question_id", sides.alias("s")).groupBy("question_id", "s.side", "s.value").agg(F.count("*").alias("n"))


def adjudicated_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of documents labelled toxic have been reviewed: they are left open."""
    rows = _classified(spark, d)
    labels = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("record_id")).distinct()
    says = {"decision": F.lit("uncertain"), "confidence": F.lit("high"), "evidence_basis": F.lit("abstract"), "reason_codes": F.array(F.lit("population"), F.lit("outcome")), "status": F.lit("ok")}
    reviewed = labels.select(F.element_at(F.array(*map(F.lit, P.QUESTIONS)), (F.col("record_id") % 5 + 1).cast("int")).alias("question_id"), "record_id", *(c.alias(n) for n, c in says.items()))
    out = with_adjudications(rows, reviewed)
    return out.groupBy("question_id", "decision", "confidence", F.array_join("reason_codes", "|").alias("reason_codes")).agg(F.count("*").alias("n"))


def classified_errors(spark: SparkSession, d: str) -> DataFrame:
    """Decisions that break the contract: none."""
    return decision_errors(_classified(spark, d), ["question_id", "record_id"], P.REASON_CODES).select("question_id", "record_id", F.array_join("errors", ",").alias("errors"))


def match_windows(spark: SparkSession, d: str) -> DataFrame:
    """What lies near what: a nutrient in use, a linked exposure, and two pairs of concepts within a distance."""
    text = F.col("text")
    rows = records(spark, d).select("record_id", F.concat_ws(" ", "title", "abstract").alias("text"))
    return rows.select(
        "record_id", nutrient_in_use(text).alias("in_use"), exposure_linked(text).alias("linked"), concepts_near(text, P.PREGNANCY_TIME, P.STRONG_EXPOSURE).alias("pregnancy_near"), concepts_near(text, P.PROCEDURE, P.PROCEDURE_SUPPLEMENT, P.PROCEDURE_REACH).alias("procedure_near")
    )


def postings_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Records that show three axes, by intersecting the blocks of a written index."""
    rows = records(spark, d)
    shown = rows.select("question_id", "record_id", F.explode(C.observed_axes(F.col("title"), F.col("abstract"))).alias("axis"))
    index = materialized(lookup.postings(shown, "question_id", "record_id", 512), "postings")
    return lookup.intersect_postings(index, "question_id", list(ASKED)).select("question_id", F.col("id").alias("record_id"))


#: Axes that the lookup asks for.
ASKED = ("sex", "concomitant_medication", "underlying_condition")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _has(text: str, pattern: str) -> str:
    """Patterns that look ahead are searched in a text from which what they look for is gone."""
    for ahead, gone in ((r"(?!\s+age\b)", r"\bgestational\s+age\b"), (r"(?!supplement)", r"dietary supplement")):
        if ahead in pattern:
            text, pattern = f"regexp_replace({text}, '(?i){gone}', 'xx', 'g')", pattern.replace(ahead, "")
    return f"regexp_matches({text}, {_quoted('(?i)' + pattern)})"


def _cut(text: str, *patterns: str) -> str:
    for p in patterns:
        text = f"regexp_replace({text}, {_quoted('(?i)' + p)}, '', 'g')"
    return text


def _parts(text: str, pattern: str) -> str:
    """gestational age is no time of pregnancy: the engine can't look ahead, so that word is spoilt without moving anything."""
    if r"(?!\s+age\b)" in pattern:
        text, pattern = f"regexp_replace({text}, '(?i)\\bgestational(\\s+age\\b)', 'xxxxxxxxxxx\\1', 'g')", pattern.replace(r"(?!\s+age\b)", "")
    return f"string_split(regexp_replace({text}, {_quoted('(?i)' + pattern)}, chr(1) || '\\0' || chr(2), 'g'), chr(1))"


def _starts(text: str, pattern: str) -> str:
    return f"(select [length(x[1]) + coalesce(list_sum([length(x[j]) - 1 for j in range(2, k)]), 0) for k in range(2, len(x) + 1)] from (select {_parts(text, pattern)} x))"


def _near(text: str, first: str, second: str, most: int) -> str:
    return f"(select len([1 for a in xa if len([1 for b in xb if abs(a - b) <= {most}]) > 0]) > 0 from (select {_starts(text, first)} xa, {_starts(text, second)} xb))"


def _windows(text: str, pattern: str, context: str, reach: int) -> str:
    spans = f"[{{'a': length(x[1]) + coalesce(list_sum([length(x[j]) - 1 for j in range(2, k)]), 0), 'n': instr(x[k], chr(2)) - 1}} for k in range(2, len(x) + 1)]"
    windows = f"[substring(t, greatest(s.a - {reach}, 0)::bigint + 1, (s.a + s.n + {reach} - greatest(s.a - {reach}, 0))::bigint) for s in {spans}]"
    return f"(select len([w for w in {windows} if {_has('w', context)}]) > 0 from (select {text} t, {_parts(text, pattern)} x))"


def _phrase(a: int, b: int) -> str:
    return f"w[(doc_id * {a} + {b}) % {len(PHRASES)} + 1]"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


_NOISE = (P.NOT_A_SUPPLEMENT, P.NOT_THERAPEUTIC, P.INSTITUTION)
_VITAMIN = (P.VITAMIN_K_MECHANISM, P.VITAMIN_K_NOISE, P.VITAMIN_K_THERAPY)
_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_TYPES = "list_transform(string_split(lower(types), '|'), lambda x: trim(x))"
_OF_TYPES = lambda *names: f"list_has_any({_TYPES}, {_list(names)})"
_GATE = (
    f"({_OF_TYPES(*C.TERMINAL_TYPES, 'editorial', 'news')} or {_has('title', C.EDITORIAL_TITLE)} or {_has('title', C.COMMENTARY_TITLE)} or ({_OF_TYPES('comment')} and not (abstract <> '' and ({_has('abstract', C.HUMAN_ENROLLMENT)} or {_has('abstract', C.DIRECT_SECTION)})))"
    f" or ({_OF_TYPES('letter')} and ({_has('title', C.OPINION_TITLE)} or {_has('title', C.LETTER_TITLE)})))"
)
_HEAD, _BODY = f"regexp_replace(title, '{C.NO_ANIMAL}', '', 'g')", f"regexp_replace(front, '{C.NO_ANIMAL}', '', 'g')"
_ANIMAL = (
    f"({_has(_HEAD, C.SPECIES_TITLE)} or {_has(_HEAD, C.BENCH_TITLE)} or ({_has(_HEAD, C.LAB_TITLE)} and not {_has(_HEAD, C.HUMAN_ENROLLMENT)} and not {_has(_HEAD, C.TRIAL_TITLE)}) or ((not {_has(_HEAD, C.PATIENTS_TITLE)} or {_has(_HEAD, C.LAB_TITLE)}) and "
    f"({' or '.join(_has(_BODY, p) for p in (C.PRECLINICAL_METHOD, C.LAB_BODY, C.TREATED_SPECIES, C.SPECIES_BODY))}) and not {_has(_BODY, C.HUMAN_ENROLLMENT)}))"
)
_ACRONYM = f"(len([a for a in list_concat(regexp_extract_all(abstract, {_quoted('(?i)' + C.DEFINED)}, 1), regexp_extract_all(abstract, {_quoted(C.NAMED_FORMULA)}, 1)) if regexp_matches(bare_front, '\\b' || a || '\\b')]) > 0)"
_NEAR = _near("op_front", P.POPULATION[P.PERIOPERATIVE], P.PROCEDURE_SUPPLEMENT, P.PROCEDURE_REACH)
_FLAGS = {name: _has(where, pattern) for group in SIGNALS.values() for name, (where, pattern) in group.items()} | {
    "nutrient_title": _windows("bare_title", P.NUTRIENT, P.ADMINISTRATION, 90), "nutrient_front": _windows("bare_front", P.NUTRIENT, P.ADMINISTRATION, 90), "acronym": _ACRONYM, "op_near": _NEAR, "editorial": _GATE, "animal": _ANIMAL,
    "linked": f"({_windows('bare_front', P.STRONG_EXPOSURE, P.RELATION, 130)} or {_windows('bare_front', P.TRADITIONAL_EXPOSURE, P.RELATION, 130)})",
}
_OWN_OUTCOME = lambda kind: "case q when 1 then op_outcome{0} when 2 then kid_outcome{0} when 3 then preg_outcome{0} when 4 then liv_outcome{0} else ac_outcome{0} end".format(kind)
_ALL = f"""(with d as (select doc_id, coalesce(text, '') x, {_list(PHRASES)} w from documents),
    r as (select doc_id record_id, doc_id % 5 + 1 q, {_phrase(7, 1)} || ' and ' || {_phrase(11, 3)} || case when doc_id % 4 = 0 then ': ' || split_part(x, chr(10), 1) else '' end title0,
        case doc_id % 6 when 0 then '' when 1 then {_phrase(19, 4)} || '. ' || x || '. ' || {_phrase(23, 9)} when 2 then {_phrase(19, 4)} || ' and ' || {_phrase(23, 9)} || '.'
        else 'BACKGROUND: ' || {_phrase(29, 5)} || ' (Gan Mai Da Zao Decoction (GMD) is old).' || chr(10) || 'METHODS: ' || {_phrase(19, 4)} || '. ' || x || chr(10) || 'RESULTS: ' || {_phrase(23, 9)} || case when doc_id % 5 = 0 then ' with GMD' else '' end || '; ' || {_phrase(31, 2)} end abstract0,
        {_list(KINDS)}[doc_id % 10 + 1] types from d),
    a as (select *, {_STRIP('title0')} title, {_STRIP('abstract0')} abstract from r),
    b as (select *, string_split(regexp_replace(abstract, '(?im)^[ \\t]*({C.SECTION})\\s*:\\s*', chr(1) || '\\1' || chr(2), 'g'), chr(1)) cuts from a),
    c as (select *, [{_STRIP("split_part(c, chr(2), 2)")} for c in cuts[2:] if not regexp_matches(upper(c), '^(?:{C.BACKGROUND_SECTIONS})')] bodies from b),
    f as (select *, case when len([y for y in bodies if y <> '']) > 0 then array_to_string([y for y in bodies if y <> ''], chr(10)) else abstract end front from c),
    g as (select *, title || ' ' || front as text, {_cut('title', *_NOISE)} bare1, {_cut('front', *_NOISE)} bare2 from f),
    h as (select *, case when q = 5 then {_cut('bare1', *_VITAMIN)} else bare1 end bare_title, case when q = 5 then {_cut('bare2', *_VITAMIN)} else bare2 end bare_front from g),
    t as (select *, title || ' ' || bare_front title_bare_front, {_cut('title', P.NOT_SURGICAL)} op_title_, {_cut('front', P.NOT_SURGICAL)} op_front, front[1:900] aim, front[1:1200] beginning, {_cut('title', P.NO_KIDNEY_DISEASE)} kid_title_, {_cut('title', P.GENETIC_TESTING)} preg_title,
        {_cut('title', P.NO_LIVER_DISEASE)} liv_title_, {_cut('front', P.NO_LIVER_DISEASE)} liv_front_, {_cut('title || chr(32) || front', P.NO_LIVER_DISEASE)} liv_text from h),
    s as materialized (select record_id, q, types, abstract, front, {', '.join(f'{sql} as s_{name}' for name, sql in _FLAGS.items())} from t),
    i1 as (select *, s_strong or s_traditional or s_nutrient_title or s_nutrition or (q = 3 and s_preg_nutrient and (s_preg_prevention or (s_preg_bare_time and s_preg_trial))) ti, s_linked or s_nutrient_front or (s_structured and s_traditional_abstract and s_acronym) fi from s),
    i2 as (select *, ((s_diet or s_intake or s_meal) and not s_named_supplementation) or (s_not_oral and not s_oral) or s_aroma or ((s_biomarker or s_endogenous or s_measured or s_measure) and not s_form and not (s_trial_title and s_trial_nutrient)) or (s_malnutrition and not s_form)
        or (s_alternative and not s_form and ((s_hard_alternative and not ti) or (not fi and not s_target))) or (s_other_focus and not s_given) or (s_summary and s_tcm and not s_product) or (q = 2 and s_kid_drug) or (q = 3 and not ti and (s_preg_other or (s_preg_microbiome and not fi))) v1 from i1),
    i3 as (select *, q = 5 and s_ac_class_title and not ((ti or fi) and not v1) v2, q = 5 and (((s_ac_reversal or s_ac_therapy) and not s_ac_food) or (s_ac_measured and not s_form) or s_ac_blood or (s_ac_antithrombin and s_ac_at) or (s_ac_comparison and not s_ac_compared) or s_ac_lupus or s_ac_material) v3 from i2),
    i4 as (select *, (ti or fi) and not v1 and not v3 i, v1 or v2 or v3 no_i from i3),
    p1 as (select *, s_op_procedure or s_op_around told, s_liv_title or s_liv_coma_title or ((s_liv_front or s_liv_coma_front) and (s_liv_patients or (s_liv_review and s_liv_population))) ill from i4),
    p2 as (select *, case q when 1 then s_op_title or (told and not s_monograph and not s_op_teaching) when 2 then s_kid_title or s_kid_patients when 3 then s_preg_time or (s_preg_people and not s_monograph)
            when 4 then ill or (i and s_liv_injury and (s_liv_caused or s_liv_herb_caused or (s_liv_injury_title and s_liv_caused_title))) else s_ac_title or s_ac_patients or (s_ac_review and s_ac_text) end base,
        case q when 1 then (not s_op_title and told and i and not s_op_near) or s_op_consequence or (s_op_provider and s_op_practice) or s_op_teaching or (s_op_child and not s_op_adult) when 2 then s_kid_staff and s_kid_work
            when 3 then (s_preg_postpartum and not s_preg_gestation) or ((s_preg_neonatal or s_preg_child or s_preg_babies) and not s_preg_time) or s_preg_regulation
            when 4 then (i and s_liv_injury and s_liv_strong and s_liv_protective and not s_liv_by_herb and not ill) or s_liv_healthy or (s_monograph and not s_liv_existing and not s_liv_gene)
            else (s_ac_provider and s_ac_practice) or s_ac_healthy or s_ac_lupus or s_ac_material end veto, q = 3 and s_preg_review and not s_preg_time early from p1),
    p3 as (select *, case when veto then false when q = 3 and s_preg_eclampsia then true when early then false else base end p from p2),
    p4 as (select *, veto or (early and not s_preg_eclampsia) or (abstract <> '' and not p) or (q = 5 and not p and s_ac_thrombosis) no_p from p3),
    o1 as (select *, q = 1 and (s_op_after or (s_op_in_title and s_op_pressure)) after_op, contains(lower(types), 'review') rev, {_OWN_OUTCOME('').replace('then ', 'then s_').replace('else ', 'else s_')} own, {_OWN_OUTCOME('_title').replace('then ', 'then s_').replace('else ', 'else s_')} own_title,
        {_OWN_OUTCOME('_front').replace('then ', 'then s_').replace('else ', 'else s_')} own_front, front <> '' and s_systematic and s_says_safety and not (s_safety_front or s_evaluated_front) unreported from p4),
    o2 as (select *, case when unreported then own_front or s_safety_front when q = 1 and rev and not s_op_in_title then s_safety_text or s_op_outcome_title
            when q = 4 and s_liv_any_injury and not (s_liv_existing or (i and (s_liv_any_caused or s_liv_herb_injury)) or s_evaluated_text) then false else own or s_safety_text or s_generic_text or after_op end o0,
        not unreported and (s_evaluated_text or s_safety_front or s_safety_title or own_title or s_generic_title or (q = 5 and own_front) or after_op) sure from o1),
    o3 as (select *, q = 4 and s_liv_efficacy and not s_liv_safety e4, s_efficacy_title and not s_harm_title only_title,
        q in (2, 3, 4) and not (q = 4 and trim(types) = '' and (s_liv_existing or s_liv_monograph)) and not sure and s_endpoint_front by_front, q = 1 and (s_op_efficacy_title or s_op_aim or s_op_efficacy) and not s_op_feasibility and not (rev and not s_op_review_efficacy) by_aim from o2),
    o4 as (select *, p and i and (s_endpoint_title or s_efficacy_only or by_front or by_aim or e4 or only_title) and not (sure and (not e4 or s_evaluated_front) and (not only_title or s_evaluated_front or (q in (2, 3) and own_title) or (q = 5 and own))) no_o from o3),
    v1 as (select *, o0 and not no_o o, length(abstract) >= 180 detailed from o4),
    v2 as (select *, no_i or (detailed and p and not s_animal and not i and case when q <= 3 then true when q = 4 then s_alternative or s_biomarker or s_liv_drug or (s_liv_drug_injury and not s_liv_herbal) else not (s_ac_broad and o) end) not_i from v1),
    v3 as (select *, p and not no_p and not s_animal fp, i and not not_i f_i, no_p or not_i or no_o or s_animal or s_editorial against from v2),
    v4 as (select *, fp::int + f_i::int + o::int n, abstract = '' untold from v3),
    z as (select *, case when against then 'deprioritize' when n >= 2 then 'retain' when untold then case when n = 1 then 'uncertain' else 'deprioritize' end when detailed then 'deprioritize' else 'uncertain' end decision,
        case when untold then 'low' when against or n = 3 then 'high' when n = 2 then 'medium' when detailed then 'high' else 'low' end confidence, case when untold then 'title_only' else 'abstract' end evidence_basis from v4)
    select record_id, {_list(P.QUESTIONS)}[q] question_id, decision, confidence, evidence_basis, [c for c in [case when fp then 'population' end, case when f_i then 'exposure' end, case when o then 'outcome' end, case when (s_human_text or s_human_title) and not s_animal then 'human_signal' end,
        case when (s_design or {_OF_TYPES(*P.DESIGN_TYPES)}) and not s_editorial then 'design_signal' end, case when s_animal then 'animal_term_present' end, case when decision = 'deprioritize' then 'off_topic' end, case when untold or decision = 'uncertain' then 'insufficient_abstract' end] if c is not null] codes from z)"""
#: Texts of one question have its signals' names; as columns they end in _.
for _name in ("op_title", "kid_title", "liv_title", "liv_front"):
    _ALL = _ALL.replace(f"regexp_matches({_name}, ", f"regexp_matches({_name}_, ")
#: The records as a table for other queries' SQL.
RECORDS_SQL = f"(select record_id, {_list(P.QUESTIONS)}[q] question_id, title0 as title, abstract0 abstract, types publication_types from " + _ALL[: _ALL.index("\n    a as (select *")].rstrip(",") + " select * from r))"
SQL = {
    "classified_records": f"select record_id, question_id, decision, confidence, evidence_basis, array_to_string(codes, '|') reason_codes from {_ALL}",
    "classified_distribution": f"select question_id, side, value, count(*) n from (select question_id, unnest(['decision', 'evidence_basis', 'confidence']) side, unnest([decision, evidence_basis, confidence]) as value from {_ALL}) group by all",
    "adjudicated_records": f"select question_id, case when l.doc_id is null then decision else 'uncertain' end decision, case when l.doc_id is null then confidence else 'high' end confidence, case when l.doc_id is null then array_to_string(codes, '|') else 'population|outcome' end reason_codes, count(*) n from {_ALL} r left join (select distinct doc_id from labels where toxic = 1) l on l.doc_id = r.record_id group by 1, 2, 3, 4",
    "match_windows": f"""select record_id, {_windows('whole', P.NUTRIENT, P.ADMINISTRATION, 90)} in_use, {_windows('whole', P.STRONG_EXPOSURE, P.RELATION, 130)} or {_windows('whole', P.TRADITIONAL_EXPOSURE, P.RELATION, 130)} linked,
        {_near('whole', P.PREGNANCY_TIME, P.STRONG_EXPOSURE, 900)} pregnancy_near, {_near('whole', P.PROCEDURE, P.PROCEDURE_SUPPLEMENT, 220)} procedure_near from (select *, title || ' ' || abstract whole from {RECORDS_SQL})""",
    "postings_lookup": f"select question_id, record_id from {RECORDS_SQL} where {' and '.join(_has("title || ' ' || abstract", C.AXES[a]) for a in ASKED)}",
    "classified_errors": "select '' question_id, 0::bigint record_id, '' errors where false",
}
QUERIES = {name: globals()[name] for name in SQL}
