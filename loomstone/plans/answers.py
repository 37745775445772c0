"""Lookup requests made of events, answered over the records of documents with the real axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import clinical as C
from loomstone.operators import lookup, response
from loomstone.operators import screening_patterns as P
from loomstone.plans.classified import RECORDS_SQL, records
from loomstone.session import importable, materialized, table

#: The axes in order, with the input field of each.
FIELDS = {"age_group": "age", "concomitant_medication": "medication", "dose_range": "dose", "sex": "sex", "underlying_condition": "condition"}


def _requests(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    listed = F.filter(F.array(*(F.when((n % 32).bitwiseAND(1 << k) != 0, a) for k, a in enumerate(FIELDS))), lambda x: x.isNotNull())
    axes = F.when(n % 7 == 0, None).when(n % 13 == 0, F.array_append(listed, F.lit("weight"))).otherwise(listed)
    inputs = F.create_map(F.lit("age"), F.when(n % 2 == 0, "60").otherwise(" - "), F.lit("dose"), F.when(n % 3 == 0, "5 mg").otherwise(""))
    situation = F.element_at(F.array(*map(F.lit, (*P.QUESTIONS, "HRS9_OTHER"))), (F.col("user_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select(n.alias("request_id"), situation.alias("situation"), axes.alias("axes"), inputs.alias("inputs"), (n % 3 == 0).alias("expanded"), F.when(n % 5 != 0, (n % 90 - 10).cast("double")).alias("offset"))


def _evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    text = F.concat_ws(" ", "title", "abstract")
    shows = {a: C.matches(text, C.AXES[a]) for a in FIELDS}
    rows = records(spark, d).select(F.col("question_id").alias("situation"), "record_id", response.axis_bits(shows).alias("bits"), (F.col("record_id") % 50).alias("score"), F.col("title").alias("finding"))
    rows = materialized(rows, "evidence")  # patterns are matched once
    return rows, lookup.top_k(rows, ["situation"], [F.desc("score"), F.col("record_id")], response.SELECTED).drop("rank")


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    evidence, core = _evidence(spark, d)
    return response.respond(_requests(spark, d), evidence, core, P.QUESTIONS, FIELDS), evidence, core


def lookup_response(spark: SparkSession, d: str) -> DataFrame:
    answers = _answers(spark, d)[0]
    joined = {c: F.array_join(c, "|").alias(c) for c in ("applied_axes", "unavailable_axes")} | {"trace": F.array_join(F.transform("trace", lambda n: n.cast("string")), "|").alias("trace")}
    return answers.select("request_id", "error", *joined.values(), "extended_total", "page_offset", "core_shown", "extended_shown", "matching_basis")


def lookup_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The records that each request is shown, in order; the greedy order has no SQL."""
    importable(spark)
    answers, evidence, core = _answers(spark, d)
    return response.shown_evidence(materialized(answers, "answers"), evidence, core, "record_id", "score", "finding")


_BITS = " + ".join(f"case when regexp_matches(title || ' ' || abstract, '(?i){C.AXES[a]}') then {1 << k} else 0 end" for k, a in enumerate(FIELDS))
_NAMES = lambda bits: "array_to_string([x for x in [" + ", ".join(f"case when {bits} & {1 << k} <> 0 then '{a}' end" for k, a in enumerate(FIELDS)) + "] if x is not null], '|')"
_LEFT = lambda mask: f"(select count(*) from core where core.question_id = a.question_id and bits & (a.applied & {mask}) = (a.applied & {mask}))"
_STEPS = ", ".join(f"case when applied & {1 << k} <> 0 then {_LEFT((1 << (k + 1)) - 1)}::varchar end" for k in range(len(FIELDS)))
SQL = {
    "lookup_response": f"""with e as materialized (select question_id, record_id, {_BITS} bits from {RECORDS_SQL}), core as materialized (select question_id, bits from (select *, row_number() over (partition by question_id order by record_id % 50 desc, record_id) r from e) where r <= 15),
        q as (select event_id n, [{', '.join(repr(s) for s in (*P.QUESTIONS, 'HRS9_OTHER'))}][user_id % 6 + 1] question_id, event_id % 3 = 0 wide, case when event_id % 5 <> 0 then event_id % 90 - 10 else 0 end off,
            case when user_id % 6 = 5 then 'unknown situation' when event_id % 7 <> 0 and event_id % 13 = 0 then 'unknown axis' end error, case when event_id % 7 = 0 then case when event_id % 2 = 0 then 1 else 0 end + case when event_id % 3 = 0 then 4 else 0 end else event_id % 32 end wanted from events),
        s as (select question_id, bit_or(bits) there from core group by 1), a as (select q.*, wanted & coalesce(there, 0) applied from q left join s using (question_id)),
        t as (select *, (select count(*) from core where core.question_id = a.question_id and bits & a.applied = a.applied) left_, (select count(*) from e where e.question_id = a.question_id and bits & a.applied = a.applied) total,
            array_to_string([x for x in [(select count(*) from core where core.question_id = a.question_id)::varchar, {_STEPS}] if x is not null], '|') trace from a),
        u as (select *, case when wide and off > 0 then least(off, (greatest(total, 1) - 1) // 30 * 30) else 0 end page_offset, case when wide then 0 else least(left_, 15) end core_shown from t)
        select n request_id, error, case when error is null then {_NAMES('applied')} end applied_axes, case when error is null then {_NAMES('(wanted - applied)')} end unavailable_axes, case when error is null then trace end trace, case when error is null then total end extended_total,
            case when error is null then page_offset::bigint end page_offset, case when error is null then core_shown::bigint end core_shown, case when error is null then (case when wide then least(total - page_offset, 30) when applied <> 0 then least(15 - core_shown, total - left_) else 0 end)::bigint end extended_shown,
            case when error is null then case when wide and applied <> 0 then 'metadata_axis_presence_extended' when wide then 'expanded_question_corpus' when applied <> 0 then 'metadata_axis_presence' else 'question_core_evidence' end end matching_basis from u""",
}
QUERIES = {"lookup_response": lookup_response, "lookup_evidence": lookup_evidence}
