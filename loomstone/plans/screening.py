"""Screening by three patterns and what is explicitly absent, over the records of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.intervals import found
from loomstone.operators import metrics
from loomstone.operators import screening_patterns as P
from loomstone.operators.screening import decide, decision_errors
from loomstone.plans.classified import RECORDS_SQL, _has, records
from loomstone.session import materialized, table

CODES = ("population", "exposure", "outcome", "off_topic", "insufficient_abstract")


def _decided(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d)
    title, text = F.col("title"), F.concat_ws(" ", "title", "abstract")
    asked = lambda patterns: reduce(lambda rest, qp: F.when(F.col("question_id") == qp[0], found(text, qp[1])).otherwise(rest), patterns.items(), F.lit(False))
    absent = (found(title, P.PEDIATRIC) & ~found(title, P.ADULT), found(title, P.NOT_ORAL) & ~found(title, P.ORAL), found(title, P.EFFICACY_TITLE) & ~found(title, P.HARM_TITLE))
    return decide(rows, asked(P.POPULATION), found(text, P.STRONG_EXPOSURE), asked(P.OUTCOME), *absent, F.col("abstract"))


def screening_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("record_id", "decision", "confidence", "evidence_basis", F.array_join("reason_codes", "|").alias("reason_codes"))


def screening_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).groupBy("question_id", "decision").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == "high").alias("high"))


def screening_errors(spark: SparkSession, d: str) -> DataFrame:
    """Decisions into which errors were put: what is labelled toxic is decided as `drop`, and long abstracts say a code twice."""
    toxic = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("record_id")).distinct().withColumn("bad", F.lit(True))
    rows = _decided(spark, d).join(toxic, "record_id", "left")
    rows = rows.withColumn("decision", F.when(F.col("bad"), "drop").otherwise(F.col("decision"))).withColumn("reason_codes", F.when(F.length("abstract") > 4000, F.concat("reason_codes", "reason_codes")).otherwise(F.col("reason_codes")))
    found_errors = decision_errors(rows, ["record_id"], CODES)
    return found_errors.select("record_id", F.array_join("errors", ",").alias("errors"))


def metric_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of records whose documents are labelled against what the labels say, by layer and question."""
    says = F.when(F.max("quality") == 1, "retain").when(F.max("toxic") == 1, "uncertain").otherwise("deprioritize")
    truth = table(spark, d, "labels").filter("doc_id is not null").groupBy(F.col("doc_id").alias("record_id")).agg(says.alias("reference"))
    n = F.col("record_id")
    labels = _decided(spark, d).select("question_id", "record_id", "decision").join(truth.select("record_id"), "record_id", "left_semi")
    labels = materialized(labels, "decisions")  # patterns are matched once, for the check of the keys and all sums
    layers = F.array(F.lit("all"), F.when(n % 4 == 0, "adjudication").otherwise("worker"), F.col("question_id"))
    blocks = metrics.metric_blocks(metrics.paired_labels(labels, truth, ["record_id"]), layers, "decision", "reference", "retain", 1 + n % 3)
    return blocks.select("layer", "n", "same", *(F.round(c, 6).alias(c) for c in BLOCK))


#: Numbers of a block.
BLOCK = ("tp", "fp", "fn", "tn", "recall", "specificity", "precision", "f1", "agreement", "prevalence", "reverse_recall", "reverse_specificity", "represented", "scorer_prevalence", "unweighted_agreement", "low", "high", "kappa")
_TEXT = "title || ' ' || abstract"
_OF = lambda patterns: "case question_id " + " ".join(f"when '{q}' then {_has(_TEXT, p)}" for q, p in patterns.items()) + " else false end"
_FLAGS = f"""select *, {_OF(P.POPULATION)} p0, {_has(_TEXT, P.STRONG_EXPOSURE)} i0, {_OF(P.OUTCOME)} o0, {_has('title', P.PEDIATRIC)} and not {_has('title', P.ADULT)} np,
    {_has('title', P.NOT_ORAL)} and not {_has('title', P.ORAL)} ni, {_has('title', P.EFFICACY_TITLE)} and not {_has('title', P.HARM_TITLE)} no from {RECORDS_SQL}"""
#: One row for each line of the decision table, as it is stated: what speaks against a record comes first, then how many positives are left.
_DECIDED = f"""select *, case when neg then 'deprioritize' when k >= 2 then 'retain' when not t and dt then 'deprioritize' when t and k = 0 then 'deprioritize' else 'uncertain' end decision,
    case when t then 'low' when neg then 'high' when k = 3 then 'high' when k = 2 then 'medium' when dt then 'high' else 'low' end confidence, case when t then 'title_only' else 'abstract' end evidence_basis,
    [x for x in [case when p then 'population' end, case when i then 'exposure' end, case when o then 'outcome' end, case when neg or (t and k = 0) or (not t and k < 2 and dt) then 'off_topic' end, case when t or (not neg and k < 2 and not dt) then 'insufficient_abstract' end] if x is not null] codes
    from (select *, trim(abstract, ' ') = '' t, p::int + i::int + o::int k, length(trim(abstract, ' ')) >= 180 dt from (select *, p0 and not np p, i0 and not ni i, o0 and not no o, np or ni or no neg from ({_FLAGS})))"""
SQL = {
    "screening_decisions": f"select record_id, decision, confidence, evidence_basis, case when len(codes) = 0 then 'off_topic' else array_to_string(codes, '|') end reason_codes from ({_DECIDED})",
    "screening_distribution": f"select question_id, decision, count(*) n, count(*) filter (confidence = 'high') high from ({_DECIDED}) group by 1, 2",
    "metric_blocks": f"""with t as (select doc_id, case when max(quality) = 1 then 'retain' when max(toxic) = 1 then 'uncertain' else 'deprioritize' end reference from labels where doc_id is not null group by 1),
        x as (select *, unnest(['all', case when record_id % 4 = 0 then 'adjudication' else 'worker' end, question_id]) layer, (1 + record_id % 3)::double w from ({_DECIDED}) join t on doc_id = record_id),
        c as (select layer, count(*) n, count(*) filter (decision = reference) same, coalesce(sum(w) filter (decision = 'retain' and reference = 'retain'), 0) tp, coalesce(sum(w) filter (decision = 'retain' and reference <> 'retain'), 0) fp, coalesce(sum(w) filter (decision <> 'retain' and reference = 'retain'), 0) fn,
            coalesce(sum(w) filter (decision <> 'retain' and reference <> 'retain'), 0) tn, sum(w) represented from x group by 1),
        m as (select layer, v, count(*) filter (decision = v)::double * count(*) filter (reference = v) / count(*) / count(*) e from x, (select unnest(['retain', 'deprioritize', 'uncertain']) v) group by 1, 2),
        k as (select layer, sum(e) e from m group by 1), r as (select c.*, e, tp / nullif(tp + fn, 0) recall, tp / nullif(tp + fp, 0) prec, same / n::double u, 1 + 1.959963985::double ^ 2 / n z from c join k using (layer))
        select layer, n, same, round(tp, 6) tp, round(fp, 6) fp, round(fn, 6) fn, round(tn, 6) tn, round(recall, 6) recall, round(tn / nullif(tn + fp, 0), 6) specificity, round(prec, 6) as "precision", round(case when recall = 0 or prec = 0 then 0 else 2 * recall * prec / (recall + prec) end, 6) f1,
            round((tp + tn) / (tp + fp + fn + tn), 6) agreement, round((tp + fn) / (tp + fp + fn + tn), 6) prevalence, round(prec, 6) reverse_recall, round(tn / nullif(fn + tn, 0), 6) reverse_specificity, round(represented, 6) represented, round((tp + fp) / represented, 6) scorer_prevalence, round(u, 6) unweighted_agreement,
            round(greatest(0, (u + 1.959963985::double ^ 2 / (2 * n)) / z - 1.959963985 * sqrt(u * (1 - u) / n + 1.959963985::double ^ 2 / (4.0 * n * n)) / z), 6) low, round(least(1, (u + 1.959963985::double ^ 2 / (2 * n)) / z + 1.959963985 * sqrt(u * (1 - u) / n + 1.959963985::double ^ 2 / (4.0 * n * n)) / z), 6) high,
            round(case when 1 - e >= 1e-12 then (u - e) / (1 - e) end, 6) kappa from r""",
    "screening_errors": f"select record_id, array_to_string(e, ',') errors from (select record_id, [x for x in [case when record_id in (select doc_id from labels where toxic = 1) then 'decision' end, case when length(abstract) > 4000 then 'unique_codes' end] if x is not null] e from {RECORDS_SQL}) where len(e) > 0",
}
QUERIES = {name: globals()[name] for name in SQL}
