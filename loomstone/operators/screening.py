"""Screening decisions from three kinds of evidence: population, intervention and outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import flagged, once

#: An abstract of so many characters is detailed enough to decide on.
DETAILED = 180


def decision_table(p: Column, i: Column, o: Column, against: Column, has_abstract: Column, detailed: Column) -> dict[str, Column]:
    """decision, confidence, evidence_basis, off_topic and insufficient of records with positives p, i, o (never null).

    against: something is explicitly absent, or the record is no report or not clinical. By title alone, two positives retain and one leaves a record
    open, always at low confidence and with too little text. With an abstract, three retain at high and two at medium confidence; fewer
    set a detailed record aside and leave another one open for want of text.
    """
    n = p.cast("int") + i.cast("int") + o.cast("int")
    aside = against | (n == 0) & ~has_abstract | (n < 2) & has_abstract & detailed
    return {
        "decision": F.when(aside, "deprioritize").when(n >= 2, "retain").otherwise("uncertain"),
        "confidence": F.when(~has_abstract, "low").when(aside | (n == 3), "high").when(n == 2, "medium").otherwise("low"),
        "evidence_basis": F.when(has_abstract, "abstract").otherwise("title_only"),
        "off_topic": aside,
        "insufficient": ~has_abstract | ~aside & (n < 2),
    }


def decide(rows: DataFrame, p: Column, i: Column, o: Column, no_p: Column, no_i: Column, no_o: Column, abstract: Column) -> DataFrame:
    """rows with decision, confidence, evidence_basis and reason_codes, from three positives and what is explicitly absent; null is false.

    What is absent isn't positive, whatever else is said of it; the other positives keep their codes.
    """
    rows, f = once(rows, "__flags", {"p": p, "i": i, "o": o, "no_p": no_p, "no_i": no_i, "no_o": no_o})
    p, i, o = f.p & ~f.no_p, f.i & ~f.no_i, f.o & ~f.no_o
    text = F.trim(F.coalesce(abstract, F.lit("")))
    out = decision_table(p, i, o, f.no_p | f.no_i | f.no_o, text != "", F.length(text) >= DETAILED)
    codes = flagged({"population": p, "exposure": i, "outcome": o, "off_topic": out["off_topic"], "insufficient_abstract": out["insufficient"]}, "off_topic")
    return rows.select("*", *(out[c].alias(c) for c in ("decision", "confidence", "evidence_basis")), codes.alias("reason_codes")).drop("__flags0")


def decision_errors(decisions: DataFrame, key: list[str], codes: tuple[str, ...]) -> DataFrame:
    """Decisions that break the contract, with what they break."""
    from loomstone.operators.evidence import violations

    rules = {
        "decision": F.col("decision").isin("retain", "deprioritize", "uncertain"),
        "confidence": F.col("confidence").isin("high", "medium", "low"),
        "evidence_basis": F.col("evidence_basis").isin("abstract", "title_only"),
        "reason_codes": F.size(F.array_except("reason_codes", F.array(*map(F.lit, codes)))) == 0,
        "unique_codes": F.size(F.array_distinct("reason_codes")) == F.size("reason_codes"),
        "title_only_is_low": (F.col("evidence_basis") != "title_only") | (F.col("confidence") == "low") & F.array_contains("reason_codes", "insufficient_abstract"),
    }
    return violations(decisions, key, rules)
