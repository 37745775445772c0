"""The screening classifier: match intervals against brute force, cases of every branch, invariance, and adjudications."""

import re

import pytest
from pyspark.sql import functions as F

from loomstone.functions.intervals import any_window, concepts_near, intervals
from loomstone.operators import screening_patterns as P
from loomstone.operators.classify import classify, with_adjudications

TEXTS = [
    "", "iron", "iron iron", "given iron and zinc; " * 30, "x" * 95 + " iron " + "y" * 84 + " dose", "dose" + "z" * 89 + " iron", "zdose" + " " * 86 + "iron", "éiron naïve iron\u0001 iron\u0002 dose ironé",
    "IRON\n\nwas GIVEN " + "word " * 40 + "zinc", "\U0001f600 iron \U0001f600 taking", "vitamin D3 vitamin B12 capsules",
]


def spans(text, pattern):
    return [(m.start(), m.end()) for m in re.finditer(pattern, text, re.IGNORECASE)]


def test_intervals_and_windows_equal_brute_force(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    got = df.select("k", intervals(F.col("t"), P.NUTRIENT).alias("s"), any_window(F.col("t"), intervals(F.col("t"), P.NUTRIENT), P.ADMINISTRATION, 90).alias("w"), *(concepts_near(F.col("t"), r"\biron\b", r"\bzinc\b", d).alias(f"n{d}") for d in (5, 12, 900)))
    for row in got.collect():
        text = TEXTS[row["k"]].replace("\u0001", " ").replace("\u0002", " ")
        found = spans(text, P.NUTRIENT)
        assert [(s["start"], s["end"]) for s in row["s"]] == found
        assert row["w"] == any(re.search(P.ADMINISTRATION, text[max(0, a - 90) : b + 90], re.IGNORECASE) for a, b in found)
        for d in (5, 12, 900):
            assert row[f"n{d}"] == any(abs(a - b) <= d for a, _ in spans(text, r"\biron\b") for b, _ in spans(text, r"\bzinc\b"))


def record(question, title, abstract="", types="Journal Article"):
    return (question, "r", title, abstract, types)


def classified(spark, rows):
    schema = "question_id string, record_id string, title string, abstract string, publication_types string, n int"
    out = classify(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], schema)).orderBy("n").collect()
    return [(r["decision"], r["confidence"], set(r["reason_codes"]), r["evidence_basis"], list(r["reason_codes"])) for r in out]


Q1, Q2, Q3, Q4, Q5 = P.QUESTIONS
#: name, record, decision, codes that must be there, codes that must not, confidence (None: any).
CASES = [
    ("supplementing language", record(Q1, "Supplementing instruction in surgical simulation training for medical students", "METHODS: Medical students received extra instruction during a simulated examination. RESULTS: Student interaction scores improved."), "deprioritize", set(), {"exposure"}, None),
    ("target title", record(Q1, "Dietary vitamin D supplementation and bleeding after surgery"), "retain", {"population", "exposure", "outcome", "insufficient_abstract"}, set(), "low"),
    ("animals", record(Q2, "Curcumin protects against renal injury in rats with potential clinical application", "METHODS: Rats were treated with curcumin. RESULTS: Renal injury was reduced."), "deprioritize", {"animal_term_present"}, {"population", "human_signal"}, None),
    ("negated liver", record(Q4, "Nutritional supplementation in adults without hepatic disease", "METHODS: Adults without liver disease received an oral multivitamin. RESULTS: No adverse events were observed."), "deprioritize", set(), {"population"}, None),
    ("zero events", record(Q4, "Herbal supplementation in patients with cirrhosis", "METHODS: Patients with cirrhosis received an oral herbal supplement. RESULTS: No adverse events were observed."), "retain", {"population", "exposure", "outcome"}, set(), None),
    ("drug class", record(Q5, "Safety of switching from a vitamin K antagonist to a non-vitamin K oral anticoagulant", "METHODS: Patients receiving warfarin switched to apixaban. RESULTS: Bleeding was recorded."), "deprioritize", set(), {"exposure"}, None),
    ("broad interactions", record(Q5, "Warfarin safety and interactions", "This review discusses bleeding, INR monitoring, drug interactions, diet, and lifestyle for patients receiving warfarin.", "Review|Journal Article"), "retain", set(), {"exposure"}, None),
    ("hospital", record(Q1, "Postoperative complication prediction after hip surgery", "METHODS: Patients were enrolled at the Hospital of Traditional Chinese Medicine. RESULTS: Readmission was predicted from routine laboratory data."), "retain", set(), {"exposure"}, None),
    ("biomarker", record(Q3, "Maternal plasma choline concentrations and birth weight", "METHODS: Plasma choline was measured in pregnant participants. RESULTS: Concentrations were associated with birth weight."), "deprioritize", set(), {"exposure"}, None),
    ("perinatal", record(Q3, "Dietary supplements in the perinatal period"), "retain", {"population", "exposure", "insufficient_abstract"}, set(), "low"),
    ("postpartum", record(Q3, "Oral iron supplementation for postpartum anemia", "METHODS: Women received iron after delivery. RESULTS: Hemoglobin improved."), "deprioritize", set(), {"population"}, None),
    ("cells", record(Q4, "Hawthorn extract protects HepG2 cells from induced hepatotoxicity", "METHODS: HepG2 cells were treated with hawthorn extract. RESULTS: Injury markers fell."), "deprioritize", {"animal_term_present"}, {"population", "human_signal"}, None),
    ("caused injury", record(Q4, "Acute liver failure secondary to green tea extract"), "retain", {"exposure", "outcome", "insufficient_abstract"}, set(), "low"),
    ("reversal", record(Q5, "Vitamin K and plasma for reversal of warfarin-associated hemorrhage", "METHODS: Warfarin users with hemorrhage received vitamin K and plasma."), "deprioritize", set(), {"exposure"}, None),
    ("hyphens", record(Q5, "DOACs versus vitamin-K antagonists for major bleeding"), "deprioritize", set(), {"exposure"}, "low"),
    ("reply", record(Q5, "DOAC-VKA comparisons in kidney recipients. Author's reply.", "", "Letter"), "deprioritize", set(), set(), "low"),
    # Further branches, worked out by hand.
    ("kidney drug", record(Q2, "Cinacalcet and vitamin D supplements in dialysis patients: hypercalcemia"), "deprioritize", {"population", "outcome"}, {"exposure"}, "low"),
    ("kidney staff", record(Q2, "Dietitians in dialysis units: a survey of supplement practice"), "deprioritize", {"exposure"}, {"population"}, "low"),
    ("without kidney disease", record(Q2, "Zinc supplementation in adults without chronic kidney disease"), "uncertain", {"exposure"}, {"population"}, "low"),
    ("ordinary diet", record(Q2, "Dietary patterns and hyperkalemia in kidney failure"), "deprioritize", {"population", "outcome", "off_topic"}, {"exposure"}, "low"),
    ("named supplementation outweighs diet", record(Q2, "Food intake and potassium supplementation: hyperkalemia in kidney failure"), "retain", {"population", "exposure", "outcome"}, {"off_topic"}, "low"),
    ("topical", record(Q1, "Topical curcumin gel after surgery: bleeding"), "deprioritize", {"population", "outcome"}, {"exposure"}, "low"),
    ("eclampsia grants", record(Q3, "Calcium supplementation review and pre-eclampsia"), "retain", {"population", "exposure", "outcome"}, {"off_topic"}, "low"),
    ("a later veto holds", record(Q3, "Calcium supplementation for preeclampsia in newborn infants postpartum"), "deprioritize", {"exposure"}, {"population"}, "low"),
    ("prevention in pregnancy", record(Q3, "Folic acid to prevent preterm birth in pregnancy"), "retain", {"population", "exposure", "outcome"}, set(), "low"),
    ("prevention without a harm", record(Q3, "Folic acid to prevent tiredness in pregnancy: a complication"), "retain", {"population", "exposure", "outcome"}, set(), "low"),
    ("prevention alone", record(Q3, "Folic acid to prevent tiredness in pregnancy", "METHODS: Pregnant women received folic acid. RESULTS: Tiredness improved.", ""), "deprioritize", {"population", "exposure"}, {"outcome"}, "high"),
    ("protective title", record(Q4, "Silymarin protects from acute liver injury due to drugs"), "deprioritize", {"exposure"}, {"population"}, "low"),
    ("healthy volunteers", record(Q5, "Ginkgo and warfarin in healthy volunteers: pharmacokinetics"), "deprioritize", {"exposure", "outcome"}, {"population"}, "low"),
    ("blood product", record(Q5, "Antithrombin supplementation during heparin therapy and thromboembolism"), "deprioritize", {"population", "outcome"}, {"exposure"}, "low"),
    ("efficacy only", record(Q5, "Efficacy of ginseng in warfarin users"), "deprioritize", {"population", "exposure"}, {"outcome"}, "low"),
    ("efficacy of a question's outcome", record(Q5, "Efficacy of ginseng in warfarin users: bleeding"), "retain", {"population", "exposure", "outcome"}, set(), "low"),
    ("short and thin", record(Q2, "Notes", "Iron was given."), "deprioritize", {"exposure", "off_topic"}, {"insufficient_abstract"}, "high"),
    ("detailed other intervention", record(Q2, "Exercise in dialysis patients: mortality", "METHODS: We enrolled 120 dialysis patients. RESULTS: Mortality was recorded over two years in both arms, and hospitalization was rare in either of them, as far as follow-up could tell us at the end.", "Randomized Controlled Trial"), "deprioritize", {"population", "outcome", "human_signal", "design_signal"}, {"exposure"}, "high"),
    ("short other intervention", record(Q2, "Exercise in dialysis patients: mortality", "METHODS: We enrolled 120 dialysis patients. RESULTS: Mortality fell.", "Randomized Controlled Trial"), "retain", {"population", "outcome", "human_signal", "design_signal"}, {"exposure"}, "medium"),
    ("acronym carried", record(Q1, "Recovery of patients after hip surgery and bleeding", "BACKGROUND: Buyang Huanwu Decoction (BHD) is old.\nMETHODS: Patients underwent surgery and were followed under BHD.\nRESULTS: Bleeding was rare."), "retain", {"population", "exposure", "outcome"}, set(), "high"),
    ("acronym not carried", record(Q1, "Recovery of patients after hip surgery and bleeding", "BACKGROUND: Buyang Huanwu Decoction (BHD) is old.\nMETHODS: Patients underwent surgery and were followed.\nRESULTS: Bleeding was rare."), "retain", {"population", "outcome"}, {"exposure"}, "medium"),
    ("far from the procedure", record(Q1, "Herbal supplements at home", "Herbal capsules were taken. " + "Nothing else was of note here. " * 12 + "Later the patients underwent surgery with bleeding."), "deprioritize", {"exposure", "outcome"}, {"population"}, "high"),
    ("near the procedure", record(Q1, "Herbal supplements at home", "Later the patients underwent surgery with bleeding. Herbal capsules were taken before surgery. " + "Nothing else was of note here. " * 12), "retain", {"population", "exposure", "outcome"}, set(), "high"),
    ("comment with data", record(Q5, "Ginkgo and warfarin: bleeding", "METHODS: We enrolled 12 patients.", "Comment"), "retain", {"exposure", "population", "outcome", "human_signal"}, {"design_signal", "off_topic"}, "high"),
]


@pytest.fixture(scope="module")
def results(spark):
    return dict(zip((c[0] for c in CASES), classified(spark, [c[1] for c in CASES]), strict=True))


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_case(results, case):
    name, row, decision, required, forbidden, confidence = case
    got = results[name]
    assert got[0] == decision and required <= got[2] and not forbidden & got[2], got
    assert confidence in (None, got[1]), got
    assert got[3] == ("abstract" if row[3] else "title_only")
    assert got[4] == [c for c in P.REASON_CODES if c in got[2]]


def test_background_and_identifiers_do_not_matter(spark):
    base = record(Q1, "Peer feedback in clinical examination training", "METHODS: Students practiced examination skills. RESULTS: Training scores improved.")
    other = (Q1, "changed", base[2], "BACKGROUND: Surgical patients sometimes use herbal supplements and experience bleeding.\n" + base[3], base[4])
    a, b = classified(spark, [base, other])
    assert a == b


def test_nulls_empty_tables_and_long_texts(spark):
    rows = [(None, None, None, None, None), (Q1, "r", None, " \n", None), ("unknown", "r", "Iron supplementation and safety", "x " * 200, ""), (Q5, "r", "Ginkgo with warfarin", "Bleeding in patients taking warfarin and ginkgo. " * 3000, "")]
    got = classified(spark, rows)
    assert [g[0] for g in got] == ["deprioritize", "deprioritize", "deprioritize", "retain"]
    assert got[0][2] == {"off_topic", "insufficient_abstract"} and got[3][2] >= {"population", "exposure", "outcome"}
    empty = spark.createDataFrame([], "question_id string, title string, abstract string, publication_types string, decision_date string")
    assert classify(empty).count() == 0


def test_adjudications_replace_or_are_refused(spark):
    rows = spark.createDataFrame([(Q1, "a", "Vitamin D supplementation after surgery", "", ""), (Q1, "b", "Vitamin D supplementation after surgery", "", "")], "question_id string, record_id string, title string, abstract string, publication_types string")
    kind = "question_id string, record_id string, decision string, confidence string, evidence_basis string, reason_codes array<string>, status string"
    good = (Q1, "a", "uncertain", "high", "abstract", ["population"], "ok")
    out = {r["record_id"]: r for r in with_adjudications(classify(rows), spark.createDataFrame([good], kind), 1).collect()}
    assert (out["a"]["decision"], out["a"]["reason_codes"], out["a"]["evidence_basis"]) == ("uncertain", ["population"], "abstract") and out["b"]["decision"] == "retain"
    bad = [[good, good], [("", *good[1:])], [(*good[:2], "drop", *good[3:])], [(*good[:5], [], "ok")], [(*good[:5], ["population", "population"], "ok")], [(*good[:5], ["other"], "ok")], [(*good[:6], "failed")], [(*good[:2], None, *good[3:])]]
    for adjudications in bad:
        with pytest.raises(ValueError):
            with_adjudications(classify(rows), spark.createDataFrame(adjudications, kind))
    with pytest.raises(ValueError):
        with_adjudications(classify(rows), spark.createDataFrame([good], kind), 2)
