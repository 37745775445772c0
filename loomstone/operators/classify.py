"""The screening classifier: population, exposure and outcome of a record for its question, and the decision that follows.

A record's texts (title, foreground, and both with noise phrases cut out) come first, then every pattern is matched once into an array of flags, those of one question only for
its records: in tasks, on Arrow batches (`functions.plain`); records with characters that this can't read alike are matched as columns. The rest is columns. What a rule says is a claim: when it holds, what grants it and what vetoes
it; a veto also says that the claim is explicitly absent. Exposure, population and outcome are projected one after the other, as each
reads the one before, so no expression is written out where it is used.

Defined results: null texts and types are empty; a null or unknown question has no population and no specific outcome; repeated rows are classified each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from loomstone.functions import plain
from loomstone.functions.intervals import any_window, concepts_near, found, intervals, stripped, without
from loomstone.functions.text import flagged, let, once
from loomstone.operators import clinical
from loomstone.operators import screening_patterns as P
from loomstone.operators.screening import decision_table
from loomstone.session import importable

#: Texts and what is searched in them, by question ("": all). Each pair is matched once.
SIGNALS: dict[str, dict[str, tuple[str, str]]] = {
    "": {
        "strong": ("bare_title", P.STRONG_EXPOSURE), "traditional": ("bare_title", P.TRADITIONAL_EXPOSURE), "nutrition": ("bare_title", P.NUTRITION_TITLE), "form": ("bare_title", P.SUPPLEMENT_FORM),
        "target": ("bare_title", P.NAMED_TARGET), "given": ("bare_title", P.GIVEN_TITLE), "diet": ("title", P.ORDINARY_DIET), "intake": ("title", P.DIETARY_INTAKE), "meal": ("title", P.MEAL_PROGRAM),
        "named_supplementation": ("title", P.NAMED_SUPPLEMENTATION), "not_oral": ("title", P.NOT_ORAL), "oral": ("title", P.ORAL), "aroma": ("title", P.AROMATHERAPY), "biomarker": ("title", P.BIOMARKER_TITLE),
        "endogenous": ("title", P.ENDOGENOUS_NUTRIENT), "measured": ("title", P.MEASURED_NUTRIENT), "measure": ("title", P.NUTRIENT_MEASURE), "trial_title": ("title", P.INTERVENTION_TITLE),
        "trial_nutrient": ("title", P.INTERVENTION_NUTRIENT), "malnutrition": ("title", P.MALNUTRITION), "alternative": ("title", P.ALTERNATIVE_TITLE), "hard_alternative": ("title", P.HARD_ALTERNATIVE),
        "other_focus": ("title", P.OTHER_FOCUS), "summary": ("title", P.SUMMARY_TITLE), "tcm": ("front", P.CHINESE_MEDICINE), "product": ("title_bare_front", P.NAMED_PRODUCT),
        "traditional_abstract": ("abstract", P.TRADITIONAL_EXPOSURE), "structured": ("abstract", rf"(?m)^[ \t]*(?:{clinical.SECTION})\s*:\s*"), "monograph": ("abstract", P.MONOGRAPH),
        "safety_text": ("text", P.DIRECT_SAFETY), "safety_title": ("title", P.DIRECT_SAFETY), "safety_front": ("front", P.DIRECT_SAFETY), "generic_text": ("text", P.GENERIC_OUTCOME), "generic_title": ("title", P.GENERIC_OUTCOME),
        "evaluated_text": ("text", P.SAFETY_EVALUATION), "evaluated_front": ("front", P.SAFETY_EVALUATION), "systematic": ("title", P.SYSTEMATIC_TITLE), "says_safety": ("title", P.SAFETY_TITLE),
        "endpoint_title": ("title", P.EFFICACY_ENDPOINT), "endpoint_front": ("front", P.EFFICACY_ENDPOINT), "efficacy_only": ("title", P.EFFICACY_ONLY), "efficacy_title": ("title", P.EFFICACY_TITLE), "harm_title": ("title", P.HARM_TITLE),
        "human_text": ("text", P.HUMAN_STUDY), "human_title": ("title", P.HUMAN_TITLE), "design": ("text", P.DESIGN),
    },
    P.PERIOPERATIVE: {
        "op_title": ("op_title", P.POPULATION[P.PERIOPERATIVE]), "op_teaching": ("title", P.TEACHING_TITLE), "op_procedure": ("op_front", P.PROCEDURE), "op_around": ("op_front", P.AROUND_OPERATION),
        "op_provider": ("title", P.SURGICAL_PROVIDER), "op_practice": ("title", P.SURGICAL_PRACTICE), "op_consequence": ("title", P.CONSEQUENT_PROCEDURE), "op_child": ("title", P.PEDIATRIC), "op_adult": ("title", P.ADULT),
        "op_in_title": ("title", P.POPULATION[P.PERIOPERATIVE]), "op_after": ("text", P.AFTER_OPERATION), "op_pressure": ("title", P.BLOOD_PRESSURE), "op_outcome": ("text", P.OUTCOME[P.PERIOPERATIVE]),
        "op_outcome_title": ("title", P.OUTCOME[P.PERIOPERATIVE]), "op_outcome_front": ("front", P.OUTCOME[P.PERIOPERATIVE]), "op_efficacy_title": ("title", P.OPERATION_EFFICACY_TITLE), "op_aim": ("aim", P.STATED_AIM),
        "op_efficacy": ("beginning", P.OPERATION_EFFICACY), "op_feasibility": ("title", P.FEASIBILITY), "op_review_efficacy": ("title", P.REVIEW_EFFICACY_TITLE),
    },
    P.KIDNEY: {
        "kid_title": ("kid_title", P.POPULATION[P.KIDNEY]), "kid_patients": ("front", P.KIDNEY_PATIENTS), "kid_staff": ("title", P.KIDNEY_STAFF), "kid_work": ("title", P.STAFF_WORK), "kid_drug": ("title", P.KIDNEY_DRUG),
        "kid_outcome": ("text", P.OUTCOME[P.KIDNEY]), "kid_outcome_title": ("title", P.OUTCOME[P.KIDNEY]), "kid_outcome_front": ("front", P.OUTCOME[P.KIDNEY]),
    },
    P.PREGNANCY: {
        "preg_nutrient": ("bare_title", P.NUTRIENT), "preg_prevention": ("bare_title", P.PREVENTION_TITLE), "preg_bare_time": ("bare_title", P.PREGNANCY_TIME), "preg_trial": ("bare_title", P.PREGNANCY_TRIAL_TITLE),
        "preg_other": ("title", P.PREGNANCY_OTHER_FOCUS), "preg_microbiome": ("title", P.MICROBIOME), "preg_time": ("preg_title", P.PREGNANCY_TIME), "preg_gestation": ("preg_title", P.GESTATION_TITLE),
        "preg_people": ("front", P.PREGNANT_PEOPLE), "preg_review": ("title", P.REVIEW_TITLE), "preg_eclampsia": ("title", P.ECLAMPSIA), "preg_postpartum": ("title", P.POSTPARTUM), "preg_neonatal": ("title", P.NEONATAL),
        "preg_child": ("title", P.PEDIATRIC), "preg_babies": ("title", P.BABIES), "preg_regulation": ("title", P.REGULATION_TITLE), "preg_outcome": ("text", P.OUTCOME[P.PREGNANCY]),
        "preg_outcome_title": ("title", P.OUTCOME[P.PREGNANCY]), "preg_outcome_front": ("front", P.OUTCOME[P.PREGNANCY]),
    },
    P.LIVER: {
        "liv_title": ("liv_title", P.LIVER_EXISTING), "liv_coma_title": ("title", P.ENCEPHALOPATHY), "liv_front": ("liv_front", P.LIVER_EXISTING), "liv_coma_front": ("front", P.ENCEPHALOPATHY), "liv_patients": ("front", P.LIVER_PATIENTS),
        "liv_review": ("title", P.LIVER_REVIEW_TITLE), "liv_population": ("title", P.POPULATION[P.LIVER]), "liv_injury": ("liv_text", P.LIVER_INJURY), "liv_caused": ("liv_text", P.CAUSED), "liv_herb_caused": ("liv_text", P.HERB_CAUSED_INJURY),
        "liv_injury_title": ("title", P.LIVER_INJURY), "liv_caused_title": ("title", P.CAUSED_TITLE), "liv_strong": ("title", P.STRONG_EXPOSURE), "liv_protective": ("title", P.PROTECTIVE), "liv_by_herb": ("title", P.CAUSED_BY_HERB_TITLE),
        "liv_healthy": ("title", P.HEALTHY), "liv_existing": ("title", P.LIVER_EXISTING), "liv_gene": ("title", P.LIVER_GENE_TITLE), "liv_outcome": ("text", P.OUTCOME[P.LIVER]), "liv_outcome_title": ("title", P.OUTCOME[P.LIVER]),
        "liv_outcome_front": ("front", P.OUTCOME[P.LIVER]), "liv_any_injury": ("text", P.LIVER_INJURY), "liv_any_caused": ("text", P.CAUSED), "liv_herb_injury": ("text", P.HERB_INJURY), "liv_monograph": ("title", P.LIVER_MONOGRAPH_TITLE),
        "liv_efficacy": ("title", P.LIVER_EFFICACY_TITLE), "liv_safety": ("title", P.LIVER_SAFETY_TITLE), "liv_drug": ("title", P.LIVER_DRUG_TITLE), "liv_drug_injury": ("title", P.DRUG_INJURY_TITLE), "liv_herbal": ("text", P.HERBAL_TEXT),
    },
    P.ANTICOAGULATION: {
        "ac_class_title": ("title", P.VITAMIN_K_DRUG_TITLE), "ac_reversal": ("text", P.VITAMIN_K_REVERSAL), "ac_therapy": ("text", P.VITAMIN_K_THERAPY), "ac_food": ("text", P.VITAMIN_K_FOOD), "ac_measured": ("text", P.MEASURED_VITAMIN_K),
        "ac_blood": ("text", P.BLOOD_PRODUCT), "ac_antithrombin": ("title", P.ANTITHROMBIN_TITLE), "ac_at": ("front", P.ANTITHROMBIN_SHORT), "ac_comparison": ("title", P.DRUG_COMPARISON), "ac_compared": ("title", P.COMPARED_SUPPLEMENT),
        "ac_lupus": ("title", P.LUPUS), "ac_material": ("text", P.HEPARIN_MATERIAL), "ac_title": ("title", P.POPULATION[P.ANTICOAGULATION]), "ac_text": ("text", P.POPULATION[P.ANTICOAGULATION]), "ac_patients": ("front", P.ON_ANTICOAGULANT),
        "ac_review": ("title", P.BROAD_REVIEW_TITLE), "ac_provider": ("title", P.DRUG_PROVIDER), "ac_practice": ("title", P.DRUG_PRACTICE), "ac_healthy": ("title", P.HEALTHY), "ac_thrombosis": ("title", P.THROMBOSIS_TITLE),
        "ac_outcome": ("text", P.OUTCOME[P.ANTICOAGULATION]), "ac_outcome_title": ("title", P.OUTCOME[P.ANTICOAGULATION]), "ac_outcome_front": ("front", P.OUTCOME[P.ANTICOAGULATION]), "ac_broad": ("text", P.BROAD_INTERACTION),
    },
}


#: Signals that matter only where another text says something, which is cheaper to look for: (text, pattern).
GATES = {"tcm": ("title", P.SUMMARY_TITLE), "product": ("title", P.SUMMARY_TITLE), "traditional_abstract": ("abstract", r"\([A-Za-z][A-Za-z0-9-]{1,8}\)")}
#: What stands in every traditional exposure, which takes any run of words for the beginning of a formula's name.
TRADITIONAL = r"Chinese|TCM|Kampo|inositol|glycyrrhizin|herbal|botanical|traditional|decoction|\s(?:Tang|Wan|San)\b"
#: Signals of all questions that only these use.
ONLY = {"endpoint_front": (P.KIDNEY, P.PREGNANCY, P.LIVER)}
#: Parts of words without which a phrase that is cut out can't stand in a text.
STEMS = {P.NOT_A_SUPPLEMENT: ("supplement",), P.NOT_THERAPEUTIC: ("supplement",), P.INSTITUTION: ("tcm", "chinese medicine"), P.VITAMIN_K_MECHANISM: ("vitamin", "vkor", "warfarin"), P.VITAMIN_K_NOISE: ("vitamin", "vkor"), P.VITAMIN_K_THERAPY: ("vitamin", "phytonadione")}


@dataclass(frozen=True)
class Claim:
    """Whether something is present, and whether it is explicitly absent."""

    present: Column
    absent: Column

    def unless(self, *vetoes: Column) -> Claim:
        veto = reduce(or_, vetoes)
        return Claim(self.present & ~veto, self.absent | veto)

    def granted(self, grant: Column) -> Claim:
        """Present after all, and no longer absent."""
        return Claim(self.present | grant, self.absent & ~grant)

    def also_absent(self, condition: Column) -> Claim:
        return Claim(self.present, self.absent | condition)


#: Phrases that are cut out of texts, for all questions and for the last.
NOISE, VITAMIN = (P.NOT_A_SUPPLEMENT, P.NOT_THERAPEUTIC, P.INSTITUTION), (P.VITAMIN_K_MECHANISM, P.VITAMIN_K_NOISE, P.VITAMIN_K_THERAPY)
#: Flags in the order in which tasks give them, after the one that says that a record stands apart.
FLAGS = (*(name for group in SIGNALS.values() for name in group), "nutrient_title", "nutrient_front", "linked", "acronym", "op_near", "animal")
#: Bytes of text whose flags are found together, unless one record has more.
_SLICE = 4 << 20


def _gate(head: pa.Array, body: pa.Array) -> np.ndarray:
    """As clinical.nonclinical_gate."""
    head, body = (plain.without(t, clinical.NO_ANIMAL, flags="") for t in (head, body))
    lab_title = plain.found(head, clinical.LAB_TITLE)
    by_title = plain.found(head, clinical.SPECIES_TITLE) | plain.found(head, clinical.BENCH_TITLE) | lab_title & ~plain.found(head, clinical.HUMAN_ENROLLMENT) & ~plain.found(head, clinical.TRIAL_TITLE)
    by_text = reduce(or_, (plain.found(body, p) for p in (clinical.PRECLINICAL_METHOD, clinical.LAB_BODY, clinical.TREATED_SPECIES, clinical.SPECIES_BODY)))
    return by_title | ~(plain.found(head, clinical.PATIENTS_TITLE) & ~lab_title) & by_text & ~plain.found(body, clinical.HUMAN_ENROLLMENT)


def _carried(abstract: pa.Array, front: pa.Array) -> np.ndarray:
    """As clinical.acronym_carried."""
    named = [set() for _ in range(len(abstract))]
    for pattern, flags in ((clinical.DEFINED, "(?i)"), (clinical.NAMED_FORMULA, "")):
        for place, _, parts in plain.marked(abstract, pattern, "\\1", flags):
            named[place].update(plain.groups(parts))
    return np.array([any(re.search(rf"\b{a}\b", front[k].as_py(), re.ASCII) for a in some) for k, some in enumerate(named)], bool)


def _flags(question: np.ndarray, title: pa.Array, front: pa.Array, abstract: pa.Array) -> np.ndarray:
    """A row for each record: whether it stands apart, then FLAGS (false for such a record)."""
    (title, t), (front, f), (abstract, a) = map(plain.plain, (title, front, abstract))
    apart = t | f | a
    head, body, whole = title, front, abstract
    title, front, abstract = map(plain.spaced, (title, front, abstract))
    join = lambda a, b: pc.binary_join_element_wise(a, b, " ")
    last = pa.array(question == P.ANTICOAGULATION)

    def bare(text: pa.Array) -> pa.Array:
        text = plain.without(text, *NOISE)
        return pc.replace_with_mask(text, last, plain.without(text.filter(last), *VITAMIN))

    texts = {"title": title, "front": front, "abstract": abstract, "text": join(title, front), "bare_title": bare(title), "bare_front": bare(front)}
    texts["title_bare_front"] = join(title, texts["bare_front"])
    own = {
        P.PERIOPERATIVE: lambda x: {"op_title": plain.without(x["title"], P.NOT_SURGICAL), "op_front": plain.without(x["front"], P.NOT_SURGICAL), "aim": pc.utf8_slice_codeunits(x["front"], 0, P.AIM_WITHIN), "beginning": pc.utf8_slice_codeunits(x["front"], 0, P.EFFICACY_WITHIN)},
        P.KIDNEY: lambda x: {"kid_title": plain.without(x["title"], P.NO_KIDNEY_DISEASE)},
        P.PREGNANCY: lambda x: {"preg_title": plain.without(x["title"], P.GENETIC_TESTING)},
        P.LIVER: lambda x: {f"liv_{c}": plain.without(x[c], P.NO_LIVER_DISEASE) for c in ("title", "front", "text")},
        P.ANTICOAGULATION: lambda x: {},
    }
    out = {name: np.zeros(len(apart), bool) for name in FLAGS}
    for q, group in SIGNALS.items():
        if not q:
            rows, some = slice(None), texts
        elif len(rows := np.flatnonzero(question == q)):
            some = {name: text.take(pa.array(rows)) for name, text in texts.items()}
            some |= own[q](some)
        else:
            continue
        for name, (where, pattern) in group.items():
            if name in GATES or name in ONLY:
                shown = plain.found(texts[GATES[name][0]], GATES[name][1]) if name in GATES else np.isin(question, ONLY[name])
                out[name][shown] = plain.found(texts[where].filter(pa.array(shown)), pattern)
            else:
                out[name][rows] = plain.found(some[where], pattern)
        if q == P.PERIOPERATIVE:
            out["op_near"][rows] = plain.concepts_near(some["op_front"], P.POPULATION[q], P.PROCEDURE_SUPPLEMENT, P.PROCEDURE_REACH)
    for name in ("title", "front"):
        out[f"nutrient_{name}"] = plain.any_window(texts[f"bare_{name}"], P.NUTRIENT, P.ADMINISTRATION, P.NUTRIENT_REACH)
    out["linked"] = reduce(or_, (plain.any_window(texts["bare_front"], p, P.RELATION, P.EXPOSURE_REACH) for p in (P.STRONG_EXPOSURE, P.TRADITIONAL_EXPOSURE)))
    defining = pa.array(out["traditional_abstract"])
    out["acronym"][out["traditional_abstract"]] = _carried(whole.filter(defining), texts["bare_front"].filter(defining))
    out["animal"] = _gate(head, body)
    found_flags = np.stack([out[name] for name in FLAGS], 1) & ~apart[:, None]
    return np.concatenate((apart[:, None], found_flags), 1)


def _in_tasks(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """_flags of Arrow batches, some MB of text at a time."""
    for question, *texts in batches:
        question = np.array(question.to_pylist(), object)
        ends = np.cumsum(sum(pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts))
        rows, at, n = [np.zeros((0, 1 + len(FLAGS)), bool)], 0, len(question)
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE, "right")))
            rows.append(_flags(question[at:to], *(t.slice(at, to - at) for t in texts)))
            at = to
        yield pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (1 + len(FLAGS)), pa.int32()), pa.array(np.concatenate(rows).ravel()))


def _texts(rows: DataFrame) -> DataFrame:
    """rows (question_id, title, abstract, publication_types) with what tasks found in their texts (`__found`) and, for records that stand apart, the texts that signals are searched in, as columns of one name each with __ before it."""
    asks = lambda q: F.col("question_id") == q
    importable(rows.sparkSession)
    rows = rows.withColumns({"__title": stripped(F.col("title")), "__abstract": stripped(F.col("abstract")), "__types": F.coalesce("publication_types", F.lit(""))})
    rows = rows.withColumn("__front", clinical.foreground(F.col("__abstract")))
    rows = rows.withColumn("__found", F.arrow_udf(_in_tasks, ArrayType(BooleanType()))("question_id", "__title", "__front", "__abstract"))
    apart = F.col("__found")[0]
    rows = rows.withColumns({"__text": F.when(apart, F.concat_ws(" ", "__title", "__front")), "__bare_title": F.when(apart, F.col("__title")), "__bare_front": F.when(apart, F.col("__front"))})
    for pattern in NOISE + VITAMIN:  # one projection each: a text is read more than once in it
        for c in ("__bare_title", "__bare_front"):
            some = reduce(or_, (F.contains(F.lower(c), F.lit(stem)) for stem in STEMS[pattern]))
            rows = rows.withColumn(c, F.when(some & asks(P.ANTICOAGULATION) if pattern in VITAMIN else some, without(F.col(c), pattern)).otherwise(F.col(c)))
    only = lambda q, text: F.when(apart & asks(q), text)
    return rows.withColumns(
        {
            "__title_bare_front": F.when(apart, F.concat_ws(" ", "__title", "__bare_front")),
            "__op_title": only(P.PERIOPERATIVE, without(F.col("__title"), P.NOT_SURGICAL)),
            "__op_front": only(P.PERIOPERATIVE, without(F.col("__front"), P.NOT_SURGICAL)),
            "__aim": only(P.PERIOPERATIVE, F.left("__front", F.lit(P.AIM_WITHIN))),
            "__beginning": only(P.PERIOPERATIVE, F.left("__front", F.lit(P.EFFICACY_WITHIN))),
            "__kid_title": only(P.KIDNEY, without(F.col("__title"), P.NO_KIDNEY_DISEASE)),
            "__preg_title": only(P.PREGNANCY, without(F.col("__title"), P.GENETIC_TESTING)),
            "__liv_title": only(P.LIVER, without(F.col("__title"), P.NO_LIVER_DISEASE)),
            "__liv_front": only(P.LIVER, without(F.col("__front"), P.NO_LIVER_DISEASE)),
            "__liv_text": only(P.LIVER, without(F.col("__text"), P.NO_LIVER_DISEASE)),
        }
    )


def nutrient_in_use(text: Column) -> Column:
    """A nutrient is named with a word of administration or use near it."""
    return let(text, lambda t: any_window(t, intervals(t, P.NUTRIENT), P.ADMINISTRATION, P.NUTRIENT_REACH))


def exposure_linked(text: Column) -> Column:
    """A supplement or traditional product is named with a word that relates people or events to it nearby."""
    linked = lambda t, pattern: any_window(t, intervals(t, pattern), P.RELATION, P.EXPOSURE_REACH)
    return let(text, lambda t: linked(t, P.STRONG_EXPOSURE) | found(t, TRADITIONAL) & linked(t, P.TRADITIONAL_EXPOSURE))


def _exposure(s: SimpleNamespace) -> Claim:
    in_title = s.strong | s.traditional | s.nutrient_title | s.nutrition | s.preg_nutrient & (s.preg_prevention | s.preg_bare_time & s.preg_trial)
    in_front = s.linked | s.nutrient_front | s.structured & s.traditional_abstract & s.acronym
    measurement = s.biomarker | s.endogenous | s.measured | s.measure
    comparison = s.ac_comparison & ~s.ac_compared
    claim = Claim(in_title | in_front, F.lit(False)).unless(
        (s.diet | s.intake | s.meal) & ~s.named_supplementation,
        s.not_oral & ~s.oral | s.aroma,
        measurement & ~s.form & ~(s.trial_title & s.trial_nutrient),
        s.malnutrition & ~s.form,
        s.alternative & ~s.form & (s.hard_alternative & ~in_title | ~in_front & ~s.target),
        s.other_focus & ~s.given,
        s.summary & s.tcm & ~s.product,
        s.kid_drug,
        ~in_title & (s.preg_other | s.preg_microbiome & ~in_front),
    )
    claim = claim.also_absent(s.ac_class_title & ~claim.present)
    return claim.unless((s.ac_reversal | s.ac_therapy) & ~s.ac_food, s.ac_measured & ~s.form, s.ac_blood | s.ac_antithrombin & s.ac_at, comparison, s.ac_lupus | s.ac_material)


def _population(s: SimpleNamespace, exposed: Column, has_abstract: Column) -> dict[str, Claim]:
    """The claim of each question."""
    told = s.op_procedure | s.op_around
    operation = Claim(s.op_title | told & ~s.monograph & ~s.op_teaching, F.lit(False)).unless(
        ~s.op_title & told & exposed & ~s.op_near, s.op_consequence, s.op_provider & s.op_practice, s.op_teaching, s.op_child & ~s.op_adult
    )
    kidney = Claim(s.kid_title | s.kid_patients, F.lit(False)).unless(s.kid_staff & s.kid_work)
    pregnancy = Claim(s.preg_time | s.preg_people & ~s.monograph, F.lit(False)).unless(s.preg_review & ~s.preg_time).granted(s.preg_eclampsia)
    pregnancy = pregnancy.unless(s.preg_postpartum & ~s.preg_gestation, (s.preg_neonatal | s.preg_child | s.preg_babies) & ~s.preg_time, s.preg_regulation)
    ill = s.liv_title | s.liv_coma_title | (s.liv_front | s.liv_coma_front) & (s.liv_patients | s.liv_review & s.liv_population)
    injured = exposed & s.liv_injury
    liver = Claim(ill | injured & (s.liv_caused | s.liv_herb_caused | s.liv_injury_title & s.liv_caused_title), F.lit(False)).unless(
        injured & s.liv_strong & s.liv_protective & ~s.liv_by_herb & ~ill, s.liv_healthy, s.monograph & ~(s.liv_existing | s.liv_gene)
    )
    treated = Claim(s.ac_title | s.ac_patients | s.ac_review & s.ac_text, F.lit(False)).unless(s.ac_provider & s.ac_practice, s.ac_healthy, s.ac_lupus | s.ac_material)
    treated = treated.also_absent(~treated.present & s.ac_thrombosis)
    claims = {P.PERIOPERATIVE: operation, P.KIDNEY: kidney, P.PREGNANCY: pregnancy, P.LIVER: liver, P.ANTICOAGULATION: treated}
    return {q: c.also_absent(has_abstract & ~c.present) for q, c in claims.items()}


def _outcome(s: SimpleNamespace, present: Column, exposed: Column, types: Column, front: Column, asks) -> Claim:
    """Gated signals are false for other questions, so what is said of one question needs no test of it."""
    either = lambda kind: reduce(or_, (getattr(s, f"{q}_outcome{kind}") for q in ("op", "kid", "preg", "liv", "ac")))
    review = F.contains(F.lower(types), F.lit("review"))
    after_operation = s.op_after | s.op_in_title & s.op_pressure
    outcome = either("") | s.safety_text | s.generic_text | after_operation
    injury = s.liv_existing | exposed & (s.liv_any_caused | s.liv_herb_injury) | s.evaluated_text
    outcome = outcome & (~s.liv_any_injury | injury)
    aside = asks(P.PERIOPERATIVE) & review & ~s.op_in_title
    outcome = F.when(aside, s.safety_text | s.op_outcome_title).otherwise(outcome)
    unreported = s.systematic & s.says_safety & ~s.safety_front & ~s.evaluated_front & front.rlike(r"(?U)\S")
    outcome = F.when(unreported, either("_front") | s.safety_front).otherwise(outcome)
    confirmed = (s.evaluated_text | s.safety_front | s.safety_title | either("_title") | s.generic_title | s.ac_outcome_front | after_operation) & ~unreported
    monograph = asks(P.LIVER) & (stripped(types) == "") & (s.liv_existing | s.liv_monograph)
    by_front = asks(P.KIDNEY, P.PREGNANCY, P.LIVER) & ~monograph & ~confirmed & s.endpoint_front
    by_aim = (s.op_efficacy_title | s.op_aim | s.op_efficacy) & ~s.op_feasibility & ~(review & ~s.op_review_efficacy)
    liver_efficacy = s.liv_efficacy & ~s.liv_safety
    title_only = s.efficacy_title & ~s.harm_title
    focused = s.endpoint_title | s.efficacy_only | by_front | by_aim | liver_efficacy | title_only
    own_outcome = s.kid_outcome_title | s.preg_outcome_title | s.ac_outcome
    doubted = liver_efficacy & ~s.evaluated_front | title_only & ~s.evaluated_front & ~own_outcome
    return Claim(outcome, F.lit(False)).unless(present & exposed & focused & ~(confirmed & ~doubted))


def _signals(rows: DataFrame) -> tuple[DataFrame, SimpleNamespace]:
    """rows with their texts, and FLAGS as columns over them."""
    asks = lambda *qs: F.coalesce(F.col("question_id").isin(*qs), F.lit(False))
    rows = _texts(rows)
    text = lambda name: F.col(f"__{name}")
    flags: dict[str, Column] = {}
    for question, group in SIGNALS.items():
        for name, (where, pattern) in group.items():
            flag, of = found(text(where), pattern), (question,) if question else ONLY.get(name)
            gates = ([asks(*of)] if of else []) + ([found(text(GATES[name][0]), GATES[name][1])] if name in GATES else [])
            flags[name] = F.when(reduce(and_, gates), flag) if gates else flag
    flags |= {"nutrient_title": nutrient_in_use(text("bare_title")), "nutrient_front": nutrient_in_use(text("bare_front")), "linked": exposure_linked(text("bare_front"))}
    flags |= {"acronym": F.when(flags["traditional_abstract"], clinical.acronym_carried(text("abstract"), text("bare_front"))), "op_near": F.when(asks(P.PERIOPERATIVE), concepts_near(text("op_front"), P.POPULATION[P.PERIOPERATIVE], P.PROCEDURE_SUPPLEMENT, P.PROCEDURE_REACH))}
    flags["animal"] = clinical.nonclinical_gate(text("title"), text("front"))
    return once(rows, "__signals", {name: flags[name] for name in FLAGS}, known=F.col("__found"))


def classify(rows: DataFrame) -> DataFrame:
    """rows (question_id, title, abstract, publication_types and any others) with decision, confidence, evidence_basis, reason_codes and status."""
    asks = lambda *qs: F.coalesce(F.col("question_id").isin(*qs), F.lit(False))
    own = rows.columns
    rows, s = _signals(rows)
    text = lambda name: F.col(f"__{name}")
    rows, e = once(rows, "__editorial", {"editorial": clinical.publication_gate(text("title"), text("types"), text("abstract"))})
    has_abstract = text("abstract") != ""
    exposure = _exposure(s)
    rows, i = once(rows, "__exposure", {"present": exposure.present, "absent": exposure.absent})
    by_question = _population(s, i.present, has_abstract).items()
    pick = lambda side, other: reduce(lambda rest, qc: F.when(asks(qc[0]), getattr(qc[1], side)).otherwise(rest), by_question, other)
    rows, p = once(rows, "__population", {"present": pick("present", F.lit(False)), "absent": pick("absent", has_abstract)})
    outcome = _outcome(s, p.present, i.present, text("types"), text("front"), asks)
    rows, o = once(rows, "__outcome", {"present": outcome.present, "absent": outcome.absent})
    detailed = F.length("__abstract") >= P.DETAILED
    # A detailed record of the population that names no exposure has another one, unless it may be about interactions at large.
    other_drug = s.liv_drug | s.liv_drug_injury & ~s.liv_herbal
    elsewhere = asks(P.PERIOPERATIVE, P.KIDNEY, P.PREGNANCY) | asks(P.LIVER) & (s.alternative | s.biomarker | other_drug) | asks(P.ANTICOAGULATION) & ~(s.ac_broad & o.present)
    not_exposed = i.absent | detailed & p.present & ~s.animal & ~i.present & elsewhere
    types = clinical.type_set(text("types"))
    verdict = {
        "population": p.present & ~p.absent & ~s.animal, "exposure": i.present & ~not_exposed, "outcome": o.present & ~o.absent, "mismatch": p.absent | not_exposed | o.absent,
        "human": (s.human_text | s.human_title) & ~s.animal, "design": (s.design | F.arrays_overlap(types, F.array(*map(F.lit, P.DESIGN_TYPES)))) & ~e.editorial, "animal": s.animal, "editorial": e.editorial,
    }
    rows, v = once(rows, "__verdict", verdict)
    out = decision_table(v.population, v.exposure, v.outcome, v.mismatch | v.animal | v.editorial, has_abstract, detailed)
    codes = {"population": v.population, "exposure": v.exposure, "outcome": v.outcome, "human_signal": v.human, "design_signal": v.design, "animal_term_present": v.animal, "off_topic": out["off_topic"], "insufficient_abstract": out["insufficient"]}
    return rows.select(*own, out["decision"].alias("decision"), out["confidence"].alias("confidence"), out["evidence_basis"].alias("evidence_basis"), flagged(codes, "off_topic").alias("reason_codes"), F.lit("ok").alias("status"))


def with_adjudications(classified: DataFrame, adjudications: DataFrame, record_count: int | None = None) -> DataFrame:
    """classified (question_id, record_id, ...) with decision, confidence, evidence_basis and reason_codes of reviewed records in place of their own.

    Raises ValueError, before any row is used, where an adjudication lacks a key, repeats one, says something that isn't allowed, isn't `ok`, or where there aren't record_count of them.
    """
    fine = [
        F.coalesce(F.col("question_id"), F.lit("")) != "", F.coalesce(F.col("record_id").cast("string"), F.lit("")) != "", F.col("decision").isin("retain", "deprioritize", "uncertain"), F.col("confidence").isin("high", "medium", "low"),
        F.col("evidence_basis").isin("abstract", "title_only"), F.col("status") == "ok", F.size("reason_codes") > 0, F.size(F.array_distinct("reason_codes")) == F.size("reason_codes"),
        F.size(F.array_except("reason_codes", F.array(*map(F.lit, P.REASON_CODES)))) == 0,
    ]
    by_key = adjudications.groupBy("question_id", "record_id").agg(F.count("*").alias("n"), F.count_if(~F.coalesce(reduce(and_, fine), F.lit(False))).alias("bad"))
    n, bad, repeated = by_key.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
    if bad or repeated or record_count not in (None, n):
        raise ValueError(f"{n} adjudications: {bad} invalid, {repeated} keys repeated" + (f", {record_count} expected" if record_count not in (None, n) else ""))
    says = ("decision", "confidence", "evidence_basis", "reason_codes", "status")
    reviewed = adjudications.select("question_id", "record_id", F.struct(*says).alias("__reviewed"))
    both = classified.join(reviewed, ["question_id", "record_id"], "left")
    return both.select(*(F.when(F.col("__reviewed").isNotNull(), F.col("__reviewed")[c]).otherwise(F.col(c)).alias(c) if c in says else F.col(c) for c in classified.columns))
