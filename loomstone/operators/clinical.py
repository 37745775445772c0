"""Clinical records: axes, doses, study kinds, foreground, publication gate, aliases, evidence tables, rebuilt strata and adjudications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import flagged, let

# Patterns, word lists and names that results depend on.
DOSE = r"\b\d+(?:[.,]\d+)?(?:\s*(?:-|–|to)\s*\d+(?:[.,]\d+)?)?\s*(?:mg|g|µg|μg|mcg|iu|units?|ml|mmol|%)\b(?:\s*/\s*(?:d|day|week))?"
AXES = {
    "age_group": r"child|adolesc|adult|elder|older|aged|years? old|age[sd]?\b",
    "sex": r"\bmen\b|\bwomen\b|\bmale\b|\bfemale\b|\bsex\b|\bgender\b",
    "concomitant_medication": r"warfarin|anticoag|aspirin|heparin|medication|drug|therapy",
    "underlying_condition": r"kidney|renal|dialysis|pregnan|liver|hepatic|cirrho|surg|diabet|hypertens|cancer",
    "dose_range": DOSE,
}
STUDY_KINDS = [
    ("meta-analysis", "메타분석"),
    ("systematic review", "체계적 문헌고찰"),
    ("randomized controlled trial", "무작위 대조시험"),
    ("case reports", "증례 보고"),
    ("observational study|cohort", "관찰연구"),
    ("clinical trial", "임상시험"),
    ("review", "문헌고찰"),
]
OTHER_STUDY = "연구"
SENTENCE_ROLES = [
    (r"^(?:RESULTS?|CONCLUSIONS?|FINDINGS?|SYNTHESIS OF RESULTS):", "result_or_conclusion"),
    (r"^(?:BACKGROUND|INTRODUCTION|METHODS?|OBJECTIVES?|BACKGROUND/OBJECTIVES):", "background_or_methods"),
]
SECTION = (
    r"BACKGROUND(?: AND (?:AIM|OBJECTIVE|PURPOSE))?|INTRODUCTION|CONTEXT|RATIONALE|OBJECTIVES?|AIMS?|PURPOSE|METHODS?|MATERIALS(?: AND METHODS)?|"
    r"PATIENTS(?: AND METHODS)?|DESIGN|SETTING|PARTICIPANTS?|INTERVENTIONS?|MEASUREMENTS?|MAIN OUTCOME MEASURES?|RESULTS?|FINDINGS|CASE PRESENTATION|"
    r"CASE REPORT|CLINICAL CHARACTERISTICS|MANAGEMENT|TREATMENT|DISCUSSION|CONCLUSIONS?"
)
BACKGROUND_SECTIONS = "BACKGROUND|INTRODUCTION|CONTEXT|RATIONALE"
TERMINAL_TYPES = ("published erratum", "retracted publication", "retraction notice", "expression of concern")
EDITORIAL_TITLE = r"\b(?:statement of retraction|retraction notice|retracted:|withdrawn:|expression of concern|published erratum|correction to:|corrigendum(?: to|:)|erratum(?: to|:))\b"
COMMENTARY_TITLE = (
    r"^(?:re:\s*|response by|response to|a response to|respond to|reply(?: to)?|letter by|letter regarding|comments? on|commentary:|EBNEO commentary:|comment on|commentary on)|"
    r"\b(?:author'?s reply|response to the editor|retraction|retracted|corrigendum|erratum|expression of concern)\b|\[(?:letter|comment)\][\s.]*$"
)
HUMAN_ENROLLMENT = (
    r"\b(?:we (?:enrolled|recruited|randomi[sz]ed|followed|reviewed)|(?:patients?|participants?|subjects?|pregnant women) (?:were|received|underwent)|"
    r"(?:enrolled|recruited|included|randomi[sz]ed) \d+|\d+[ -](?:patients?|participants?|subjects?|pregnant women)|n\s*=\s*\d+[^.;]{0,50}(?:patients?|"
    r"participants?|subjects?|women)|case report|case series|clinical trial|prospective (?:study|cohort)|retrospective (?:study|cohort))\b"
)
DIRECT_SECTION = r"(?m)^\s*(?:METHODS?|RESULTS?|CASE PRESENTATION)\s*:"
OPINION_TITLE = r"\b(?:deserves attention|commentary|perspective|viewpoint|practice update|call for action|national .+ day|forum|event report)\b"
LETTER_TITLE = r"\b(?:author reflections?|paired editorial|comments? on|letter to (?:the )?editor|response to reviewer|advancing evidence|integrating .{0,60} practices?)\b"
ALIASES = {
    "A1": r"\bvitamin\s*k(?:1|2)?\b|phylloquinone|menaquinone|phytonadione|menadione",
    "A2": r"omega|fish oil|eicosapenta|docosahexa",
    "B1": r"\bcalcium\b|calcitriol",
    "B2": r"vitamin\s*d|ergocalciferol|cholecalciferol",
    "B3": r"vitamin c|ascorb",
}
ANTAGONISTS = r"\b(?:non[- ]?vitamin\s*k(?:\s+antagonist)?\s+oral\s+anticoagulants?|vitamin\s*k\s+antagonists?)\b"
DEFINED = r"(?:traditional Chinese (?:herbal )?medicine|Chinese herbal medicine|herbal (?:formula|formulation|medicine|treatment)|[A-Za-z -]+ decoction)[^.;]{0,60}\(([A-Z][A-Z0-9-]{1,8})\)"
NAMED_FORMULA = r"\b[A-Z][A-Za-z'-]+(?:\s+[A-Z][A-Za-z'-]+){1,5}\s+(?:Tang|Wan|San|Decoction|Formula)\s*\(([A-Z][A-Z0-9-]{1,8})\)"
REASON_ORDER = ("population", "exposure", "outcome", "human_signal", "design_signal", "animal_term_present", "off_topic", "insufficient_abstract")
LAB_TITLE = (
    r"\b(?:mice|mouse|rats?|murine|rodents?|rabbits?|zebrafish|gilts?|sows?|cows?|bovine|porcine|dairy farms?|animal models?|in vitro|in silico|ex vivo|"
    r"network pharmacology|bioinformatics|molecular docking|cell lines?|cell culture|cultured cells?|scaffolds?|tissue engineering|nanoparticles?|biomaterials?|"
    r"adsorption|wastewater|materials? engineering|mineralization|apatites?|hydroxyapatite|chemical synthesis|fabrication|spectrum[- ]effect analysis|"
    r"HepG2|HepaRG|Huh7|trophoblasts?|mesenchymal stem cells?|hamsters?|hepatic stellate cells?|human macrophages?|xenografts?|ion channels?|molecular interactions?)\b"
)
SPECIES_TITLE = r"\b(?:mice|mouse|rats?|murine|hamsters?|gilts?|sows?|cows?|bovine|porcine|zebrafish)\b"
BENCH_TITLE = r"\b(?:in vitro|in silico|ex vivo|network pharmacology|molecular docking)\b"
TRIAL_TITLE = r"\b(?:clinical trial|case report|case series)\b"
PATIENTS_TITLE = r"\bpatients? with\b"
PRECLINICAL_METHOD = (
    r"\b(?:(?:mice|rats?|rabbits?|animals?) (?:were|received|were given|were fed|were injected|were divided|were treated)|(?:mouse|rat|murine|animal) model|"
    r"cells? (?:were|was) (?:cultured|treated|incubated|exposed)|in vitro|ex vivo|human (?:cells?|hepatocytes?|macrophages?|organoids?|tissues?))\b"
)
LAB_BODY = (
    r"\b(?:in vitro|in silico|ex vivo|network pharmacology|molecular docking|HepG2|HepaRG|Huh7|cell lines?|cell culture|cultured cells?|trophoblasts?|"
    r"mesenchymal stem cells?|hepatic stellate cells?|human macrophages?|(?:kidney|renal|proximal tubular) cells?|xenografts?|"
    r"bacterial (?:cultures?|extracts?|growth)|organoids?|bioreactor|wastewater|computational docking|spectroscopic techniques?)\b"
)
TREATED_SPECIES = (
    r"\b(?:mice|mouse|rats?|murine|hamsters?|rabbits?|zebrafish|gilts?|sows?|bovine|porcine)\b[^.;]{0,100}\b(?:received|were|fed|treated|injected|"
    r"randomi[sz]ed|divided|model)\b"
)
SPECIES_BODY = r"\b(?:mice|mouse|rats?|murine|hamsters?|rabbits?|zebrafish|gilts?|sows?)\b"
#: In capitals it is an abbreviation, not the animal.
NO_ANIMAL = r"\bRAT\b"
# End of fixed values.


def matches(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs, in any case; false for null."""
    return F.coalesce(text.rlike("(?i)" + pattern), F.lit(False))


def observed_axes(title: Column, abstract: Column) -> Column:
    """Names of the axes that title and abstract speak of, in fixed order."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")))
    return flagged({name: matches(text, pattern) for name, pattern in AXES.items()})


def doses(text: Column, most: int = 8) -> Column:
    """The first distinct doses of a text, in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)" + DOSE), 0)), 1, most)


def first_fitting(text: Column, cases: list[tuple[str, str]], default: str) -> Column:
    out = F.lit(default)
    for pattern, name in reversed(cases):
        out = F.when(matches(text, pattern), name).otherwise(out)
    return out


def study_kind(publication_types: Column) -> Column:
    return first_fitting(publication_types, STUDY_KINDS, OTHER_STUDY)


def sentence_role(sentence: Column) -> Column:
    return first_fitting(sentence, SENTENCE_ROLES, "unclassified")


def foreground(abstract: Column) -> Column:
    """The sections of a labelled abstract but those of background, one a line; the abstract itself if it has none."""
    marked = F.regexp_replace(abstract, rf"(?im)^[ \t]*({SECTION})\s*:\s*", "\u0001$1\u0002")
    sections = let(F.split(marked, "\u0001"), lambda cut: F.filter(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), lambda s: ~F.upper(F.left(s, F.lit(16))).rlike(f"^(?:{BACKGROUND_SECTIONS})")))
    bodies = F.filter(F.transform(sections, lambda s: F.regexp_replace(F.substring_index(s, "\u0002", -1), r"^\s+|\s+$", "")), lambda s: s != "")
    return let(bodies, lambda found: F.when(F.size(found) > 0, F.array_join(found, "\n")).otherwise(abstract))


def type_set(publication_types: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(publication_types), r"\|"), lambda t: F.trim(t)), lambda t: t != ""))


def publication_gate(title: Column, publication_types: Column, abstract: Column) -> Column:
    """Whether a record is no report of its own: retracted, an erratum, an editorial, a comment without data, an opinion in a letter."""
    types = type_set(F.coalesce(publication_types, F.lit("")))
    one_of = lambda *names: F.arrays_overlap(types, F.array(*map(F.lit, names)))
    direct = (F.trim(F.coalesce(abstract, F.lit(""))) != "") & (matches(abstract, HUMAN_ENROLLMENT) | matches(abstract, DIRECT_SECTION))
    return (
        one_of(*TERMINAL_TYPES)
        | matches(title, EDITORIAL_TITLE)
        | matches(title, COMMENTARY_TITLE)
        | one_of("editorial", "news")
        | one_of("comment") & ~direct
        | one_of("letter") & (matches(title, OPINION_TITLE) | matches(title, LETTER_TITLE))
    )


def nonclinical_gate(title: Column, foreground_text: Column) -> Column:
    """Whether a record is about animals, cells or materials: by its title, or by its text where no people are enrolled.

    A title that names patients with something speaks for people unless it names a laboratory subject, too. A null is an empty text.
    """

    def gate(head: Column, body: Column) -> Column:
        lab_title = matches(head, LAB_TITLE)
        by_title = matches(head, SPECIES_TITLE) | matches(head, BENCH_TITLE) | lab_title & ~matches(head, HUMAN_ENROLLMENT) & ~matches(head, TRIAL_TITLE)
        by_text = matches(body, PRECLINICAL_METHOD) | matches(body, LAB_BODY) | matches(body, TREATED_SPECIES) | matches(body, SPECIES_BODY)
        return by_title | ~(matches(head, PATIENTS_TITLE) & ~lab_title) & by_text & ~matches(body, HUMAN_ENROLLMENT)

    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), NO_ANIMAL, "")
    return let(bare(title), lambda head: let(bare(foreground_text), lambda body: gate(head, body)))


def alias_matches(text: Column) -> Column:
    """Aliases of ingredients that a text names; antagonists of vitamin K don't name it."""
    bare = F.regexp_replace(text, "(?i)" + ANTAGONISTS, " ")
    return flagged({alias: matches(bare if alias == "A1" else text, pattern) for alias, pattern in ALIASES.items()})


def acronym_carried(abstract: Column, foreground_text: Column) -> Column:
    """An acronym that the abstract defines for a herbal formula is used in the foreground."""
    whole_runs = DEFINED.replace("[A-Za-z -]+ decoction", r"(?:\G|(?<![A-Za-z -]))[A-Za-z -]+ decoction")  # what fits inside a run fits from its start, too, so a run is read once
    defined = F.concat(F.regexp_extract_all(abstract, F.lit("(?i)" + whole_runs), 1), F.regexp_extract_all(abstract, F.lit(NAMED_FORMULA), 1))
    return F.exists(F.array_distinct(defined), lambda a: F.regexp_like(foreground_text, F.concat(F.lit(r"\b"), a, F.lit(r"\b"))))


def alias_rules(records: DataFrame, group: str, key: str, order: list[Column], preview: int = 3) -> DataFrame:
    """For each (group, alias) with records at all: how many name the alias, the first of them by order, and the rule's state; none is `no_direct_evidence`."""
    from pyspark.sql import Window

    named = records.select(group, key, F.explode("aliases").alias("alias"), *(c.alias(f"__o{k}") for k, c in enumerate(order)))
    place = Window.partitionBy(group, "alias").orderBy(*(f"__o{k}" for k in range(len(order))))
    first = named.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= preview)
    first = first.groupBy(group, "alias").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", key))), lambda s: s[key]).alias("preview"))
    counts = named.groupBy(group, "alias").agg(F.count("*").alias("n"))
    grid = records.select(group).distinct().withColumn("alias", F.explode(F.array(*map(F.lit, ALIASES))))
    out = grid.join(counts, [group, "alias"], "left").join(first, [group, "alias"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n") > 0, "direct_evidence").otherwise("no_direct_evidence")).withColumn("preview", F.coalesce("preview", F.array().cast(dict(first.dtypes)["preview"])))


def evidence_gate(records: DataFrame, passed: Column) -> DataFrame:
    """Every screened record with what the patterns and the decision say; kept if both agree."""
    return records.withColumn("regex_passed", passed).withColumn("kept", F.col("regex_passed") & (F.col("decision") == "retain"))


def evidence_rows(gated: DataFrame) -> DataFrame:
    """The kept records as evidence: where the text comes from, doses and a status that claims no effect."""
    text = F.concat_ws(" ", "title", "abstract")
    return gated.filter("kept").select(
        "question_id", "record_id", F.when(F.trim("abstract") != "", "abstract_only").otherwise("title_only").alias("source_scope"), F.array_join(doses(text), " | ").alias("dose"),
        F.lit("").alias("extracted_effect_value"), F.lit("not_observed").alias("extracted_effect_status"), F.lit("ai_screened_regex_confirmed").alias("status"),
    )


def normalized_dashes(text: Column) -> Column:
    """Minus signs and dashes as hyphens, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(text, "−–", "--"), r"\s+", " "))


def cards(selected: DataFrame, corpus: DataFrame, terms: DataFrame, key: list[str]) -> DataFrame:
    """Cards of the selected keys with the corpus' text and indexing terms; where there are none, an empty string."""
    return corpus.join(selected.select(*key).distinct(), key, "left_semi").join(terms, key, "left").withColumn("terms", F.coalesce("terms", F.lit("")))


def adjudicated(expected: DataFrame, observed: DataFrame, key: list[str]) -> DataFrame:
    """Expected decisions (decision, confidence, required, forbidden) over observed codes: required ones are added, forbidden ones go, none is off_topic; in fixed order."""
    joined = expected.withColumnRenamed("confidence", "__c").join(observed.select(*key, "codes", "confidence"), key)
    codes = F.array_except(F.array_union("codes", "required"), "forbidden")
    ordered = F.filter(F.array(*map(F.lit, REASON_ORDER)), lambda c: F.array_contains(codes, c))
    return joined.select(*key, "decision", F.when(F.size(codes) == 0, F.array(F.lit("off_topic"))).otherwise(ordered).alias("reason_codes"), F.coalesce("__c", "confidence").alias("confidence"))


def rebuilt_strata(rows: DataFrame, design: DataFrame) -> DataFrame:
    """Strata rebuilt from labels (label_source, decision, question_id) against a design (stratum, sample_n): where either count differs."""
    prefix = F.when(F.col("decision") == "retain", "S1_worker_retain").otherwise("S2_worker_deprioritize")
    stratum = F.when(F.col("label_source") == "adjudication", "S4_adjudication").when(F.col("decision") == "uncertain", "S3_worker_uncertain").otherwise(F.concat_ws("|", prefix, "question_id"))
    both = rows.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("rebuilt")).join(design, "stratum", "full_outer")
    return both.select("stratum", F.coalesce("rebuilt", F.lit(0)).alias("rebuilt"), F.coalesce("sample_n", F.lit(0)).alias("design")).filter("rebuilt != design")


def translated(core: DataFrame, translations: DataFrame, key: list[str]) -> DataFrame:
    """Core records with their translation; a record without one is marked missing, not lost."""
    return core.join(translations, key, "left").withColumn("missing", F.col("translation").isNull())
