"""What is costly is done once, in many tasks: expressions that are used again are bound, and tables that several sums read are written first."""

from pyspark.sql import functions as F

from loomstone import catalog
from loomstone.functions import intervals as I
from loomstone.operators import clinical as C

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_classifier_and_windows_match_a_pattern_once(spark):
    text = spark.createDataFrame([("x", "y")], "title string, text string").repartition(2)
    times = lambda c, what: plan(text.select(c.alias("v"))).count(what)
    assert times(I.intervals(F.col("text"), "zinc"), "regexp_replace") == 1
    assert times(I.concepts_near(F.col("text"), "zinc", "iron"), "regexp_replace") == 2
    assert times(C.foreground(F.col("text")), "BACKGROUND(?: AND") == 1
    assert times(C.nonclinical_gate(F.col("title"), F.col("text")), C.NO_ANIMAL) == 2


def test_acronyms_in_runs_of_words(spark):
    texts = [("a b decoction (AB) c d decoction (CD), old", "AB"), ("a b decoction (AB) c d decoction (CD), old", "CD"), ("so: x-y decoction, long known (XY)", "XY"), ("decoction (XY)", "XY"), ("a decoction. (XY)", "XY"), ("a " * 30000, "XY")]
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "k int, abstract string, front string")
    assert [r[0] for r in rows.orderBy("k").select(C.acronym_carried(F.col("abstract"), F.col("front"))).collect()] == [False, True, True, False, False, False]  # the last acronym within reach


def test_records_and_sentences_are_dealt_out(spark):
    for name in ("classified_records", "match_windows", "screening_decisions", "sentence_split"):
        assert "Repartition" in plan(catalog.queries()[name](spark, DATA)), name


def test_sums_read_what_was_written_once(spark):
    for name in ("metric_blocks", "build_violations"):
        assert not any("documents" in f for f in catalog.queries()[name](spark, DATA).inputFiles()), name
