"""Agreement of two raters: weighted confusion, rates, kappa, intervals and a stratified bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The 97.5 % point of the normal distribution (a fixed value).
Z = 1.959963985


def rate(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def weighted_confusion(rows: DataFrame, group: list[str], predicted: Column, actual: Column, weight: Column) -> DataFrame:
    cell = lambda p, a: F.coalesce(F.sum(F.when((predicted == p) & (actual == a), weight)), F.lit(0.0)).alias
    return rows.groupBy(*group).agg(cell(True, True)("tp"), cell(True, False)("fp"), cell(False, True)("fn"), cell(False, False)("tn"))


def rates(confusion: DataFrame) -> DataFrame:
    """Adds recall, specificity, precision, f1 (0 if recall or precision is), agreement and prevalence."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = confusion.withColumn("recall", rate(tp, tp + fn)).withColumn("specificity", rate(tn, tn + fp)).withColumn("precision", rate(tp, tp + fp))
    r, p = F.col("recall"), F.col("precision")
    out = out.withColumn("f1", F.when((r == 0) | (p == 0), 0.0).otherwise(2 * r * p / (r + p)))
    return out.withColumn("agreement", rate(tp + tn, tp + fp + fn + tn)).withColumn("prevalence", rate(tp + fn, tp + fp + fn + tn))


def reverse_rates(confusion: DataFrame) -> DataFrame:
    """Adds reverse_recall and reverse_specificity: the reference judged by the scorer, the same cells read the other way round; null where nothing is judged so."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return confusion.withColumn("reverse_recall", rate(tp, tp + fp)).withColumn("reverse_specificity", rate(tn, fn + tn))


def paired_labels(labels: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """labels joined with truth by key. Raises ValueError unless both have the same keys, each once: metrics of a part would be metrics of something else."""
    sides = labels.select(*key, F.lit(1).alias("l"), F.lit(0).alias("t")).unionByName(truth.select(*key, F.lit(0).alias("l"), F.lit(1).alias("t")))
    sums = sides.groupBy(*key).agg(F.sum("l").alias("l"), F.sum("t").alias("t"))
    only_l, only_t, again = sums.agg(F.count_if(F.col("t") == 0), F.count_if(F.col("l") == 0), F.count_if((F.col("l") > 1) | (F.col("t") > 1))).first()
    if only_l or only_t or again:
        raise ValueError(f"{only_l} labelled keys aren't in the truth, {only_t} of the truth aren't labelled, {again} come more than once")
    return labels.join(truth, key)


def metric_blocks(rows: DataFrame, layers: Column, scorer: str, reference: str, positive: str, weight: Column) -> DataFrame:
    """One row for each layer (layers: the names of those that a row belongs to) with weighted confusion and rates in both directions, weighted share of positives, kappa, and unweighted agreement with its interval.

    Rows are copied to their few layers and added up in the tasks before they are shuffled, so that a layer of all rows is no large group.
    """
    rows = rows.select(F.explode(F.array_distinct(layers)).alias("layer"), F.col(scorer).alias("s"), F.col(reference).alias("r"), weight.cast("double").alias("w"))
    yes = lambda c: F.col(c) == positive
    block = reverse_rates(rates(weighted_confusion(rows, ["layer"], yes("s"), yes("r"), F.col("w"))))
    plain = rows.groupBy("layer").agg(F.count("*").alias("n"), F.sum("w").alias("represented"), F.count_if(F.col("s") == F.col("r")).alias("same"), F.sum(F.when(yes("s"), F.col("w")).otherwise(0.0)).alias("__p"))
    low, high = wilson(F.col("same"), F.col("n"))
    plain = plain.withColumns({"scorer_prevalence": rate(F.col("__p"), F.col("represented")), "unweighted_agreement": F.col("same") / F.col("n"), "low": low, "high": high}).drop("__p")
    return block.join(plain, "layer").join(cohen_kappa(rows, ["layer"], "s", "r").select("layer", "kappa"), "layer")


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of a share, inside [0, 1]; null for n = 0."""
    some = F.when(n > 0, n)
    share, scale = successes / some, 1 + Z * Z / some
    middle = (share + Z * Z / (2 * some)) / scale
    half = Z * F.sqrt(share * (1 - share) / some + Z * Z / (4 * some * some)) / scale
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))


def cohen_kappa(rows: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Unweighted kappa of each group; null where chance agreement is 1."""
    cells = rows.groupBy(*group, a, b).agg(F.count("*").alias("n"))
    total = cells.groupBy(*group).agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    by_a = cells.groupBy(*group, F.col(a).alias("__c")).agg(F.sum("n").alias("na"))
    by_b = cells.groupBy(*group, F.col(b).alias("__c")).agg(F.sum("n").alias("nb"))
    chance = by_a.join(by_b, [*group, "__c"]).groupBy(*group).agg(F.sum(F.col("na") * F.col("nb")).alias("products"))
    both = total.join(chance, group, "left") if group else total.crossJoin(chance)
    observed, expected = F.col("same") / F.col("total"), F.coalesce("products", F.lit(0)) / (F.col("total") * F.col("total"))
    return both.select(*group, "total", observed.alias("observed"), expected.alias("expected"), F.when(1 - expected >= 1e-12, (observed - expected) / (1 - expected)).alias("kappa"))


def rogan_gladen(prevalence: Column, sensitivity: Column, specificity: Column) -> Column:
    """Prevalence corrected for an imperfect rater; null where the denominator is about 0."""
    below = sensitivity + specificity - 1
    return F.when(F.abs(below) >= 1e-9, (prevalence + specificity - 1) / below)


def disagreements(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    pair = F.concat(a.cast("string"), F.lit("->"), b.cast("string"))
    return rows.filter(a != b).groupBy(pair.alias("pair")).agg(F.count("*").alias("n"))


def stratified_bootstrap(rows: DataFrame, stratum: str, agree: Column, weight: Column, draws: int = 1000, seed: int = 7) -> DataFrame:
    """Interval of weighted agreement by resampling inside strata: point, low, high (order statistics at int(p * (draws - 1))).

    Rows of a stratum are alike up to their agreement and weight, so a draw is one multinomial over counts: rows become counts first, which are few,
    and each draw takes each cell's count from a binomial by its share of what is left. Each draw is a row of its own for Spark.
    """
    cells = rows.groupBy(F.col(stratum).alias("s"), agree.cast("int").alias("agrees"), weight.cast("double").alias("w")).agg(F.count("*").alias("n"))
    packed = cells.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("agrees", "w", "n"))).alias("cells"))
    each = packed.crossJoin(rows.sparkSession.range(draws).withColumnRenamed("id", "draw"))

    def resample(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            good, total = [], []
            for s, draw, own in zip(batch.column("s").to_pylist(), batch.column("draw").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                rng = np.random.default_rng([seed, draw, *str(s).encode()])
                n = np.array([c["n"] for c in own])
                taken = rng.multinomial(n.sum(), n / n.sum())
                w = np.array([c["w"] for c in own]) * taken
                good.append(float((w * [c["agrees"] for c in own]).sum()))
                total.append(float(w.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("draw"), pa.array(good, pa.float64()), pa.array(total, pa.float64())], names=["draw", "good", "total"])

    drawn = each.mapInArrow(resample, "draw long, good double, total double").groupBy("draw").agg((F.sum("good") / F.sum("total")).alias("v"))
    at = lambda p: F.element_at(F.sort_array(F.collect_list("v")), int(p * (draws - 1)) + 1)
    point = cells.agg((F.sum(F.col("agrees") * F.col("w") * F.col("n")) / F.sum(F.col("w") * F.col("n"))).alias("point"))
    return drawn.agg(at(0.025).alias("low"), at(0.975).alias("high")).crossJoin(point)


def bootstrap_metrics(rows: DataFrame, stratum: str, scored: Column, reference: Column, weight: Column, apparent: float, census: tuple[str, ...] = (), draws: int = 10000, seed: int = 7) -> DataFrame:
    """Intervals of seven weighted measures of a scorer against a reference by resampling inside strata: metric, low, high, draws_used.

    Strata in census were counted whole and stay as they are. Rows become counts by stratum, outcome and weight first; a draw of a stratum is one multinomial over
    them and a row of its own for Spark. A draw in which a measure isn't defined doesn't count for it; a measure without any has no row. Rows with a null outcome don't count.
    """
    known = rows.filter(scored.isNotNull() & reference.isNotNull())
    place = F.when(scored & reference, 0).when(scored, 1).when(reference, 2).otherwise(3)
    cells = known.groupBy(F.col(stratum).cast("string").alias("s"), place.alias("place"), weight.cast("double").alias("w")).agg(F.count("*").alias("n"))
    packed = cells.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("place", "w", "n"))).alias("cells"))
    each = packed.crossJoin(rows.sparkSession.range(draws).withColumnRenamed("id", "draw"))
    names = ["tp", "fp", "fn", "tn"]

    def resample(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sums = np.zeros((4, batch.num_rows))
            for k, (s, draw, own) in enumerate(zip(batch.column("s").to_pylist(), batch.column("draw").to_pylist(), batch.column("cells").to_pylist(), strict=True)):
                n = np.array([c["n"] for c in own])
                taken = n if s in census else np.random.default_rng([seed, draw, *str(s).encode()]).multinomial(n.sum(), n / n.sum())
                np.add.at(sums[:, k], [c["place"] for c in own], taken * np.array([c["w"] for c in own]))
            yield pa.RecordBatch.from_arrays([batch.column("draw"), *map(pa.array, sums)], names=["draw", *names])

    drawn = each.mapInArrow(resample, "draw long, tp double, fp double, fn double, tn double").groupBy("draw").agg(*(F.sum(c).alias(c) for c in names))
    measured = rates(drawn)
    tp, fp, fn, tn = (F.col(c) for c in names)
    measures = {c: F.col(c) for c in ("recall", "specificity", "precision", "f1", "agreement")}
    measures["f1"] = F.when(F.col("recall").isNotNull() & F.col("precision").isNotNull(), F.col("f1"))
    measures["scored_prevalence"] = rate(tp + fp, tp + fp + fn + tn)
    measures["corrected_prevalence"] = rogan_gladen(F.lit(apparent), rate(tp, tp + fp), rate(tn, fn + tn))
    values = measured.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), v.alias("v")) for n, v in measures.items()))).alias("m")).select("m.*").filter("v is not null")
    ordered = values.groupBy("metric").agg(F.sort_array(F.collect_list("v")).alias("v"))
    at = lambda p: F.get("v", F.floor(F.lit(p) * (F.size("v") - 1)).cast("int"))
    return ordered.select("metric", at(0.025).alias("low"), at(0.975).alias("high"), F.size("v").cast("long").alias("draws_used"))
