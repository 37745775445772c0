"""Queries over documents and labels as evidence: lang stands for the question, doc_id for the record, n_chars for its priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.operators import bins, evidence, lookup, metrics
from loomstone.session import dealt, importable, table

#: What each axis of a document is recognised by.
AXES = {
    "age": T.word_pattern("the|el|der|le"),
    "sex": T.word_pattern("that|que|und|les"),
    "medication": T.word_pattern("with|con|mit|des"),
    "condition": T.word_pattern("from|para|von|une"),
    "dose": T.word_pattern("on|su|den|un"),
}
ASKED = ("age", "sex", "medication")
SEED = "20260101"


def axes(names=AXES) -> dict[str, Column]:
    return {n: F.coalesce(F.col("text").rlike(AXES[n]), F.lit(False)) for n in names}


def _sql_axis(name: str, column: str = "text") -> str:
    return f"regexp_matches({column}, '{AXES[name]}')"


_SQL_BRIDGE = "select lang, doc_id, n_chars, unnest([x for x in [" + ", ".join(f"case when {_sql_axis(n)} then '{n}' end" for n in AXES) + "] if x is not null]) as axis from documents"


def axis_flags_by_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    grid = docs.select("lang").distinct().withColumn("axis", F.explode(F.array(*map(F.lit, AXES))))
    return lookup.coverage(lookup.axis_table(docs, ["lang", "doc_id"], axes()), "lang", grid)


def axis_filter_trace(spark: SparkSession, d: str) -> DataFrame:
    return lookup.filter_trace(table(spark, d, "documents"), "lang", axes(ASKED))


def core_top15_per_lang(spark: SparkSession, d: str) -> DataFrame:
    kept = lookup.conjunctive(table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text"), axes(ASKED[:2]))
    return lookup.top_k(kept.drop("text"), ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 15)


def dedup_within_lang(spark: SparkSession, d: str) -> DataFrame:
    return evidence.deduplicate(table(spark, d, "documents").select("doc_id", "lang", "text", "n_chars"), ["lang"], F.sha2("text", 256), [(F.col("n_chars") < 180).cast("int"), F.col("doc_id")]).select("doc_id", "lang", "n_chars")


def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return evidence.dedup_statistics(table(spark, d, "documents"), "lang", F.sha2("text", 256))


def cross_source_repeats(spark: SparkSession, d: str) -> DataFrame:
    return evidence.cross_group_repeats(table(spark, d, "documents"), "source", F.sha2("text", 256))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("n_chars") >= 2000, "long").otherwise("short").alias("size"))
    return evidence.stratified_sample(docs, ["lang", "size"], ["lang", "doc_id"], SEED, 20)


def rotation_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.rotation_key(SEED, F.col("doc_id")).alias("position"))


def band_paging(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return lookup.band_pages(docs, "lang", [F.desc("n_chars"), F.asc("doc_id")], SEED, "doc_id").drop("n_chars")


def core_then_topup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text")
    extended = lookup.conjunctive(docs, axes(ASKED)).drop("text")
    core = lookup.top_k(docs.filter("n_chars < 900").drop("text"), ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 7).drop("rank")
    return lookup.core_then_top_up(core, extended, "doc_id", "lang", [F.desc("n_chars"), F.asc("doc_id")], 15)


def postings_index(spark: SparkSession, d: str) -> DataFrame:
    found = lookup.postings(lookup.axis_table(table(spark, d, "documents"), ["lang", "doc_id"], axes()), "lang", "doc_id")
    return found.select("lang", "axis", "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), "|").alias("ids"), "n")


def leave_one_out_counts(spark: SparkSession, d: str) -> DataFrame:
    return lookup.leave_one_out(table(spark, d, "documents"), "lang", axes(ASKED))


def overlay_labels(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") >= 500, 1).otherwise(0).alias("quality"))
    return evidence.overlay(base, table(spark, d, "labels"), ["doc_id"], "quality")


def _rated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


def _metric_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, *(F.round(c, 9).alias(c) for c in df.columns if c not in keep))


def rater_metrics(spark: SparkSession, d: str) -> DataFrame:
    weight = F.when(F.col("n_chars") >= 2000, 2.0).otherwise(1.0)
    return _metric_columns(metrics.rates(metrics.weighted_confusion(_rated(spark, d), ["lang"], F.col("toxic") == 1, F.col("quality") == 1, weight)), ["lang"])


def rogan_gladen_by_lang(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.rates(metrics.weighted_confusion(_rated(spark, d), ["lang"], F.col("toxic") == 1, F.col("quality") == 1, F.lit(1.0)))
    share = metrics.rate(F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return r.select("lang", F.round(metrics.rogan_gladen(share, F.col("recall"), F.col("specificity")), 9).alias("corrected_vs_reference"))


def disagreement_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.disagreements(table(spark, d, "labels"), F.col("quality"), F.col("toxic"))


def kappa_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return _metric_columns(metrics.cohen_kappa(_rated(spark, d), ["lang"], "quality", "toxic"), ["lang", "total"])


def wilson_by_lang(spark: SparkSession, d: str) -> DataFrame:
    counts = _rated(spark, d).groupBy("lang").agg(F.sum(F.col("quality").cast("long")).alias("good"), F.count("*").alias("n"))
    low, high = metrics.wilson(F.col("good"), F.col("n"))
    return counts.select("lang", "good", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    importable(spark)
    return metrics.stratified_bootstrap(_rated(spark, d), "lang", F.col("quality") != F.col("toxic"), F.lit(1.0))


def two_level_distribution(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def source_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


def exploded_codes(spark: SparkSession, d: str) -> DataFrame:
    codes = T.flagged({n: ~c for n, c in axes(ASKED).items()}, "complete")
    return table(spark, d, "documents").select("lang", F.explode(codes).alias("code")).groupBy("lang", "code").agg(F.count("*").alias("n"))


def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy("lang").agg(
        F.count_if(F.col("text").rlike("[0-9]")).alias("with_number"), F.count_if(F.col("n_chars") < 180).alias("title_only"), F.count_distinct(T.first_line(F.col("text"))).alias("titles"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest")
    )


def token_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    tokens = T.content_tokens(F.col("text")).alias("tokens")
    items = table(spark, d, "benchmark").select("item_id", tokens)
    docs = dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", tokens)
    return evidence.overlapping(items, docs, "item_id", "doc_id", 0.5)


def _positions(pattern: str) -> Column:
    words = F.split(F.lower("text"), "[^a-z0-9]+")
    return F.filter(F.transform(words, lambda w, i: F.when(w.rlike(f"^({pattern})$"), i)), lambda i: i.isNotNull())


def proximity_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.near(_positions("with|con|mit|des"), _positions("from|para|von|une"), 5).alias("near"))


def dose_extract(spark: SparkSession, d: str) -> DataFrame:
    found = T.pattern_list(F.col("text"), "([0-9]+(?:[.,][0-9]+)?)")
    return table(spark, d, "documents").select("doc_id", F.array_join(found, " | ").alias("doses")).filter("doses != ''")


def number_check(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a document that its first line doesn't have."""
    docs = table(spark, d, "documents").select("doc_id", F.size(F.array_except(T.numbers_in(F.col("text")), T.numbers_in(T.first_line(F.col("text"))))).alias("unsupported"))
    return docs.filter("unsupported > 0")


def title_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalized_title(T.first_line(F.col("text"))).alias("title"))


def multi_value_split(spark: SparkSession, d: str) -> DataFrame:
    values = T.split_multi_value(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(values).cast("long").alias("n"), T.join_multi_value(values).alias("joined"))


def hash_inventory(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


def partition_check(spark: SparkSession, d: str) -> DataFrame:
    """Batches that lack what is labelled toxic, repeat what is long and hold some orders, against all documents."""
    docs = table(spark, d, "documents")
    toxic = table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    batches = evidence.even_batches(docs.select("doc_id", "lang"), ["lang"], ["doc_id"], 6).withColumn("part", F.concat("lang", F.lit("-"), "batch")).select("doc_id", "part")
    batches = batches.join(toxic, "doc_id", "left_anti").unionByName(docs.filter("n_chars > 4000").select("doc_id", F.lit("long").alias("part")))
    foreign = table(spark, d, "customer").select((-F.col("c_custkey") - 1).alias("doc_id"), F.lit("foreign").alias("part"))
    out = evidence.exact_partition(batches.unionByName(foreign), docs, "part", "doc_id")
    return out.select(*(F.col(c).cast("long").alias(c) for c in out.columns))


def validation_errors(spark: SparkSession, d: str) -> DataFrame:
    rules = {"long_enough": F.col("n_chars") >= 60, "counted": F.length("text") == F.col("n_chars"), "known_lang": F.col("lang").isin("en", "fr", "de"), "no_pipe": ~F.contains("text", F.lit("|"))}
    return evidence.violations(table(spark, d, "documents"), ["doc_id"], rules).select("doc_id", F.array_join("errors", ",").alias("errors"))


def even_batches(spark: SparkSession, d: str) -> DataFrame:
    out = evidence.even_batches(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], 7)
    return evidence.chunk_numbers(out, ["lang"], ["doc_id"], 25).select("doc_id", "lang", F.col("batch").cast("long").alias("batch"), F.col("chunk").cast("long").alias("chunk"))


def greedy_bins(spark: SparkSession, d: str) -> DataFrame:
    importable(spark)
    return bins.greedy_bins(table(spark, d, "documents").withColumn("part", F.concat_ws("-", "lang", "source")), "part", "doc_id", "n_chars")


def bootstrap_metrics(spark: SparkSession, d: str) -> DataFrame:
    importable(spark)
    return metrics.bootstrap_metrics(_rated(spark, d), "lang", F.col("quality") == 1, F.col("toxic") == 0, F.when(F.col("lang") == "en", 1.5).otherwise(1.0), 0.4, ("de",), 2000)


def mmr_pages(spark: SparkSession, d: str) -> DataFrame:
    importable(spark)
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text")
    return lookup.diverse_pages(docs, "lang", [F.desc("n_chars"), F.asc("doc_id")], SEED, "doc_id", "text")


def mmr_page(spark: SparkSession, d: str) -> DataFrame:
    importable(spark)
    page = lookup.top_k(table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text"), ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 30)
    return lookup.diversify(page, "lang", "rank", "doc_id", "text")


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    from loomstone.functions.sentences import with_sentences

    importable(spark)
    return with_sentences(dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id")).select("doc_id", F.posexplode("sentences").alias("place", "sentence"))


def scored_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The score of a lookup: fit to the asked axes in the title or anywhere, the sentence's quality, and priority."""
    docs = table(spark, d, "documents").filter(axes(("age",))["age"])
    near = {n: T.first_line(F.col("text")).rlike(AXES[n]) for n in ASKED}
    fit = sum((F.when(near[n], 3.0).when(c, 1.0).otherwise(0.0) for n, c in axes(ASKED).items()), F.lit(0.0)) / len(ASKED)
    quality = T.sentence_quality(T.first_line(F.col("text")), F.col("n_chars") < 180)
    score = 3 * fit + quality + F.least(F.col("n_chars") / 100, F.lit(30.0)) / 30
    out = docs.select("doc_id", "lang", F.round(score, 6).alias("score"))
    return lookup.top_k(out, ["lang"], [F.desc("score"), F.asc("doc_id")], 30)


_TOKENS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: length(w) > 3 and w not in (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "))"
_ORDERED = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_CONFUSION = "select lang, sum(case when toxic=1 and quality=1 then w else 0 end)::double tp, sum(case when toxic=1 and quality<>1 then w else 0 end)::double fp, sum(case when toxic<>1 and quality=1 then w else 0 end)::double fn, sum(case when toxic<>1 and quality<>1 then w else 0 end)::double tn from (select l.*, lang, {w} w from labels l join documents using (doc_id)) group by lang"

SQL = {
    "axis_flags_by_lang": f"select g.lang, g.axis, b.n from (select lang, unnest([{', '.join(repr(a) for a in AXES)}]) axis from (select distinct lang from documents)) g left join (select lang, axis, count(*) n from ({_SQL_BRIDGE}) group by all) b using (lang, axis)",
    "axis_filter_trace": " union all ".join(
        f"select lang, {k + 1}::integer step, '{n}' axis, count(*) filter ({' and '.join(_sql_axis(a) for a in ASKED[: k + 1])}) remaining from documents group by lang" for k, n in enumerate(ASKED)
    ),
    "core_top15_per_lang": f"select * from (select doc_id, lang, n_chars, (row_number() over (partition by lang order by n_chars desc, doc_id))::integer as rank from documents where {_sql_axis('age')} and {_sql_axis('sex')}) where rank <= 15",
    "dedup_within_lang": "select doc_id, lang, n_chars from (select *, row_number() over (partition by lang, text order by (n_chars < 180)::int, doc_id) p from documents) where p = 1",
    "dedup_stats": "select lang, count(*) as rows, count(distinct text) identities, count(*) - count(distinct text) removed from documents group by lang",
    "cross_source_repeats": "select count(*) identities, coalesce(sum(n - 1), 0)::bigint repeats from (select text, count(distinct source) n from documents group by text having count(distinct source) > 1)",
    "stratified_sample": f"select doc_id, lang, size, r::integer as rank, population, population <= 20 census, case when population <= 20 then 1.0::double else population / 20.0::double end weight from (select doc_id, lang, size, row_number() over (partition by lang, size order by sha256('{SEED}|' || lang || '|' || doc_id), lang, doc_id) r, count(*) over (partition by lang, size) population from (select doc_id, lang, case when n_chars >= 2000 then 'long' else 'short' end size from documents)) where r <= 20",
    "rotation_order": f"select doc_id, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split('{SEED}|' || doc_id, ''), lambda c: ascii(c)::bigint)), lambda h, c: ((xor(h, c) * 16777619::bigint) & 4294967295::bigint)) / 4294967296.0::double as position from documents",
    "band_paging": f"""with p as (select doc_id, lang, row_number() over (partition by lang order by n_chars desc, doc_id) - 1 i, count(*) over (partition by lang) n from documents),
        b as (select *, case when n <= 30 then 0 else list_min(list_filter(range(0, 30), lambda k: k = 29 or floor((k + 1) * (n / 30.0::double)) > i)) end band from p),
        q as (select *, row_number() over (partition by lang, band order by list_reduce(list_prepend(2166136261::bigint, list_transform(string_split('{SEED}|' || doc_id, ''), lambda c: ascii(c)::bigint)), lambda h, c: ((xor(h, c) * 16777619::bigint) & 4294967295::bigint)) desc, doc_id) - 1 place from b)
        select doc_id, lang, band::integer band, place::integer place, (case when n <= 30 then 0 else place end)::integer page from q""",
    "core_then_topup": f"""with core as (select doc_id, lang, n_chars from (select *, row_number() over (partition by lang order by n_chars desc, doc_id) r from documents where n_chars < 900) where r <= 7),
        ext as (select doc_id, lang, n_chars from documents where {" and ".join(map(_sql_axis, ASKED))}),
        t as (select *, 0 tier from core union all select *, 1 tier from ext where doc_id not in (select doc_id from core))
        select doc_id, lang, n_chars, tier::integer tier, r::integer as rank from (select *, row_number() over (partition by lang order by tier, n_chars desc, doc_id) r from t) where r <= 15""",
    "postings_index": f"select lang, axis, (doc_id // 4096)::bigint block, string_agg(doc_id::varchar, '|' order by doc_id) ids, count(*) n from ({_SQL_BRIDGE}) group by all",
    "leave_one_out_counts": "select * from ("
    + " union all ".join(f"select lang, '{n}' axis, count(*) filter ({' and '.join(_sql_axis(a) for a in ASKED if a != n)}) \"without\", count(*) filter ({' and '.join(_sql_axis(a) for a in ASKED if a != n)} and not {_sql_axis(n)}) gain from documents group by lang" for n in ASKED)
    + ") where gain > 0",
    "overlay_labels": "select d.doc_id, case when l.doc_id is not null then l.quality else (case when n_chars >= 500 then 1 else 0 end) end::integer quality, case when l.doc_id is not null then 'overlay' else 'base' end label_source from documents d left join labels l using (doc_id)",
    "rater_metrics": f"""select lang, round(tp,9) tp, round(fp,9) fp, round(fn,9) fn, round(tn,9) tn, round(r,9) recall, round(s,9) specificity, round(p,9) as precision, round(case when r=0 or p=0 then 0 else 2*r*p/(r+p) end,9) f1, round((tp+tn)/nullif(tp+fp+fn+tn,0),9) agreement, round((tp+fn)/nullif(tp+fp+fn+tn,0),9) prevalence
        from (select *, tp/nullif(tp+fn,0) r, tn/nullif(tn+fp,0) s, tp/nullif(tp+fp,0) p from ({_CONFUSION.format(w="case when n_chars >= 2000 then 2 else 1 end")}))""",
    "rogan_gladen_by_lang": f"select lang, round(case when abs(r+s-1) >= 1e-9 then ((tp+fp)/(tp+fp+fn+tn)+s-1)/(r+s-1) end,9) corrected_vs_reference from (select *, tp/nullif(tp+fn,0) r, tn/nullif(tn+fp,0) s from ({_CONFUSION.format(w='1')}))",
    "disagreement_matrix": "select quality || '->' || toxic as pair, count(*) n from labels where quality <> toxic group by 1",
    "kappa_by_lang": """with c as (select lang, quality q, toxic t, count(*) n from labels join documents using (doc_id) group by all), s as (select lang, sum(n)::bigint total, sum(case when q=t then n else 0 end)::double same from c group by lang),
        m as (select a.lang, sum(a.n*b.n)::double p from (select lang, q k, sum(n) n from c group by all) a join (select lang, t k, sum(n) n from c group by all) b using (lang, k) group by a.lang)
        select lang, total, round(same/total,9) observed, round(coalesce(p,0)/(total*total),9) expected, round(case when 1-coalesce(p,0)/(total*total) >= 1e-12 then (same/total-coalesce(p,0)/(total*total))/(1-coalesce(p,0)/(total*total)) end,9) kappa from s left join m using (lang)""",
    "wilson_by_lang": f"""select lang, good, n, round(greatest(0, (good/n + {metrics.Z}*{metrics.Z}/(2*n))/(1+{metrics.Z}*{metrics.Z}/n) - {metrics.Z}*sqrt((good/n)*(1-good/n)/n + {metrics.Z}*{metrics.Z}/(4*n*n))/(1+{metrics.Z}*{metrics.Z}/n))::double,9) low,
        round(least(1, (good/n + {metrics.Z}*{metrics.Z}/(2*n))/(1+{metrics.Z}*{metrics.Z}/n) + {metrics.Z}*sqrt((good/n)*(1-good/n)/n + {metrics.Z}*{metrics.Z}/(4*n*n))/(1+{metrics.Z}*{metrics.Z}/n))::double,9) high from (select lang, sum(quality)::bigint good, count(*) n from labels join documents using (doc_id) group by lang)""",
    "two_level_distribution": "select lang, source, count(*) n, sum(n_chars)::bigint chars from documents group by lang, source",
    "source_rollup": "select lang, source, count(*) files, sum(strlen(text))::bigint bytes from documents group by rollup (lang, source)",
    "exploded_codes": "select lang, code, count(*) n from (select lang, unnest(case when len(c) = 0 then ['complete'] else c end) code from (select lang, [x for x in [" + ", ".join(f"case when not {_sql_axis(n)} then '{n}' end" for n in ASKED) + "] if x is not null] c from documents)) group by all",
    "conditional_counts": "select lang, count(*) filter (regexp_matches(text, '[0-9]')) with_number, count(*) filter (n_chars < 180) title_only, count(distinct split_part(text, chr(10), 1)) titles, min(n_chars) shortest, max(n_chars) longest from documents group by lang",
    "token_overlap_pairs": f"""with i as (select item_id, list_distinct({_TOKENS.format("text")}) t from benchmark), d as (select doc_id, list_distinct({_TOKENS.format("text")}) t from documents)
        select item_id, doc_id, len(list_intersect(i.t, d.t))::bigint shared, round(len(list_intersect(i.t, d.t)) / least(len(i.t), len(d.t))::double, 9) overlap from i, d where len(i.t) > 0 and len(d.t) > 0 and round(len(list_intersect(i.t, d.t)) / least(len(i.t), len(d.t))::double, 9) >= 0.5""",
    "proximity_match": """with w as (select doc_id, string_split_regex(lower(text), '[^a-z0-9]+') w from documents), p as (select doc_id, [i for x, i in w if regexp_full_match(x, 'with|con|mit|des')] a, [i for x, i in w if regexp_full_match(x, 'from|para|von|une')] b from w)
        select doc_id, len(list_filter(a, lambda x: len(list_filter(b, lambda y: abs(x - y) <= 5)) > 0)) > 0 near from p""",
    "dose_extract": f"select doc_id, array_to_string({_ORDERED.format('l')}[1:8], ' | ') doses from (select doc_id, regexp_extract_all(text, '([0-9]+(?:[.,][0-9]+)?)', 1) l from documents) where len(l) > 0",
    "number_check": f"select * from (select doc_id, len(list_distinct([x for x in a if not list_contains(b, x)]))::integer unsupported from (select doc_id, list_transform(regexp_extract_all(text, '{T.NUMBER}', 1), lambda x: replace(x, ',', '')) a, list_transform(regexp_extract_all(split_part(text, chr(10), 1), '{T.NUMBER}', 1), lambda x: replace(x, ',', '')) b from documents)) where unsupported > 0",
    "title_normalise": "select doc_id, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9가-힣]+', ' ', 'g'), ' ') title from documents",
    "multi_value_split": f"select doc_id, len(v)::bigint n, array_to_string(v, ' · ') joined from (select doc_id, {_ORDERED.format('l')} v from (select doc_id, list_filter(list_transform(string_split_regex(text, '[·,;\\n]'), lambda x: trim(x, ' ')), lambda x: x <> '') l from documents))",
    "hash_inventory": "select doc_id, sha256(text) sha256, strlen(text)::bigint bytes from documents",
    "partition_check": """with b as (select doc_id, lang || '-' || ntile(6) over (partition by lang order by doc_id) part from documents), t as (select doc_id from labels where toxic = 1),
        p as (select * from b where doc_id not in (select doc_id from t where doc_id is not null) union all select doc_id, 'long' from documents where n_chars > 4000 union all select -c_custkey - 1, 'foreign' from customer)
        select count(*) as rows, count(distinct doc_id) distinct_keys, count(distinct part) parts, (select count(*) from documents where doc_id not in (select doc_id from p)) missing,
        (select count(*) from p where doc_id not in (select doc_id from documents)) "foreign", (select count(*) from documents) expected from p""",
    "validation_errors": "select doc_id, array_to_string(e, ',') errors from (select doc_id, [x for x in [case when not n_chars >= 60 then 'long_enough' end, case when length(text) <> n_chars then 'counted' end, case when lang not in ('en', 'fr', 'de') then 'known_lang' end, case when contains(text, '|') then 'no_pipe' end] if x is not null] e from documents) where len(e) > 0",
    "even_batches": "select doc_id, lang, ntile(7) over (partition by lang order by doc_id) batch, ((row_number() over (partition by lang order by doc_id) - 1) // 25)::bigint as chunk from documents",
    "greedy_bins": """with recursive o as (select lang || '-' || source as part, doc_id, n_chars, row_number() over (partition by lang, source order by doc_id) r from documents),
        f as (select part, doc_id, r, 1 as bin, 1 as items, n_chars as total from o where r = 1
        union all select o.part, o.doc_id, o.r, case when f.items >= 30 or f.total + o.n_chars > 60000 then f.bin + 1 else f.bin end, case when f.items >= 30 or f.total + o.n_chars > 60000 then 1 else f.items + 1 end, case when f.items >= 30 or f.total + o.n_chars > 60000 then o.n_chars else f.total + o.n_chars end from f join o on o.part = f.part and o.r = f.r + 1)
        select part, doc_id, bin::integer bin from f""",
    "scored_lookup": f"""with s as (select doc_id, lang, round(3 * (({" + ".join(f"case when {_sql_axis(n, 'split_part(text, chr(10), 1)')} then 3.0 when {_sql_axis(n)} then 1.0 else 0.0 end" for n in ASKED)})::double / 3) + (case when regexp_matches(lower(split_part(text, chr(10), 1)), '^(results?|conclusions?|findings?)\\b') then 1.5 else 0 end + case when regexp_matches(split_part(text, chr(10), 1), '(^|[^A-Za-z])[0-9]') then 1 else 0 end
        + case when regexp_matches(lower(split_part(text, chr(10), 1)), 'increase|decrease|reduc|associat|risk|higher|lower|significant') then 1 else 0 end + case when length(split_part(text, chr(10), 1)) >= 90 then 0.5 else 0 end - case when n_chars < 180 then 2 else 0 end)::double + least(n_chars / 100.0::double, 30) / 30, 6) score from documents where {_sql_axis("age")})
        select * from (select *, (row_number() over (partition by lang order by score desc, doc_id))::integer as rank from s) where rank <= 30""",
}
QUERIES = {
    name: f
    for name, f in list(globals().items())
    if callable(f) and not name.startswith("_") and getattr(f, "__module__", "") == __name__ and name != "axes"
}
