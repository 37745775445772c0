"""Queries over the star schema and events: keys, checkpoints, calendars and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.operators import evidence, rules
from loomstone.session import importable, scratch_path, table
from loomstone.sources.readers import date_slices
from loomstone.streaming import rounds
from loomstone.streaming.checkpoint import Checkpoint

#: Kinds of a part's type, the first that fits (a stand-in for publication types).
KINDS = [("PROMO", "promotion"), ("BRUSHED|POLISHED", "finished"), ("PLATED|ANODIZED|BURNISHED", "coated"), ("STANDARD", "standard")]
#: Synthetic limits: name, lowest size, highest price, jurisdiction.
LIMITS = [("small", 10, 1200.0, "eu"), ("large", 30, 1500.0, "us"), ("any", 1, 900.0, "eu")]


def doi_normalise(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" HTTPS://dx.doi.org/10."), "p_partkey", F.lit("/"), F.upper("p_name"), F.lit(" .;"))
    return table(spark, d, "part").select("p_partkey", T.normalize_doi(raw).alias("doi"), T.paper_identity(F.when(F.col("p_partkey") % 3 == 0, raw), F.col("p_name"), F.col("p_partkey")).alias("identity"))


def study_kinds(spark: SparkSession, d: str) -> DataFrame:
    kind = T.first_match(F.upper("p_type"), KINDS, "other")
    return table(spark, d, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min("p_size").alias("smallest"), F.max("p_size").alias("largest"))


def date_shards(spark: SparkSession, d: str) -> DataFrame:
    span = table(spark, d, "orders").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    months = span.select(F.inline(date_slices(F.col("a"), F.col("b"))))
    return months.select(F.date_format("first", "yyyy/MM/dd").alias("first"), F.date_format("last", "yyyy/MM/dd").alias("last"))


def key_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return evidence.key_reconciliation(table(spark, d, "orders").filter("o_totalprice > 100000"), lines, "o_orderkey")


def row_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    a = lines.filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("v"))
    b = lines.filter("l_quantity > 20").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("v"))
    return evidence.reconcile(a, b).groupBy("only_in").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return evidence.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"])


def checkpoint_append(spark: SparkSession, d: str) -> DataFrame:
    """Batches of events put into a checkpoint in two appends, the second with all batches: those of the first are complete and passed over."""
    events = table(spark, d, "events").select(F.floor(F.col("event_id") / 100).alias("batch_id"), "event_id", "user_id", "event_type")
    checkpoint = Checkpoint(spark, scratch_path(spark, "checkpoint"))
    checkpoint.append(events.filter("batch_id % 3 != 1"), ["event_id"])
    checkpoint.append(events, ["event_id"])
    rows = checkpoint.read().groupBy("batch_id").agg(F.count_distinct("user_id").alias("users"), F.sum("event_id").alias("ids"))
    return checkpoint.runs().select("batch_id", "row_count", F.col("commit").cast("int").alias("commit")).join(rows, "batch_id")


def judged_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Rounds of judgements, dropped as files and read by a stream that lets a key be judged once: by round, how many count, how many come again and how many of those say something else."""
    importable(spark)
    n = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("event_type").alias("question_id"), F.col("user_id").cast("string").alias("record_id"), (n % 5 + 1).alias("round"), n.alias("place"), F.when(n % 3 == 0, "retain").otherwise("deprioritize").alias("decision"))
    dropped, out, state = (scratch_path(spark, name) for name in ("rounds", "judged", "state"))
    rows.write.json(dropped)
    rounds.follow_rounds(spark.readStream.schema(rounds.JUDGEMENT).json(dropped), out, state).awaitTermination()
    judged = spark.read.parquet(out)
    return judged.groupBy("round").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("again"), F.count_if(F.col("decision") != F.col("first_decision")).alias("differing"))


def batch_receipts(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("batch_id", F.concat(F.lit("batch-"), F.lpad(F.floor(F.col("event_id") / 250).cast("string"), 4, "0")))
    rows = events.groupBy("batch_id").agg(F.count("*").alias("row_count"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))
    return rows


def threshold_rules(spark: SparkSession, d: str) -> DataFrame:
    """Each part against each limit: matched, excluded, or needs_more_info where something is missing; the strictest jurisdiction wins."""
    part = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("size"), F.col("p_retailprice").alias("price"))
    limits = spark.createDataFrame(LIMITS, "rule string, least_size int, most_price double, jurisdiction string")
    return rules.evaluate(part, limits, "p_partkey")


def strictest_limit(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return rules.strictest(lines.select("l_partkey", "l_suppkey", "s_nationkey", "l_discount"), ["l_partkey"], "l_discount", ["l_suppkey", "s_nationkey"])


SQL = {
    "doi_normalise": "select p_partkey, doi, case when p_partkey % 3 = 0 then 'doi:' || doi else 'title:' || p_name end as identity from (select p_partkey, p_name, regexp_replace(replace(regexp_replace(lower(trim(' HTTPS://dx.doi.org/10.' || p_partkey || '/' || upper(p_name) || ' .;')), '^(https?://(dx\\.)?doi\\.org/|doi:)', ''), ' ', ''), '[.,;]+$', '') doi from part)",
    "study_kinds": "select " + "case " + " ".join(f"when regexp_matches(upper(p_type), '{p}') then '{n}'" for p, n in KINDS) + " else 'other' end kind, count(*) n, min(p_size) smallest, max(p_size) largest from part group by 1",
    "date_shards": "with s as (select min(o_orderdate)::date a, max(o_orderdate)::date b from orders), m as (select a, b, unnest(generate_series(date_trunc('month', a), b::timestamp, interval 1 month))::date m from s) select strftime(greatest(m, a), '%Y/%m/%d') as first, strftime(least(last_day(m), b), '%Y/%m/%d') as last from m",
    "key_reconciliation": "with a as (select distinct o_orderkey k from orders where o_totalprice > 100000), b as (select distinct l_orderkey k from lineitem where l_quantity > 45) select case when a.k is null then 'right' when b.k is null then 'left' else 'both' end side, count(*) keys from a full outer join b on a.k = b.k group by 1",
    "row_reconciliation": "with a as (select l_orderkey k, l_linenumber::bigint v from lineitem where l_linenumber <= 2), b as (select l_orderkey k, l_linenumber::bigint v from lineitem where l_quantity > 20), x as (select 'expected' only_in, * from (select * from a except all select * from b) union all select 'observed', * from (select * from b except all select * from a)) select only_in, count(*) n, sum(k)::bigint keys from x group by 1",
    "duplicate_keys": "select l_orderkey, l_suppkey, count(*) n from lineitem group by 1, 2 having count(*) > 1",
    "checkpoint_append": "select floor(event_id / 100)::bigint batch_id, count(*) row_count, case when floor(event_id / 100) % 3 <> 1 then 1 else 2 end as commit, count(distinct user_id) users, sum(event_id)::bigint ids from events group by 1, 3",
    "judged_rounds": """with j as (select event_type, user_id, event_id % 5 + 1 r, event_id, case when event_id % 3 = 0 then 'retain' else 'deprioritize' end decision from events),
        f as (select *, row_number() over w k, first_value(decision) over w first_ from j window w as (partition by event_type, user_id order by r, event_id))
        select r as "round", count(*) filter (k = 1) accepted, count(*) filter (k > 1) again, count(*) filter (decision <> first_) differing from f group by 1""",
    "batch_receipts": "select 'batch-' || lpad((event_id // 250)::varchar, 4, '0') batch_id, count(*) row_count, count(distinct user_id) users, round(sum(value), 4) total from events group by 1",
    "threshold_rules": "with l(rule, least_size, most_price, jurisdiction) as (values " + ", ".join(f"('{a}', {b}, {c}::double, '{j}')" for a, b, c, j in LIMITS) + ") select p_partkey, rule, jurisdiction, case when p_partkey % 7 = 0 then 'needs_more_info' when p_size >= least_size and p_retailprice <= most_price then 'definitely_matched' else 'excluded' end outcome from part, l",
    "strictest_limit": "select l_partkey, l_suppkey, s_nationkey, l_discount from (select l_partkey, l_suppkey, s_nationkey, l_discount, row_number() over (partition by l_partkey order by l_discount, l_suppkey, s_nationkey) r from lineitem join supplier on s_suppkey = l_suppkey) where r = 1",
}
QUERIES = {
    name: f
    for name, f in list(globals().items())
    if callable(f) and not name.startswith("_") and getattr(f, "__module__", "") == __name__
}
