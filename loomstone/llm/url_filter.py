"""URL filtering with a path-template tree for each host.

Judged urls (a rule, or any other label of 0 or 1) train a tree: paths are cut into segments, segments of digits, hexadecimals or mixed
letters and digits become typed wildcards, and below each node
* segments without support of their own, where a node has many, become one wildcard;
* literal segments whose share of bad urls doesn't differ from that of all their siblings (a two-proportion z-test of the branch against the rest)
  are merged into one branch, and so are those that differ from the rest but are alike among themselves (the same tenth of the scale); so the tree keeps literals
  only where they alone tell good from bad.
A template is rejected where its smoothed purity, (bad + weight * purity of its parent) / (judged + weight), reaches a threshold.
Parents are: the template's own prefix in the host's tree, then the same in the tree of all hosts, then the share of bad urls at large;
so templates without judged urls inherit from the nearest ancestor that has some.

Nodes are rows; a level of the tree is one grouped aggregation and one join, for any number of hosts, and a hot host is
aggregated before it is shuffled. Paths deeper than `depth` segments keep all text: the rest is one last segment, in which > stands for /.

Defined results: null urls and urls without :// have empty host and path and are judged by the method like others; an empty
table gives no rows; repeated rows are judged each; a url no node covers is allowed unless most judged urls are bad; result columns replace columns of the same name,
all others come through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.session import materialized

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANY_HOST = "*"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_verdicts(pages: DataFrame, rules: list[tuple[str, bool]]) -> DataFrame:
    """pages with host, path, rule and blocked: the longest rule (host and path, blocked) that fits, else null."""
    kept = pages.select(*(pages[c] for c in pages.columns if c not in ("host", "path", "rule", "blocked")))
    out = kept.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    best = F.lit(None).cast("struct<rule:string,blocked:boolean>")
    for rule, blocked in sorted(rules, key=lambda r: len(r[0])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(blocked).alias("blocked"))).otherwise(best)
    return out.withColumn("__best", best).select(*out.columns, F.col("__best.rule").alias("rule"), F.col("__best.blocked").alias("blocked"))


def _segment(s: Column) -> Column:
    """A segment, or the typed wildcard of a variable one."""
    return (
        F.when(s.rlike(r"^\d+(\.[A-Za-z0-9]{1,5})?$"), "<n>")
        .when(s.rlike(r"^[0-9A-Fa-f-]{8,}$") & s.rlike(r"\d"), "<x>")
        .when(s.rlike(r"\d") & s.rlike(r"\D"), "<id>")
        .otherwise(F.regexp_replace(s, "[<>*]", "_"))
    )


def segments(path: Column, depth: int) -> Column:
    """Segments of a path without its empty ones; the last one holds the rest, with > for / so that / always parts segments."""
    parts = F.split(F.regexp_replace(path, "^/+|/+$|/+(?=/)", ""), "/", depth)
    return F.transform(F.filter(parts, lambda s: s != ""), lambda s: F.replace(_segment(s), F.lit("/"), F.lit(">")))


def template_tree(judged: DataFrame, depth: int = 6, many: int = 16, support: int = 3, z: float = 1.96, weight: float = 4.0) -> DataFrame:
    """Nodes of all trees from judged urls (host, path, bad 0 or 1; null where unknown): host, level, shape, node, n, judged, bad, purity.

    shape is the path's segments joined up to the level; node is the template it belongs to. The tree of host "*" is that of all hosts.
    """
    shapes = judged.select("host", segments(F.col("path"), depth).alias("parts"), F.col("bad").cast("long").alias("bad"))
    shapes = shapes.groupBy("host", "parts").agg(F.count("*").alias("n"), F.count("bad").alias("judged"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    everywhere = shapes.groupBy(F.lit(ANY_HOST).alias("host"), "parts").agg(*(F.sum(c).alias(c) for c in ("n", "judged", "bad")))
    at = materialized(shapes.unionByName(everywhere).withColumn("node", F.lit("")).withColumn("shape", F.lit("")), "shapes")
    counts = [F.sum(c).alias(c) for c in ("n", "judged", "bad")]
    levels = [at.groupBy("host", "node", "shape").agg(*counts).withColumn("level", F.lit(0))]
    for level in range(1, depth + 1):
        part = F.element_at("parts", level)
        at = at.filter(F.size("parts") >= level).withColumn("part", part)
        child = at.groupBy("host", "node", "part").agg(*counts)
        siblings = child.groupBy("host", "node").agg(F.count("*").alias("kinds"), F.sum("judged").alias("all_judged"), F.sum("bad").alias("all_bad"))
        child = child.join(siblings, ["host", "node"])
        rare = (F.col("kinds") > many) & (F.col("n") < support)
        typed = F.col("part").startswith("<")
        # Each branch against the rest of its siblings; those that differ are alike if they have the same tenth.
        share, rest = F.col("bad") / F.col("judged"), F.col("all_judged") - F.col("judged")
        overall = F.col("all_bad") / F.col("all_judged")
        spread = F.sqrt(overall * (1 - overall) * (1 / F.col("judged") + 1 / rest))
        differs = F.when((F.col("judged") > 0) & (rest > 0), F.abs(share - (F.col("all_bad") - F.col("bad")) / rest) > z * spread).otherwise(False)
        tenth = F.when(differs & ~rare & ~typed, F.least(F.floor(share * 10), F.lit(9)))
        child = child.withColumn("tenth", tenth).withColumn("rare", rare)
        alike = child.filter("tenth is not null").groupBy("host", "node", "tenth").agg(F.count("*").alias("branches"))
        child = child.join(alike, ["host", "node", "tenth"], "left")
        merged = F.when(F.col("rare"), "*").when(typed | (F.col("kinds") == 1) | (F.col("branches") == 1), F.col("part")).when(F.col("branches") > 1, F.concat(F.lit("*"), "tenth")).otherwise("*")
        step = child.select("host", "node", "part", F.concat("node", F.lit("/"), merged).alias("next"))
        at = at.join(step, ["host", "node", "part"]).withColumn("node", F.col("next")).withColumn("shape", F.concat("shape", F.lit("/"), "part")).drop("part", "next")
        at = materialized(at, "level")
        levels.append(at.groupBy("host", "node", "shape").agg(*counts).withColumn("level", F.lit(level)))
    shapes = materialized(reduce(DataFrame.unionByName, levels), "nodes")
    nodes = shapes.groupBy("host", "level", "node").agg(*counts)
    total = nodes.filter((F.col("host") == ANY_HOST) & (F.col("level") == 0)).select((F.col("bad") / F.greatest("judged", F.lit(1))).alias("base"))
    base = (total.first() or [0.0])[0] or 0.0
    smooth = lambda prior: (F.col("bad") + weight * prior) / (F.col("judged") + weight)
    known = None
    for level in range(depth + 1):  # parents first; a parent's purity is its children's prior
        own = nodes.filter(F.col("level") == level)
        parent = F.regexp_replace("node", "/[^/]*$", "")
        if known is None:
            own = own.withColumn("purity", smooth(F.lit(base)))
        else:
            own = own.withColumn("parent", parent).join(known.select("host", F.col("node").alias("parent"), F.col("purity").alias("prior")), ["host", "parent"]).withColumn("purity", smooth(F.col("prior"))).drop("parent", "prior")
        known = materialized(own, "purity")
        levels[level] = known
    purity = reduce(DataFrame.unionByName, levels)
    return shapes.select("host", "level", "node", "shape").join(purity, ["host", "level", "node"])


def method_verdicts(pages: DataFrame, judged: DataFrame, depth: int = 6, threshold: float = 0.5, weight: float = 4.0, **options) -> DataFrame:
    """pages (host, path) with template, purity and rejected. judged: host, path, bad (0, 1 or null); pages' own paths should be among it."""
    tree = materialized(template_tree(judged, depth, weight=weight, **options), "tree")
    # A path's deepest node in its host's tree and in that of all hosts.
    shape = F.concat_ws("", F.transform(segments(F.col("path"), depth), lambda s: F.concat(F.lit("/"), s)))
    kept = [c for c in pages.columns if c not in ("template", "purity", "rejected")]
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col("host").alias("host"), shape.alias("shape"))  # one struct, so that no name can clash
    own = tree.filter(F.col("host") != ANY_HOST).select(F.col("host").alias("__host"), F.col("shape").alias("__shape"), F.col("node").alias("own_node"), F.col("judged").alias("own_judged"), F.col("bad").alias("own_bad"), F.col("purity").alias("own_purity"))
    rest = tree.filter(F.col("host") == ANY_HOST).select(F.col("shape").alias("__any"), F.col("node").alias("any_node"), F.col("purity").alias("any_purity"))
    keys = rows.select(F.col("host").alias("__host"), F.col("shape").alias("__shape")).distinct()
    scored = keys.join(own, ["__host", "__shape"], "left").join(rest, F.col("__shape") == F.col("__any"), "left")
    # The host's own evidence, with the template of all hosts as its prior.
    purity = (F.coalesce("own_bad", F.lit(0)) + weight * F.coalesce("any_purity", "own_purity", F.lit(0.0))) / (F.coalesce("own_judged", F.lit(0)) + weight)
    scored = scored.select("__host", "__shape", F.coalesce("own_node", "any_node").alias("template"), purity.alias("purity"))
    out = rows.join(scored, (F.col("host") == F.col("__host")) & (F.col("shape") == F.col("__shape")), "left")
    return out.select(*(F.col("row").getField(c).alias(c) for c in kept), "template", "purity", (F.col("purity") >= threshold).alias("rejected"))
