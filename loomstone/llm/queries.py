"""The registered queries of this package: thin calls of the operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.session import importable, table


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstone.llm.packing import pack_documents

    importable(spark)
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstone.llm.suffix_dedup import remove_repeats

    importable(spark)
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstone.llm.minhash import near_duplicates

    importable(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstone.llm.quality import train, with_score

    importable(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train(docs, labels.filter(~held_out))
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstone.llm.decontam import contaminated

    importable(spark)
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tag")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstone.llm.fingerprint_index import remove_seen_words

    importable(spark)
    return remove_seen_words(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstone.llm.token_count import count_tokens

    importable(spark)
    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


#: Relaxation of the tree's pruning; recall against brute force is in the README.
VP_FACTOR = 1.2


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstone.llm.ann import nearest

    importable(spark)
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"), factor=VP_FACTOR)


#: Host and path prefixes, and whether they block.
URL_RULES = [("com/", False), ("example.com/en/", True), ("www.example.com/en/", False), ("net/es/", True), ("net/fr/", True)]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstone.llm.url_filter import method_verdicts, rule_verdicts

    importable(spark)
    pages = rule_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    judged = pages.select("host", "path", F.col("blocked").cast("int").alias("bad"))
    out = method_verdicts(pages, judged)
    blocked = F.coalesce("blocked", "rejected", F.lit(False))
    return out.select("page_id", "host", "path", "rule", F.when(blocked, "block").otherwise("allow").alias("verdict"), "template", "purity")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstone.llm.chat import format_conversations, read_back

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role")) for k, role in enumerate(("user", "assistant"))))).alias("t"))
    extra = extra.select("conv_id", "t.turn", "t.role", F.lit(says).alias("text"))
    back = read_back(format_conversations(turns.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("masked", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("characters").alias("formatted_chars")
    )


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstone.llm.topk import build_index, search

    importable(spark)
    vectors = table(spark, sf_dir, "embeddings")
    return search(build_index(vectors, scale=256), vectors.filter("vec_id % 50 = 0"), k=5, scale=256)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstone.llm.prefix_trie import conversation_trie

    importable(spark)
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstone.llm.vector_codes import code_string, codebooks_digest, encode

    importable(spark)
    coded, codebooks = encode(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    digest = F.lit(None if codebooks is None else codebooks_digest(codebooks)).cast("string")
    return coded.select("vec_id", code_string("entries").alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Words of a text as the contracts define them, as a list.
_WORDS = "list_filter(string_split_regex({0}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"

_MARKED = "length({0}) + length(regexp_replace({0}, '[^\\\\\\[\\]<]', '', 'g'))"

#: Vectors without null or non-finite components, as whole numbers; {0} is the scale.
_FLOORS = "select vec_id, label, list_transform(embedding, lambda x: cast(floor({0} * cast(x as double)) as bigint)) v from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Each round assigns all parts (a0, a1, ...) and replaces the entries (b1, b2, ...)."""
    steps = [
        f"v as materialized ({_FLOORS.format(scale)})",
        f"x as materialized (select vec_id, label, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] w from v, range({parts}) r(p))",
        f"b0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 e, w from x where vec_id in (select vec_id from v order by vec_id limit {entries}))",
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} as materialized (select vec_id, label, p, any_value(x.w) w, min(list_inner_product(x.w::double[], x.w::double[]) - 2 * list_inner_product(x.w::double[], b.w::double[]) + list_inner_product(b.w::double[], b.w::double[]))::bigint d, min_by(e, ({{}}) * {2 * entries} + e) e from x join b{k} b using (p) group by 1, 2, 3)".replace("{}", "list_inner_product(x.w::double[], x.w::double[]) - 2 * list_inner_product(x.w::double[], b.w::double[]) + list_inner_product(b.w::double[], b.w::double[])"))
        if k < rounds:
            steps.append(f"n{k} as (select p, e, list(s order by i) w from (select p, e, i, (s - ((s % n) + n) % n) // n s from (select p, e, i, sum(c)::bigint s, count(*)::bigint n from (select p, e, unnest(w) c, generate_subscripts(w, 1) i from a{k}) group by 1, 2, 3)) group by 1, 2)")
            steps.append(f"b{k + 1} as materialized (select p, e, coalesce(n.w, b.w) w from b{k} b left join n{k} n using (p, e))")
    steps.append(f"c as (select vec_id, label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' order by p) code, sum(d)::bigint error from a{rounds} group by 1, 2)")
    steps.append(f"h as (select sha256(string_agg(array_to_string(w, ','), ',' order by p, e)) codebooks_sha256 from b{rounds})")
    return f"with {', '.join(steps)} select vec_id, code, error, sum(error) over (partition by label)::bigint label_error, codebooks_sha256 from c, h"


SQL = {
    "op11_exact_top_k": f"""with v as ({_FLOORS.format(256)}), s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
        select query_id, rank::int rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= 5""",
    "op12_conversation_trie": """with t as (select conv_id, coalesce(role, '') r, coalesce(text, '') x, turn, substr(sha256(strlen(r)::varchar || ':' || r || x), 1, 48) k, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) w from conversations where conv_id is not null),
        o as (select conv_id, list(k order by turn nulls first, k) k, list(w order by turn nulls first, k) w from t group by 1),
        c as (select *, conv_id - conv_id % 20 base, xor(4294967295, list_reduce(list_transform(range(1, len(conv_id::varchar) + 1), lambda i: ascii((conv_id::varchar)[i])::bigint),
            lambda acc, b: list_reduce(range(8), lambda a, z: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, xor(acc, b)), 4294967295::bigint)) % 4 h from o),
        s as (select c.conv_id, list_concat(coalesce(b.k[1:c.h], []), c.k[c.h + 1:]) k, list_concat(coalesce(b.w[1:c.h], []), c.w[c.h + 1:]) w from c left join o b on b.conv_id = c.base),
        m as (select *, sha256(array_to_string(k[1:d], ',')) node, case when d > 0 then sha256(array_to_string(k[1:d - 1], ',')) end above from (select *, unnest(range(0, len(k) + 1)) d from s)),
        n as (select node, d, any_value(above) above, min(conv_id) conv_id, count(*) n_convs, (count(*) - 1) * coalesce(any_value(w[d]), 0) saved, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(k) = d), '')) ends_sha256 from m group by 1, 2),
        kids as (select above node, count(*) n_children from n where d > 0 group by 1),
        below as (select distinct a.node, b.node lower from m a join m b on a.conv_id = b.conv_id and a.d <= b.d),
        sums as (select below.node, count(*) filter (kids.node is null) n_leaves, sum(saved) saved_tokens from below join n on n.node = lower left join kids on kids.node = lower group by 1)
        select n.conv_id, n.d::bigint as depth, p.conv_id parent_conv_id, n.n_convs, coalesce(n_children, 0) n_children, n_leaves, saved_tokens::bigint saved_tokens, n.ends_sha256 from n left join n p on p.node = n.above left join kids on kids.node = n.node join sums on sums.node = n.node""",
    "op13_vector_codes": _codes_sql(),
    "op4_chat_formatting": f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, k, case when k = 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) r(k)),
        a as (select *, len(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]')) + 4 tok, 3 + {_MARKED.format("role")} + {_MARKED.format("text")} + 4 size, row_number() over (partition by conv_id order by turn, role, text) place from t),
        b as (select *, coalesce(sum(tok) over (partition by conv_id order by place rows between unbounded preceding and 1 preceding), 0)::bigint start, max(case when place = 1 and role = 'system' then tok end) over (partition by conv_id) systok, max(case when place = 1 and role = 'system' then size end) over (partition by conv_id) syssize from a),
        c as (select *, greatest(16, floor((1024 - 128 - coalesce(systok, 0)) / 2.0)) cell from b),
        e as (select *, floor(start / cell) k, tok > cell alone from c),
        g as (select *, case when lag(k) over w = k and lag(alone) over w = alone and not alone then 0 else 1 end change from e window w as (partition by conv_id order by place)),
        h as (select *, sum(change) over (partition by conv_id order by place) win from g),
        m as (select conv_id, win, min(start) opens, min(place) head, max(syssize) syssize from h group by 1, 2),
        extra as (select conv_id, sum(n)::bigint n from (select h.conv_id, h.size + 3 n from h join m on m.conv_id = h.conv_id and m.win > h.win and m.opens - h.start between 1 and 128 where h.tok <= 128 and not (h.place = 1 and h.role = 'system') union all select conv_id, syssize + 3 from m where syssize is not null and head > 1) group by 1),
        o as (select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) turns_sha256, coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '') loss, sum(size)::bigint chars from h group by 1)
        select conv_id, n_turns, turns_sha256, length(loss)::bigint loss_chars, sha256(loss) loss_sha256, (chars + coalesce(n, 0))::bigint formatted_chars from o left join extra using (conv_id)""",
    "op3_substring_dedup": f"""with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} w from documents),
        win as (select doc_id, i, list_aggregate(w[i:i + 19], 'string_agg', ' ') s from (select doc_id, w, unnest(range(1, len(w) - 18)) i from d where len(w) >= 20)),
        late as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) r from win) where r > 1),
        gone as (select distinct doc_id, unnest(range(i, i + 20)) p from late),
        word as (select doc_id, unnest(range(1, len(w) + 1)) p, unnest(w) x from d),
        kept as (select word.doc_id, string_agg(x, ' ' order by word.p) t, count(*) n from word left join gone using (doc_id, p) where gone.p is null group by word.doc_id)
        select d.doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join kept using (doc_id)""",
    "op10_minhash_near_dedup": f"""with recursive d as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w from documents),
        s as (select distinct doc_id, h from (select doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') h from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i from d where len(w) > 0))),
        n as (select doc_id, count(*) n from s group by 1),
        c as (select a.doc_id x, b.doc_id y, count(*) k from s a join s b using (h) where a.doc_id <> b.doc_id group by 1, 2),
        l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 85 * (a.n + b.n - k)),
        r as (select doc_id, doc_id reach from d union select r.doc_id, l.y from r join l on l.x = r.reach)
        select d.doc_id, coalesce(max(n), 0)::bigint n_shingles, min(reach) component_id, min(reach) = d.doc_id kept from d left join n using (doc_id) join r on r.doc_id = d.doc_id group by d.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
