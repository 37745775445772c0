import random
import re

from pyspark.sql import functions as F

from loomstone.functions.sentences import sentences
from loomstone.functions.text import fnv1a, is_blank, near, normalize_doi, overlap_ratio, read_field, rotation_key, split_multi_value, toggle_value
from loomstone.operators import evidence, lookup, metrics
from loomstone.operators.screening import decide
from loomstone.sources import readers, writers


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


def test_sentences(spark):
    split_sentences = lambda t: one(spark, sentences(F.lit(t).cast("string")))
    assert split_sentences("Dose was 2.5 mg. It helped. e.g. this one! Done") == ["Dose was 2.5 mg.", "It helped.", "e.g. this one!", "Done"]
    assert split_sentences("See Fig. 2 for it. He said \"yes.\" Then left.") == ["See Fig. 2 for it.", "He said \"yes.\"", "Then left."]
    assert split_sentences(None) == [] and split_sentences("  ") == []


def test_text_functions(spark):
    assert one(spark, normalize_doi(F.lit(" https://doi.org/10.1/ABC.;"))) == "10.1/abc"
    h = 2166136261
    for c in "seed|7":
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    assert one(spark, fnv1a(F.lit("seed|7"))) == h
    assert one(spark, rotation_key("seed", F.lit(7))) == h / 2**32
    assert one(spark, split_multi_value(F.lit("a, b;a\n c ,"))) == ["a", "b", "c"]
    assert one(spark, toggle_value(F.array(F.lit("a"), F.lit("none")), "b", ("none",))) == ["a", "b"]
    assert one(spark, toggle_value(F.array(F.lit("a")), "none", ("none",))) == ["none"]
    assert one(spark, is_blank(F.lit(" 없음 "))) and one(spark, is_blank(F.lit(None).cast("string")))
    assert one(spark, read_field(F.lit("x" * 121))) == ""
    assert one(spark, overlap_ratio(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 1.0
    assert one(spark, near(F.array(F.lit(1), F.lit(50)), F.array(F.lit(45)), 5))


def test_screening_table(spark):
    long = "x" * 180
    off, thin = "off_topic", "insufficient_abstract"
    cases = [
        # p i o, what is absent, abstract -> decision confidence codes
        (1, 1, 1, "", "x", "retain", "high", "population exposure outcome"), (1, 1, 0, "", "x", "retain", "medium", "population exposure"), (1, 0, 0, "", "x", "uncertain", "low", f"population {thin}"),
        (0, 0, 0, "", "x", "uncertain", "low", thin), (1, 0, 0, "", long, "deprioritize", "high", f"population {off}"), (1, 1, 1, "o", "x", "deprioritize", "high", f"population exposure {off}"), (1, 1, 1, "pio", "x", "deprioritize", "high", off),
        (1, 1, 0, "", "", "retain", "low", f"population exposure {thin}"), (0, 1, 0, "", "", "uncertain", "low", f"exposure {thin}"), (0, 0, 0, "", "", "deprioritize", "low", f"{off} {thin}"),
        (1, 1, 1, "i", "", "deprioritize", "low", f"population outcome {off} {thin}"), (1, 1, 0, "", None, "retain", "low", f"population exposure {thin}"), (None, 1, 1, "", long, "retain", "medium", "exposure outcome"),
    ]
    rows = spark.createDataFrame(cases, "p int, i int, o int, neg string, abstract string, d string, c string, codes string")
    out = decide(rows, *(F.col(c) == 1 for c in "pio"), *(F.contains("neg", F.lit(c)) for c in "pio"), F.col("abstract")).withColumn("got", F.array_join("reason_codes", " "))
    assert out.filter("decision != d or confidence != c or got != codes").collect() == []


def test_diversify_pushes_repeats_back(spark):
    rows = spark.createDataFrame([("q", 1, 1, "alpha beta gamma delta"), ("q", 2, 2, "alpha beta gamma delta"), ("q", 3, 3, "omega sigma kappa lambda")], "g string, place0 int, id int, text string")
    got = [r.id for r in lookup.diversify(rows, "g", "place0", "id", "text").orderBy("place").collect()]
    assert got == [1, 3, 2]
    assert lookup.diversify(rows.filter("id < 3"), "g", "place0", "id", "text").orderBy("place").first().id == 1


def test_paging_offset(spark):
    at = lambda n, o: one(spark, lookup.page_bounds(F.lit(n), F.lit(o)))
    assert (at(100, 95.5), at(100, 45), at(100, -3), at(0, 10)) == (90, 45, 0, 0)


def test_metrics_guards(spark):
    rows = spark.createDataFrame([("a", 0, 0), ("a", 0, 0)], "g string, x int, y int")
    assert metrics.cohen_kappa(rows, ["g"], "x", "y").first().kappa is None
    got = metrics.rates(metrics.weighted_confusion(rows, ["g"], F.col("x") == 1, F.col("y") == 1, F.lit(1.0))).first()
    assert got.recall is None and got.specificity == 1.0 and got.f1 is None
    low, high = metrics.wilson(F.lit(0), F.lit(0))
    assert spark.range(1).select(low.alias("v")).first().v is None
    ci = metrics.stratified_bootstrap(spark.createDataFrame([("s", i % 4 != 0, 1.0) for i in range(200)], "s string, ok boolean, w double"), "s", F.col("ok"), F.col("w"), draws=300).first()
    assert ci.low < ci.point == 0.75 < ci.high and 0.65 < ci.low and ci.high < 0.85


def test_readers_and_writers(spark, tmp_path):
    row = {c: "" for c in readers.CORPUS_COLUMNS} | {"record_id": "pubmed:1", "question_id": "Q1", "abstract": 'two\nlines, "quoted"'}
    table = spark.createDataFrame([tuple(row.values())], readers.CORPUS)
    writers.write_csv(table, f"{tmp_path}/c", readers.CORPUS)
    assert readers.read_csv(spark, f"{tmp_path}/c").first().abstract == 'two\nlines, "quoted"'
    (tmp_path / "d.jsonl").write_text('{"record_id": "1", "question_id": "Q", "decision": "retain", "reason_codes": ["a"]}\n\n')
    assert readers.read_jsonl(spark, f"{tmp_path}/d.jsonl").count() == 1
    (tmp_path / "rounds").mkdir()
    (tmp_path / "rounds" / "round_007.json").write_text('{"round": 7, "judgments": [{"record_id": "1", "decision": "retain"}, {"record_id": "2", "decision": "uncertain"}]}')
    assert {(r.file_round, r.record_id) for r in readers.read_rounds(spark, f"{tmp_path}/rounds/*.json").collect()} == {(7, "1"), (7, "2")}
    files = readers.read_files(spark, f"{tmp_path}/rounds", "*.json")
    lines = writers.checksum_lines(files)
    lines.coalesce(1).write.text(f"{tmp_path}/sums")
    sums = readers.read_checksums(spark, f"{tmp_path}/sums")
    got = readers.ledger_differences(sums, files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "sha256")).first()
    assert (got.name, got.state) == ("round_007.json", "same")
    (tmp_path / "a.xml").write_text(
        '<?xml version="1.0"?><PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>9</PMID><Article><Journal><JournalIssue><PubDate><Year>2020</Year></PubDate></JournalIssue><Title>J</Title></Journal>'
        '<ArticleTitle>x <i>y</i> z</ArticleTitle><Abstract><AbstractText Label="AIM">a</AbstractText><AbstractText>b</AbstractText></Abstract></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>'
    )
    a = readers.read_articles(spark, f"{tmp_path}/a.xml").first()
    assert (a.provider_id, a.title, a.abstract, a.year, a.doi) == ("9", "x y z", "AIM: a\nb", "2020", "10.1/x")
    (tmp_path / "r.ris").write_text("TY  - JOUR\nTI  - One\nAU  - A\nAU  - B\nER  - \nTY  - JOUR\nTI  - Two\nER  - \n")
    assert sorted(r.tags["TI"][0] for r in readers.read_ris(spark, f"{tmp_path}/r.ris").collect()) == ["One", "Two"]
    slices = spark.sql("select date'2020-01-15' a, date'2020-03-10' b").select(F.inline(readers.date_slices(F.col("a"), F.col("b")))).collect()
    assert [(str(s.first), str(s.last)) for s in slices] == [("2020-01-15", "2020-01-31"), ("2020-02-01", "2020-02-29"), ("2020-03-01", "2020-03-10")]


def test_batches_and_violations(spark):
    rows = spark.range(10).select(F.lit("a").alias("g"), "id")
    sizes = [r["count"] for r in evidence.even_batches(rows, ["g"], ["id"], 4).groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [3, 3, 2, 2]
    bad = evidence.violations(rows, ["id"], {"small": F.col("id") < 8, "known": F.when(F.col("id") != 3, F.lit(True))})
    assert {(r.id, tuple(r.errors)) for r in bad.collect()} == {(3, ("known",)), (8, ("small",)), (9, ("small",))}
    assert evidence.reconcile(rows, rows.filter("id > 0")).count() == 1


def test_sentences_as_the_rules_have_them(spark):
    split_sentences = lambda t: one(spark, sentences(F.lit(t).cast("string")))
    assert split_sentences("They took vitamin C. The risk fell.") == ["They took vitamin C.", "The risk fell."]
    assert split_sentences("Dr. Kim reported 0.7 mg, e.g., in the first group. The result\n remained stable.") == ["Dr. Kim reported 0.7 mg, e.g., in the first group.", "The result remained stable."]
    assert split_sentences("Prof. Lee et al. agreed. In the U.S. too! (Really?) Yes") == ["Prof. Lee et al. agreed.", "In the U.S. too!", "(Really?)", "Yes"]


def sentences_one_by_one(text):
    """The same rules, walking from stop to stop."""
    text = re.sub("[\t\n\x0b\f\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+", " ", text).strip(" ")
    out, begin = [], 0
    for stop in re.finditer("[.?!][\"'’”)\\]}]*(?= |$)", text):
        upto = text[: stop.start() + 1]
        if upto.endswith(".") and (upto.lower().endswith(("dr.", "mr.", "mrs.", "ms.", "prof.", "fig.", "no.", "vs.", "et al.", "e.g.", "i.e.")) or re.search("(?:^| )(?:[A-Za-z][.]){2,}$", upto)):
            continue
        out.append(text[begin : stop.end()].strip(" "))
        begin = stop.end()
    return [p for p in (*out, text[begin:].strip(" ")) if p]


def test_sentences_equal_walking_from_stop_to_stop(spark):
    rng = random.Random(12)
    bits = ["Dr.", "terms.", "U.S.", "A.b.C.", "x.y.", "no.", "It fell.", "Why?!", "(so.)", "2.5 mg.", "’ok.’", "\u2003", "\n", "\xa0", "et al.", "Et AL.", "...", ". .", "end", "No. 5", "é.", "B.", "e.g.", "\u0001"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", sentences(F.col("t")).alias("s")).collect()
    for r in rows:
        assert r["s"] == sentences_one_by_one(texts[r["k"]].replace("\u0001", " ")), texts[r["k"]]


def test_keys_and_numbers(spark):
    from loomstone.functions.text import content_tokens, numbers_in

    assert one(spark, normalize_doi(F.lit("\t DOI: 10.1/A\n b.,"))) == "10.1/ab"
    assert one(spark, numbers_in(F.lit("1.2.3 and 1,000 and 7. 7"))) == ["1.2.3", "1000", "7"]
    assert one(spark, content_tokens(F.lit("Patients WITH results reduced after group therapy"))) == ["reduced", "therapy"]


def test_numbering_in_two_passes(spark):
    rows = spark.range(200).select((F.col("id") % 3).alias("g"), F.col("id").alias("k")).union(spark.createDataFrame([(None, 5), (None, 6)], "g long, k long"))
    got = evidence.numbered(rows, ["g"], ["k"], "i").collect()
    for g in (0, 1, 2, None):
        assert [r.i for r in sorted((r for r in got if r.g == g), key=lambda r: r.k)] == list(range(sum(r.g == g for r in got)))
    sample = evidence.stratified_sample(rows, ["g"], ["k"], "s", 3)
    assert {(r.g, r.population, r.census) for r in sample.collect()} == {(0, 67, False), (1, 67, False), (2, 66, False), (None, 2, True)}


def test_overlaps_against_brute_force(spark):
    import random

    rng = random.Random(1)
    sets = lambda n, most: [(i, rng.sample("abcdefghijklmnop", rng.randint(0, most))) for i in range(n)]
    few, many = sets(20, 6), sets(60, 12)
    got = {(r.a, r.b): r.shared for r in evidence.overlapping(spark.createDataFrame(few, "a long, tokens array<string>"), spark.createDataFrame(many, "b long, tokens array<string>"), "a", "b", 0.5).collect()}
    assert got == {(a, b): len(set(x) & set(y)) for a, x in few for b, y in many if x and y and len(set(x) & set(y)) >= 0.5 * min(len(x), len(y))}


def test_overlaps_write_shared_tokens_only_and_keep_rows_without_or_with_one_key(spark, monkeypatch):
    from collections import Counter

    written, write = [], evidence.materialized
    monkeypatch.setattr(evidence, "materialized", lambda df, name: written.append(write(df, name)) or written[-1])
    few = [(1, ["a", "b", "c", "d"]), (1, ["x"]), (None, ["b", "c"]), (2, [])]
    many = [(7, ["a", "b", "p", "q", "r"]), (7, ["x", "p"]), (None, ["c", "p", "q"]), (8, ["p", "q"]), (9, ["d"]), (10, ["a", "p", "q"]), (11, [])]
    frames = spark.createDataFrame(few, "a long, tokens array<string>"), spark.createDataFrame(many, "b long, tokens array<string>")
    for sent in (1_000_000, 0):
        monkeypatch.setattr(evidence, "SENT", sent, raising=False)
        got = Counter((r.a, r.b, r.shared) for r in evidence.overlapping(*frames, "a", "b", 0.5).collect())
        assert got == Counter((a, b, n) for a, x in few for b, y in many for n in [len(set(x) & set(y))] if x and y and n >= 0.5 * min(len(x), len(y)))
    tokens = {t for df in written for r in df.collect() for t in [*r.asDict().get("tokens", []), r.asDict().get("token")]}
    assert tokens - {None} == set("abcdx")  # those that only many has aren't written


def test_nonclinical_gate(spark):
    from loomstone.operators import clinical

    gate = lambda title, text: one(spark, clinical.nonclinical_gate(F.lit(title), F.lit(text)))
    assert gate("Calcium in mice", "We enrolled 40 patients") and gate("Nanoparticles", "") and gate("x", "HepG2 cells") and gate("x", "Rabbits of one kind were fed")
    assert gate("Patients with scaffolds", "") and not gate("Patients with stones", "mice were fed") and not gate("RAT in prenatal tests", "RAT was seen")
    assert not gate("Scaffolds in a clinical trial", "") and not gate("x", "We enrolled 40 patients; mice were fed") and not gate(None, None)


def test_query_lint(spark):
    from loomstone.operators import review

    terms = lambda c, tags: [f"{c}{k}{tags[k % len(tags)]}" for k in range(26)]
    p, i = terms("p", ["[Mesh]", "[tiab]"]), terms("i", ["[Mesh]", "[tiab]", "[tw]"])
    base = f"({' OR '.join(p)}) AND ({' OR '.join(i)})"
    dates = '("2000/01/01"[Date - Publication] : "2024/12/31"[Date - Publication])'
    rows = [
        ("good", p, i, f"{base} AND {dates}", [], [], []), ("limits", p, i, f"{base} AND {dates} AND Humans[Mesh] AND english[LANG]", [], [], []), ("design", p, i, f"{base} AND {dates} AND Cohort[ti]", [], [], []),
        ("few", p[:24], i, f"{base} AND (2000)", ["x"], [], ["Wildcard search"]), ("null", None, None, None, None, ["e"], None), ("bare", p, [*i, "bare"], base, [], ["e"], []),
    ]
    specs = spark.createDataFrame(rows, "k string, p_terms array<string>, i_terms array<string>, query string, not_found array<string>, errors array<string>, warnings array<string>")
    specs = specs.withColumn("first", F.lit("2000/01/01")).withColumn("last", F.lit("2024/12/31"))
    broken = {}
    for r in review.query_lint(specs, "k").collect():
        broken.setdefault(r.k, set()).update([] if r.kept else [r.rule])
    assert broken == {"good": set(), "limits": {2, 3, 4}, "design": {3}, "few": {1, 5, 6, 8, 9}, "null": {1, 5, 6, 8}, "bare": {1, 5, 6, 7}}


def test_bootstrap_of_metrics(spark):
    rows = [("a", k % 10 < 6, k % 10 < 5, 1.0) for k in range(400)] + [("b", k % 5 != 0, k % 4 != 0, 2.0) for k in range(200)] + [("b", None, True, 2.0)]
    rows = spark.createDataFrame(rows, "s string, x boolean, y boolean, w double")
    run = lambda census, some=rows: {r.metric: r for r in metrics.bootstrap_metrics(some, "s", F.col("x"), F.col("y"), F.col("w"), 0.4, census, 400).collect()}
    point = metrics.rates(metrics.weighted_confusion(rows.dropna(), [], F.col("x"), F.col("y"), F.col("w"))).first()
    free, half, whole = run(()), run(("a",)), run(("a", "b"))
    assert len(free) == 7
    for name in ("recall", "specificity", "precision", "f1", "agreement"):
        assert free[name].low < point[name] < free[name].high and abs(whole[name].low - point[name]) < 1e-12 and whole[name].low == whole[name].high
        assert half[name].high - half[name].low <= free[name].high - free[name].low + 0.02
    assert whole["scored_prevalence"].low == (240 + 2 * 160) / 800 and free["recall"].draws_used == 400
    assert set(run((), rows.filter("not x and not y"))) == {"specificity", "agreement", "scored_prevalence"}
    assert run((), rows.limit(0)) == {}


def test_pages_diverse_in_themselves(spark):
    import random

    rng, words = random.Random(3), ["alpha", "gamma", "delta", "omega", "kappa", "sigma", "theta", "lambda"]
    rows = [(g, k, k % 7, " ".join(rng.sample(words, 4))) for g, n in (("a", 23), ("b", 4), (None, 2)) for k in range(n)]
    frame = spark.createDataFrame(rows, "g string, k int, s int, t string")
    seed, page = "q", 5
    got = {}
    for r in lookup.diverse_pages(frame, "g", [F.desc("s"), F.asc("k")], seed, "k", "t", page).orderBy("page", "place").collect():
        got.setdefault(r.g, []).append(r.k)
    turn = {r.k: r.v for r in spark.range(30).select(F.col("id").alias("k"), rotation_key(seed, F.col("id").cast("int")).alias("v")).collect()}
    texts = {(g, k): set(t.split()) for g, k, _, t in rows}

    def diverse(g, ks):
        chosen, left = [], list(ks)
        while left and len(ks) > 2:
            worst = lambda k: max((len(texts[g, k] & texts[g, c]) / 4 for c in chosen), default=0)
            best = max(range(len(left)), key=lambda i: ((len(left) - i) / len(ks) - 2.5 * worst(left[i]), -i))
            chosen.append(left.pop(best))
        return chosen + left

    for g in ("a", "b", None):
        order = [k for _, k, _, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))]
        if len(order) > page:
            cut = [int(b * len(order) / page) for b in range(page)] + [len(order)]
            bands = [sorted(order[a:b], key=lambda k: (-turn[k], str(k))) for a, b in zip(cut, cut[1:])]
            pages = [[b[j] for b in bands if j < len(b)] for j in range(max(map(len, bands)))]
        else:
            pages = [order]
        assert got[g] == [k for p in pages for k in diverse(g, p)]


def test_nested_texts(spark):
    from loomstone.functions import nested

    bodies = {1: '[{"title": "validated", "note": ["invalidated", "EXCLUDE it"], "accuracy": {"title": "include"}}]', 2: None, 3: '"include"', 4: "7", 5: '{"a": {}, "b": [], "c": null}', 6: '{"source_text": {"include": ["include"]}, "x": [[["Accuracy"]]]}'}
    rows = spark.createDataFrame(list(bodies.items()), "id int, body string")
    find = lambda k, where: sorted(r["path"] for r in nested.claimed_terms(rows.filter(F.col("id") == k), "id", "body", nested.GENERATED_TERM, where).collect())
    rest = ["$[0].<generated_field>.title", "$[0].<generated_field>:name", "$[0].note[1]"]
    assert find(1, nested.VERBATIM["bundle"]) == rest and find(1, None) == find(1, nested.VERBATIM["rules"]) == [*rest, "$[0].title"]
    assert find(2, None) == find(4, None) == find(5, None) == [] and find(3, None) == ["$"]
    assert find(6, {"source_text": r"^\$$"}) == ["$.x[0][0][0]"]
    assert find(6, {"source_text": r"^nowhere$"}) == ["$.source_text.<generated_field>:name", "$.source_text.<generated_field>[0]", "$.x[0][0][0]"]
    texts = spark.createDataFrame([(1, '{"a": "x", "b": ["y", 3], "c": {"d": null, "e": 5}}'), (2, None), (3, "[]")], "id int, body string")
    assert sorted(r["text"] for r in nested.said(texts, "id", "body").collect()) == ["3", "5", "a", "b", "c", "d", "e", "x", "y"]
    flat = {tuple(s["name"] or s["place"] for s in r["steps"]): (r["kind"], r["text"]) for r in nested.flattened(texts.filter("id = 1"), "id", "body").collect()}
    assert flat[()] == ("object", None) and flat[("b", 1)][1] == "3" and flat[("c", "d")] == ("void", None) and len(flat) == 8


def test_indexing_terms(spark, tmp_path):
    article = lambda i, *terms: f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID><MeshHeadingList>{''.join(f'<MeshHeading><DescriptorName>{t}</DescriptorName></MeshHeading>' for t in terms)}</MeshHeadingList></MedlineCitation></PubmedArticle>"
    for name, items in (("a", [article(1, "Calcium", " ", "Aged "), article(2), article("")]), ("b", [article(1, "Other"), article(3, "Male")])):
        (tmp_path / f"{name}.xml").write_text(f"<Set>{''.join(items)}</Set>")
    assert {r.provider_id: r.terms for r in readers.read_terms(spark, f"{tmp_path}/*.xml").collect()} == {"1": "Calcium;Aged", "2": "", "3": "Male"}


def test_authors_and_ids(spark, tmp_path):
    author = "<AuthorList><Author><LastName>Kim</LastName><Initials>A</Initials></Author><Author><CollectiveName>Group</CollectiveName></Author><Author/></AuthorList>"
    (tmp_path / "x.xml").write_text(f"<S><PubmedArticle><PMID>4</PMID>{author}</PubmedArticle><PubmedArticle><PMID> </PMID></PubmedArticle><PubmedArticle><PMID>6</PMID></PubmedArticle></S>")
    found = readers.read_articles(spark, f"{tmp_path}/x.xml")
    assert {r.provider_id: r.authors for r in found.collect()} == {"4": "Kim A; Group", "6": ""}
    asked = spark.createDataFrame([("4",), ("5",)], "provider_id string")
    assert {(r.provider_id, r.state) for r in readers.id_differences(asked, found).collect()} == {("5", "missing"), ("6", "extra")}


def test_cited_referee(spark):
    from loomstone.operators import review

    rows = [
        ("fine", 0, " 3 of 1,200 ", ["a"], "x 3"), ("fine", 1, None, ["zz"], ""), ("fine", 2, "7 7.5", ["b", None], ""),
        ("wrong", 0, "9 and 7", ["a"], "7"), ("wrong", 1, "이 약을 드세요?", ["q", "a", "b", "r"], ""), ("wrong", 2, "당신은 " + "x" * 320, None, ""),
        ("many", 4, "e", [], ""), ("many", 3, "8", [], ""), ("many", 2, "c", [], ""), ("many", 1, "b", [], ""), ("many", 0, "a", [], ""), ("none", 0, "  ", ["q"], ""), (None, 0, "5", None, None),
    ]
    paragraphs = spark.createDataFrame(rows, "k string, place int, text string, ids array<string>, shared string")
    records = spark.createDataFrame([("a", "1200 people"), ("b", "7.5 and 7"), ("c", None)], "id string, text string")
    got = {r.k: r.rejections for r in review.cited_referee(paragraphs, records, "k").collect()}
    assert got["fine"] == [] and got["many"] == ["too_many_paragraphs", "unsupported_number:3:8"] and got["none"] == ["empty"] and got[None] == ["unsupported_number:0:5"]
    assert got["wrong"] == ["unsupported_number:0:9", "question:1", "direction:1:드세요|복용하세요|섭취하세요", "unknown_record:1:q", "too_many_refs:1:4", "too_long:2", "personal_claim:2:당신(?:의|에게|은|이)"]
    reason = lambda line: one(spark, review.line_reason(F.lit(line), F.lit("5 7")))
    assert (reason(" 5 of 7"), reason(None), reason("x" * 151), reason("왜？"), reason("8")) == (None, "empty", "too_long", "question", "unsupported_number:8")


def test_lock_receipt(spark):
    import pytest

    from loomstone.operators import review

    cards = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "id int, t string")
    labels = spark.createDataFrame([(k, "x") for k in (3, 1, 2)], "id int, label string")
    lock = review.lock_receipt(cards, labels, ["id"])
    review.check_receipt(lock)
    one_of, again = lock.first(), review.lock_receipt(cards.orderBy("t").repartition(3), labels.orderBy("id"), ["id"]).first()
    assert (one_of.scored_rows, one_of.labels_digest, one_of.cards_digest) == (3, again.labels_digest, again.cards_digest)
    changed = review.lock_receipt(cards, labels.withColumn("label", F.when(F.col("id") == 2, None).otherwise("x")), ["id"]).first()
    assert changed.labels_digest != one_of.labels_digest and changed.cards_digest == one_of.cards_digest
    for bad in (review.lock_receipt(cards, labels.filter("id > 1"), ["id"]), review.lock_receipt(cards.filter("id > 1"), labels, ["id"]), review.lock_receipt(cards, labels, ["id"], True), lock.limit(0)):
        with pytest.raises(ValueError):
            review.check_receipt(bad)


def test_publication_gate_and_foreground(spark):
    from loomstone.operators import clinical

    gate = lambda title, types, abstract: one(spark, clinical.publication_gate(F.lit(title), F.lit(types), F.lit(abstract)))
    assert gate("Erratum to: a study", "Journal Article", "") and gate("x", "Editorial", "x") and gate("x", "Comment", "x") and gate("Letter to the editor", "Letter", "x")
    assert not gate("x", "Comment", "METHODS: we enrolled 5") and not gate("A trial", "Letter", "x") and not gate(None, None, None)
    assert one(spark, clinical.foreground(F.lit("BACKGROUND: a\nMETHODS: b\nConclusion: c"))) == "b\nc"
    assert one(spark, clinical.foreground(F.lit("BACKGROUND: a"))) == "BACKGROUND: a" and one(spark, clinical.foreground(F.lit("plain"))) == "plain"


def test_what_is_refused(spark, tmp_path):
    base, over = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {(r.k, r.v, r.label_source) for r in evidence.overlay(base, over, ["k"], "v").collect()} == {(1, "a", "base"), (2, "c", "overlay")}
    for refused in (lambda: evidence.overlay(base, over, ["k"], "v", inside=True), lambda: writers.write_csv(base, f"{tmp_path}/../x", root=str(tmp_path)), lambda: writers.write_jsonl(base, "/elsewhere", root=str(tmp_path)), lambda: metrics.paired_labels(base, over, ["k"])):
        try:
            refused()
            raise AssertionError("not refused")
        except ValueError:
            pass
    evidence.overlay(base, over.filter("k = 2"), ["k"], "v", inside=True)
    writers.write_jsonl(base, f"{tmp_path}/in", root=str(tmp_path))
    assert spark.read.json(f"{tmp_path}/in").count() == 2


def test_blocks_of_a_layer_read_in_both_directions(spark):
    rows = spark.createDataFrame([("x", "retain", "retain", 2.0), ("x", "retain", "other", 1.0), ("x", "other", "retain", 1.0), ("y", "other", "other", 4.0)], "l string, s string, r string, w double")
    got = {r.layer: r for r in metrics.metric_blocks(rows, F.array(F.lit("all"), F.col("l"), F.col("l")), "s", "r", "retain", F.col("w")).collect()}
    assert (got["all"].tp, got["all"].fp, got["all"].fn, got["all"].tn, got["all"].n, got["all"].represented) == (2, 1, 1, 4, 4, 8)
    assert abs(got["all"].reverse_recall - 2 / 3) < 1e-12 and abs(got["all"].reverse_specificity - 0.8) < 1e-12 and got["all"].scorer_prevalence == 0.375 and got["all"].unweighted_agreement == 0.5
    assert got["y"].reverse_recall is None and got["y"].kappa is None and got["y"].n == 1 and got["x"].n == 3
