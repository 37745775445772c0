"""The lookup as one job: counts, refusals, and shown evidence against a plain walk through each request."""

from pyspark.sql import functions as F

from loomstone.operators import lookup, response
from loomstone.sources import readers

FIELDS = {"age": "age", "sex": "sex", "dose": "dose"}


def test_requests_are_answered_or_refused(spark):
    rows = [("s", i, (i * 5) % 8, (i * 7) % 50, f"finding {i % 9} of {i % 4} words {i}") for i in range(200)] + [("t", i, 4, i, "x") for i in range(1000, 1003)]
    evidence = spark.createDataFrame(rows, "situation string, id int, bits int, score int, text string")
    core = lookup.top_k(evidence.filter("bits != 1"), ["situation"], [F.desc("score"), F.col("id")], 15).drop("rank")
    asks = [
        # situation, axes, inputs, expanded, offset
        ("s", [], {}, False, None), ("s", ["sex", "age", "sex"], {}, False, 5.0), ("s", ["dose"], {}, True, 29.9), ("s", None, {"sex": "f", "age": " - ", "dose": "없음"}, True, 1e9), ("s", [], {"sex": "f"}, True, -3.0), ("s", ["weight"], {}, False, None),
        ("other", [], {}, False, None), (None, None, None, None, None), ("t", ["sex", "dose"], {}, False, None), ("t", ["dose"], {}, None, float("nan")), ("s", ["age", "sex", "dose"], {}, False, None), ("s", [None, "age"], {}, False, None),
    ]
    requests = spark.createDataFrame([(k, *a) for k, a in enumerate(asks)], "request_id int, situation string, axes array<string>, inputs map<string,string>, expanded boolean, offset double")
    answers = response.respond(requests, evidence, core, ("s", "t"), FIELDS)
    got = {r["request_id"]: r for r in answers.collect()}
    assert {k: r["error"] for k, r in got.items() if r["error"]} == {5: "unknown axis", 6: "unknown situation", 7: "unknown situation", 11: "unknown axis"}
    assert got[8]["applied_axes"] == ["dose"] and got[8]["unavailable_axes"] == ["sex"] and got[8]["trace"] == [3, 3]
    in_core = {(r["situation"], r["id"]) for r in core.collect()}
    shown = {}
    for r in response.shown_evidence(answers, evidence, core, "id", "score", "text").collect():
        shown.setdefault(r["request_id"], []).append((r["place"], r["id"], r["tier"]))
    pages = {}
    for k, (situation, axes, inputs, expanded, offset) in enumerate(asks):
        if got[k]["error"]:
            assert got[k]["applied_axes"] is None and k not in shown
            continue
        names = axes if axes is not None else [a for a, f in FIELDS.items() if (inputs or {}).get(f, "").strip() not in ("", "-", "없음")]
        own = [r for r in rows if r[0] == situation]
        bit = {a: 1 << n for n, a in enumerate(FIELDS)}
        applied = [a for a in FIELDS if a in names and any(r[2] & bit[a] for r in own if (situation, r[1]) in in_core)]
        assert got[k]["applied_axes"] == applied
        trace, pool = [sum((situation, r[1]) in in_core for r in own)], own
        for a in applied:
            pool = [r for r in pool if r[2] & bit[a]]
            trace.append(sum((situation, r[1]) in in_core for r in pool))
        assert got[k]["trace"] == trace and got[k]["extended_total"] == len(pool)
        seen = sorted(shown.get(k, []))
        assert [p for p, _, _ in seen] == list(range(1, len(seen) + 1)) and len({i for _, i, _ in seen}) == len(seen)
        assert {i for _, i, _ in seen} <= {r[1] for r in pool}
        if expanded:
            start = min(int(offset), (len(pool) - 1) // 30 * 30) if offset and offset > 0 else 0
            assert got[k]["page_offset"] == start and len(seen) == min(30, len(pool) - start) == got[k]["extended_shown"]
            pages[k] = seen
        else:
            kept = [r[1] for r in pool if (situation, r[1]) in in_core]
            assert {i for _, i, t in seen if t == 0} == set(kept) and [t for _, _, t in seen] == sorted(t for _, _, t in seen)
            assert len(seen) == (min(15, len(pool)) if applied else len(kept))
    assert pages[2] and pages[3] and pages[4]


def test_pages_of_one_query_make_the_whole_list(spark):
    rows = [("s", i, 1, i % 40, f"finding {i % 9} words {i}") for i in range(100)]
    evidence = spark.createDataFrame(rows, "situation string, id int, bits int, score int, text string")
    requests = spark.createDataFrame([(k, "s", ["age"], None, True, 30.0 * k) for k in range(5)], "request_id int, situation string, axes array<string>, inputs map<string,string>, expanded boolean, offset double")
    answers = response.respond(requests, evidence, evidence.limit(15), ("s",), {"age": "age"})
    shown = response.shown_evidence(answers, evidence, evidence.filter("id < 15"), "id", "score", "text").collect()
    by = {k: [r["id"] for r in shown if r["request_id"] == k] for k in range(5)}
    assert [len(by[k]) for k in range(5)] == [30, 30, 30, 10, 10] and set(by[3]) == set(by[4])
    assert sorted(i for k in range(4) for i in by[k]) == list(range(100))


def test_terms_of_wanted_articles(spark, tmp_path):
    article = lambda i, terms, other="": f'<PubmedArticle><MedlineCitation><PMID Version="1"> {i} </PMID>{terms}<CommentsCorrectionsList><CommentsCorrections><PMID>999</PMID></CommentsCorrections></CommentsCorrectionsList>{other}</MedlineCitation></PubmedArticle>\n'
    heading = lambda *names: "<MeshHeadingList>" + "".join(f'<MeshHeading><DescriptorName UI="D1">{n}</DescriptorName><QualifierName>q</QualifierName></MeshHeading>' for n in names) + "</MeshHeadingList>"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xml").write_text('<?xml version="1.0"?>\n<PubmedArticleSet>' + article(1, heading("One", " ", "Two &amp; a half ")) + article(2, "") + article(3, heading("Three")) + article("", heading("lost")) + "</PubmedArticleSet>")
    (tmp_path / "in/b.xml").write_text("<PubmedArticleSet>" + article(3, heading("later")) + article(4, heading("Four")) + article(2, heading("later")) + "</PubmedArticleSet>")
    terms = lambda wanted=None: {r["provider_id"]: r["terms"] for r in readers.read_terms(spark, f"{tmp_path}/in", wanted).collect()}
    assert terms() == {"1": "One;Two & a half", "2": "", "3": "Three", "4": "Four"}
    assert terms(spark.createDataFrame([("3",), ("4",), ("4",), ("77",)], "provider_id string")) == {"3": "Three", "4": "Four"}


def test_texts_are_read_for_shown_pages_only(spark, monkeypatch):
    """Of 600 records that a wide request meets, the pages that it is shown are put in order, not all twenty."""
    seen, whole = [], response.in_pages
    monkeypatch.setattr(response, "in_pages", lambda paged, *more: seen.append(paged) or whole(paged, *more))
    evidence = spark.range(600).selectExpr("'s' situation", "id", "1 bits", "id % 50 score", "concat('text number ', id) text")
    answers = spark.createDataFrame([(1, "s", True, None, 1, 45, 0, 30)], "request_id int, situation string, expanded boolean, error string, applied int, page_offset long, core_shown long, extended_shown long")
    shown = response.shown_evidence(answers, evidence, evidence.filter("id < 15"), "id", "score", "text").collect()
    assert sorted(r["place"] for r in shown) == list(range(1, 31))
    assert seen[0].count() == 60
