"""Rules over profiles: four outcomes, and results by request."""

import pytest
from pyspark.sql import functions as F

from loomstone.operators.rules import apply_rules, responses

ITEM = "request_id string, item_id int, ingredient_id string, profile string, amount double, unit string, scope string"
RULE = "rule_id string, ingredient_id string, severity string, priority int, applies_when string, threshold_operator string, threshold_value double, threshold_unit string, threshold_scope string"
RULES = [
    ("adult", "d", "high", 50, '{"age": {"min": 19}}', ">", 100.0, "mcg", "supplement"),
    ("drug", "d", "critical", 10, '{"drugs": ["warfarin", "heparin"]}', None, None, None, None),
    ("pregnant", "a", "critical", 90, '{"pregnancy": "yes", "sex": ["female"]}', ">=", 3000.0, "mcg", "supplement"),
    ("any", "a", "odd", 1, "{}", None, None, None, None),
    ("nothing said", "a", "low", 5, None, "<=", 10.0, "mcg", "supplement"),
]
CASES = [
    # profile, ingredient, amount, unit, scope -> outcomes by rule
    ("{}", "d", 125.0, "mcg", "supplement", {"adult": "needs_more_info", "drug": "needs_more_info"}),
    (None, "d", 125.0, "mcg", "supplement", {"adult": "needs_more_info", "drug": "needs_more_info"}),
    ('{"age": 32, "drugs": ["aspirin"]}', "d", 125.0, "mcg", "supplement", {"adult": "definitely_matched", "drug": "excluded"}),
    ('{"age": 12, "drugs": ["aspirin", "warfarin"]}', "d", 125.0, "mcg", "supplement", {"adult": "excluded", "drug": "definitely_matched"}),
    ('{"age": 12}', "d", None, None, None, {"adult": "excluded", "drug": "needs_more_info"}),
    ('{"age": 40, "drugs": "heparin"}', "d", 90.0, "mcg", "supplement", {"adult": "excluded", "drug": "definitely_matched"}),
    ('{"drugs": []}', "d", 90.0, "mcg", "supplement", {"adult": "excluded", "drug": "excluded"}),
    ('{"age": "unknown"}', "d", 125.0, "mcg", "supplement", {"adult": "needs_more_info", "drug": "needs_more_info"}),
    ('{"age": 40}', "d", 125.0, "iu", "supplement", {"adult": "needs_more_info", "drug": "needs_more_info"}),
    ('{"age": 40}', "d", 125.0, "mcg", "all", {"adult": "possibly_relevant", "drug": "needs_more_info"}),
    ('{"age": 19}', "d", 100.0, "mcg", None, {"adult": "excluded", "drug": "needs_more_info"}),
    ('{"pregnancy": "yes", "sex": "female"}', "a", 3000.0, "mcg", "supplement", {"pregnant": "definitely_matched", "any": "definitely_matched", "nothing said": "excluded"}),
    ('{"pregnancy": "yes"}', "a", 3500.0, "mcg", "supplement", {"pregnant": "needs_more_info", "any": "definitely_matched", "nothing said": "excluded"}),
    ('{"pregnancy": "no"}', "a", None, "mcg", "supplement", {"pregnant": "excluded", "any": "definitely_matched", "nothing said": "needs_more_info"}),
    ('{"age": 1}', "other", 1.0, "mcg", "supplement", {}),
]


@pytest.fixture(scope="module")
def applied(spark):
    items = [(f"r{k // 2}", k, i, p, a, u, s) for k, (p, i, a, u, s, _) in enumerate(CASES)]
    return apply_rules(spark.createDataFrame(items, ITEM), spark.createDataFrame(RULES, RULE))


def test_outcomes(applied):
    got = {k: {} for k in range(len(CASES))}
    for r in applied.collect():
        got[r["item_id"]][r["rule_id"]] = r["outcome"]
    assert got == {k: c[-1] for k, c in enumerate(CASES)}


def test_results_by_request_in_order_of_severity(applied):
    got = {r["request_id"]: (r["overall"], [(i["ingredient_id"], [(x["rule_id"], x["item_id"]) for x in i["results"]]) for i in r["ingredients"] or ()]) for r in responses(applied).collect()}
    assert got["r0"] == ("needs_more_info", [("d", [("drug", 0), ("drug", 1), ("adult", 0), ("adult", 1)])])
    assert got["r1"] == ("critical", [("d", [("drug", 3), ("adult", 2)])])
    assert got["r3"] == ("needs_more_info", [("d", [("drug", 7), ("adult", 7)])])
    assert got["r5"] == ("critical", [("a", [("pregnant", 11), ("any", 11)]), ("d", [("drug", 10)])])
    assert got["r6"] == ("odd", [("a", [("pregnant", 12), ("nothing said", 13), ("any", 12), ("any", 13)])])
    assert "r7" not in got
    assert responses(applied.filter(F.lit(False))).count() == 0
