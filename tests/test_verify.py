"""Verification reports and approximate names against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomstone.operators import verify
from loomstone.operators.aliases import within_edits


def test_each_planted_fault_is_found_once(spark):
    rebuilt = spark.range(1, 101).select(F.concat(F.lit("q"), F.col("id") % 3).alias("q"), "id", F.when(F.col("id") % 7 != 0, F.col("id") * 2).alias("v"))
    stored = rebuilt.filter("id != 5").withColumn("v", F.when(F.col("id") == 6, -1).when(F.col("id") == 14, 0).when(F.col("id") == 8, None).otherwise(F.col("v")))
    stored = stored.unionByName(rebuilt.filter("id = 9")).unionByName(rebuilt.filter("id = 10").withColumn("id", F.lit(999)))
    found = [verify.rebuild_violations("core", stored, rebuilt, ["q", "id"]), verify.row_violations("core", stored, ["id"], {"small": F.col("id") < 500, "positive": F.col("v") > 0})]
    got = {r["rule"]: (r["n"], r["keys"]) for r in verify.report(spark, found, ["core: missing", "hash: wrong"], 2).collect()}
    assert got == {
        "core: missing": (1, ["q2|5"]), "core: differs": (3, ["q0|6", "q2|14"]), "core: repeated": (1, ["q0|9"]), "core: unexpected": (1, ["q1|999"]), "core: small": (1, ["999"]), "core: positive": (16, ["14", "21"]), "hash: wrong": (0, []),
    }
    with pytest.raises(ValueError, match="core: missing: 1"):
        verify.require(verify.report(spark, found))
    fine = verify.report(spark, [verify.rebuild_violations("core", rebuilt, rebuilt, ["q", "id"])], ["core: missing"])
    verify.require(fine)
    assert [tuple(r) for r in fine.collect()] == [("core: missing", 0, [])]
    assert verify.report(spark, []).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_names_within_edits_equal_brute_force(spark, most):
    rng = random.Random(9)
    word = lambda alphabet, least, longest: "".join(rng.choice(alphabet) for _ in range(rng.randint(least, longest)))
    names = ["", "a", "aaaa", "aaaaaaaaaa", "aaaaaaaaab", "vitamin d3", "vitamín d", *(word("ab", 0, 6) for _ in range(60)), *(word("abc", 4, 9) for _ in range(60)), *(word("abcdefgh", 8, 14) for _ in range(40))]
    edited = names[:7] + [(n[: len(n) // 2] + rng.choice(["", "x", "ab"]) + n[len(n) // 2 + rng.randint(0, 1) :]) for n in names]
    left = spark.createDataFrame([(n,) for n in [*names, None]], "name string")
    right = spark.createDataFrame([(n,) for n in [*edited, None]], "alias string")
    got = [tuple(r) for r in within_edits(left, right, "name", "alias", most).collect()]
    want = {(a, b, d) for a, b in itertools.product(set(names), set(edited)) if (d := distance(a, b)) <= most}
    assert len(got) == len(set(got)) and set(got) == want
