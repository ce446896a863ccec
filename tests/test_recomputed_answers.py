"""Gold answers of all seven types against answers recomputed from the lines."""

import oracle

from ledgerproof.operators.gold import QUESTION_TYPES
from ledgerproof.plans import gold
from ledgerproof.plans.registry import ORACLE, QUERIES

ROOT = "/root/testdata/sf0.001"


def test_wrong_entities_and_unmatched_rows_are_bad(spark):
    key = "question_type string, variant string, month string, field string, text string, num double"
    expected = [("t", "", m, f, x, n) for m in ("1995-01", "1995-02", "1995-03") for f, x, n in (("country", "A", None), ("net", None, 1.0))]
    given = [
        ("t", "", "1995-01", "country", "B", None), ("t", "", "1995-01", "net", None, 1.005),
        ("t", "", "1995-02", "country", "A", None), ("t", "", "1995-02", "net", None, None),
        ("t", "", "1900-01", "country", "A", None),
    ]
    got = gold.recomputed(spark.createDataFrame(given, key), spark.createDataFrame(expected, key))
    assert {r["field"]: (r["checked"], r["bad"]) for r in got.collect()} == {"country": (4, 3), "net": (3, 2)}


def test_all_types_and_seeded_wrong_answers(spark):
    assert oracle.compare(spark, ROOT, QUERIES["v10_recompute_all_types"], ORACLE["v10_recompute_all_types"]) is None
    rows = QUERIES["v10_recompute_all_types"](spark, ROOT).collect()
    for answers in ("published", "seeded"):
        assert {r["question_type"] for r in rows if r["answers"] == answers} == set(QUESTION_TYPES)
    assert not any(r["bad"] for r in rows if r["answers"] == "published")
    # Of so many questions in a row one at least is seeded; the small table has few comparisons.
    assert all(r["bad"] for r in rows if r["answers"] == "seeded" and r["checked"] >= 13)
