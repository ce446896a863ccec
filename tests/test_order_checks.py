"""Neighbours, sorted stretches and the order checks of prompts."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerproof.operators import ordering, prompts


@pytest.mark.parametrize("chunk", [1, 3, 8, 4096])
def test_sorted_stretches_over_chunks(spark, chunk):
    rng = random.Random(chunk)
    groups = {g: [rng.choice([None, 1, 2, 3, 4]) for _ in range(rng.randrange(1, 60))] for g in "abcdefgh"}
    groups["one"], groups["up"] = [7], list(range(50))
    gap = {g: rng.randrange(2, 30) for g in groups}
    rows = [(g, i * gap[g], v) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, p long, v int").repartition(4)
    for down in (False, True):
        want = {}
        for g, vs in groups.items():
            runs = [1]
            for a, b in zip(vs, vs[1:]):
                bad = a is not None and b is not None and (b > a if down else b < a)
                runs.append(1) if bad else runs.__setitem__(-1, runs[-1] + 1)
            want[g] = (len(vs), len(runs) - 1, max(runs))
        got = {r["g"]: (r["rows"], r["breaks"], r["longest_run"]) for r in ordering.sorted_stretches(df, ["g"], "p", "v", down, chunk).collect()}
        assert got == want
    paired = ordering.with_previous(df, ["g"], "p", ["v"], chunk=chunk)
    got = {(r["g"], r["p"]): r["previous"] and (r["previous"]["p"], r["previous"]["v"]) for r in paired.collect()}
    assert got == {(g, i * gap[g]): (None if not i else ((i - 1) * gap[g], vs[i - 1])) for g, vs in groups.items() for i in range(len(vs))}


ROW = "array<struct<stock_code string, description string, country string, year_month string, net_revenue decimal(18,2)>>"


def prompt(spark, rows, policy, name="p1", question="q1"):
    return spark.createDataFrame([(name, question, policy, rows)], f"prompt_id string, question_id string, row_order_policy string, prompt_evidence_rows {ROW}")


def test_order_report_by_policy(spark):
    from decimal import Decimal as D

    row = lambda c, v: (c, c, c, f"2020-{int(v):02d}", D(v))
    rows = [row(c, v) for c, v in zip("abcdefg", (5, 3, 7, 1, 6, 2, 4))]
    hashed = prompts.POLICIES["hash_order"]
    made = prompt(spark, rows, hashed)
    kept = made.withColumn("prompt_evidence_rows", prompts.ordered_evidence(F.col("prompt_evidence_rows"), F.col("row_order_policy"), F.col("question_id")))
    wrong = kept.withColumns({"prompt_id": F.lit("p2"), "prompt_evidence_rows": F.reverse("prompt_evidence_rows")})
    control = made.withColumns({"prompt_id": F.lit("p3"), "row_order_policy": F.lit(prompts.CONTROL_POLICY), "prompt_evidence_rows": prompts.metric_descending(F.col("prompt_evidence_rows"))})
    leak = control.withColumns({"prompt_id": F.lit("p4"), "row_order_policy": F.lit(hashed)})
    report = prompts.order_report(kept.unionByName(wrong).unionByName(control).unionByName(leak))
    got = {r["prompt_id"]: (r["rows"], r["policy_breaks"]) for r in report.collect()}
    assert got["p1"] == (7, 0) and got["p2"] == (7, 6) and got["p3"] == (7, 0) and got["p4"][1] > 0
    assert [r["prompt_id"] for r in prompts.order_leaks(report).collect()] == ["p4"]
    checks = {r["check_name"]: r["detail"] for r in prompts.policy_checks(report).collect()}
    assert checks["hash_order"] == 6 + got["p4"][1] and checks["control_falls_by_metric"] == 0
