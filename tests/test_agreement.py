"""Agreement of tables, two-sided differences, and audit rules."""

from pyspark.sql import functions as F

from ledgerproof.operators import quality, review


def test_disagreements_in_one_aggregation(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, None, 7), (3, None, 7), (5, "e", 1), (6, None, 2)], "id int, name string, size int")
    right = spark.createDataFrame([(1, "a", True), (2, "x", True), (4, "d", True), (5, None, False), (6, None, None)], "id int, name string, fine boolean")
    found = quality.disagreements({"left": left, "right": right}, "id", ["name", "size"], {"right": {"not_fine": F.col("fine")}})
    got = sorted(map(tuple, found.collect()))
    assert got == [(2, "name_differs"), (3, "missing_in_right"), (3, "repeated_in_left"), (4, "missing_in_left"), (5, "name_differs"), (5, "not_fine"), (6, "not_fine")]
    checks = {r["check_name"]: (r["passed"], r["detail"]) for r in quality.problem_checks(found, ["not_fine", "size_differs"]).collect()}
    assert checks == {"not_fine": (False, 2), "size_differs": (True, 0)}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_id_differences(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = quality.id_differences(ids("a", "b", "b", "c"), ids("b", "c", "c", "d"), "id")
    assert sorted(map(tuple, got.collect())) == [("a", "missing"), ("d", "extra")]


def test_lineage_and_split_rules(spark):
    spans = spark.createDataFrame(
        [("q1", "a1", "hallucinated_key_fact", "/in/main.parquet/part-1"), ("q1", "a2", "correct_key_fact", "/in/late/x"), ("q2", "a3", "correct_key_fact", None)],
        "question_id string, annotation_id string, label string, source_file string").withColumns(
        {"fact_type": F.lit("month"), "reference_fact_type": F.lit("month"), "span_text": F.lit("x"), "notes": F.lit("")})
    asked = spark.createDataFrame([("q1", "t", "dev"), ("q2", "t", "test"), ("q3", "t", "train")], "question_id string, question_type string, split string")
    flags = review.policy_flags(spans, asked, "/main.parquet", ["dev", "test", "held_back"]).filter("severity = 'failure'")
    assert sorted((r["question_id"], r["annotation_id"], r["rule"]) for r in flags.collect() if r["annotation_id"]) == [
        ("q1", "a2", "unexpected_source_file"), ("q2", "a3", "unexpected_source_file")]
    assert sorted(r["question_id"] for r in flags.collect() if not r["annotation_id"]) == ["held_back", "test"]
