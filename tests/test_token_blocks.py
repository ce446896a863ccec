"""Tokens in blocks of their documents against the token table, and the shuffle that they save."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerproof.operators import spans
from ledgerproof.plans.registry import QUERIES


def documents(rng):
    docs = {f"d{n}": [rng.choice(["�", "�", " �", "ab", "<|x|>", "é�", "<|y|>�", "word"]) for _ in range(rng.randint(1, 90))] for n in range(40)}
    return docs | {"run": ["a�"] + ["�"] * 80 + ["b"], "lone": ["�"] * 41, "wide": ["x" * 700, " ", "y" * 5000, "z"], "none": []}


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_blocks_place_tokens_like_the_token_table(spark, size):
    docs = documents(random.Random(size))
    held = spark.createDataFrame([(q, "en", t) for q, t in docs.items()], "qid string, lang string, pieces array<string>")
    columns = ["qid", "position", "token_text", "display_text", "is_special_token", "aligned_text", "char_start", "char_end"]
    rows = held.select("qid", F.posexplode("pieces").alias("position", "token_text")).withColumn("position", F.col("position").cast("long"))
    want = sorted(map(tuple, spans.placed_tokens(rows).select(*columns).collect()))
    assert sorted(map(tuple, spans.unpacked_tokens(spans.token_blocks(held, size=size)).select(*columns).collect())) == want
    answers = spark.createDataFrame([(q, "".join(r[5] for r in want if r[0] == q)) for q in docs], "qid string, generated_text string")
    checked = {r["qid"]: r["text_matches"] and r["length_matches"] for r in spans.rebuilt_from_blocks(spans.token_blocks(held, size=size), answers).collect()}
    assert checked == {q: q != "none" for q in docs}


@pytest.mark.parametrize("width", [3, 64, 2048])
def test_block_overlaps_match_overlap_join(spark, width):
    rng = random.Random(width)
    docs = documents(rng)
    held = spark.createDataFrame([(q, "en", t) for q, t in docs.items()], "qid string, lang string, pieces array<string>")
    blocked = spans.token_blocks(held, {"token_length": F.transform("pieces", F.length)}, size=5)
    notes = [(f"{q}-{i}", q, s, s + rng.choice([0, 1, 9, 600])) for q in docs for i, s in enumerate(rng.sample(range(200), 8))]
    left = spark.createDataFrame(notes, "annotation_id string, qid string, span_start_char long, span_end_char long")
    columns = ["annotation_id", "position", "token_length", "char_start", "char_end"]
    right = spans.unpacked_tokens(spans.token_blocks(held)).withColumn("token_length", F.length("token_text"))
    want = sorted(map(tuple, spans.overlap_join(left, right).select(*columns).collect()))
    got = spans.block_overlap_join(left, blocked, ["lang"], ["token_length"], width=width).select(*columns).collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("name", ["w10_token_offsets", "w11_byte_pair_repair", "v15_contiguous_positions", "j03_interval_overlap"])
def test_tokens_cross_no_shuffle_as_rows(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    before = plan.split("== Initial Plan ==")[-1]
    assert "Window" not in before and "token_text" not in before.split("Exchange")[0]


@pytest.mark.parametrize("positions, want", [([0, 1, 2], True), ([3, 4, 4, 5], True), ([0, 2], False), ([7], True)])
def test_contiguous(spark, positions, want):
    df = spark.createDataFrame([(positions,)], "p array<long>")
    assert df.select(spans.contiguous(F.col("p"))).first()[0] is want


@pytest.mark.parametrize("name", [
    "w10_token_offsets", "v14_tokens_rebuild_text", "j03_interval_overlap", "a17_span_features", "p08_derived_scores", "p13_all_or_nothing_group"])
def test_jobs_that_read_documents_once_store_no_tokens(spark, name, monkeypatch):
    from ledgerproof import session

    stored = []
    path = session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda *a: stored.append(a) or path(*a))
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not stored


def test_sums_of_items_are_no_lambda(spark):
    held = spark.createDataFrame([("d", "en", ["ab"] * 40)], "qid string, lang string, pieces array<string>")
    blocked = spans.token_blocks(held, size=16)
    assert [r[0] for r in blocked.select("edges").collect()] == [list(range(0, 33, 2)), list(range(32, 65, 2)), list(range(64, 81, 2))]
    plan = blocked.select("edges")._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan.split("Generate explode(array(")[0]


def test_ends_of_blocks_cross_no_shuffle_beside_the_edges(spark):
    held = spark.createDataFrame([("d", "en", ["ab"] * 40)], "qid string, lang string, pieces array<string>")
    left = spark.createDataFrame([("n", "d", 0, 5)], "annotation_id string, qid string, span_start_char long, span_end_char long")
    plan = spans.block_overlap_join(left, spans.token_blocks(held)).drop("qid")._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("Join Inner")[1].split("Generate explode(array(")[0]
    assert "_from" not in top and "_to#" not in top


def test_scores_are_summed_as_whole_numbers(spark):
    plan = QUERIES["a17_span_features"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "decimal" not in plan.lower()


def test_features_of_units_match_those_of_decimals(spark):
    from ledgerproof.plans.spans import UNITS, score_rows, score_units

    rng = random.Random(2)
    rows = [(f"a{rng.randrange(60)}", rng.choice(["fr", "en", None]), p, rng.choice([1, 7, 13, 100000])) for p in range(1500)]
    held = spark.createDataFrame(rows, "annotation_id string, lang string, position long, n int").selectExpr("*", "position AS char_start", "position + n AS char_end")
    want = spans.span_features(score_rows(held, "n")).collect()
    assert sorted(map(str, spans.span_features(score_units(held, "n"), units=UNITS).collect())) == sorted(map(str, want))


@pytest.mark.parametrize("scale", [0, 1, 6, 9])
def test_means_of_units_are_rounded_once(spark, scale):
    from fractions import Fraction

    from ledgerproof.functions import numbers

    rng = random.Random(scale)
    rows = [(g, rng.choice([rng.randrange(-9, 10), rng.randrange(-(10**9), 10**9), None])) for g in range(200) for _ in range(rng.choice([1, 2, 3, 8]))]
    got = spark.createDataFrame(rows, "g int, v long").groupBy("g").agg(numbers.exact_mean_of_units(F.col("v"), scale).alias("m")).collect()
    for g, m in got:
        held = [v for k, v in rows if k == g and v is not None]
        mean = Fraction(sum(held), len(held) * 10**scale) if held else None
        size = None if mean is None else (abs(mean) * 10**6 * 2 + 1) // 2
        assert m == (None if mean is None else (size if mean >= 0 else -size) / 10**6)


def test_lengths_cross_the_shuffle_only_where_they_are_no_widths(spark):
    texts = ["ab"] * 16 + ["c�", "�"] + ["ab"] * 14 + ["d"] * 15 + ["<|im_end|>"]
    held = spark.createDataFrame([("d", "en", texts)], "qid string, lang string, pieces array<string>")
    got = [r[0] for r in spans.token_blocks(held, lengths="n").orderBy("first").select("n").collect()]
    assert got == [None, [2, 1] + [2] * 14, [1] * 15 + [10]]
