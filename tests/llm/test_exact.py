"""Exact duplicates against a brute-force version and the check SQL."""

import hashlib
import random
import re

import duckdb
import oracle
import pytest

from ledgerproof.llm import exact

SCHEMA = "doc_id long, text string, norm string, salt int"


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        out.append((i, min(g)[3], len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    return out, len(groups)


def cases():
    rng = random.Random(3)
    rows = [(i, rng.choice(["a b", "ab", "a  b\n", "c d", "c d", None, "", " \t", "é🙂 x", "é 🙂x", "long " * 3000])) for i in range(300)]
    rows += [(None, "ab"), (None, "only"), (5, "a b"), (5, "a b"), (9, "\x0bnew\x0c\r")]
    rows += [(1000 + i, "hot text" + " " * (i % 3)) for i in range(900)]
    return rows


@pytest.mark.parametrize("hot", [False, True])
def test_against_brute_force(spark, hot):
    rows = [r for r in cases() if hot or not (r[1] or "").startswith("hot")]
    rows = rows if hot else rows[:12]
    docs = spark.createDataFrame([(*r, "n", 7) for r in rows], SCHEMA).repartition(5)
    got = exact.duplicates(docs).collect()
    want, groups = brute(rows)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == sorted(want, key=key)
    assert sum(r["kept"] for r in got) == groups
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    kept = exact.without_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == groups and {r["norm"] for r in kept.collect()} == {"n"}


def test_a_frequent_text_is_dealt_to_many_splits(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i}") for i in range(3000)], "doc_id long, text string")
    assert [r["salts"] >= 8 for r in exact.frequent_texts(docs, 8).collect()] == [True]
    local, names, split = exact._ranked(docs)
    assert split
    parts = local.filter("text = 'same'").selectExpr("spark_partition_id() as p").distinct().count()
    assert parts >= 3


def test_one_shuffle_and_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = exact.duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.duplicates(docs).collect() == [] and exact.without_duplicates(docs).collect() == []


def test_check_sql(spark):
    assert duckdb and oracle.compare(spark, "/root/testdata/sf0.001", exact.op5_exact_dedup, exact.OP5_SQL) is None
