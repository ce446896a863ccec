"""Naive Bayes language identification: held-out accuracy and a brute-force version."""

import collections
import math
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerproof.llm import language

ROOT = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    got = language.op2_language_id(spark, ROOT).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    own = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in own) / len(own) > 0.97


def test_posteriors_against_brute_force(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et la souris", "fr"), (3, "The end.", "en"), (4, "oui, la fin", "fr"), (5, "der Hund", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tests = ["the dog", "la fin du chat", "Hund", "a", "x1 \n y"]
    model = language.train(docs, F.lit(True)).value
    grams = collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        grams[lang].update(language.hashed(text).tolist())
    langs = sorted(grams)
    names, scores = model.predict(tests, [True] * len(tests))
    for text, name, score in zip(tests, names, scores):
        logs = []
        for lang in langs:
            n = sum(r[2] == lang for r in rows)
            total = sum(grams[lang].values()) + 0.5 * language.BUCKETS
            logs.append(math.log((n + 1) / (len(rows) + len(langs))) + sum(math.log((grams[lang][g] + 0.5) / total) for g in language.hashed(text).tolist()))
        best = max(logs)
        assert name == langs[logs.index(best)]
        assert math.isclose(score, 1 / sum(math.exp(x - best) for x in logs), rel_tol=1e-4)


def test_bounded_sample_is_enough(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    model = language.train(docs, F.lit(True), per_language=20)
    got = language.identified(docs, model, "p", "s")
    assert got.filter("p = lang").count() > 0.95 * docs.count()


@pytest.mark.parametrize("learn", [True, False])
def test_odd_rows(spark, learn):
    texts = [None, "", "123 !? \n", "🙂", "the words", "les mots é", "中文", "the " * 300_000]
    rows = [(k, t, "en" if k % 2 else None, "x") for k, t in enumerate(texts)] + [(None, "the words", None, "y"), (4, "the words", "fr", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = language.identified(docs, language.train(docs, F.lit(learn)), "lang_pred", "score")
    assert got.columns == [*docs.columns, "_lang_pred", "score"]
    for r in got.collect():
        lettered = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["_lang_pred"] == "und") == (not lettered or not learn)
        assert 0 <= r["score"] <= 1 and (r["_lang_pred"] != "und" or r["score"] == 0)
    assert language.identified(docs.limit(0), language.train(docs.limit(0), F.lit(True))).count() == 0


def test_blocks_of_languages_score_as_one_matrix(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(k * 3 + j, f"l{k:02d}", " ".join(letters[(k * 7 + i * i + j) % 26] * (1 + i % 3) for i in range(12))) for k in range(11) for j in range(3)]
    docs = spark.createDataFrame([*rows, (98, None, "12 3"), (99, None, None)], "doc_id long, lang string, text string")
    every = language.F.lit(True)
    one, blocks = (language.train(docs, every, block=n) for n in (400, 3))
    assert len(blocks) == 4
    a, b = ({r["doc_id"]: r for r in language.identified(docs, m).collect()} for m in (one, blocks))
    assert a.keys() == b.keys() and len(a) == 35
    for k, r in a.items():
        assert r["lang_pred"] == b[k]["lang_pred"] and abs(r["score"] - b[k]["score"]) < 1e-9


def test_more_languages_than_one_block(spark):
    n = language.MAX_LANGUAGES + 1
    docs = spark.createDataFrame([(k, f"l{k:03d}", "abc " * 3) for k in range(n)], "doc_id long, lang string, text string")
    got = language.identified(docs, language.train(docs, language.F.lit(True))).collect()
    assert len(got) == n and {r["lang_pred"] for r in got} == {"l000"}
