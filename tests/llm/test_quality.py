"""Nearest-neighbour voting: held-out accuracy and a brute-force version."""

import math
import zlib

import numpy as np
import pytest

from ledgerproof.llm import quality as q

ROOT = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in q.op10_quality(spark, ROOT).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    own = [i for i in labels if i in got and got[i]["held_out"]]
    assert sum(got[i]["predicted"] == labels[i] for i in own) / len(own) > 0.95


def test_scores_against_brute_force():
    texts = ["Good text here. And more.", "Fine words, too; they go on.", "BAD!! BAD!! BAD!!", "x*** y### z%%%", None, "", "A", "🙂🙂 ok\n\nok\nok"] * 4
    labels = [1, 1, 0, 0, 1, 0, 1, 1] * 4
    model = q.fit(texts, labels, 0.7)
    counts = q.term_counts(texts)
    vectors = model.vectors_of(counts)
    for t, got in zip(texts, model.scores(texts)):
        (v,) = model.vectors_of(q.term_counts([t]))
        votes = sorted(((float(np.dot(v, w)), y) for w, y in zip(vectors, labels)), reverse=True)[: q.NEIGHBOURS]
        weights = [max(0.0, c) ** 8 for c, _ in votes]
        if len({round(c, 4) for c, _ in votes}) == len(votes) or not t:
            want = (sum(w * y for w, (_, y) in zip(weights, votes)) + q.PRIOR_VOTES * 0.7) / (sum(weights) + q.PRIOR_VOTES)
            assert math.isclose(got, want, abs_tol=1e-4)
        if not t:
            assert math.isclose(got, 0.7)


def test_texts_of_one_shape_differ_by_their_words():
    import random

    rng = random.Random(1)
    good = "the river ran past old stone houses while children played near bridges".split()
    bad = "the casino pay for big poker rounds while gamblers jumped near jackpot".split()
    assert [len(a) == len(b) for a, b in zip(good, bad)].count(True) >= 6
    text = lambda words: " ".join(rng.choice(words) for _ in range(60))
    model = q.fit([text(good) for _ in range(150)] + [text(bad) for _ in range(150)], [1] * 150 + [0] * 150, 0.5)
    assert min(model.scores([text(good) for _ in range(30)])) > 0.9 and max(model.scores([text(bad) for _ in range(30)])) < 0.1


def test_term_counts():
    (row,) = q.term_counts(["aB a a\n\na."])
    want = {0: 4, 1: 1, 3: 2, 4: 2, q.TERMS: 1, q.TERMS + 1: 0, q.TERMS + 2: 0}
    assert all(math.isclose(row[k], math.log1p(n), rel_tol=1e-6) for k, n in want.items())


@pytest.mark.parametrize("labelled", [True, False])
def test_missing_empty_repeated_and_no_rows(spark, labelled):
    docs = spark.createDataFrame([(i % 50, t, "x") for i, t in enumerate([None, "", "Good one. Yes it is.", "BAD!! BAD!!", "long words here " * 9000] * 20)] + [(None, "no id", "y")], "doc_id long, text string, score string")
    known = [(i, int(i % 5 != 3), 0) for i in range(50)] + [(None, 1, 0), (3, None, 0), (2, 1, 0)] if labelled else []
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    kept = q.good_documents(docs, labels, docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert texts.count(None) == 20
    assert (texts.count("BAD!! BAD!!") == 0) == labelled and texts.count("Good one. Yes it is.") == 20
    assert q.good_documents(docs.limit(0), labels, docs.limit(0)).count() == 0
