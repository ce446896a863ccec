"""Base patterns against plain regular expressions, messages against enumeration, added spans."""

import hashlib
import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerproof.llm import personal as p

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            odd = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
            if {
                "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and odd % 10 == 0, "phone": 9 <= len(digits) <= 15,
            }[kind]:
                out.append((k, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "a.b-", "@", ".", "c.d", "1", "22", "255.1.2.3", ".256", "0004", "4111111111111111", "4111 1111 1111 1111", " ", "-", "+", "+1 (375) 555-4393", "(", "é", "x", "\n"]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    assert p.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000 + "@", "1" * 300_000, "1." * 200_000, "+1" + "(" * 300_000, "a@" * 100_000, "1 " * 200_000, "+1 " * 100_000):
        assert p.base_spans(text) == plain(text[:50]) or p.base_spans(text) is not None
        p.all_spans("a@b.cc " + text, p.fit([]))


def test_many_mentions_take_linear_time():
    import time

    took = []
    for n in (50_000, 200_000):
        text = " and ".join(str(10**9 + 7919 * k) for k in range(n)) + " a@b.cc"
        started = time.perf_counter()
        m = p.mentions(text, p.base_spans(text))
        took.append(time.perf_counter() - started)
        assert len(m.spans) == n + 1
    assert took[1] < 12 * took[0] + 1 and took[1] < 30


def test_fit_from_counts_is_the_fit_of_documents():
    texts = ["Call +1 (375) 555-4393, later 375-555-4393", "a@b.cc and 10.1.2.3 or 20241107", "Card 4111 1111 1111 1111 4111.1111.1111.1111", "no 1234567890"]
    found = [p.mentions(t, p.base_spans(t)) for t in texts]
    apart = p.tally([])
    for m in found * 3:
        for key, n in p.tally([m]).items():
            apart[key] = apart.get(key, 0) + n
    one, other = p.fit(found * 3), p.fit_counts(apart)
    assert np.allclose(one.unary, other.unary) and np.allclose(one.chain, other.chain) and one.skip == other.skip


def test_beliefs_on_small_loops_are_near_enumeration():
    """Three labels of a loop of chain and skip edges: beliefs lean to the labels that enumeration does."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        field = p.Field(rng.normal(size=(p.FEATURES, p.LABELS)), rng.normal(size=(p.LABELS, p.LABELS)) / 4, 1.0)
        m = p.Mentions([(k, k + 1) for k in range(4)], [0, 0, 2, 0], rng.normal(size=(4, p.FEATURES)) / 3, [0, 1, 0, 1])
        unary, want = m.features @ field.unary, np.zeros((4, p.LABELS))
        for y in itertools.product(range(p.LABELS), repeat=4):
            if y[2] != 2:
                continue
            score = sum(unary[k, y[k]] for k in (0, 1, 3)) + sum(field.chain[y[k], y[k + 1]] for k in range(3))
            hubs = sum(np.exp(field.skip * (y[0] == g) + field.skip * (y[2] == g)) for g in range(p.LABELS)) * sum(np.exp(field.skip * (y[1] == g) + field.skip * (y[3] == g)) for g in range(p.LABELS))
            want[range(4), y] += np.exp(score) * hubs
        want /= want.sum(axis=1, keepdims=True)
        assert np.abs(field.marginals(m) - want).max() < 0.12


def test_missing_ids_and_clashing_names(spark):
    rows = [(None, "a@b.cc", "x", 1), (1, None, "y", 2), (1, None, "y", 2), (2, "", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, kind int")
    got = p.found(docs, p.train(docs))
    assert got.columns == ["doc_id", "text", "base", "kind", "_base", "spans"] and got.count() == 4
    assert [len(r["_base"]) for r in got.collect() if r["doc_id"] is None] == [1]


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(2)
    field = p.Field(rng.normal(size=(p.FEATURES, p.LABELS)), np.zeros((p.LABELS, p.LABELS)), 1.5)
    m = p.Mentions([(k, k + 1) for k in range(5)], [0, 3, 0, 0, 0], rng.normal(size=(5, p.FEATURES)) / 3, [0, 0, 1, -1, 0])
    unary = m.features @ field.unary
    want = np.zeros((5, p.LABELS))
    for y in itertools.product(range(p.LABELS), repeat=5):
        if y[1] != 3:
            continue
        for hubs in itertools.product(range(p.LABELS), repeat=2):
            skip = sum(field.skip for k, g in enumerate(m.group) if g >= 0 and hubs[g] == y[k])
            want[range(5), y] += np.exp(sum(unary[k, y[k]] for k in range(5) if k != 1) + skip)
    assert np.allclose(field.marginals(m), want / want.sum(axis=1, keepdims=True), atol=1e-3)


def test_similar_mentions_get_the_label_of_a_base_span(spark):
    texts = [
        "Call +1 (375) 555-4393 now. Later: 375-555-4393, and order 20241107 of 12.50.",
        "Mail jo.doe7@mail.example.com or jo.doe7 [at] mail.example.com today, not ann (at) other.org",
        "Card 4111 1111 1111 1111, again 4111.1111.1111.1111 and 1234567812345678",
        "Host 10.20.30.244 is 10-20-30-244 there",
        "No base span: 375-555-4393 and 1234 5678 9012",
        None, "", "plain words 12 only",
    ]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] * 2, "doc_id long, text string, spans string")
    got = p.found(docs, p.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")), spans="spans")
    assert got.columns == ["doc_id", "text", "spans", "base", "_spans"] and got.count() == 2 * len(texts)
    added = {r["doc_id"]: {(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["_spans"] if s not in r["base"]} for r in got.collect()}
    assert added[0] == {("phone", "375-555-4393")}
    assert added[1] == {("email", "jo.doe7 [at] mail.example.com")}
    assert added[2] == {("card", "4111.1111.1111.1111")}
    assert added[3] == {("ip", "10-20-30-244")}
    assert not any(added[k] for k in range(4, 8))



def test_prefilters_keep_no_mention_from_the_field(spark):
    field = p.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).value
    for text, want in {
        "Mail bob@example.com now, later bob @ example.com": {("email", "bob @ example.com")},
        "Mail bob@example.com. Later bob @ example.com. Thanks": {("email", "bob @ example.com")},
        "Host 10.0.0.1 is 10-0-0-1 there": {("ip", "10-0-0-1")},
        "Call +1 (375) 555-4393 or locally 555-4393": {("phone", "555-4393")},
        "Version 2.0.2.4 of 2024": set(),
        "No base span: +1 375/555/4393": {("phone", "+1 375/555/4393")},
    }.items():
        base, spans = p.all_spans(text, field)
        assert {(p.KINDS[k], text[a:b]) for k, a, b in spans if (k, a, b) not in base} == want, text


def test_query_over_the_table(spark):
    root = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    got = p.op4_personal_data(spark, root).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r["doc_id"]])
        told = [f"{p.KINDS[k]}:{a}:{b}" for k, a, b in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in p.KINDS] == [sum(w[0] == i for w in want) for i in range(4)]
        assert set(told) <= set(filter(None, r["spans"].split(",")))


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert p.found(docs, p.train(docs)).count() == 0
