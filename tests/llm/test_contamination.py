"""Benchmark passages against a brute-force version."""

import hashlib
import random
import re

import pytest

from ledgerproof.llm import contamination as c

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, n=10):
    ws, hit, who = plain_words(text), set(), set()
    for name, item in items:
        iw = plain_words(item)
        if not iw or name is None:
            continue
        size = min(n, len(iw))
        windows = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)}
        for i in range(len(ws) - size + 1):
            if tuple(ws[i : i + size]) in windows:
                hit.update(range(i, i + size))
                who.add(str(name))
    return len(ws), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()


def made(seed, n_items, n_docs, vocabulary):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, some(rng.choice([1, 2, 3, 5, 9, 10, 11, 14, 30]))) for k in range(n_items)] + [(900, None), (901, ""), (902, " ,"), (None, "aa"), (3, "dup id")]
    docs = [None, "", "...", "Aa, BB"]
    for _ in range(n_docs):
        t = some(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)[1] or ""
            a = rng.randrange(0, len(item) // 2 + 1)
            t += rng.choice([" ", "\n", ".. "]) + item[a : a + rng.randrange(10, 120)].upper() + " " + some(3)
        docs.append(t)
    return items, docs


@pytest.mark.parametrize("vocabulary", ["aa bb", "aa bb cc Dé ee3 f_f", " ".join(f"w{i}" for i in range(300))])
def test_against_brute_force(spark, vocabulary):
    items, docs = made(len(vocabulary), 25, 60, vocabulary.split())
    if len(vocabulary) < 9:
        items = [x for x in items if len(plain_words(x[1])) > 4]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, spans string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (c.SHARD_WORDS, 120):
        found, spans, names, n_words = c.matches(df, bench, limit=limit)
        assert spans == "_spans"
        for r in found.collect():
            hit = sum(b - a for a, b in zip(r[spans][::2], r[spans][1::2]))
            got = (r[n_words], hit, len(r[names]), hashlib.sha256(",".join(r[names]).encode()).hexdigest())
            assert got == brute(r["text"], items), (r["text"], r[spans])


def test_query_over_the_tables(spark):
    root = "/root/testdata/sf0.001"
    items = [tuple(r) for r in spark.read.parquet(f"{root}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    got = c.op6_decontamination(spark, root).collect()
    assert len(got) == len(texts)
    for r in got[::3]:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == brute(texts[r["doc_id"]], items)
        assert r["contaminated"] == (r["n_hit"] > 0)


def test_cut_and_drop(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before, {item.title()}! After it all is as it was, word for word for word for word for word and so on and on and on and on and on and on for long."), (2, item), (3, None), (4, "clean")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r["doc_id"]: r["text"] for r in c.decontaminated(df, bench, 0.5).collect()}
    assert out[1].startswith("Before, After it all") and set(out) == {1, 3, 4} and out[3] is None
    strict = c.decontaminated(df, bench, 0.0)
    assert strict.columns == df.columns and {r["doc_id"] for r in strict.collect()} == {3, 4}
    none = spark.createDataFrame([], "item_id long, text string")
    assert c.decontaminated(df, none, 0.0).count() == 4
    assert c.decontaminated(df.limit(0), bench, 0.0).count() == 0


def test_shards_keep_their_bound(spark):
    rng = random.Random(8)
    rows = [(k, "the same text of seven words here") for k in range(400)] + [(1000 + k, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 60)))) for k in range(300)]
    bench = spark.createDataFrame([*rows, (None, "no id"), (5000, None)], "item_id long, text string")
    items, n = c.dealt(bench, limit=1000)
    shards = {}
    for r in items.collect():
        shards.setdefault(r["shard"], []).append(len(plain_words(r["text"])) + len(r["names"]))
    assert sum(map(len, shards.values())) == len({t for _, t in rows}) and n == max(shards) + 1
    assert all(sum(x) <= 1000 + max(x) for x in shards.values()) and len(shards) > 5
    assert c.dealt(bench.limit(0))[1] == 1


def test_a_long_text_and_repeated_rows(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "x " * 200_000 + item + " y" * 100_000), (1, item), (1, item), (2, "w1 w2")], "doc_id long, text string")
    found, spans, names, n_words = c.matches(docs, spark.createDataFrame([(7, item)] * 3, "item_id long, text string"))
    assert sorted((r["doc_id"], r[n_words], list(r[spans]), r[names]) for r in found.collect()) == [
        (1, 12, [0, 12], ["7"]), (1, 12, [0, 12], ["7"]), (1, 300_012, [200_000, 200_012], ["7"]), (2, 2, [], [])]
