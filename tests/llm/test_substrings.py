"""Repeated passages against a brute-force version."""

import hashlib
import random
import re

from ledgerproof.llm import substrings as s


def brute(rows, n=50):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, ws in split:
        for k in range(len(ws) - n + 1):
            if i is not None:
                w = tuple(ws[k : k + n])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in split:
        gone = set()
        for k in range(len(ws) - n + 1):
            if i is not None and first[tuple(ws[k : k + n])] < i:
                gone.update(range(k, k + n))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return out


def order(row):
    return tuple((x is None, x) for x in row)


def made(seed):
    rng = random.Random(seed)
    some = lambda n, of=5000: " ".join(f"w{rng.randrange(of)}" for _ in range(n))
    shared = [some(n) for n in (49, 50, 51, 80, 300)] + ["same " * 90, "a b " * 60, some(200, 2)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, some(49)), (None, shared[4]), (None, None)]
    for i in range(5, 60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            piece = rng.choice(shared)
            parts.append(rng.choice([some(rng.randrange(120)), piece, piece, piece + " é", " ".join(piece.split()[rng.randrange(20) :])]))
        rows.append((i, rng.choice([" ", "\n", " \x0b\x0c\r\t "]).join(parts)))
    rows += [(70 + k, rows[20][1]) for k in range(25)] + [(71, some(60)), (72, rows[21][1]), (72, rows[21][1]), (4, rows[22][1] + " " + rows[22][1])]
    return rows


def test_against_brute_force(spark):
    for seed in range(3):
        rows = made(seed)
        docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string").repartition(4)
        got = [tuple(r) for r in s.without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept").collect()]
        assert sorted(got, key=order) == sorted(brute(rows), key=order)
    runs = s.repeated(docs)
    assert runs.count() > 0 and s.verify(docs, runs).count() == 0
    wrong = runs.withColumn("start", runs.start + 1).filter("windows = 1")
    assert s.verify(docs, wrong).count() > 0


def test_texts_of_many_segments(spark, monkeypatch):
    monkeypatch.setattr(s, "SEGMENT", 64)
    rng = random.Random(8)
    words = [f"w{rng.randrange(400)}" for _ in range(1000)]
    at = {}
    for base, seg in s._segments([w.encode() for w in words]):
        for k in range(len(seg.anchors)):
            at[base + k] = (int(seg.anchors[k]), int(seg.contents(s.np.array([k]), s.np.array([1]))[0]))
    assert sorted(at) == list(range(951))
    monkeypatch.setattr(s, "SEGMENT", 1 << 12)
    ((_, seg),) = s._segments([w.encode() for w in words])
    assert [int(a) for a in seg.anchors] == [at[k][0] for k in range(951)]
    assert [int(c) for c in seg.contents(s.np.arange(951), s.np.ones(951, int))] == [at[k][1] for k in range(951)]


def test_long_text(spark):
    text = " ".join(f"t{i}" for i in range(150_000))
    docs = spark.createDataFrame([(1, text), (2, "x " + text), (3, "tail " * 100)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in s.without_repeats(docs).collect()}
    assert got[1] == (150_000, 0, text) and got[2] == (150_001, 150_000, "x") and got[3][1] == 0


def test_query_and_no_rows(spark):
    root = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows)}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in s.op3_substring_dedup(spark, root).collect()}
    assert got == want and any(gone for _, gone, _ in got.values())
    assert s.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
