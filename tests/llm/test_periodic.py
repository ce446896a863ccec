"""Periodic runs against a brute-force version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerproof.llm import periodic


def brute_runs(words, least=6):
    """All runs by comparing each word with the one q places on, for every q."""
    n, out, held = len(words), [], {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= 4 * q and not any(s <= start and start + length <= e and q % p == 0 for p, runs in held.items() for s, e in runs):
                held.setdefault(q, []).append((start, start + length))
                if length >= least:
                    out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def made(rng):
    words = [str(rng.randrange(rng.choice([2, 3, 50]))) for _ in range(rng.randrange(1, 40))]
    for _ in range(rng.randrange(5)):
        root = [str(rng.randrange(rng.choice([1, 2, 3, 9]))) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 31, 33, 40]))]
        if rng.random() < 0.3:
            root = ["0"] * rng.randrange(1, 30) + root
        times = rng.choice([2, 3, 3.9, 4, 4.1, 5, 9])
        piece = (root * 10)[: int(len(root) * times)]
        at = rng.randrange(len(words) + 1)
        words[at:at] = piece
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        words = made(rng)
        names = {w: k for k, w in enumerate(dict.fromkeys(words))}
        found = periodic.find_runs(np.array([names[w] for w in words]), len(words))
        got = sorted(((s, e - s, q) for s, e, q in zip(*(x.tolist() for x in found)) if e - s >= 6), key=lambda r: (r[0], r[2]))
        assert got == brute_runs(words), words


def test_short_alphabets_in_full():
    for n in (6, 9, 12, 16):
        for bits in range(1 << n) if n < 13 else random.Random(1).sample(range(1 << n), 3000):
            words = [bits >> k & 1 for k in range(n)]
            found = periodic.find_runs(np.array(words), n)
            got = sorted(((s, e - s, q) for s, e, q in zip(*(x.tolist() for x in found)) if e - s >= 6), key=lambda r: (r[0], r[2]))
            assert got == brute_runs(words)


def texts():
    rng = random.Random(5)
    rows = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "é x " * 4, "x\x0by " * 3 + "x y"]
    rows += [rng.choice([" ", "\n", " \x0c\r "]).join(made(rng)) for _ in range(60)]
    return rows + [rows[20]] * 3


def test_documents(spark):
    rows = list(enumerate(texts())) + [(None, "b b b b b b"), (3, "b b b b b b")]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, runs string").repartition(3)
    found = periodic.with_runs(docs, names=("n_words", "found", "collapsed"))
    assert found.columns == ["doc_id", "text", "runs", "n_words", "found", "collapsed"]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["n_words"], [tuple(x) for x in r["found"]], r["collapsed"]) for r in found.collect())
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute_runs(words)
        want.append((i is None, i or 0, t or "", len(words), runs, collapsed(words, runs)))
    assert got == sorted(want)
    assert periodic.with_runs(docs.filter("doc_id < 0"), names=("n_words", "found", "collapsed")).collect() == []


def test_a_long_text(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    words[5_000:5_000] = words[100:9_000] * 5 + words[100:200]
    words += ["end"] * 200_000
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    (row,) = periodic.with_runs(docs).collect()
    assert [tuple(r) for r in row["runs"]] == [(5_000, 44_600, 8_900), (74_600, 200_000, 1)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_against_brute_force(spark):
    root = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{root}/documents.parquet").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if len(words) > 3000:
            continue  # too slow by brute force
        runs = brute_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        want[r["doc_id"]] = (len(runs), *best, runs and 1000 * best[1] // best[2] or None, digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)), digest(collapsed(words, runs)))
    got = {r[0]: tuple(r)[1:8] for r in periodic.op11_periodic_runs(spark, root).collect()}
    assert len(want) > 150 and {k: got[k] for k in want} == want
