"""SimHash near-duplicates against brute force."""

import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerproof.llm import simhash
from ledgerproof.llm.components import components


def plain_print(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_segments_bound_the_distance(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        a = rng.getrandbits(64) - (1 << 63)
        b = a
        for _ in range(rng.randrange(6)):
            b ^= (1 << rng.randrange(63))
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a long, b long")
    x, y = simhash.segment_counts(df.a), simhash.segment_counts(df.b)
    out = df.select("a", "b", x.alias("x"), simhash.manhattan(x, y).alias("m"), simhash.cells(x).alias("p"), simhash.cells(y).alias("q")).collect()
    for r in out:
        seg = lambda v: [bin(v >> 2 * s & 3).count("1") for s in range(32)]
        assert [r["x"] >> 2 * s & 3 for s in range(32)] == seg(r["a"])
        assert r["m"] == sum(abs(i - j) for i, j in zip(seg(r["a"]), seg(r["b"])))
        bits = bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1")
        assert r["m"] <= bits
        if bits <= 2:
            assert set(r["p"]) & set(r["q"])


@pytest.mark.parametrize("crowd", [2, 60])
def test_links_connect_what_brute_force_connects(spark, crowd):
    rng = random.Random(crowd)
    fps = {0, -1}
    for _ in range(40):
        centre = rng.getrandbits(64) - (1 << 63)
        for _ in range(rng.randrange(1, crowd)):
            fps.add(centre)
            for _ in range(rng.choice([1, 1, 2, 2, 3])):
                bit = rng.randrange(64)
                centre ^= -(1 << 63) if bit == 63 else 1 << bit
    fps = sorted(fps)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = dict.fromkeys(fps)
    got.update({r["node"]: r["root"] for r in components(simhash.links(df)).collect()})
    assert {f: (f if r is None else r) for f, r in got.items()} == roots(fps, near)


def test_components_of_long_chains_loops_and_missing_ends(spark):
    rng = random.Random(9)
    order = list(range(-200, 200))
    rng.shuffle(order)
    linked = [*zip(order[:300], order[1:300]), *zip(order[300:350], order[301:351]), (7, 7)]
    df = spark.createDataFrame([*linked, *linked[:5], *((b, a) for a, b in linked[:9]), (None, 4), (4, None)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    want = roots(order, linked)
    alone = {n for n in order if list(want.values()).count(want[n]) == 1}
    assert got == {n: r for n, r in want.items() if n not in alone}
    assert components(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\n\t🙂", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_print(text)


def test_documents_against_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta".split()) for _ in range(n)) for n in (1, 2, 3, 90, 400, 1500)]
    texts = [None, "", " \t", *base]
    for b in base:
        for _ in range(12):
            ws = b.split()
            ws[rng.randrange(len(ws))] = rng.choice(["x", "Yy"])
            texts.append(" ".join(ws).upper() if rng.random() < 0.3 else "  ".join(ws))
    rows = [(i * 7 % 101, t, "f") for i, t in enumerate(texts)]
    rows += [(None, base[3], "f"), (rows[5][0], "same id, other text", "f"), rows[4], (None, "all alone here", "f")]
    prints = [plain_print(t) for _, t, _ in rows]
    linked = [(a, b) for a in set(prints) for b in set(prints) if a < b and bin(a ^ b).count("1") <= 2]
    root = roots(set(prints), linked)
    least = {}
    for (i, _, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    want = sorted([(str(i), f"{p:016x}", str(least.get(root[p]))) for (i, _, _), p in zip(rows, prints)])
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {*least.values(), None}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_whole_table(spark):
    root = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: plain_print(r["text"]) for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in simhash.op9_simhash(spark, root).collect()}
    nodes = sorted(set(docs.values()))
    root_of = roots(nodes, [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if bin(a ^ b).count("1") <= 2])
    least = {}
    for d, p in docs.items():
        least[root_of[p]] = min(d, least.get(root_of[p], d))
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{p:016x}", least[root_of[p]]) for d, p in docs.items()}
