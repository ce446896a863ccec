"""Near-duplicate lines against a brute-force version."""

import random

import numpy as np
from test_simhash import roots

from ledgerproof.llm import fuzzy_lines as f
from ledgerproof.session import durable


def similarity(a, b):
    x, y = ({s[i : i + f.SHINGLE] for i in range(max(1, len(s) - f.SHINGLE + 1))} for s in (a, b))
    return len(x & y) / len(x | y)


def brute(rows):
    """The lines that go, by document."""
    own = [(i, k, f.normal(line)) for i, t in rows if i is not None for k, line in enumerate((t or "").split("\n")) if f.normal(line)]
    forms = sorted({s for _, _, s in own})
    near = [(a, b) for i, a in enumerate(forms) for b in forms[:i] if min(len(a), len(b)) > 0.6 * max(len(a), len(b)) and similarity(a, b) >= 0.8]
    root = roots(forms, near)
    first = {}
    for i, k, s in own:
        first[root[s]] = min(first.get(root[s], (i, k)), (i, k))
    gone = {i: [] for i, _ in rows}
    for i, k, s in own:
        if first[root[s]] != (i, k):
            gone[i].append(k)
    return {i: sorted(v) for i, v in gone.items()}


def made():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioubcdrst") for _ in range(rng.randrange(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))

    def edited(s):
        ws = s.split()
        for _ in range(rng.randrange(1, 3)):
            ws[rng.randrange(len(ws))] = word()
        return " ".join(ws)

    base = [line(n) for n in (1, 2, 4, 9, 20, 40, 60, 60)]
    chain = [base[5]]
    for _ in range(25):
        chain.append(edited(chain[-1]))
    rows = [(0, None), (1, ""), (2, "\n \n\t\n"), (None, base[6]), (3, "a\nA\n b\nab")]
    for i in range(4, 80):
        rows.append((i, "\n".join(rng.choice([line(rng.randrange(1, 30)), rng.choice(base).upper(), edited(rng.choice(base)), rng.choice(chain), "", "  x  y "]) for _ in range(rng.randrange(1, 7)))))
    return rows


def test_against_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string").repartition(4)
    want = brute(rows)
    report = durable(f.without_near_lines(docs))
    got = report.collect()
    assert len(got) == len(rows)
    # A pair at the very threshold is missed once in a thousand; here none is.
    assert {r["doc_id"]: r["removed"] for r in got} == want
    by_id = dict(rows)
    assert all(r["n_lines"] == (0 if by_id[r["doc_id"]] is None else by_id[r["doc_id"]].count("\n") + 1) and r["n_removed"] == len(r["removed"]) for r in got)
    texts = {r["doc_id"]: r["text"] for r in f.kept_texts(docs, report).collect()}
    assert texts[9] == "\n".join(x for k, x in enumerate(by_id[9].split("\n")) if k not in want[9])


def families(rng):
    """Lines of families that share most of their text, at similarities of 0.5 to 0.95, a hot one among them."""
    word = lambda: "".join(rng.choice("aeioubcdrst") for _ in range(rng.randrange(2, 9)))
    lines = []
    for size in (1, 2, 30, 30, 150):
        shared = [word() for _ in range(14)]
        for _ in range(size):
            own = [word() for _ in range(rng.choice([1, 2, 4, 6]))]
            at = rng.randrange(len(shared))
            lines.append(" ".join(shared[:at] + own + shared[at:]))
    return list(dict.fromkeys([*lines, "a", "ab", "a b c", "short one"]))


def test_prefixes_leave_out_no_near_pair(spark):
    for seed in range(3):
        rng = random.Random(seed)
        lines = families(rng)
        near = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if similarity(lines[i], lines[j]) >= 0.8}
        for root in ([i for i in range(len(lines))], [rng.choice([0, 0, 0, i]) for i in range(len(lines))]):
            df = spark.createDataFrame([(i, root[i], s) for i, s in enumerate(lines)], "id long, root long, form string").repartition(3)
            got = {tuple(r) for r in f._across(f._mixed(f._prefixes(df, f._rarity(df)))).collect()}
            want = {(i, j) for i, j in near if root[i] != root[j]}
            assert want <= got and all(root[i] != root[j] for i, j in got)
            apart = sum(root[i] != root[j] for i in range(len(lines)) for j in range(i + 1, len(lines)))
            assert len(got) < 0.4 * apart


def test_links_join_all_near_lines(spark, monkeypatch):
    """Chains of near lines that are no component yet, with crowded shingles."""
    monkeypatch.setattr(f, "CROWD", 3)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioubcdrst") for _ in range(6))
    lines = families(rng)
    for _ in range(3):
        ws = [word() for _ in range(16)]
        for _ in range(40):
            ws[rng.randrange(16)] = word()
            lines.append(" ".join(ws))
    lines = list(dict.fromkeys(lines))
    df = spark.createDataFrame([(i, i, s) for i, s in enumerate(lines)], "id long, root long, form string").repartition(3)
    near = [(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if similarity(lines[i], lines[j]) >= 0.8]
    links = [tuple(r) for r in f._links_across(df).collect()]
    assert {(min(x), max(x)) for x in links} <= set(near)
    assert roots(range(len(lines)), links) == roots(range(len(lines)), near)


def test_shared_buckets_over_batches(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(4)) for k in range(40) for _ in range(rng.randrange(1, 9))] + [(99, 7)] * 20 + [(100, k % 3) for k in range(20)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, h in rows:
        want.setdefault(k, set()).add(h)
    want = {k: hs for k, hs in want.items() if len(hs) > 1}
    try:
        for n in ("1", "2", "7", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            df = spark.createDataFrame(rows, "key long, h long").repartition(2, "key")
            got, hubs = {}, {}
            for k, h, hub in map(tuple, f._shared_buckets(df).collect()):
                got.setdefault(k, set()).add(h)
                hubs.setdefault(k, set()).add(hub)
            assert got == want and all(len(x) == 1 and x <= want[k] for k, x in hubs.items())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_recall_of_the_bands():
    rng = random.Random(2)
    pairs = []
    while len(pairs) < 1500:
        a = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(60, 300)))
        at = rng.randrange(len(a) - 12)
        b = a[:at] + "".join(rng.choice("xyz") for _ in range(rng.randrange(1, 9))) + a[at + rng.randrange(9) :]
        if 0.8 <= similarity(a, b) < 0.9:
            pairs.append((a, b))
    x, y = f.band_keys([a for a, _ in pairs]), f.band_keys([b for _, b in pairs])
    assert (x == y).any(axis=1).mean() > 0.995
    assert f.near([a for a, _ in pairs], [b for _, b in pairs]) == [True] * len(pairs)
    assert f.near(["a", "a b", pairs[0][0]], ["a", "a c", pairs[1][0]]) == [True, False, False]
    assert len(np.unique(f.band_keys(["short", "short x", "é" * 9]))) == 3 * f.BANDS


def test_over_the_table(spark):
    root = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    got = {r["doc_id"]: r["removed"] for r in f.op8_line_dedup(spark, root).collect()}
    assert got == {i: ",".join(map(str, v)) for i, v in want.items()}


def test_no_rows_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert f.without_near_lines(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "one line here\nother"), (1, "one line here\nother"), (1, "one line here"), (2, "ONE  line here")]
    got = sorted((r["doc_id"], r["n_lines"], r["n_removed"]) for r in f.without_near_lines(spark.createDataFrame(rows, schema)).collect())
    assert got[-1] == (2, 1, 1) and sum(g[2] for g in got[:-1]) in (1, 2)
