"""Hard negatives against a brute-force version and the check SQL."""

import math
import random

import numpy as np
import oracle
import pytest

from ledgerproof.llm import hard_negatives as h

SCHEMA = "id long, label int, vector array<double>, score string, key string"


def brute(rows, anchors, positives=5, negatives=5, floor=80):
    def whole(v):
        return [math.floor(x * 256) for x in v]

    fine = lambda r: r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])
    rows, out, used = [(i, k, whole(v)) for i, k, v in filter(fine, rows)], [], {}
    for i, k, v in sorted((i, k, whole(v)) for i, k, v in filter(fine, anchors)):
        used.setdefault(i, (k, v))
    for i, (k, v) in used.items():
        scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j, label) for j, label, w in rows if j != i)
        for s, j, _ in [r for r in scored if r[2] == k][:positives]:
            near = [r for r in scored if r[2] != k and floor * -s <= 100 * -r[0] <= 100 * -s][:negatives]
            out += [(i, j, n + 1, r[1], -s, -r[0]) for n, r in enumerate(near)]
    return sorted(out)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "mine", "mine") for r in rows], SCHEMA).repartition(parts)


def made(rng, n=400, dims=4):
    rows = []
    for i in range(n):
        v = [rng.choice([rng.gauss(0, 1), rng.choice([0.0, 0.5, 1.0])]) for _ in range(dims)]
        rows.append((rng.choice([i, -i]), rng.randrange(rng.choice([2, 9])), v))
    rows += [(1000 + k, k % 3, [0.5, 0.5, 1.0, 0.25]) for k in range(150)]  # ties
    rows += [(2000, 50, [1.0, 1.0, 1.0, 1.0]), (2100, 51, [2.0] * 4), (2101, 51, [1.0] * 4)]  # none and one positive
    rows += [(3000, 1, None), (3001, None, [1.0] * 4), (None, 1, [1.0] * 4), (3003, 1, [1.0, None, 1.0, 1.0]), (3004, 1, [math.nan] * 4), (3005, 1, [math.inf, 1.0, 1.0, 1.0]), (3006, 1, []), (3007, 2, [1.0]), (3008, 1, [3.0] * 6)]
    return rows + [rows[5]] * 7 + [rows[100], rows[400], rows[400]]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed, monkeypatch):
    rows = made(random.Random(seed))
    anchors = [r for r in rows if r[0] is None or r[0] % 20 == 0]
    got = h.hard_negatives(frame(spark, rows), frame(spark, anchors, 2))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, anchors)
    got = h.hard_negatives(frame(spark, rows), frame(spark, anchors, 2), positives=3, negatives=2, floor=50, block_values=100)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, anchors, 3, 2, 50)


def test_numbers_beyond_exact_doubles(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [rng.choice([1e14, 3e13, 1.5, -2e14, 1e30]) for _ in range(3)]) for i in range(60)]
    anchors = rows[:6]
    assert sorted(tuple(r) for r in h.hard_negatives(frame(spark, rows), frame(spark, anchors)).collect()) == brute(rows, anchors)


def test_small_tiles(monkeypatch):
    """Tiles and gathering limits change nothing."""
    rng = np.random.default_rng(1)
    score, allowed = rng.integers(-3, 4, (7, 90)), rng.random((7, 90)) < 0.4
    for n in (1, 5, 89, 90, 200):
        anchor, row = h._tile_best(score, allowed, n)
        got = sorted(zip(anchor.tolist(), row.tolist()))
        want = [(a, r) for a in range(7) for r in sorted((r for r in range(90) if allowed[a, r]), key=lambda r: (-score[a, r], r))[:n]]
        assert got == sorted(want)
    monkeypatch.setattr(h, "GATHERED", 50)
    best, seen = h.Best(3), []
    for _ in range(40):
        group, s, ids = rng.integers(0, 9, 30), rng.integers(-2, 3, 30), rng.integers(0, 1000, 30)
        best.add(group, s, ids)
        seen += zip(group.tolist(), s.tolist(), ids.tolist())
    got = sorted(zip(*(x.tolist() for x in best.settle())))
    assert got == sorted(x for g in range(9) for x in sorted((x for x in seen if x[0] == g), key=lambda x: (-x[1], x[2]))[:3])


def test_keys_sort_like_their_parts():
    rng = random.Random(2)
    some = [(rng.choice([-5, 0, 7, 2**62]), rng.choice([-(2**63) + 1, -1, 0, 1, 2**63 - 1]), rng.random() < 0.5, rng.choice([-9, 0, 3, 2**61])) for _ in range(300)]
    a, s, p, i = (np.array(x) for x in zip(*some))
    keys = h.packed(a, s, p, i).to_pylist()
    order = sorted(range(300), key=lambda k: keys[k])
    parts = [(some[k][0], -some[k][1], not some[k][2], some[k][3]) for k in order]
    assert parts == sorted(parts) and {len(k) for k in keys} == {25}


def test_no_rows(spark):
    rows = frame(spark, made(random.Random(1))[:30])
    none = rows.filter("id = 123456")
    assert h.hard_negatives(rows, none).collect() == [] and h.hard_negatives(none, rows).collect() == []


def test_check_sql(spark):
    assert oracle.compare(spark, "/root/testdata/sf0.01", h.op13_hard_negatives, h.OP13_SQL) is None


def test_a_tile_without_anchors_has_no_best():
    anchor, row = h._tile_best(np.zeros((0, 50), np.int64), np.zeros((0, 50), bool), 5)
    assert len(anchor) == len(row) == 0
