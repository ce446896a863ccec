import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerproof.operators import detectors as det
from ledgerproof.operators import normalize, ordering, quality, review, spans
from ledgerproof.sources import files


def test_running_totals_with_one_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.randint(0, 5), i, rng.randint(-9, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, id int, v int")
    got = ordering.running_totals(df, [F.col("k").desc(), F.col("id")], ["g"], {"upto": F.col("v")}, "pos", {"peak": F.col("v")})
    want, state = {}, {}
    for g, k, i, v in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        pos, total, peak = state.get(g, (0, 0, None))
        state[g] = (pos + 1, total + v, v if peak is None else max(peak, v))
        want[i] = (pos + 1, total + v, peak)
    assert {r["id"]: (r["pos"], r["upto"], r["peak"]) for r in got.collect()} == want


def test_running_offsets_cross_chunks(spark):
    df = spark.createDataFrame([("d", i, i % 4) for i in range(50)], "k string, p int, w int")
    got = ordering.running_offsets(df, ["k"], "p", "w", "at", chunk=8)
    assert [r["at"] for r in got.orderBy("p").collect()] == [sum(j % 4 for j in range(i)) for i in range(50)]


def test_exact_median(spark):
    rng = random.Random(2)
    rows = [(g, round(rng.random(), 2)) for g in ("a", "b", "c") for _ in range(50 + len(g) * ord(g) % 3)]
    got = {r["g"]: r["median"] for r in ordering.exact_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in "abc":
        assert got[g] == pytest.approx(statistics.median(v for k, v in rows if k == g))


def test_top_n_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    plan = ordering.top_n(df, 2, ["g"], [F.col("id").desc()])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_exact_duplicates_keep_the_first_copy(spark):
    row = ("1", "A", None, 2, None, 1.0, 7, "X")
    rows = [(*row, f"{i:03d}") for i in range(40)] + [("2", "A", None, 2, None, 1.0, 7, "X", "900")]
    schema = "invoice_no string, stock_code string, description string, quantity int, invoice_date timestamp, unit_price double, customer_id int, country string, row_id string"
    got = {r["row_id"]: r["is_exact_duplicate"] for r in normalize.flag_exact_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert [k for k, v in got.items() if not v] and sorted(k for k, v in got.items() if not v) == ["000", "900"]


@pytest.mark.parametrize("bits", [8, 1 << 16, 1 << 27])
def test_duplicate_flags_do_not_depend_on_the_filter(spark, bits):
    rng = random.Random(bits)
    rows = [(f"{i:05d}", rng.choice(["a", "b", None]), rng.choice([None, *range(200)])) for i in range(900)] + [(f"x{i:04d}", "hot", 1) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id string, s string, n int").repartition(4)
    first = {}
    for i, s, n in sorted(rows):
        first.setdefault((s, n), i)
    got = {r["row_id"]: r["is_exact_duplicate"] for r in normalize.flag_exact_duplicates(df, ["s", "n"], bits=bits).collect()}
    assert got == {i: first[s, n] != i for i, s, n in rows}


def looped_repair(tokens):
    out = list(tokens)
    for i in range(len(out) - 1):
        if out[i].endswith("�") and out[i + 1] == "�":
            out[i], out[i + 1] = out[i][:-1], "≈"
    return out


def test_byte_pair_repair_matches_the_sequential_rule(spark):
    rng = random.Random(3)
    docs = {f"d{n}": [rng.choice(["�", " �", "a", "�"]) for _ in range(rng.randint(1, 30))] for n in range(60)}
    rows = [(q, i, t) for q, ts in docs.items() for i, t in enumerate(ts)]
    fixed = spans.repair_byte_pairs(spark.createDataFrame(rows, "qid string, position long, token_text string"))
    got = {}
    for r in fixed.orderBy("qid", "position").collect():
        got.setdefault(r["qid"], []).append(r["display_text"])
    assert got == {q: looped_repair(ts) for q, ts in docs.items()}


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 4096])
def test_placed_tokens_over_chunks(spark, chunk):
    rng = random.Random(chunk)
    docs = {f"d{n}": [rng.choice(["�", "�", "�", " �", "ab", "<|x|>", "é�"]) for _ in range(rng.randint(1, 40))] for n in range(60)}
    docs["run"], docs["lone"] = ["a�"] + ["�"] * 40 + ["b"], ["�"] * 41
    gaps = {q: rng.choice([None, len(ts) // 2]) for q, ts in docs.items()}
    place = lambda q, i: i + (gaps[q] is not None and i >= gaps[q])
    rows = [(q, place(q, i), t) for q, ts in docs.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "qid string, position long, token_text string").repartition(3)
    got = {}
    for r in spans.placed_tokens(df, chunk=chunk).orderBy("qid", "position").collect():
        got.setdefault(r["qid"], []).append((r["display_text"], r["aligned_text"], r["char_start"], r["char_end"]))
    for q, ts in docs.items():
        cut = gaps[q] if gaps[q] is not None else len(ts)
        at, want = 0, []
        for t in looped_repair(ts[:cut]) + looped_repair(ts[cut:]):
            kept = "" if t == "<|x|>" else t
            want.append((t, kept, at, at + len(kept)))
            at += len(kept)
        assert got[q] == want, q


def test_overlap_join_matches_brute_force(spark):
    rng = random.Random(4)
    tokens, at = [], 0
    for i in range(300):
        width = rng.choice([0, 1, 3, 9, 40])
        tokens.append(("d", i, at, at + width, False))
        at += width
    notes = [(f"a{i}", "d", s, s + rng.randint(1, 200)) for i, s in enumerate(rng.sample(range(at), 60))]
    left = spark.createDataFrame(notes, "annotation_id string, qid string, span_start_char long, span_end_char long")
    right = spark.createDataFrame(tokens, "qid string, position long, char_start long, char_end long, is_special_token boolean")
    want = sorted((a, p) for a, _, s, e in notes for _, p, b, c, _ in tokens if c > s and b < e and c > b)
    for width in (7, 64, 10_000):
        got = sorted((r["annotation_id"], r["position"]) for r in spans.overlap_join(left, right, width=width).collect())
        assert got == want


@pytest.mark.parametrize("shape", ["mixed", "one island"])
def test_greedy_tiling_matches_brute_force(spark, shape):
    rng = random.Random(5)
    rows = [(f"q{rng.randint(0, 3)}", f"s{i:03d}", s, s + rng.randint(0, 25)) for i, s in enumerate(rng.choices(range(400), k=200))]
    if shape == "one island":
        rows = [("q", f"s{i:06d}", i, i + rng.randint(2, 9)) for i in range(100_000)]
    want = set()
    for q in {r[0] for r in rows}:
        cursor = 0
        for _, name, s, e in sorted((r for r in rows if r[0] == q), key=lambda r: (r[2], r[3], r[1])):
            if s >= cursor:
                want.add(name)
                cursor = e
    df = spark.createDataFrame(rows, "qid string, annotation_id string, span_start_char long, span_end_char long")
    assert {r["annotation_id"] for r in spans.greedy_tiling(df).collect()} == want


def brute_metrics(pairs, threshold):
    tp = sum(y and s >= threshold for y, s in pairs)
    fp = sum(not y and s >= threshold for y, s in pairs)
    fn = sum(y and s < threshold for y, s in pairs)
    tn = len(pairs) - tp - fp - fn
    p, r = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
    return (2 * p * r / (p + r) if p + r else 0.0, p, r, (tp + tn) / len(pairs), -threshold)


def test_thresholds_and_rank_metrics_match_brute_force(spark):
    rng = random.Random(6)
    rows = [("d", "dev", i, rng.randint(0, 1), round(rng.random(), 1)) for i in range(80)]
    df = spark.createDataFrame(rows, "baseline string, split string, row_id long, y int, score double")
    pairs = [(y, s) for _, _, _, y, s in rows]
    swept = det.sweep(df)
    best = det.best_thresholds(swept).first()
    assert best["threshold"] == max({s for _, s in pairs}, key=lambda t: brute_metrics(pairs, t))
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert det.auroc(swept).first()["auroc"] == pytest.approx(auc)
    hits, total = 0, 0.0
    for place, (y, _) in enumerate(sorted(pairs, key=lambda x: -x[1]), 1):
        if y:
            hits += 1
            total += hits / place
    assert det.average_precision(df).first()["auprc"] == pytest.approx(total / len(pos))


def test_split_evaluation_known_answer(spark):
    good = {"dev": [0.9, 0.8, 0.2, 0.1], "test": [0.9, 0.3, 0.2, 0.1]}
    bad = {"dev": [0.2, 0.3, 0.8, 0.9], "test": [0.2, 0.3, 0.8, 0.9]}
    rows = [
        (name, split, n, y, values[split][n])
        for name, values in (("score_good", good), ("score_bad", bad)) for split in ("dev", "test") for n, y in enumerate([1, 1, 0, 0])
    ]
    df = spark.createDataFrame(rows, "baseline string, split string, row_id long, y int, score double")
    got = {(r["baseline"], r["evaluated_split"]): r for r in det.evaluate_splits(df).collect()}
    assert (got["score_good", "dev"]["threshold"], got["score_good", "dev"]["f1"], got["score_good", "test"]["f1"]) == (0.8, 1.0, 0.666667)
    worst = got["score_bad", "test"]
    assert (worst["threshold"], worst["f1"], worst["auroc"], worst["auprc"]) == (0.2, 0.666667, 0.0, 0.416667)


def test_unknown_label_and_open_lock_stop_the_job(spark):
    labels = spark.createDataFrame([("correct_key_fact",), ("new",)], "label string")
    with pytest.raises(Exception, match="unknown label"):
        labels.select(det.binary_label(F.col("label"), "raise")).collect()
    rows = spark.createDataFrame([("c1", "fix", "label_supported", "x")], "confirmation_item_id string, source_action string, label_verdict string, presentation_use string")
    assert review.unresolved(rows).count() == 1
    with pytest.raises(Exception, match="cannot lock"):
        review.lock_decisions(rows).collect()


def test_checks_and_gate(spark):
    df = spark.createDataFrame([(1, 0.5), (1, float("nan")), (2, None)], "k int, v double")
    found = {r["check_name"]: r["detail"] for r in quality.violations(df, {"range": quality.finite_between("v", 0, 1)}).collect()}
    assert found == {"range": 2}
    assert quality.unique_key(df, ["k"], "k").first()["passed"] is False
    assert {r["check_name"]: r["passed"] for r in quality.required_columns(df, ["k", "w"]).collect()} == {"required_k": True, "required_w": False}
    with pytest.raises(Exception, match="stage one: failed check k"):
        quality.gate(quality.unique_key(df, ["k"], "k"), "stage one").collect()


def test_train_only_scores_are_rejected(spark):
    df = spark.createDataFrame([("d", "train", 1, 1, 0.5)], "baseline string, split string, row_id long, y int, score double")
    assert det.evaluate_splits(df).count() == 0


def test_malformed_lines_are_numbered_per_file(spark, tmp_path):
    for name, bad in (("a", {3, 7}), ("b", {1})):
        lines = ["{oops" if n in bad else json.dumps({"k": n}) for n in range(1, 11)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n\n")
    got = files.scan_json_lines(spark, str(tmp_path), "k bigint")
    bad = {(r["file"].rsplit("/", 1)[1], r["line_no"]) for r in got.filter("is_malformed").collect()}
    assert bad == {("a.jsonl", 3), ("a.jsonl", 7), ("b.jsonl", 1)}
    assert got.count() == 20


def test_a_missing_note_or_an_unknown_error_type_stops_the_job(spark):
    from ledgerproof.operators import review

    rows = [("confirm_1", "none", "label_supported", "supporting"), ("confirm_2", "none", "label_supported", None)]
    df = spark.createDataFrame(rows, "confirmation_item_id string, source_action string, label_verdict string, presentation_use string")
    assert review.lock_decisions(df.limit(1)).first()["labels_locked"]
    with pytest.raises(Exception, match="confirm_2"):
        review.lock_decisions(df).collect()
    odd = spark.createDataFrame([("other", "month", "x")], "error_type string, fact_type string, question_type string")
    with pytest.raises(Exception, match="unknown error type other"):
        odd.select(det.error_family()).collect()
