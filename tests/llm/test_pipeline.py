"""The pipeline against its stages in plain Python."""

import hashlib
import re

import corpus_pipeline
import test_contamination
import test_simhash

from ledgerproof.llm import quality

ROOT = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").select("item_id", "text").collect()]
    model = quality.train(spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/labels.parquet")).value
    kept = {i: t for i, t in docs.items() if model.scores([t])[0] >= quality.THRESHOLD}
    best = {}
    for i, t in kept.items():
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    kept = {min(g)[1]: kept[min(g)[1]] for g in best.values()}
    prints = {i: test_simhash.plain_print(t) for i, t in kept.items()}
    near = [(a, b) for a in kept for b in kept if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2]
    root = test_simhash.roots(sorted(kept), near)
    kept = {i: t for i, t in kept.items() if root[i] == i}
    kept = {i: t for i, t in kept.items() if not test_contamination.brute(t, items)[1]}
    got = corpus_pipeline.run(spark, ROOT).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in got} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in kept.items()}
    assert all(r["n_tokens"] == len(r["ids"]) and hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() == r["ids_sha256"] for r in got)
    assert 50 < len(got) < len(docs)


def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, score double, component_id long"
    rows = [(1, None, None, None, None, "x", 0.5, 7), (None, "", "en", "s", 0, "x", 0.5, 7), (2, "Some words of a text. Here.", None, "s", 3, None, None, None)] * 3
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, ROOT)
            assert docs.columns == columns
        assert set(columns) - {"text"} < set(corpus_pipeline.STAGES[-1][1](spark, docs, ROOT).columns)
        docs.collect()
