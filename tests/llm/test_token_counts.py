"""The ledger of token counts against recounting, and replays."""

import random

import oracle
import pytest
from pyspark.sql import functions as F

from ledgerproof.llm import bpe
from ledgerproof.llm import token_counts as t

SCHEMA = "doc_id long, source string, lang string, tokenizer string, tokens long, old string"


def recount(state):
    out = {}
    for (_, tokenizer), (tokens, source, lang) in state.items():
        documents, total = out.get((source, lang, tokenizer), (0, 0))
        out[source, lang, tokenizer] = documents + 1, total + tokens
    return out


def told(ledger):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["documents"], r["tokens"]) for r in ledger.totals().collect()}


@pytest.mark.parametrize("compacted", [False, True])
def test_batches_against_recounting(spark, tmp_path, compacted):
    rng = random.Random(1)
    ledger, state = t.Ledger(spark, str(tmp_path)), {}
    assert told(ledger) == {} and ledger.current().count() == 0
    for batch in range(5):
        rows = [(rng.choice([*range(12), None]), rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice(["v1", "v2"]), rng.randrange(0, 9), "x") for _ in range(20)]
        gone = [rng.randrange(15) for _ in range(4)] + [None] if batch else []
        assert ledger.commit(batch, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(g,) for g in gone], "doc_id long"))
        best = {}
        for i, source, lang, tokenizer, tokens, _ in rows:
            if i is not None:
                best.setdefault((i, tokenizer), []).append((tokens, source is not None, source or "", lang is not None, lang or ""))
        state |= {k: (max(v)[0], max(v)[2] or None, max(v)[4] or None) for k, v in best.items()}
        state = {k: v for k, v in state.items() if k[0] not in gone}
        assert told(ledger) == recount(state)
        before = told(ledger)
        assert not ledger.commit(batch, spark.createDataFrame(rows[:3], SCHEMA)) and told(ledger) == before
        if compacted and batch in (1, 3):
            ledger.compact()
            ledger.compact()
            assert ledger.batches("base")[-1] == batch and told(ledger) == before
            spark.createDataFrame([(0, "z", "z", "v1", 99, 9)], t.STATE).write.parquet(f"{tmp_path}/base/batch=9{batch}")
            (tmp_path / "base" / f"batch=9{batch}" / "_SUCCESS").unlink()  # broken off
    assert ledger.batches() == list(range(5))
    assert {(r["doc_id"], r["tokenizer"]): (r["tokens"], r["source"], r["lang"]) for r in ledger.current().collect()} == state


def test_a_batch_that_was_broken_off_is_written_anew(spark, tmp_path):
    ledger = t.Ledger(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a", "en", "v1", 5, "x")], SCHEMA)
    ledger.commit(1, rows)
    spark.createDataFrame([(9, "z", "zz", "v9", 99, 2)], t.STATE).write.parquet(f"{tmp_path}/state/batch=2")
    spark.createDataFrame([("z", "zz", "v9", 1, 99)], t.DELTA).write.parquet(f"{tmp_path}/delta/batch=2")
    (tmp_path / "delta" / "batch=2" / "_SUCCESS").unlink()
    assert told(ledger) == {("a", "en", "v1"): (1, 5)}
    assert ledger.commit(2, rows, None) and told(ledger) == {("a", "en", "v1"): (1, 5)}
    assert ledger.commit(3, None, spark.createDataFrame([(1,), (8,)], "doc_id long")) and told(ledger) == {}


def test_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, "s", "en"), (2, "", "s", None), (3, " a\tb\n é ", None, "en"), (4, "w " * 100_000, "s", "en")], "doc_id long, text string, source string, lang string")
    got = {(r["doc_id"], r["tokenizer"]): r["tokens"] for r in t.counted(docs, t.tokenizers()).collect()}
    assert [got[i, "words-1"] for i in (1, 2, 3, 4)] == [0, 0, 3, 100_000] and [got[i, "bytes4-1"] for i in (1, 2, 3, 4)] == [0, 0, 3, 50_000]


def test_tokens_of_a_vocabulary(spark, tmp_path):
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("ids", F.lit("clash"))
    vocabulary = bpe.broadcast_vocabulary(spark, path, public_tokenizers.PATTERN)
    ledger = t.Ledger(spark, str(tmp_path))
    ledger.commit(1, t.counted(docs, t.tokenizers()).unionByName(t.bpe_counted(docs, vocabulary, "byte_bpe_50k-1")))
    want = {}
    for r in docs.collect():
        n, total = want.get((r["source"], r["lang"]), (0, 0))
        want[r["source"], r["lang"]] = n + 1, total + len(library.encode_ordinary(r["text"] or ""))
    assert {k[:2]: v for k, v in told(ledger).items() if k[2] == "byte_bpe_50k-1"} == want
    assert {k[2] for k in told(ledger)} == {"byte_bpe_50k-1", "words-1", "bytes4-1"}


def test_check_sql(spark):
    assert oracle.compare(spark, "/root/testdata/sf0.001", t.op7_token_counts, t.OP7_SQL) is None
