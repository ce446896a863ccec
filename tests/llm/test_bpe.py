"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from ledgerproof.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(PATH, public_tokenizers.PATTERN)


def samples():
    rng = random.Random(5)
    alphabet = "ab th'sreE 0129\t\n\r\x0b\x0c\x1c\x1f\x85\xa0​ 　éßñ中文字🙂👩‍🚀ⅷ²١̈.,!?<|>-_"
    return [
        "", " ", "a", "<|endoftext|>", "x" * 5000, "ab" * 3000, "中" * 500, " " * 700 + "a", "it's they'll I'M", "\n\n \n a",
        *("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(2500)),
    ]


def test_ids_and_bytes_match_the_library(library, vocabulary):
    texts = samples()
    flat, ends = vocabulary.encode(texts)
    for k, text in enumerate(texts):
        assert flat[ends[k] : ends[k + 1]].tolist() == library.encode_ordinary(text), text


def test_perfect_hash_is_minimal_and_knows_strangers():
    keys = [f"k{i}".encode() for i in range(3000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.at.tolist()) == list(range(3000))
    assert table.find(keys) == list(range(3000))
    assert table.find([b"k3000", b"", b"z"]) == [-1] * 3
    assert bpe.PerfectHash([]).find([b"a"]) == [-1]


def test_operator_round_trip(spark, library):
    texts = [None, "", *samples()[:60], "tail " * 40_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, "same id", "y")], "doc_id long, text string, ids string")
    vocabulary = bpe.broadcast_vocabulary(spark, PATH, public_tokenizers.PATTERN)
    coded = bpe.decode(bpe.encode(docs, vocabulary), vocabulary, ids="_ids").collect()
    assert len(coded) == docs.count()
    for row in coded:
        assert row["_ids"] == library.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]).decode() == (row["text"] or "")
    got = {r["doc_id"]: r for r in bpe.round_trip_digests(docs.filter("text <> 'same id' or text is null"), vocabulary).collect()}
    ids = library.encode_ordinary(texts[-1])
    last = got[len(texts) - 1]
    assert (last["n_tokens"], last["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert last["decoded_sha256"] == hashlib.sha256(texts[-1].encode()).hexdigest()
    assert got[0]["n_tokens"] == 0 and got[0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def test_no_rows(spark):
    vocabulary = bpe.broadcast_vocabulary(spark, PATH, public_tokenizers.PATTERN)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip_digests(empty, vocabulary).collect() == []


def test_the_cache_is_bounded_by_bytes(library, monkeypatch):
    vocabulary = bpe.Vocabulary.read(PATH, public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 20_000)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    for _ in range(20):
        texts = [" ".join(word(rng.choice([3, 9, 63, 64, 65, 300])) for _ in range(30)) for _ in range(5)]
        flat, ends = vocabulary.encode(texts)
        assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library.encode_ordinary(t) for t in texts]
        assert all(len(p.encode()) <= bpe.LONG_PIECE for p in vocabulary._seen)
        assert vocabulary._held[0] < 20_000 + 150 * (bpe.PIECE_BYTES + 64 * 9)
