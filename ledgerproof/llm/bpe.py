"""Byte-level BPE: texts to token ids and back.

A pre-token goes through two tiers. A minimal perfect hash finds those that are in the
vocabulary as a whole; the others are merged with a heap over linked bytes. The rank file
is a parameter. It is read on the driver and broadcast; MAX_TOKENS bounds its size.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerproof.llm.common import append_columns, fresh, table

#: Largest vocabulary that is broadcast, in tokens and in bytes of all tokens.
MAX_TOKENS, MAX_TOKEN_BYTES = 2_000_000, 64 << 20
#: Bytes of pieces and their ids that a worker remembers, roughly; longer pieces are not remembered.
REMEMBERED_BYTES, LONG_PIECE = 128 << 20, 64
#: Bytes of one entry beside the piece's own and the ids'.
PIECE_BYTES = 220
#: Bytes of text whose pre-tokens a task holds at a time.
ENCODE_BYTES = 1 << 20
_EMPTY = np.uint64(0x9E3779B97F4A7C15)


def _slots(hashes: np.ndarray, tries: np.ndarray | int, size: int) -> np.ndarray:
    """The slot of each hash for a displacement."""
    with np.errstate(over="ignore"):
        x = hashes ^ (np.asarray(tries, np.uint64) * _EMPTY)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: key number i sits in its own one of n slots.

    Keys fall into n/3 buckets. Large buckets first, each takes the first displacement that
    sends its keys to free slots; a bucket of one key names its slot outright.
    """

    def __init__(self, keys: list[bytes]):
        self.keys, n = keys, len(keys)
        self.buckets = max(1, n // 3)
        hashes = self._hash(keys)
        if len(np.unique(hashes)) < n:
            raise ValueError("keys repeat")
        self.shift = np.zeros(self.buckets, np.int64)
        self.at = np.full(max(1, n), -1, np.int64)
        bucket = self._bucket(hashes)
        order = np.argsort(bucket, kind="stable")
        ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
        groups = sorted((order[a:b] for a, b in pairwise([0, *ends.tolist()])), key=len, reverse=True) if n else []
        free = np.ones(max(1, n), bool)
        singles = iter(())
        for members in groups:
            if len(members) == 1:
                break
            start = 0
            while True:
                tries = np.arange(start, start + 256, dtype=np.uint64)
                where = _slots(hashes[members][:, None], tries[None, :], n)
                ordered = np.sort(where, axis=0)
                good = free[where].all(axis=0) & (np.diff(ordered, axis=0) > 0).all(axis=0)
                if good.any():
                    pick = int(np.argmax(good))
                    self.shift[bucket[members[0]]] = start + pick
                    self.at[where[:, pick]] = members
                    free[where[:, pick]] = False
                    break
                start += 256
        singles = iter(np.flatnonzero(free).tolist()) if n else singles
        for members in groups:
            if len(members) == 1:
                slot = next(singles)
                self.shift[bucket[members[0]]] = -slot - 1
                self.at[slot] = members[0]

    @staticmethod
    def _hash(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)

    def find(self, keys: list[bytes]) -> list[int]:
        """The number of each key, -1 for strangers."""
        if not keys or not self.keys:
            return [-1] * len(keys)
        hashes = self._hash(keys)
        shift = self.shift[self._bucket(hashes)]
        slots = np.where(shift < 0, -shift - 1, _slots(hashes, np.maximum(shift, 0), len(self.keys)))
        own = self.keys
        return [i if i >= 0 and own[i] == k else -1 for k, i in zip(keys, self.at[slots].tolist())]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Merges the lowest-ranked neighbours, leftmost first, until none is in the vocabulary.

    A heap holds rank and place of the pairs as one number and links hold each part's
    neighbours, so a pre-token of n bytes takes n log n steps however long it is.
    """
    n, rank_of, push, pop = len(piece), ranks.get, heapq.heappush, heapq.heappop
    if n == 1:
        return (ranks[piece],)
    bits = n.bit_length()
    low = (1 << bits) - 1
    parts = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    # The heap entry of each part and its right neighbour; others in the heap are outdated.
    valid = [-1] * n
    heap = []
    for i in range(n - 1):
        rank = rank_of(piece[i : i + 2])
        if rank is not None:
            valid[i] = entry = rank << bits | i
            heap.append(entry)
    heapq.heapify(heap)
    while heap:
        entry = pop(heap)
        i = entry & low
        if valid[i] != entry:
            continue
        j = after[i]
        k = after[i] = after[j]
        parts[i] = own = parts[i] + parts[j]
        valid[i] = valid[j] = -1
        if k < n:
            before[k] = i
            rank = rank_of(own + parts[k])
            if rank is not None:
                valid[i] = entry = rank << bits | i
                push(heap, entry)
        h = before[i]
        if h >= 0:
            rank = rank_of(parts[h] + own)
            if rank is None:
                valid[h] = -1
            else:
                valid[h] = entry = rank << bits | h
                push(heap, entry)
    found, i = [], 0
    while i < n:
        found.append(ranks[parts[i]])
        i = after[i]
    return tuple(found)


class Vocabulary:
    """The tokens by id, with both tiers of the look-up."""

    def __init__(self, tokens: dict[bytes, int], pattern: str):
        if len(tokens) > MAX_TOKENS or sum(map(len, tokens)) > MAX_TOKEN_BYTES:
            raise ValueError("the vocabulary is beyond what is broadcast")
        if len(set(tokens.values())) != len(tokens) or not all(bytes([b]) in tokens for b in range(256)):
            raise ValueError("ids repeat or a byte has no token")
        self.pattern, self.ranks = pattern, tokens
        self.by_id = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.by_id[i] = token
        keys = sorted(tokens, key=tokens.get)
        self.ids = [tokens[k] for k in keys]
        self.whole = PerfectHash(keys)

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}
        return cls(tokens, pattern)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_split", "_seen", "_held", "_bytes")}

    @property
    def split(self):
        """Finds the matches of the pattern. White space is Unicode's property, without the separators 1C to 1F."""
        if "_split" not in self.__dict__:
            classes = self.pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
            self._split = regex.compile(classes).findall
        return self._split

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one row, and where each text's begin and end."""
        seen, held = self.__dict__.setdefault("_seen", {}), self.__dict__.setdefault("_held", [0])
        pieces = [self.split(t) if t else [] for t in texts]
        if held[0] > REMEMBERED_BYTES:
            seen.clear()
            held[0] = 0
        new = list(set(chain.from_iterable(pieces)).difference(seen))
        raw = [p.encode() for p in new]
        long = {}
        for piece, b, i in zip(new, raw, self.whole.find(raw)):
            ids = (self.ids[i],) if i >= 0 else merge_bytes(b, self.ranks)
            if len(b) > LONG_PIECE:
                long[piece] = ids
            else:
                seen[piece] = ids
                held[0] += PIECE_BYTES + len(b) + 8 * len(ids)
        known = {**{p: seen[p] for p in set(chain.from_iterable(pieces)) - long.keys()}, **long}.__getitem__ if long else seen.__getitem__
        ids = [list(chain.from_iterable(map(known, p))) for p in pieces]
        ends = np.cumsum([0, *map(len, ids)])
        return np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1])), ends

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes of each list of ids; a missing list has none."""
        if "_bytes" not in self.__dict__:
            self._bytes = pa.array(self.by_id, pa.large_binary())
        parts = self._bytes.take(ids.flatten())
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
        starts = np.frombuffer(parts.buffers()[1], np.int64, len(parts) + 1, 8 * parts.offset) if len(parts) else np.zeros(1, np.int64)
        whole = parts.buffers()[2] or pa.py_buffer(b"")
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(starts[ends.astype(np.int64)].tobytes()), whole]).cast(pa.binary())


def broadcast_vocabulary(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    return spark.sparkContext.broadcast(Vocabulary.read(path, pattern))


def encode(docs: DataFrame, vocabulary: Broadcast, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs and the token ids of each whole text, and under `decoded` the bytes that these ids
    decode to, if a name is given.

    A missing or empty text has an empty list. Rows may repeat. If docs has a column of a
    new name, the new one gets underscores ahead.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        flat, ends = vocabulary.value.encode(texts.to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        return [lists, vocabulary.value.decode(lists)][: len(fields)]

    names = fresh(docs, ids, *([decoded] if decoded else []))
    fields = list(zip(names, (T.ArrayType(T.IntegerType()), T.BinaryType())))
    return append_columns(docs, text, compute, fields, ENCODE_BYTES)


def decode(docs: DataFrame, vocabulary: Broadcast, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs and the bytes that each list of ids stands for; a missing list stands for none."""
    (decoded,) = fresh(docs, decoded)
    schema = T.StructType([*docs.schema.fields, T.StructField(decoded, T.BinaryType())])

    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes, dtype=np.int64) // (1 << 21)
            for a, b in pairwise([0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, vocabulary.value.decode(part.column(ids))], names=[*part.schema.names, decoded])

    return docs.mapInArrow(run, schema)


def tokenised(docs: DataFrame, vocabulary: Broadcast, keep_ids: bool = True) -> DataFrame:
    """docs with token ids instead of texts, and n_tokens, ids_sha256 and decoded_sha256: their
    number and the digests of the ids and of the bytes that they decode to. Names that docs
    has already get underscores ahead."""
    ids, decoded, n_tokens, ids_sha, decoded_sha = fresh(docs, "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")
    return encode(docs, vocabulary, ids=ids, decoded=decoded).drop("text").withColumns(
        {
            n_tokens: F.size(ids).cast("long"),
            ids_sha: F.sha2(F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary"), 256),
            decoded_sha: F.sha2(decoded, 256),
        }
    ).drop(decoded, *([] if keep_ids else [ids]))


def round_trip_digests(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """Per document: the number of its tokens and digests of its ids and of what they decode to."""
    return tokenised(docs.select("doc_id", "text"), vocabulary, keep_ids=False)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = broadcast_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary)
