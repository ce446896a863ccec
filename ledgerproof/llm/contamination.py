"""Benchmark passages in documents, by a generalised suffix automaton of the test items.

The automaton holds every word sequence of every item. A document's words run through it;
at each word it knows the longest sequence ending there that some item holds. Words that
no item has reset it, so only runs of known words are walked.

Item texts, each once, are dealt to shards by a running count of words and ids: a shard holds
SHARD_WORDS of them at most, and its last text. One automaton at a time is made and broadcast;
with several shards the documents pass several times, so memory stays bounded however large
the test set is and however often an item is in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerproof.llm.common import expand_rows, fresh, table
from ledgerproof.operators.ordering import running_totals
from ledgerproof.session import durable

WINDOW = 10
SHARD_WORDS = 1_000_000
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and all characters beyond ASCII, as UTF-8."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


class SuffixAutomaton:
    """All windows of the items: `window` words each, or a shorter item as a whole."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = [name for name, _ in items]
        coded = [[self.number.setdefault(w, len(self.number)) for w in ws] for _, ws in items]
        for ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self._mark(coded)
        self.shortest = min((min(len(ws), window) for ws in coded if ws), default=1)

    def _extend(self, last: int, w: int) -> int:
        to = self.next[last].get(w)
        if to is not None:
            return to if self.length[to] == self.length[last] + 1 else self._split(last, to, w)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def _state(self, edges: dict[int, int], length: int, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The part of state q that is one word longer than p."""
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _mark(self, coded: list[list[int]]) -> None:
        """Which items each state's windows are from.

        whole[s]: the state with the last `window` words of s. short[s]: the short items that
        end in s; up[s]: the next state on the way of links that has such.
        """
        states = len(self.length)
        order = sorted(range(1, states), key=self.length.__getitem__)
        self.whole = [-1] * states
        for s in order:
            if self.length[s] >= self.window:
                self.whole[s] = s if self.length[self.link[s]] < self.window else self.whole[self.link[s]]
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, dict[int, set[int]]] = {}
        for k, ws in enumerate(coded):
            for s, length in self.walk(ws):
                if length >= self.window:
                    self.items.setdefault(self.whole[s], set()).add(k)
            if 0 < len(ws) < self.window:
                self.short.setdefault(s, {}).setdefault(len(ws), set()).add(k)
        self.up = [-1] * states
        for s in order:
            self.up[s] = self.link[s] if self.link[s] in self.short else self.up[self.link[s]] if self.link[s] > 0 else -1

    def walk(self, coded: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state and the length of the longest sequence ending there."""
        s = length = 0
        edges, link, longest = self.next, self.link, self.length
        for w in coded:
            while s and w not in edges[s]:
                s = link[s]
                length = longest[s]
            s = edges[s].get(w, 0)
            length = length + 1 if s else 0
            yield s, length

    def matches(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words inside occurrences (merged, end exclusive) and the items these are from."""
        coded = np.fromiter((self.number.get(w, -1) for w in ws), np.int64, len(ws))
        known = np.concatenate([[0], (coded >= 0).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(known))
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        found: set[int] = set()
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a < self.shortest:
                continue
            for i, (s, length) in enumerate(self.walk(coded[a:b].tolist()), a + 1):
                reach = 0
                if length >= self.window:
                    states.add(self.whole[s])
                    reach = length
                if self.short:
                    t = s if s in self.short else self.up[s]
                    while t > 0:
                        for n, who in self.short[t].items():
                            if n <= length:
                                found |= who
                                reach = max(reach, n)
                        t = self.up[t]
                if reach:
                    start = i - reach
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, found.union(*(self.items[x] for x in states))


def dealt(benchmark: DataFrame, limit: int = SHARD_WORDS) -> tuple[DataFrame, int]:
    """(text, names, shard): each distinct item text once, with its item_ids, and the number of shards.

    The texts are dealt by a running count of words and ids in the order of their hashes: a
    shard holds at most `limit` of these and its last text. Copies of a text are one text.
    """
    named = benchmark.select(F.col("item_id").cast("string").alias("name"), "text").filter(F.col("name").isNotNull() & F.col("text").isNotNull())
    texts = named.groupBy("text").agg(F.array_sort(F.collect_set("name")).alias("names"))
    size = F.size(F.split("text", "[^0-9A-Za-z\u0080-\U0010ffff]+")) + F.size("names")
    counted = running_totals(texts, [F.xxhash64("text"), F.col("text")], sums={"upto": size.cast("long")}, position="place")
    start = F.col("upto") - size
    found = durable(counted.select("text", "names", F.floor(start / limit).cast("int").alias("shard")))
    last = found.agg(F.max("shard")).first()[0]
    return found, 1 + (last or 0)


def _automaton(items: DataFrame, shard: int, window: int) -> Broadcast:
    rows = items.filter(F.col("shard") == shard).collect()
    return items.sparkSession.sparkContext.broadcast(SuffixAutomaton([(r["names"], words(r["text"])) for r in rows], window))


def _scan(docs: DataFrame, automaton: Broadcast, spans: str, items: str, n_words: str) -> DataFrame:
    """docs and the spans, items and words of each; spans and items that docs has already are united."""
    more = spans in docs.columns
    kept = [c for c in docs.columns if c not in (spans, items, n_words)]
    schema = docs.select(*kept).schema.add(spans, T.ArrayType(T.IntegerType())).add(items, T.ArrayType(T.StringType())).add(n_words, T.LongType())

    def compute(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        auto, all_spans, all_items, counts = automaton.value, [], [], []
        known = zip(part.column(spans).to_pylist(), part.column(items).to_pylist()) if more else None
        for text in part.column("text").to_pylist():
            ws = words(text)
            hit, who = auto.matches(ws)
            names = {name for k in who for name in auto.names[k]}
            if known:
                old, before = next(known)
                hit = _merged(hit + list(zip(old[::2], old[1::2])))
                names.update(before)
            all_spans.append(list(chain.from_iterable(hit)))
            all_items.append(sorted(names))
            counts.append(len(ws))
        made = [pa.array(all_spans, pa.list_(pa.int32())), pa.array(all_items, pa.list_(pa.string())), pa.array(counts, pa.int64())]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], names=[*kept, spans, items, n_words])

    return expand_rows(docs, "text", compute, schema)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = SHARD_WORDS) -> tuple[DataFrame, str, str, str]:
    """docs with the word spans that lie in benchmark windows (flat starts and ends), the
    item_ids that these are from and the number of words; and the names of the three columns.

    A missing text has no words, in documents and in items. Items without an item_id are
    left out; items that share a text or an id count once for each id. With no items nothing
    is found. The names get underscores ahead where docs has such columns.
    """
    names = fresh(docs, "spans", "items", "n_words")
    items, shards = dealt(benchmark, limit)
    for k in range(shards):
        if k:
            docs = durable(docs)
        docs = _scan(docs, _automaton(items, k, window), *names)
    return (docs, *names)


def decontaminated(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.2, window: int = WINDOW) -> DataFrame:
    """docs without benchmark passages.

    Spans of `window` words or more that an item holds (or a whole shorter item) are cut out
    of the text, with what stands between their words; a document of which more than
    max_coverage would go is dropped. At 0 every document with such a span goes.
    """
    found, spans, items, n_words = matches(docs, benchmark, window)
    pairs = F.expr(f"aggregate(sequence(0, greatest(size({spans}) - 2, 0), 2), 0L, (n, i) -> n + coalesce(get({spans}, i + 1) - get({spans}, i), 0))")
    kept = found.filter(pairs <= max_coverage * F.col(n_words))
    if max_coverage <= 0:
        return kept.drop(spans, items, n_words)

    names = docs.columns

    def compute(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [cut_words(t, s) for t, s in zip(part.column("text").to_pylist(), part.column(spans).to_pylist())]
        columns = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in names]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return expand_rows(kept.drop(items, n_words), "text", compute, docs.schema)


def cut_words(text: str | None, spans: list[int]) -> str | None:
    """The text without these word spans: from a span's first word up to the word after it."""
    if not spans or text is None:
        return text
    raw = text.encode()
    plain = np.frombuffer(raw.translate(_WORD_BYTES), np.uint8) != 32
    starts = np.flatnonzero(np.diff(plain.astype(np.int8), prepend=0) == 1).tolist() + [len(raw)]
    parts, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        parts.append(raw[at : starts[a]])
        at = starts[b]
    return b"".join([*parts, raw[at:]]).decode()


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, spans, items, n_words = matches(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.expr(f"aggregate(sequence(0, greatest(size({spans}) - 2, 0), 2), 0L, (n, i) -> n + coalesce(get({spans}, i + 1) - get({spans}, i), 0))")
    return found.select(
        "doc_id",
        F.col(n_words).alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(spans) > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), sized AS (SELECT item_id, ws, least(len(ws), 10) AS size FROM b WHERE len(ws) > 0),
item_windows AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS key
  FROM (SELECT item_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM sized)
), doc_windows AS (
  SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS key
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM sized))
), found AS (SELECT doc_id, i, size, item_id FROM doc_windows JOIN item_windows USING (size, key)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY 1),
named AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM found GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
