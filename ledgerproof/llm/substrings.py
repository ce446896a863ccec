"""Repeated passages across documents, by a compacted de Bruijn graph.

An edge of the graph is a window of WINDOW consecutive words. In each window one sequence of
ANCHOR words is the smallest by hash, wherever the window stands. Consecutive windows of a
document with the same smallest sequence are a path, and a path is one row: its anchor, a
hash of all its words and its coordinates (document, first window, number of windows). That
is about one row for twenty words.

Paths meet by their anchor. An anchor in one document alone repeats nothing. Where all
paths of an anchor are equal the graph doesn't branch, and each path but those of the first
document repeats as a whole, without looking at its windows. Only where paths of an anchor
differ are they opened: the words at their coordinates are read again and their windows
meet one by one. Paths and windows are equal when anchor and content agree, two hashes of 64
bits each, and removal trusts them; verify() looks for the words of a span anywhere in its
source document, for audits.

A path that is cut at any place stays right, since equal windows have equal anchors. Long
texts are therefore read in segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerproof.llm.common import expand_rows, fresh, table
from ledgerproof.session import durable

WINDOW, ANCHOR = 50, 16
#: Words of a text that are hashed at a time.
SEGMENT = 1 << 16
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@cache
def _powers(n: int) -> tuple[np.ndarray, ...]:
    """Of each base the powers 0..n and those of its inverse, modulo 2**64."""
    out = []
    for base in _BASES:
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n + 1, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    return tuple(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Segment:
    """The windows of a run of words: their anchors, and hashes of any stretch."""

    def __init__(self, words: list[bytes], window: int = WINDOW, anchor: int = ANCHOR):
        n = len(words)
        self.window = window
        self.power, self.inverse, power2, self.inverse2 = _powers(SEGMENT + WINDOW)
        two = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(n, 2)
        first = np.concatenate([[np.uint64(0)], np.cumsum(two[:, 0] * self.power[:n])])
        self.second = np.concatenate([[np.uint64(0)], np.cumsum(two[:, 1] * power2[:n])])
        grams = _mixed((first[anchor:] - first[:-anchor]) * self.inverse[: n - anchor + 1])
        self.anchors = _sliding_least(grams, window - anchor + 1)

    def contents(self, starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Hashes of the words under so many windows from each start."""
        whole = (self.second[starts + windows + self.window - 1] - self.second[starts]) * self.inverse2[starts]
        return _mixed(whole ^ _mixed(windows.astype(np.uint64)))

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each path."""
        starts = np.flatnonzero(np.concatenate([[True], self.anchors[1:] != self.anchors[:-1]]))
        return starts, np.diff(starts, append=len(self.anchors))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    n = len(x) - width + 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span :])


def _segments(words: list[bytes]) -> Iterator[tuple[int, Segment]]:
    """Segments with their place; neighbours share WINDOW - 1 words, so each window is in one."""
    for at in range(0, len(words) - WINDOW + 1, SEGMENT):
        yield at, Segment(words[at : at + SEGMENT + WINDOW - 1])


def _rows(columns: list[tuple[str, np.ndarray | pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for _, c in columns], names=[n for n, _ in columns])


def paths(docs: DataFrame) -> DataFrame:
    """doc_id, part, start, windows, anchor, content of each path; part tells rows apart that share a doc_id."""

    def compute(chunk: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for doc, part, text in zip(*(chunk.column(c).to_pylist() for c in ("doc_id", "part", "text"))):
            for at, segment in _segments(text.encode().split()):
                starts, windows = segment.paths()
                n = len(starts)
                yield _rows(
                    [
                        ("doc_id", np.full(n, doc, np.int64)), ("part", np.full(n, part, np.int64)), ("start", (starts + at).astype(np.int32)), ("windows", windows.astype(np.int32)),
                        ("anchor", segment.anchors[starts].view(np.int64)), ("content", segment.contents(starts, windows).view(np.int64)),
                    ]
                )

    schema = "doc_id long, part long, start int, windows int, anchor long, content long"
    return expand_rows(_known(docs).filter("text is not null and doc_id is not null"), "text", _gathered(compute), schema)


def _known(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("part"), "text")


def _gathered(compute):
    """compute, with its small batches put together."""

    def run(chunk: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = list(compute(chunk))
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    return run


def _opened(docs: DataFrame, branching: DataFrame) -> DataFrame:
    """Every window of these paths: anchor, content, doc_id, part, start. The words come from docs again."""
    lists = branching.groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "windows")).alias("at"))

    def compute(chunk: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for doc, part, text, at in zip(*(chunk.column(c).to_pylist() for c in ("doc_id", "part", "text", "at"))):
            wanted = np.array([(x["start"], x["windows"]) for x in at], np.int64)
            for base, segment in _segments(text.encode().split()):
                own = wanted[(wanted[:, 0] >= base) & (wanted[:, 0] < base + SEGMENT)]
                if not len(own):
                    continue
                starts = np.concatenate([np.arange(s, s + w) for s, w in (own - [base, 0]).tolist()])
                n = len(starts)
                yield _rows(
                    [
                        ("anchor", segment.anchors[starts].view(np.int64)), ("content", segment.contents(starts, np.ones(n, np.int64)).view(np.int64)),
                        ("doc_id", np.full(n, doc, np.int64)), ("part", np.full(n, part, np.int64)), ("start", (starts + base).astype(np.int32)),
                    ]
                )

    return expand_rows(_known(docs).join(lists, ["doc_id", "part"]), "text", _gathered(compute), "anchor long, content long, doc_id long, part long, start int")


def repeated(docs: DataFrame) -> DataFrame:
    """Runs of windows that also start in a document with a smaller doc_id: doc_id, part, start,
    windows and the first such document, source_id. A run can follow another without a gap."""
    found = durable(paths(docs))
    across = found.groupBy("anchor").agg(F.min("doc_id").alias("source_id"), F.max("doc_id").alias("last"), F.min("content").alias("low"), F.max("content").alias("high"))
    across = across.filter("source_id < last").select("anchor", "source_id", (F.col("low") != F.col("high")).alias("branches"))
    met = durable(found.drop("content").join(across, "anchor").filter("branches or doc_id > source_id"))
    columns = ("doc_id", "part", "start", "windows", "source_id")
    straight = met.filter("not branches").select(*columns)
    opened = durable(_opened(docs, met.filter("branches").select("doc_id", "part", "start", "windows")))
    firsts = opened.groupBy("anchor", "content").agg(F.min("doc_id").alias("source_id"), F.max("doc_id").alias("last")).filter("source_id < last").drop("last")
    single = opened.join(firsts, ["anchor", "content"]).filter("doc_id > source_id").withColumn("windows", F.lit(1)).select(*columns)
    return straight.unionByName(single)


def stripped(docs: DataFrame, runs: DataFrame, kept: str = "kept", n_words: str = "n_words", n_removed: str = "n_removed") -> DataFrame:
    """doc_id, the words that stay joined by one space, and how many words there were and went.

    One row for each row of docs; a missing text has no words. The spans of a document come
    together with its text, so a task holds one document at a time.
    """
    lists = runs.groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "windows")).alias("at"))

    def compute(chunk: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        left, counts, gone = [], [], []
        for text, at in zip(chunk.column("text").to_pylist(), chunk.column("at").to_pylist()):
            words = text.encode().split() if text else []
            counts.append(len(words))
            if at:
                edges = np.zeros(len(words) + 1, np.int64)
                spans = np.array([(x["start"], x["start"] + x["windows"] + WINDOW - 1) for x in at], np.int64)
                np.add.at(edges, spans[:, 0], 1)
                np.add.at(edges, spans[:, 1], -1)
                cover = np.cumsum(edges[:-1]) > 0
                words = [w for w, c in zip(words, cover.tolist()) if not c]
            gone.append(counts[-1] - len(words))
            left.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(left, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", kept, n_words, n_removed])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField(kept, T.StringType()), T.StructField(n_words, T.LongType()), T.StructField(n_removed, T.LongType())])
    return expand_rows(_known(docs).join(lists, ["doc_id", "part"], "left"), "text", compute, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, kept, n_words, n_removed.

    A word goes if a window over it also starts in a document with a smaller doc_id; windows
    are judged on the texts as given. Repeats within a document stay, and so do those among
    rows that share a doc_id. A row without doc_id loses nothing and is no source. Texts of
    fewer words than a window, empty and missing ones stay as they are. Other columns are not read.
    """
    return stripped(docs, repeated(docs))


def verify(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """The runs whose words are nowhere in the document that they name as their source.

    Runs hold no place in the source: for audits, since it reads all texts twice more.
    """
    own, source = fresh(runs, "own", "source")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("part"), F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ").alias(own))
    named = runs.join(texts, ["doc_id", "part"]).withColumn(own, F.concat(F.lit(" "), F.array_join(F.slice(own, F.col("start") + 1, F.col("windows") + WINDOW - 1), " "), F.lit(" ")))
    sources = docs.select(F.col("doc_id").cast("long").alias("source_id"), F.concat(F.lit(" "), F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "), F.lit(" ")).alias(source))
    inside = named.join(sources, "source_id").groupBy(*runs.columns).agg(F.max(F.contains(source, own)).alias(own))
    return inside.filter(~F.col(own)).drop(own)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS key
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)
), repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) AS source FROM windows) WHERE source < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM repeats)),
placed AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS words, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
