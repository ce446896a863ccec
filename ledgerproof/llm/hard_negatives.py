"""Hard negatives by a secondary-sort shuffle.

Each anchor's scores against all rows are whole numbers, made in blocks of anchors by blocks of
rows. A pair's key packs (anchor, descending score, positives first, row id) into bytes that
sort in that order; pairs are dealt by anchor and sorted inside each partition, on disk where
they don't fit. One pass over a sorted partition then opens a window at each positive and hands the
negatives that follow to the open windows, which close when they are full or the score is
below their floor. It keeps the open windows of one anchor, never its rows.

Only pairs that can be in the result are shuffled. A first pass over the rows finds each
anchor's positives: a task keeps its best few for each anchor, which is exact. The second
pass knows the windows, so a task keeps the first few negatives in each. A task therefore
sends a fixed number of pairs for each anchor, however its labels and ties fall.

Anchors go to the tasks in blocks of at most BLOCK_VALUES components, one broadcast after the
other; rows are read where they lie. Components that are too large for exact sums of doubles
are multiplied as Python's whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerproof.llm.common import table
from ledgerproof.session import durable

POSITIVES, NEGATIVES = 5, 5
#: A negative's score is from this share (in hundredths) of the positive's score up to all of it.
FLOOR = 80
#: Parts of one that a component is rounded down to.
STEPS = 256
#: Components of the anchors that are broadcast at a time (8 bytes each).
BLOCK_VALUES = 1 << 21
#: Rows, and anchors, of one product.
TILE_ROWS, TILE_ANCHORS = 4096, 512
#: Candidates that a task gathers before it keeps the best of them.
GATHERED = 1 << 20
_EXACT, _LONG = float(1 << 52), (1 << 63) - 1
PAIR = "anchor long, key binary, id long, score long, positive boolean"


def whole_numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and components, rounded down to steps, of the rows that take part.

    Left out are rows without an id, label or vector, or with a component that is missing or
    not finite. Shorter vectors are filled up with zeros.
    """
    vectors = batch.column("vector")
    offsets = np.asarray(vectors.offsets)
    values = np.asarray(vectors.values.cast(pa.float64()).fill_null(np.nan), np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])[offsets]
    use = (bad[1:] == bad[:-1]) & ~np.asarray(vectors.is_null())
    for name in ("id", "label"):
        use &= ~np.asarray(batch.column(name).is_null())
    rows = np.flatnonzero(use)
    starts, lengths = offsets[:-1][rows], np.diff(offsets)[rows]
    out = np.zeros((len(rows), int(lengths.max(initial=0))))
    at = np.repeat(np.arange(len(rows)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[at] = np.floor(values[np.repeat(starts, lengths) + at[1]] * STEPS)
    return (*(np.asarray(batch.column(n).fill_null(0), np.int64)[rows] for n in ("id", "label")), out)


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers; beyond the range of longs they are its ends."""
    width = min(anchors.shape[1], rows.shape[1])
    anchors, rows = anchors[:, :width], rows[:, :width]
    if np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * max(1, width) < _EXACT:
        return (anchors @ rows.T).astype(np.int64)
    exact = _whole(anchors) @ _whole(rows).T if width else np.zeros((len(anchors), len(rows)), object)
    return np.clip(exact, -_LONG, _LONG).astype(np.int64)


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n of each group, by descending score, then id."""
    order = np.lexsort([ids, -score, group])
    ordered = group[order]
    begins = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(order) else np.zeros(0, bool)
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))
    return order[place < n]


def _tile_best(score: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and row of the first n allowed rows of each anchor. Rows are in order of their ids."""
    rows = score.shape[1]
    if not score.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if rows <= n or np.count_nonzero(allowed) * 50 < allowed.size or np.abs(score).max() >= (1 << 62) // rows:
        anchor, row = np.nonzero(allowed)
        best = _first(anchor, score[anchor, row], row, n)
        return anchor[best], row[best]
    # A key that is different for each row of an anchor, so that a partition finds the very first n.
    key = np.where(allowed, score * rows + (rows - 1 - np.arange(rows)), np.iinfo(np.int64).min)
    row = np.argpartition(key, rows - n, axis=1)[:, rows - n :]
    anchor = np.repeat(np.arange(len(score)), n)
    row = row.ravel()
    real = allowed[anchor, row]
    return anchor[real], row[real]


def packed(anchor: np.ndarray, score: np.ndarray, positive: np.ndarray, ids: np.ndarray) -> pa.Array:
    """25 bytes a pair that sort by anchor, descending score, positives first, id."""
    out = np.empty(len(anchor), np.dtype([("a", ">u8"), ("s", ">u8"), ("p", "u1"), ("i", ">u8")]))
    shift = np.uint64(1 << 63)
    out["a"], out["i"] = anchor.astype(np.int64).view(np.uint64) ^ shift, ids.astype(np.int64).view(np.uint64) ^ shift
    out["s"], out["p"] = ~(score.astype(np.int64).view(np.uint64) ^ shift), ~positive.astype(bool)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(25), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


class Best:
    """The best few of each group so far; of what is gathered never more than GATHERED, or what is kept."""

    def __init__(self, n: int):
        self.n, self.parts, self.size, self.kept = n, [], 0, 0

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((group, score, ids))
        self.size += len(group)
        if self.size - self.kept > max(GATHERED, self.kept):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, score, ids = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in self.parts)]) for k in range(3))
        best = _first(group, score, ids, self.n)
        self.parts, self.size, self.kept = [(group[best], score[best], ids[best])], len(best), len(best)
        return self.parts[0]


def _tiles(batches: Iterator[pa.RecordBatch], anchors: np.ndarray) -> Iterator[tuple]:
    """First anchor, scores, ids and labels of each tile; rows in order of their ids."""
    for batch in batches:
        ids, labels, vectors = whole_numbers(batch)
        for r in range(0, len(ids), TILE_ROWS):
            order = r + np.argsort(ids[r : r + TILE_ROWS], kind="stable")
            for a in range(0, len(anchors), TILE_ANCHORS):
                yield a, scores(anchors[a : a + TILE_ANCHORS], vectors[order]), ids[order], labels[order]


def _pairs(anchor_ids: np.ndarray, group: np.ndarray, score: np.ndarray, ids: np.ndarray, positive: bool) -> pa.RecordBatch:
    anchor, flags = anchor_ids[group], np.full(len(group), positive)
    columns = [pa.array(anchor), packed(anchor, score, flags, ids), pa.array(ids), pa.array(score), pa.array(flags)]
    return pa.RecordBatch.from_arrays(columns, names=["anchor", "key", "id", "score", "positive"])


def _positives(rows: DataFrame, block, n: int) -> DataFrame:
    """The first n rows of the anchor's label that each task has, for each anchor of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, anchor_labels, vectors = block.value
        best = Best(n)
        for a, score, ids, labels in _tiles(batches, vectors):
            here = slice(a, a + len(score))
            anchor, row = _tile_best(score, (anchor_labels[here, None] == labels) & (anchor_ids[here, None] != ids), n)
            best.add(a + anchor, score[anchor, row], ids[row])
        yield _pairs(anchor_ids, *best.settle(), True)

    return rows.mapInArrow(run, PAIR)


def _negatives(rows: DataFrame, block, windows, n: int, floor: int) -> DataFrame:
    """The first n rows of other labels that each task has, in each window of each anchor of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, anchor_labels, vectors = block.value
        tops, known = windows.value
        width = tops.shape[1]
        lows = (-(-_whole(tops) * floor // 100)).astype(np.int64)  # rounded up: scores are whole
        best = Best(n)
        for a, score, ids, labels in _tiles(batches, vectors):
            here = slice(a, a + len(score))
            other = (anchor_labels[here, None] != labels) & (anchor_ids[here, None] != ids)
            for w in range(width):
                allowed = other & known[here, w, None] & (score <= tops[here, w, None]) & (score >= lows[here, w, None])
                some = np.flatnonzero(allowed.any(axis=1))
                anchor, row = _tile_best(score[some], allowed[some], n)
                best.add((a + some[anchor]) * width + w, score[some[anchor], row], ids[row])
        group, score, ids = best.settle()
        # A row in several windows is one pair; a row that is there twice is two.
        copy = np.arange(len(group)) - _run_starts(group, score, ids)
        one = np.unique(np.stack([group // max(1, width), score, ids, copy], axis=1), axis=0)
        yield _pairs(anchor_ids, one[:, 0], one[:, 1], one[:, 2], False)

    return rows.mapInArrow(run, PAIR)


def _run_starts(*columns: np.ndarray) -> np.ndarray:
    """For each place where the run of equal rows that holds it begins."""
    n = len(columns[0])
    begins = np.ones(n, bool)
    if n:
        begins[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.maximum.accumulate(np.where(begins, np.arange(n), 0))


def _sorted_by_anchor(pairs: DataFrame) -> DataFrame:
    """The secondary sort: dealt by anchor, in order of the packed key inside each partition."""
    return pairs.repartition("anchor").sortWithinPartitions("key")


def _leading(pairs: DataFrame, n: int) -> DataFrame:
    """The first n pairs of each anchor, from a sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            anchors = np.asarray(batch.column("anchor"))
            begins = np.concatenate([[len(anchors) > 0 and anchors[0] != last], anchors[1:] != anchors[:-1]])[: len(anchors)]
            at = np.arange(len(anchors))
            start = np.maximum.accumulate(np.where(begins, at, -1))
            place = np.where(start >= 0, at - start, at + seen)
            if len(at):
                last, seen = anchors[-1], int(place[-1]) + 1
            yield batch.filter(pa.array(place < n))

    return _sorted_by_anchor(pairs).mapInArrow(run, PAIR)


def mined(pairs: DataFrame, positives: int, negatives: int, floor: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from the stream of sorted pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened, windows = None, 0, []
        for batch in batches:
            out: list[tuple] = []
            for anchor, row, score, positive in zip(*(batch.column(c).to_pylist() for c in ("anchor", "id", "score", "positive"))):
                if anchor != now:
                    now, opened, windows = anchor, 0, []
                if positive:
                    if opened < positives:
                        windows.append([row, score, 0])
                    opened += 1
                    continue
                windows = [w for w in windows if w[2] < negatives and 100 * score >= floor * w[1]]
                for w in windows:
                    w[2] += 1
                    out.append((anchor, w[0], w[2], row, w[1], score))
            columns = zip(*out) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return _sorted_by_anchor(pairs).mapInArrow(run, schema)


def _gathered(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of a block of anchors, one for each id: the one of least label, then vector."""
    read = rows.toArrow().combine_chunks()
    if not read.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0))
    ids, labels, vectors = whole_numbers(read.to_batches()[0])
    order = np.lexsort([*vectors.T[::-1], labels, ids])
    first = order[np.concatenate([[True], np.diff(ids[order]) != 0])[: len(order)]]
    return ids[first], labels[first], vectors[first]


def _windows(found: DataFrame, anchor_ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of each anchor's positives, and which of the n there are. Bounded by the block."""
    read = found.select("anchor", "score").toArrow()
    tops, known = np.zeros((len(anchor_ids), n), np.int64), np.zeros((len(anchor_ids), n), bool)
    at = np.searchsorted(anchor_ids, np.asarray(read["anchor"]))
    order = np.argsort(at, kind="stable")
    at, score = at[order], np.asarray(read["score"])[order]
    place = np.arange(len(at)) - _run_starts(at)
    tops[at, place], known[at, place] = score, True
    return tops, known


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, floor: int = FLOOR, block_values: int = BLOCK_VALUES
) -> DataFrame:
    """For each anchor and each of its first positives, the first hard negatives.

    rows and anchors have id, label and vector. Positives are other rows of the anchor's
    label, negatives rows of another label whose score is from floor hundredths of the positive's
    score up to all of it; both come by descending score, then id. rank counts a positive's
    negatives from 1.

    Rows without an id, label or vector, or with a missing or infinite component, take no part;
    shorter vectors are filled up with zeros. Rows with the anchor's id are no other rows. Of
    anchors that share an id the one of least label, then vector, is used; repeated rows count
    each time. Other columns are not read.
    """
    spark = rows.sparkSession
    rows, anchors = (t.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector")) for t in (rows, anchors))
    anchors = durable(anchors.filter("id is not null"))
    values = anchors.agg(F.sum(F.size("vector"))).first()[0] or 0
    blocks = max(1, -(-values // block_values))
    results: list[DataFrame] = []
    for b in range(blocks):
        block = _gathered(anchors.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b))
        sent = spark.sparkContext.broadcast(block)
        found = durable(_leading(_positives(rows, sent, positives), positives))
        windows = spark.sparkContext.broadcast(_windows(found, block[0], positives))
        pairs = found.unionByName(_negatives(rows, sent, windows, negatives, floor))
        results.append(durable(mined(pairs, positives, negatives, floor)))
        sent.destroy(), windows.destroy()
    return reduce(DataFrame.unionByName, results)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = table(spark, sf_dir, "embeddings")
    # The query's planted wrong labels.
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = read.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(rows, rows.filter(F.col("id") % 100 == 0))


OP13_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, e.vec_id AS id, CAST(list_dot_product(a.v, e.v) AS BIGINT) AS score, a.label = e.label AS positive
  FROM e a JOIN e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE positive
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT * FROM (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
         id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN pairs USING (anchor_id)
  WHERE NOT positive AND 80 * positive_score <= 100 * score AND score <= positive_score
) WHERE rank <= 5
"""
