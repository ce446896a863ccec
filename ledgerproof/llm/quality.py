"""Quality by nearest-neighbour voting in a latent-semantic space.

The terms of a text are what it says and how it looks: words, as letter runs of four with a
mark where a word begins or ends, hashed; runs of one to three character classes (letters
by case, digits, white space, each punctuation mark); and words and lines that repeat. A bounded
sample of labelled documents gives term weights and, by singular value decomposition, the
latent axes. The sample's vectors and labels are broadcast; every document is compared with
all of them by exact cosines, in blocks, and its nearest vote with their similarity (of
neighbours at the very same similarity any may vote).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerproof.llm.common import append_columns, fresh, held_out, table

#: Labelled documents of each class that the model is fitted on at most, so it has a fixed size.
SAMPLE_PER_CLASS = 2000
GRAMS, LETTERS, AXES, NEIGHBOURS, BLOCK = 1024, 2048, 64, 15, 256
SHAPES = 64 + GRAMS
TERMS = SHAPES + LETTERS
#: Weight of a word's terms beside those of shape: there are more of them, and most differ by topic alone.
WORD_SHARE = 0.35
#: Rounds of subspace iteration and vectors beside the axes.
ROUNDS, SPARE = 6, 16
#: Votes of the base rate beside the neighbours' votes; a text without terms has only these.
PRIOR_VOTES = 0.05
THRESHOLD = 0.3
#: Terms for words that repeat the one before or the one before that, and lines that repeat.
REPEATS = 3


@cache
def _classes() -> np.ndarray:
    """The class of each UTF-16 unit: 0 lower, 1 upper, 2 digit, 3 space, 4 line feed, 5 other
    white space, 6 other letter, 7 other sign, 8 and up the ASCII punctuation marks."""
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    known = {" ": 3, "\n": 4} | {m: 8 + k for k, m in enumerate(marks)}
    kind = lambda c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 5 if c.isspace() else 6 if c.isalpha() else 7
    return np.array([known.get(chr(c), kind(chr(c))) for c in range(1 << 16)], np.uint32)


@cache
def _letters() -> np.ndarray:
    """Each UTF-16 unit in lower case if it is of a word (a letter, mark or digit), else 0."""
    low = lambda c: ord(c.lower()[0]) if len(c.lower()) == 1 else ord(c)
    return np.array([low(chr(c)) if chr(c).isalnum() or c >= 0xD800 and not chr(c).isspace() else 0 for c in range(1 << 16)], np.uint32)


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Logarithms of one plus the count of each term in each text."""
    out = np.zeros((len(texts), TERMS + REPEATS), np.float32)
    for row, text in zip(out, texts):
        if text:
            _count(text, row)
    return np.log1p(out)


def _count(text: str, row: np.ndarray) -> None:
    c = _classes()[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)]
    pair = c[1:] + (c[:-1] << np.uint32(6))
    triple = pair[1:] + (c[:-2] << np.uint32(12))
    row[:64] = np.bincount(c, minlength=64)
    for grams, factor in ((pair, 0x9E3779B1), (triple, 0x85EBCA77)):
        mixed = (grams + np.uint32(1)) * np.uint32(factor)
        row[64:SHAPES] += np.bincount((mixed ^ (mixed >> np.uint32(15))) & np.uint32(GRAMS - 1), minlength=GRAMS)
    low = np.concatenate([[np.uint32(0)], _letters()[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)], [np.uint32(0)] * 3])
    two = low[:-1] * np.uint32(0x9E3779B1) + low[1:]
    four = two[:-2] * np.uint32(0x85EBCA77) + two[2:]
    # Runs that begin in a word or at its edge.
    four = four[(low[:-3] > 0) | (low[1:-2] > 0)]
    mixed = (four ^ (four >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
    row[SHAPES:TERMS] = np.bincount((mixed ^ (mixed >> np.uint32(13))) & np.uint32(LETTERS - 1), minlength=LETTERS)
    words, lines = text.split(), text.split("\n")
    row[TERMS:] = sum(map(eq, words, words[1:])), sum(map(eq, words, words[2:])), len(lines) - len(set(lines))


@dataclass
class Model:
    weights: np.ndarray  # of terms
    axes: np.ndarray  # terms x axes
    vectors: np.ndarray  # labelled documents x axes, of length one
    labels: np.ndarray
    prior: float

    def vectors_of(self, counts: np.ndarray) -> np.ndarray:
        x = counts * self.weights
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        v = x @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Shares of the votes for label 1. All cosines of a block are computed; the nearest vote."""
        out = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(texts), BLOCK):
            block = texts[a : a + BLOCK]
            votes = ones = np.zeros(len(block))
            if k:
                v = self.vectors_of(term_counts(block))
                cosines = v @ self.vectors.T
                near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
                weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** 8
                votes, ones = weight.sum(axis=1), (weight * self.labels[near]).sum(axis=1)
            out[a : a + len(block)] = (ones + PRIOR_VOTES * self.prior) / (votes + PRIOR_VOTES)
        return out


def fit(texts: list[str | None], labels: list[int], prior: float) -> Model:
    """The model of these labelled texts; with none, every score is the prior."""
    return fit_counts(term_counts(texts), np.asarray(labels, np.float64), prior)


def latent_axes(x: np.ndarray, axes: int = AXES) -> np.ndarray:
    """The leading right singular vectors of x, by subspace iteration from fixed random vectors."""
    q = np.random.default_rng(3).normal(size=(x.shape[1], axes + SPARE))
    x = x.astype(np.float64)
    for _ in range(ROUNDS):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vectors = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ vectors.T)[:, :axes], np.float32)


def fit_counts(counts: np.ndarray, y: np.ndarray, prior: float) -> Model:
    n = len(counts)
    weights = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.2)
    weights[SHAPES:TERMS] *= np.float32(WORD_SHARE)
    x = counts * weights
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    model = Model(weights, latent_axes(x), np.zeros((n, AXES), np.float32), y, prior)
    model.vectors = model.vectors_of(counts).astype(np.float32)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """Text and label of at most per_class documents of each class, those of smallest id hash.

    Only labels of ids that aren't held out count. An id with both labels counts as 0; of
    rows that share an id the least text is taken. Missing ids and labels are left out.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(5, 0)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    wanted = [known.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    # At most 2 * per_class ids, so the texts stay where they are.
    return docs.select("doc_id", "text").join(F.broadcast(wanted[0].unionByName(wanted[1])), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Broadcast:
    """Fits the model on a bounded sample of labelled documents and broadcasts it.

    Terms are counted where the texts are; the driver gets a row of fixed width for each.
    """
    spark = docs.sparkSession

    def counted(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([row.tobytes() for row in term_counts(texts.to_pylist())], pa.binary())]

    sample = append_columns(labelled_sample(docs, labels, per_class), "text", counted, [("terms", T.BinaryType())]).select("doc_id", "label", "terms")
    read = sample.toArrow().sort_by("doc_id")
    counts = np.array([np.frombuffer(x, np.float32) for x in read["terms"].to_pylist()], np.float32).reshape(-1, TERMS + REPEATS)
    share = labels.filter(F.col("quality").isin(0, 1) & ~held_out(5, 0)).agg(F.avg("quality")).first()[0]
    return spark.sparkContext.broadcast(fit_counts(counts, np.asarray(read["label"], np.float64), 0.5 if share is None else float(share)))


def scored(docs: DataFrame, model: Broadcast, score: str) -> DataFrame:
    """docs and a score from 0 to 1 under this name; a text that is missing or empty has the base rate."""

    def compute(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(model.value.scores(texts.to_pylist()), pa.float64())]

    return append_columns(docs, "text", compute, [(score, T.DoubleType())])


def good_documents(docs: DataFrame, labels: DataFrame, training: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score the threshold or more, with all their columns; the model learns from training."""
    (score,) = fresh(docs, "score")
    return scored(docs, train(training, labels), score).filter(F.col(score) >= threshold).select(*docs.columns)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model, "score").drop("text")
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
