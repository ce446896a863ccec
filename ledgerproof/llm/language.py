"""Language by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything but letters becomes one space. Runs of one to three
characters are hashed into BUCKETS; the log-probabilities of buckets by language are one
matrix that is broadcast (BUCKETS x languages). The texts of a batch are scored one after the
other, each as the sum of the matrix rows of its n-grams. More languages than one matrix holds
are scored in blocks, a pass for each, which carry the best and the log-sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerproof.llm.common import expand_rows, fresh, held_out, table
from ledgerproof.session import durable

BUCKETS = 1 << 14
#: Documents of each language that are learnt from at most, and languages in one block: they bound a matrix.
SAMPLE_PER_LANGUAGE, MAX_LANGUAGES = 20_000, 400
SMOOTHING = 0.5
UNKNOWN = "und"
#: N-grams whose matrix rows are held at a time.
STEP = 1 << 18
_LETTER = r"\p{L}"


@cache
def _letters() -> np.ndarray:
    """Of each UTF-16 unit: itself if it is a letter or half of a pair, else a space."""
    return np.array([c if chr(c).isalpha() or 0xD800 <= c < 0xE000 else 32 for c in range(1 << 16)], np.uint32)


def hashed(text: str) -> np.ndarray:
    """The buckets of the text's n-grams, with one space at either end."""
    c = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-16-le", "surrogatepass"), np.uint16)]
    blank = c == 32
    c = c[~(blank & np.concatenate([[False], blank[:-1]]))]
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
    three = two[:-1] * np.uint32(0x85EBCA77) + c[2:]
    grams = np.concatenate([c, two, three]) * np.uint32(0xC2B2AE3D)
    return (grams ^ (grams >> np.uint32(15))) & np.uint32(BUCKETS - 1)


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_likelihood: np.ndarray  # buckets x languages

    def totals(self, texts: list[str | None], lettered: list[bool]) -> np.ndarray:
        """The joint log-probability of each text with each language."""
        totals = np.tile(self.log_prior, (len(texts), 1))
        for k, (text, has) in enumerate(zip(texts, lettered)):
            if has and self.languages:
                grams = hashed(text)
                for a in range(0, len(grams), STEP):
                    totals[k] += self.log_likelihood[grams[a : a + STEP]].sum(axis=0, dtype=np.float64)
        return totals

    def predict(self, texts: list[str | None], lettered: list[bool]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its posterior."""
        names, scores = [], []
        for row, has in zip(self.totals(texts, lettered), lettered):
            if not has or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(np.argmax(row))
            names.append(self.languages[best])
            scores.append(float(1 / np.exp(row - row[best]).sum()))
        return names, scores


def counted(docs: DataFrame) -> DataFrame:
    """lang and bucket with how many n-grams of the documents fall there, and lang, -1 with how many documents.

    Each task adds its own documents up, so the shuffle holds at most one row for each language and bucket of a task.
    """

    def compute(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, row in sums.items():
                (at,) = np.nonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.where(at < BUCKETS, at, -1), pa.int32()), pa.array(row[at])], names=["lang", "bucket", "n"])
            sums.clear()

        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
            row = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            row[:BUCKETS] += np.bincount(hashed(text or ""), minlength=BUCKETS)
            row[BUCKETS] += 1
            if len(sums) >= MAX_LANGUAGES:
                yield from told()
        yield from told()

    return expand_rows(docs.select("lang", "text"), "text", compute, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, learn, per_language: int = SAMPLE_PER_LANGUAGE, block: int = MAX_LANGUAGES) -> Broadcast | list[Broadcast]:
    """Learns from the rows of docs where the column `learn` holds and lang and text are there.

    Of a language with more than per_language such documents those with small id hashes are
    taken, about per_language of them. More than `block` languages make a list of models, in the
    order of names.
    """
    spark = docs.sparkSession
    usable = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in usable.select("lang").groupBy("lang").count().collect()}
    large = {lang: per_language / n for lang, n in sizes.items() if n > per_language}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    if large:
        share = F.coalesce(F.create_map(*(F.lit(x) for pair in large.items() for x in pair))[F.col("lang")], F.lit(1.0))
        usable = usable.filter(part < share)
    languages = sorted(sizes)
    rows = counted(usable)
    blocks = [languages[a : a + block] for a in range(0, len(languages), block)] or [[]]
    if len(blocks) > 1:
        rows = durable(rows)
    learnt = {r["lang"]: r["n"] for r in rows.filter("bucket < 0").collect()} if len(blocks) > 1 else {}
    models = []
    for names in blocks:
        counts = np.zeros((BUCKETS, len(names)))
        documents = np.zeros(len(names))
        place = {lang: k for k, lang in enumerate(names)}
        # One packed row for each language, of BUCKETS + 1 entries at most.
        inside = rows.filter(F.col("lang").between(names[0], names[-1])) if len(blocks) > 1 else rows
        packed = inside.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("entries")).toArrow().combine_chunks()
        for lang, entries in zip(packed["lang"].to_pylist(), packed["entries"]):
            buckets, n = (np.asarray(entries.values.field(c)) for c in ("bucket", "n"))
            counts[buckets[buckets >= 0], place[lang]] = n[buckets >= 0]
            documents[place[lang]] = n[buckets < 0].sum()
        smooth = counts + SMOOTHING
        everything = sum(learnt.values()) + len(languages) if learnt else (documents + 1).sum()
        prior = np.log((documents + 1) / everything) if names else np.zeros(0)
        models.append(spark.sparkContext.broadcast(Model(names, prior, np.log(smooth / smooth.sum(axis=0)).astype(np.float32))))
    return models if len(models) > 1 else models[0]


def _scored(docs: DataFrame, model: Broadcast, lettered: str, best: str, top: str, total: str) -> DataFrame:
    """docs with the best language so far, its joint log-probability and the log-sum of all so far."""
    more = best in docs.columns
    kept = [c for c in docs.columns if c not in (best, top, total)]

    def compute(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        block = model.value
        rows = block.totals(part.column("text").to_pylist(), part.column(lettered).to_pylist())
        at = rows.argmax(axis=1)
        tops = rows[np.arange(len(rows)), at]
        sums = tops + np.log(np.exp(rows - tops[:, None]).sum(axis=1))
        names = [block.languages[k] for k in at]
        if more:
            old = part.column(top).to_numpy(zero_copy_only=False)
            names = [a if x >= y else b for a, b, x, y in zip(part.column(best).to_pylist(), names, old, tops)]
            tops, sums = np.maximum(old, tops), np.logaddexp(part.column(total).to_numpy(zero_copy_only=False), sums)
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(names, pa.string()), pa.array(tops), pa.array(sums)], names=[*kept, best, top, total])

    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(best, T.StringType()), T.StructField(top, T.DoubleType()), T.StructField(total, T.DoubleType())])
    return expand_rows(docs, "text", compute, schema)


def identified(docs: DataFrame, model: Broadcast | list[Broadcast], lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the likeliest language of each whole text and its posterior, 0 to 1.

    Only the text is looked at. A text that is missing or has no letter is `und` with score
    0, and so is every text if there was nothing to learn from. Ties go to the first name.
    Names that docs has already get underscores ahead.
    """
    lang_pred, score, lettered = fresh(docs, lang_pred, score, "lettered")

    def compute(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, scores = model.value.predict(part.column("text").to_pylist(), part.column(lettered).to_pylist())
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, lang_pred, score])

    marked = docs.withColumn(lettered, F.coalesce(F.col("text").rlike(_LETTER), F.lit(False)))
    if isinstance(model, list):
        best, top, total = fresh(marked, "best", "top", "total")
        for k, one in enumerate(model):
            marked = _scored(durable(marked) if k else marked, one, lettered, best, top, total)
        has = F.col(lettered)
        return marked.withColumns({lang_pred: F.when(has, F.col(best)).otherwise(UNKNOWN), score: F.when(has, F.exp(F.col(top) - F.col(total))).otherwise(0.0)}).drop(lettered, best, top, total)
    schema = T.StructType([*marked.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return expand_rows(marked, "text", compute, schema).drop(lettered)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out(4, 2))
    return identified(docs.select("doc_id", "text"), model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
