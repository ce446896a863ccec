"""Token counts by source, language and tokenizer version, kept by signed deltas.

A ledger is a folder with one folder for each batch: the counts of documents that the batch
brought or changed, and the additive totals of what it changed (new minus old, and minus the
old where a document went). The totals are the sum of the committed batches' deltas, so a
batch costs what it holds, apart from looking its documents up among the narrow rows of
earlier counts; no text is read again. A batch is committed by the success marker that Spark writes after its last file;
a batch id that is committed already is left alone, and one that was broken off is written anew.
"""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerproof.llm import bpe
from ledgerproof.llm.common import table
from ledgerproof.session import scratch_path

KEYS = ("source", "lang", "tokenizer")
STATE = "doc_id long, source string, lang string, tokenizer string, tokens long, batch int"
DELTA = "source string, lang string, tokenizer string, documents long, tokens long"


def tokenizers() -> dict[str, Column]:
    """Versions that SQL can say, words and four bytes a token, and their counts of the column
    text; a missing text has none. Any other count is a column of the same kind."""
    text = F.coalesce("text", F.lit(""))
    return {
        "words-1": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
        "bytes4-1": F.ceil(F.octet_length(text) / 4).cast("long"),
    }


def counted(docs: DataFrame, versions: dict[str, Column]) -> DataFrame:
    """doc_id, source, lang, tokenizer and tokens: a row for each document and version."""
    each = [F.struct(F.lit(name).alias("tokenizer"), count.alias("tokens")) for name, count in versions.items()]
    return docs.select("doc_id", "source", "lang", F.explode(F.array(*each)).alias("count")).select("doc_id", "source", "lang", "count.*")


def bpe_counted(docs: DataFrame, vocabulary: Broadcast, name: str) -> DataFrame:
    """The same rows for a byte-level BPE vocabulary: the ids that `bpe.encode` gives each whole text."""
    coded = bpe.encode(docs.select("doc_id", "source", "lang", "text"), vocabulary, ids="ids")
    return coded.select("doc_id", "source", "lang", F.lit(name).alias("tokenizer"), F.size("ids").cast("long").alias("tokens"))


class Ledger:
    """The batches in a folder that all executors reach.

    `compact` writes the counts that hold after a batch once more as one base, so that later
    commits look documents up in the newest base and the few batches after it.

    A document is known by (doc_id, tokenizer); of rows of one batch that share both, the one
    with the largest (tokens, source, lang) counts. A missing source or language is a group
    of its own. Rows without doc_id are left out, since nothing could revise them. Deleting
    what isn't there changes nothing. Other columns are not read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def batches(self, kind: str = "delta") -> list[int]:
        """Committed batch ids, in order; of kind "base" those after which there is a base."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = (f.getPath().getName() for f in fs.listStatus(at))
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and self._exists(f"{self.path}/{kind}/{n}/_SUCCESS"))

    def _read(self, kind: str, schema: str, batches: list[int]) -> DataFrame:
        parts = [f"{self.path}/{kind}/batch={b}" for b in batches]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def current(self, only: DataFrame | None = None) -> DataFrame:
        """The counts that hold: of each document and tokenizer those of the last batch that has
        it; of the doc_ids in `only`, if given."""
        done, bases = self.batches(), self.batches("base")
        state = self._read("state", STATE, [b for b in done if not bases or b > bases[-1]])
        if bases:
            state = state.unionByName(self._read("base", STATE, bases[-1:]))
        if only is not None:
            state = state.join(only, "doc_id", "left_semi")
        last = F.max_by(F.struct("source", "lang", "tokens"), "batch").alias("last")
        return state.groupBy("doc_id", "tokenizer").agg(last).select("doc_id", "tokenizer", "last.*").filter("tokens is not null")

    def commit(self, batch: int, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Adds a batch of new or revised counts and of deleted doc_ids (all their tokenizers).

        Batch ids rise. False, and nothing done, if the batch is committed already. A document
        both in upserts and deletes of one batch is deleted.
        """
        done = self.batches()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError("batch ids must rise")
        touched = [x.select("doc_id") for x in (upserts, deletes) if x is not None]
        if not touched:
            touched = [self.spark.createDataFrame([], "doc_id long")]
        old = self.current(touched[0].unionByName(touched[-1])).select("doc_id", "tokenizer", F.struct("source", "lang", "tokens").alias("old"))
        empty = self.spark.createDataFrame([], STATE)
        new = (upserts or empty).filter("doc_id is not null").groupBy("doc_id", "tokenizer").agg(F.max(F.struct("tokens", "source", "lang")).alias("new"))
        gone = (deletes.select("doc_id").filter("doc_id is not null").distinct() if deletes is not None else empty.select("doc_id")).withColumn("gone", F.lit(True))
        joined = old.join(new, ["doc_id", "tokenizer"], "full").join(gone, "doc_id", "left")
        changed = joined.filter("gone or new is not null").filter("old is not null or gone is null")
        after = lambda c: F.when(F.col("gone").isNull(), F.col(f"new.{c}"))
        state = changed.select("doc_id", after("source").alias("source"), after("lang").alias("lang"), "tokenizer", after("tokens").alias("tokens"), F.lit(batch).alias("batch"), "old")
        state.write.mode("overwrite").parquet(f"{self.path}/state/batch={batch}")
        written = self.spark.read.parquet(f"{self.path}/state/batch={batch}")
        plus = written.filter("tokens is not null").select(*KEYS, F.lit(1).alias("documents"), "tokens")
        minus = written.filter("old is not null").select("old.source", "old.lang", "tokenizer", F.lit(-1).alias("documents"), F.negative("old.tokens").alias("tokens"))
        sums = plus.unionByName(minus).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        # The marker of this folder commits the batch.
        sums.filter("documents <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch}")
        return True

    def compact(self) -> None:
        """Writes the counts that hold now as the base; broken off, it changes nothing and can be done again."""
        done = self.batches()
        if done and done[-1] not in self.batches("base"):
            self.current().withColumn("batch", F.lit(done[-1])).write.mode("overwrite").parquet(f"{self.path}/base/batch={done[-1]}")

    def totals(self) -> DataFrame:
        """Documents and tokens of each source, language and tokenizer version that has any."""
        deltas = self._read("delta", DELTA, self.batches())
        return deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents > 0")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals after four batches over the whole table: all documents, then those with an id
    divisible by 7 deleted and those with rest 1 counted again without their last 100
    characters, then the second batch once more, then the deleted with rest 0 modulo 14 back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    ledger = Ledger(spark, scratch_path(spark, "token-ledger"))
    ledger.commit(1, counted(docs, tokenizers()))
    shorter = docs.filter("doc_id % 7 = 1").withColumn("text", F.expr("substring(text, 1, greatest(char_length(text) - 100, 0))"))
    for _ in range(2):
        ledger.commit(2, counted(shorter, tokenizers()), docs.filter("doc_id % 7 = 0"))
    ledger.commit(3, counted(docs.filter("doc_id % 14 = 0"), tokenizers()))
    return ledger.totals()


OP7_SQL = r"""
WITH d AS (
  SELECT source, lang, CASE WHEN doc_id % 7 = 1 THEN substring(text, 1, greatest(length(text) - 100, 0)) ELSE coalesce(text, '') END AS text
  FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 14 = 0
), c AS (
  SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM d
  UNION ALL
  SELECT source, lang, 'bytes4-1', CAST(ceil(strlen(coalesce(text, '')) / 4.0) AS BIGINT) FROM d
)
SELECT source, lang, tokenizer, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens FROM c GROUP BY ALL
"""
