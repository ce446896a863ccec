"""Exact duplicates by content sort, in DataFrame operations alone.

Normalised texts are range-partitioned by sampled splitters (first characters and a hash,
so that these stay small) and sorted on disk where they don't fit. Equal texts are then neighbours, and the window compares neighbouring texts in
full. Texts that a sample shows to be frequent are dealt by (text, salt), so that a group
of any share spreads over many splits; each split counts its rows and picks its best, and
only those few are compared again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from ledgerproof.llm.common import fresh, shuffle_width, table
from ledgerproof.session import durable

#: Rows sampled for each partition to find frequent texts. It steers the layout, never the result.
SAMPLE_ROWS = 64
#: Characters of a normalised text in a splitter.
HEAD = 16


def normalised(text: Column) -> Column:
    """The text without space, tab, line feed, vertical tab, form feed and carriage return; missing is empty."""
    text = F.coalesce(text, F.lit(""))
    for space in (" ", "\n", "\t", "\r", "\v", "\f"):
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def frequent_texts(docs: DataFrame, width: int) -> DataFrame:
    """Hashes of the texts that hold over a quarter of a partition's share in a sample, and
    into how many salts each is dealt. At most 4 * width rows, whatever the input."""
    rows = docs.count()
    share = min(1.0, SAMPLE_ROWS * width / max(1, rows))
    sampled = docs.select(F.xxhash64(normalised(F.col("text"))).alias("hash")).sample(share, seed=11)
    return (
        sampled.groupBy("hash").count()
        .filter(F.col("count") * 4 >= max(8.0, rows * share / width))
        .select("hash", F.least(F.lit(8 * width), F.ceil(F.col("count") * 8 * width / max(1.0, rows * share))).cast("int").alias("salts"))
    )


def _ranked(docs: DataFrame) -> tuple[DataFrame, list[str], bool]:
    """docs dealt and sorted by content, with the helper columns points, tie, norm, salt and place.

    place numbers the rows of one normalised text and salt, best first. Whole texts are
    shuffled once; the sort key is made again after the shuffle instead of being sent along.
    """
    spark, width = docs.sparkSession, shuffle_width(docs.sparkSession)
    names = points, tie, norm, salt, place, head, hashed = fresh(docs, "points", "tie", "norm", "salt", "place", "head", "hashed")
    # At most 4 * width rows, so each task looks a text's salts up.
    frequent = [(r["hash"], r["salts"]) for r in frequent_texts(docs, width).collect()]
    key = normalised(F.col("text"))
    # The splitters that the driver samples are short: first characters and a hash. Texts that differ may share both.
    short = [F.substring(key, 1, HEAD), F.xxhash64(key)]
    if frequent:
        (salts,) = fresh(docs, "salts")
        found = F.broadcast(spark.createDataFrame(frequent, T.StructType([T.StructField(hashed, T.LongType()), T.StructField(salts, T.IntegerType())])))
        docs = docs.withColumn(hashed, short[1]).join(found, hashed, "left")
        number = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col(salts)).cast("int"), F.lit(-1))
        docs = docs.withColumn(salt, number).drop(hashed, salts).repartitionByRange(width, *short, salt)
    else:
        docs = docs.repartitionByRange(width, *short).withColumn(salt, F.lit(-1))
    ranked = docs.withColumns({head: short[0], hashed: short[1], norm: key, points: F.char_length(F.coalesce("text", F.lit(""))), tie: F.xxhash64("text")})
    return ranked.withColumn(place, F.row_number().over(_best(names))), names, bool(frequent)


def _best(names: list[str], salted: bool = True) -> WindowSpec:
    points, tie, norm, salt, _, head, hashed = names
    return W.partitionBy(head, hashed, norm, *([salt] if salted else [])).orderBy(F.desc(points), F.asc_nulls_last("doc_id"), F.asc(tie))


def duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same without white space. The row with the most code
    points stays, then the smallest doc_id, then of rows that share both any one. A missing
    text is empty; a missing doc_id comes after all others. Other columns are not read.
    """
    local, names, split = _ranked(docs.select("doc_id", "text"))
    points, tie, norm, salt, place = names[:5]
    whole = _best(names).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    local = local.withColumns({"keep_id": F.first("doc_id").over(whole), "group_size": F.count(F.lit(1)).over(whole)}).select(
        "doc_id", "keep_id", "group_size", (F.col(place) == 1).alias("kept"), F.sha2(F.col(norm).cast("binary"), 256).alias("text_sha256"),
        points, tie, salt, F.when((F.col(salt) >= 0) & (F.col(place) == 1), F.col(norm)).alias(norm),
    )
    result = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    if not split:
        return local.select(*result)
    local = durable(local)
    rank = F.struct(F.negative(points), F.col("doc_id").isNull(), "doc_id", tie)
    # One row for each frequent text, as many as the salt table has at most.
    groups = local.filter(F.col(norm).isNotNull()).groupBy(norm).agg(
        F.min(rank).alias("best"), F.sum("group_size").alias("size"), F.first("text_sha256").alias("text_sha256")
    )
    merged = local.join(F.broadcast(groups.drop(norm)), "text_sha256", "left")
    return merged.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("keep_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", "group_size").alias("group_size"),
        (F.col("kept") & (F.col("best").isNull() | (rank == F.col("best")))).alias("kept"),
        "text_sha256",
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever else these are called."""
    columns = docs.columns
    local, names, split = _ranked(docs)
    norm, salt, place = names[2:5]
    local = local.filter(F.col(place) == 1)
    if not split:
        return local.select(*columns)
    local = durable(local)
    rest = local.filter(F.col(salt) >= 0).withColumn(place, F.row_number().over(_best(names, salted=False))).filter(F.col(place) == 1)
    return local.filter(F.col(salt) < 0).unionByName(rest).select(*columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""
