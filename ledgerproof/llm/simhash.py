"""Near-duplicates by SimHash fingerprints.

Two bits make a segment, and a fingerprint's 32 segment bit counts (0 to 2) are its point
in a grid. The Manhattan distance of two points is at most the Hamming distance of the
fingerprints, so fingerprints at 2 or fewer differing bits have points at 2 or less and
differ in at most two segments. The 32 segments form six blocks; a grid cell fixes the
counts of four blocks, and one of the 15 cells of each point is shared by all such pairs.

A cell that two fingerprints share is their range join: the distance of the points, then of
the fingerprints is compared. A cell of more has no pairs made from it, since these grow
with the square. Its fingerprints are joined by their midpoints: two of them are at 2 or
fewer bits exactly when some word is at 1 or 0 bits from both, so each names the 65 words
around it and links to the smallest that names the same word. A word is named by 65
fingerprints at most, so this is linear and exact for groups of any size.
"""

from __future__ import annotations

from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerproof.llm.common import append_columns, fresh, table
from ledgerproof.llm.components import components
from ledgerproof.session import durable

SHINGLE = 3
_LOW = 0x5555555555555555
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = np.array([[v >> k & 1 for k in range(8)] for v in range(256)], np.int64)
#: First segment of each block, and the end of the last.
_BLOCKS = (0, 5, 10, 15, 20, 26, 32)


def fingerprint(text: str | None) -> int:
    """The signed fingerprint of the shingles, repeats included; 0 for a text without words."""
    found = text.encode().translate(_LOWER).split() if text else []
    if not found:
        return 0
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes).tolist()
    joined = b" ".join(found)
    last = (ends[SHINGLE - 1 :] - 1).tolist() or [len(joined)]
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, last)], np.uint64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, name: str) -> DataFrame:
    """docs and the fingerprint of each whole text under this name, a long."""

    def compute(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([fingerprint(t) for t in texts.to_pylist()], pa.int64())]

    return append_columns(docs, "text", compute, [(name, T.LongType())])


def segment_counts(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, two bits each in one long."""
    upper = F.shiftrightunsigned(fp, 1)
    one = fp.bitwiseXOR(upper).bitwiseAND(F.lit(_LOW))
    return F.shiftleft(fp.bitwiseAND(upper).bitwiseAND(F.lit(_LOW)), 1).bitwiseOR(one)


def manhattan(x: Column, y: Column) -> Column:
    """Distance of two points: a segment differs by one where its low bits differ, by two where only the high do."""
    differ = x.bitwiseXOR(y)
    low = differ.bitwiseAND(F.lit(_LOW))
    high = F.shiftrightunsigned(differ, 1).bitwiseAND(F.lit(_LOW))
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def cells(point: Column) -> Column:
    """The 15 cells of a point: which two blocks are left out, and the counts of the other four."""
    masks = [sum(3 << 2 * s for s in range(a, b)) for a, b in pairwise(_BLOCKS)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    whole = (1 << 64) - 1
    out = [F.struct(F.lit(k).cast("tinyint").alias("grid"), point.bitwiseAND(F.lit(signed(whole ^ masks[i] ^ masks[j]))).alias("cell")) for k, (i, j) in enumerate(combinations(range(6), 2))]
    return F.array(*out)


def _around(fp: Column) -> Column:
    """The word itself and the 64 words at one bit."""
    flips = [1 << k for k in range(63)] + [-(1 << 63)]
    return F.array(fp, *(fp.bitwiseXOR(F.lit(m)) for m in flips))


def links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """Links a, b that connect all distinct fingerprints at 2 or fewer differing bits.

    Each link is between two at 2 or fewer bits, or between two that a third is near to in
    the same way; components are those of all such pairs.
    """
    placed = distinct.select(F.col(fp).alias("fp"), F.explode(cells(segment_counts(F.col(fp)))).alias("at")).select("fp", "at.grid", "at.cell")
    shared = durable(placed.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
    a, b = F.col("a"), F.col("b")
    pairs = shared.filter("n = 2").filter(manhattan(segment_counts(a), segment_counts(b)) <= 2).filter(F.bit_count(a.bitwiseXOR(b)) <= 2).select("a", "b")
    crowded = placed.join(shared.filter("n > 2").select("grid", "cell"), ["grid", "cell"], "left_semi").select("fp").distinct()
    named = crowded.select("fp", F.explode(_around(F.col("fp"))).alias("word"))
    # At most 65 fingerprints name a word, so the list is bounded.
    met = named.groupBy("word").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).filter("a <> b").select("a", "b")
    return pairs.unionByName(stars).distinct()


def groups(prints: DataFrame, fp: str) -> DataFrame:
    """For each distinct fingerprint: its component_id, the smallest doc_id of its component."""
    distinct = durable(prints.groupBy(F.col(fp).alias("fp")).agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct)).withColumnsRenamed({"node": "fp"})
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits) and component_id.

    A missing text and one without words have fingerprint zero, which links like any other.
    A missing doc_id is never a component's smallest unless the component has no other; rows
    that share a doc_id each keep their row. Other columns are not read.
    """
    (fp,) = fresh(docs, "fp")
    prints = durable(fingerprints(docs.select("doc_id", "text"), fp).drop("text"))
    found = groups(prints, fp)
    return prints.join(found.withColumnRenamed("fp", fp), fp, "left").select(
        "doc_id", F.lower(F.lpad(F.hex(fp), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs of which the doc_id is the smallest of its component, with all columns.

    Rows that share such a doc_id all stay, and so do components without any doc_id.
    """
    (fp,) = fresh(docs, "fp")
    prints = durable(fingerprints(docs.select("doc_id", "text"), fp).drop("text"))
    found = groups(prints, fp).select(F.col("fp").alias(fp), "component_id")
    stay = prints.join(found, fp).filter("doc_id = component_id or component_id is null").select("doc_id").distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["doc_id"]), "left_semi")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
