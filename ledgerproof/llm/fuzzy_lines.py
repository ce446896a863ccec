"""Near-duplicate lines by MinHash.

A line's normal form is lower-cased with white space runs as one space. Its shingles are all
runs of SHINGLE characters; a shorter line is one shingle. Lines are near at a Jaccard
similarity of SIMILAR or more of their shingle sets. BANDS bands of ROWS hashes each find
candidates: at similarity 0.8 a pair shares a band with probability 1 - (1 - 0.8**5)**16,
over 0.998, and higher above. All links are compared exactly.

In a band's bucket every line is first compared with one of it, so a bucket of any size is
linear. Linked lines are one component then. The lines of buckets that still hold several
components meet by prefix filtering: shingles are ordered by how rare they are among these
lines, and a line looks for partners by its rarest ones only, as many as near lines can't
all differ in. That leaves out no near pair, and lines that have only common text in common
never meet. Shingles that stand in the same lines as a rarer one bring no lines together that
it doesn't, so they are left out. Where many lines share a rare shingle they are first compared
with a few of them, and only pairs of different components are compared after that. Components of all links are then found by star contraction, and of each
component the first line in order of doc_id stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerproof.llm.common import expand_rows, table
from ledgerproof.llm.components import components
from ledgerproof.session import durable

SHINGLE, SIMILAR = 8, 0.8
BANDS, ROWS = 16, 5
#: Hash classes of shingles that are counted to tell rare ones.
COUNTERS = 1 << 18
#: Lines with a shingle above which they are first compared with HUBS of them.
CROWD, HUBS = 16, 3
#: Shingles hashed at a time, and pairs compared at a time.
BLOCK, PAIRS = 1 << 16, 2000  # two lines of each pair have places of 12 bits


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of these normal forms in a row, and where each line's start."""
    text = "".join(s if len(s) >= SHINGLE else s.ljust(SHINGLE, "\0") for s in lines)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    two = c[:-1] * base + c[1:]
    four = two[:-2] * base**2 + two[2:]
    eight = four[:-4] * base**4 + four[4:]
    sizes = np.maximum(np.fromiter(map(len, lines), np.int64, len(lines)), SHINGLE)
    ends = np.cumsum(sizes)
    inside = np.ones(len(c), bool)
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    mixed = (eight ^ (eight >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32)))[inside[: len(mixed)]], np.concatenate([[0], np.cumsum(sizes - SHINGLE + 1)])


def near(left: list[str], right: list[str]) -> list[bool]:
    """For each pair of normal forms: is the Jaccard similarity of their shingle sets SIMILAR or more?"""
    out: list[bool] = []
    for k in range(0, len(left), PAIRS):
        out += _near(left[k : k + PAIRS], right[k : k + PAIRS])
    return out


def _near(left: list[str], right: list[str]) -> list[bool]:
    """At most PAIRS pairs. A shingle of a pair is one number, the pair's place above 52 bits of
    the hash; numbers that occur on both sides are what the two lines have in common."""
    place = {s: k for k, s in enumerate(dict.fromkeys([*left, *right]))}
    hashes, starts = shingles(list(place))
    line = np.repeat(np.arange(len(place)), np.diff(starts))
    own = np.sort((line.astype(np.uint64) << np.uint64(52)) | (hashes >> np.uint64(12)))
    own = own[np.concatenate([[True], own[1:] != own[:-1]])]
    sizes = np.bincount((own >> np.uint64(52)).astype(np.int64), minlength=len(place))
    begins = np.cumsum(sizes) - sizes
    p, q = (np.fromiter(map(place.__getitem__, side), np.int64, len(side)) for side in (left, right))
    # Lines of too different lengths need no comparison.
    compared = np.flatnonzero(np.minimum(sizes[p], sizes[q]) >= SIMILAR * np.maximum(sizes[p], sizes[q]))
    both = np.zeros(len(left), np.int64)
    if len(compared):
        lines = np.concatenate([p[compared], q[compared]])
        n = sizes[lines]
        at = np.repeat(begins[lines] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair = np.repeat(np.concatenate([compared, compared]), n).astype(np.uint64)
        met = np.sort((pair << np.uint64(52)) | (own[at] & np.uint64((1 << 52) - 1)))
        twice = met[1:][met[1:] == met[:-1]] >> np.uint64(52)
        both = np.bincount(twice.astype(np.int64), minlength=len(left))
    return (both >= SIMILAR * (sizes[p] + sizes[q] - both)).tolist()


@cache
def _factors() -> np.ndarray:
    return np.random.default_rng(7).integers(1 << 20, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)


def band_keys(lines: list[str]) -> np.ndarray:
    """The bucket of each of these normal forms in each band: lines x BANDS, all bands apart."""
    hashes, starts = shingles(lines)
    hashes = hashes.astype(np.uint32)
    least = np.empty((BANDS * ROWS, len(lines)), np.uint32)
    # Lines are taken in groups that stay in the processor's cache.
    group = starts[:-1] // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lines)]
    for a, b in zip(cuts, cuts[1:]):
        own, at = hashes[starts[a] : starts[b]], starts[a:b] - starts[a]
        product = np.empty_like(own)
        for k, factor in enumerate(_factors()):
            np.multiply(own, factor, out=product)
            np.minimum.reduceat(product, at, out=least[k, a:b])
    keys = np.empty((len(lines), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(lines), band + 1, np.uint64)
        for row in least[band * ROWS : (band + 1) * ROWS]:
            key = (key ^ row) * np.uint64(0x94D049BB133111EB)
            key ^= key >> np.uint64(31)
        keys[:, band] = key
    return keys.view(np.int64)


def _known(docs: DataFrame) -> DataFrame:
    """Rows that take part, and `part`, which tells those apart that share a doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("part"), "text").filter("doc_id is not null and text is not null")


def _two(lines: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.encode()) for s in lines), np.int64).reshape(-1, 2)


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, part, line (from 0) and two hashes of the normal form for each line that isn't blank."""

    def compute(chunk: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        docs_, parts, at, forms = [], [], [], []
        for doc, part, text in zip(*(chunk.column(c).to_pylist() for c in ("doc_id", "part", "text"))):
            for k, line in enumerate(text.split("\n")):
                if form := normal(line):
                    docs_.append(doc)
                    parts.append(part)
                    at.append(k)
                    forms.append(form)
        two = _two(forms)
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs_, pa.int64()), pa.array(parts, pa.int64()), pa.array(at, pa.int32()), pa.array(two[:, 0]), pa.array(two[:, 1])], names=["doc_id", "part", "line", "h", "g"]
        )

    return expand_rows(_known(docs), "text", compute, "doc_id long, part long, line int, h long, g long")


def _banded(docs: DataFrame) -> DataFrame:
    """Bucket and line hash, once for each chunk of texts that has the line."""

    def compute(chunk: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        forms = list({f for text in chunk.column("text").to_pylist() for line in text.split("\n") if (f := normal(line))})
        if forms:
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(forms).ravel()), pa.array(np.repeat(_two(forms)[:, 0], BANDS))], names=["key", "h"])

    return expand_rows(_known(docs).select("text"), "text", compute, "key long, h long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, h and normal form of these lines, read again at the coordinates of their first occurrence."""
    lists = wanted.groupBy("doc_id", "part").agg(F.collect_list(F.struct("line", "id", "h")).alias("at"))

    def compute(chunk: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, hs, forms = [], [], []
        for text, at in zip(chunk.column("text").to_pylist(), chunk.column("at").to_pylist()):
            lines = text.split("\n")
            ids += (x["id"] for x in at)
            hs += (x["h"] for x in at)
            forms += (normal(lines[x["line"]]) for x in at)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(forms, pa.string())], names=["id", "h", "form"])

    return expand_rows(_known(docs).join(lists, ["doc_id", "part"]), "text", compute, "id long, h long, form string")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs a, b of line ids that are near, with the other columns of pairs."""
    told = texts.select(F.col("id").alias("a"), F.col("form").alias("x"))
    both = pairs.join(told, "a").join(told.toDF("b", "y"), "b").select(*pairs.columns, "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PAIRS):
                part = batch.slice(k, PAIRS)
                keep = near(part.column("x").to_pylist(), part.column("y").to_pylist())
                yield pa.RecordBatch.from_arrays(part.columns[:-2], names=part.schema.names[:-2]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, pairs.schema)


def _shared_buckets(dealt: DataFrame) -> DataFrame:
    """key, h and hub (one of the bucket's lines) of buckets with several lines; a line can be there twice.

    One pass over rows that are sorted by bucket: the first line of a bucket is its hub, and
    goes out when a second one is seen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hub = None
        told = False  # that the last bucket's hub is out
        for batch in batches:
            k, h = (np.asarray(batch.column(c)) for c in ("key", "h"))
            if not len(k):
                continue
            opens = np.concatenate([[True], k[1:] != k[:-1]])
            starts = np.flatnonzero(opens)
            hubs = h[starts]
            goes_on = k[0] == key
            if goes_on:
                hubs[0] = hub
            group = np.cumsum(opens) - 1
            other = h != hubs[group]
            shared = np.logical_or.reduceat(other, starts)
            new = shared.copy()
            new[0] &= not (goes_on and told)
            order = np.lexsort([h[other], group[other]])
            spoke, at = h[other][order], group[other][order]
            once = np.concatenate([[True], (at[1:] != at[:-1]) | (spoke[1:] != spoke[:-1])])[: len(at)]
            spoke, at = spoke[once], at[once]
            columns = [np.concatenate([k[starts][new], k[starts][at]]), np.concatenate([hubs[new], spoke]), np.concatenate([hubs[new], hubs[at]])]
            told = bool(shared[-1]) or (goes_on and told and len(starts) == 1)
            key, hub = k[-1], hubs[-1]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "h", "hub"])

    return dealt.sortWithinPartitions("key").mapInArrow(run, "key long, h long, hub long")


def _rarity(lines: DataFrame) -> Broadcast:
    """How often the lines hold shingles of each of COUNTERS hash classes: an order of shingles,
    rare ones first, that is exact enough to be short of common ones and of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, PAIRS):
                hashes, _ = shingles(batch.column("form").slice(k, PAIRS).to_pylist())
                counts += np.bincount((hashes & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["class", "n"])

    read = lines.select("form").mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[np.asarray(read["class"])] = np.asarray(read["n"])
    return lines.sparkSession.sparkContext.broadcast(counts)


def _prefixes(lines: DataFrame, rarity: Broadcast) -> DataFrame:
    """id, root, n (shingles of the line), place, shingle and how common it is for the rarest shingles of each line.

    Of n shingles these are n - ceil(SIMILAR * n) + 1: two lines that are near share one of them,
    since what is left of either is too little for the similarity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = rarity.value
        for batch in batches:
            for k in range(0, batch.num_rows, PAIRS):
                part = batch.slice(k, PAIRS)
                hashes, starts = shingles(part.column("form").to_pylist())
                line = np.repeat(np.arange(part.num_rows), np.diff(starts))
                common = counts[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)]
                order = np.lexsort([hashes.view(np.int64), common, line])
                line, hashes, common = line[order], hashes[order], common[order]
                once = np.ones(len(line), bool)
                once[1:] = (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])
                line, hashes, common = line[once], hashes[once], common[once]
                n = np.bincount(line, minlength=part.num_rows)
                place = np.arange(len(line)) - (np.cumsum(n) - n)[line]
                keep = place <= n[line] - np.ceil(SIMILAR * n - 1e-9).astype(np.int64)[line]
                line = line[keep]
                ids, roots = (np.asarray(part.column(c))[line] for c in ("id", "root"))
                columns = [pa.array(ids), pa.array(roots), pa.array(n[line].astype(np.int32)), pa.array(place[keep].astype(np.int32)), pa.array(hashes[keep].view(np.int64)), pa.array(common[keep])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "root", "n", "place", "shingle", "common"])

    return lines.select("id", "root", "form").mapInArrow(run, "id long, root long, n int, place int, shingle long, common long")


def _mixed(prefixes: DataFrame) -> DataFrame:
    """The rows of shingles that lines of several roots have, with the root that most of them have (main) and how many there are (rows).

    Of shingles that the same lines look by, told by their number and 128 bits of hashes of
    their ids, the rarest stays. The first shingle in order that two lines have in common is
    never left out: the one that would stay for it is common to both and comes before it.
    """
    lists = prefixes.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"),
        F.min("root").alias("low"), F.max("root").alias("high"), F.min("common").alias("common"),
    )
    rarest = lists.filter("low < high").groupBy("rows", "x", "y").agg(F.min(F.struct("common", "shingle")).alias("first"))
    kept = durable(prefixes.drop("common").join(rarest.select(F.col("first.shingle").alias("shingle"), "rows"), "shingle"))
    shares = kept.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"))
    main = shares.groupBy("shingle").agg(F.max(F.struct("n", "root")).alias("most"))
    return kept.join(main.select("shingle", F.col("most.root").alias("main")), "shingle")


def _merged(mixed: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows with the roots (root, top) that their roots have become part of."""
    ends = mixed.join(roots, "root", "left").join(roots.toDF("main", "main_top"), "main", "left")
    return ends.withColumns({"root": F.coalesce("top", "root"), "main": F.coalesce("main_top", "main")}).drop("top", "main_top")


def _alike(*sides: str) -> Column:
    """Can lines with n shingles, that share the one at place, be near by their numbers alone?"""
    (n_a, n_b), (place_a, place_b) = ([F.col(f"{c}{x}") for x in sides] for c in ("n", "place"))
    # What can be common from the shared shingle on.
    enough = F.least(n_a - place_a, n_b - place_b) * (1 + SIMILAR) >= SIMILAR * (n_a + n_b) - 1e-6
    return (F.least(n_a, n_b) >= SIMILAR * F.greatest(n_a, n_b) - 1e-9) & enough


def _by_hubs(mixed: DataFrame) -> DataFrame:
    """Pairs a, b with their roots: lines of crowded shingles with a few hubs of the shingle."""
    crowded = mixed.filter(F.col("rows") > CROWD)
    line = ("id", "root", "n", "place")
    hubs = crowded.groupBy("shingle").agg(F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), *line)) for k in range(HUBS)])).alias("hubs"))
    met = crowded.join(hubs.withColumn("hub", F.explode("hubs")).select("shingle", *[F.col(f"hub.{c}").alias(f"{c}_hub") for c in line]), "shingle")
    return met.filter((F.col("root") != F.col("root_hub")) & _alike("", "_hub")).select(F.col("id").alias("a"), F.col("id_hub").alias("b"), "root", "root_hub").distinct()


def _across(mixed: DataFrame) -> DataFrame:
    """Pairs a, b of line ids of different roots that can be near: those that share a rare shingle
    and are alike in length. No near pair of the lines is left out.

    Where most lines with a shingle are of one root already, only the others look for partners.
    """
    left = mixed.filter("root <> main").select("shingle", *[F.col(c).alias(f"{c}_a") for c in ("id", "root", "n", "place")])
    right = mixed.select("shingle", "main", *[F.col(c).alias(f"{c}_b") for c in ("id", "root", "n", "place")])
    once = (F.col("root_b") == F.col("main")) | (F.col("id_a") < F.col("id_b"))
    met = left.join(right, "shingle").filter((F.col("root_a") != F.col("root_b")) & once & _alike("_a", "_b"))
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _links_across(lines: DataFrame) -> DataFrame:
    """Links between lines (id, root, form) of different roots that join all roots with near lines."""
    forms = lines.select("id", "form")
    mixed = durable(_mixed(durable(_prefixes(lines, _rarity(lines)))))
    found = durable(_verified(_by_hubs(mixed), forms))
    mixed = durable(_merged(mixed, components(found, "root", "root_hub").toDF("root", "top")))
    return found.select("a", "b").unionByName(_verified(_across(mixed), forms))


def _links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Links of line ids that make the components of all near candidates."""
    spark = docs.sparkSession
    dealt = _banded(docs).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key")
    members = durable(_shared_buckets(dealt))
    wanted = members.select("h").distinct()
    texts = durable(_texts(docs, distinct.join(wanted, "h", "left_semi")).dropDuplicates(["id"]))
    ids = texts.select("h", "id")
    spokes = members.filter("h <> hub").select("h", "hub").distinct()
    hubs = ids.select(F.col("h").alias("hub"), F.col("id").alias("b"))
    links = durable(_verified(spokes.join(ids.withColumnRenamed("id", "a"), "h").join(hubs, "hub").select("a", "b"), texts))
    roots = components(links).withColumnRenamed("node", "id")
    rooted = durable(members.join(ids, "h").join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")))
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
    unsettled = rooted.join(several.filter("low < high and n > 2").select("key"), "key", "left_semi").select("id", "root").distinct()
    lines = durable(texts.select("id", "form").join(unsettled, "id"))
    # Components found so far go on as stars, which need fewer rounds than their links.
    return roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(_links_across(lines))


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, part and line of each line that goes."""
    found = durable(occurrences(docs))
    distinct = durable(
        found.groupBy("h", "g").agg(F.min(F.struct("doc_id", "part", "line")).alias("first"), F.count(F.lit(1)).alias("n"))
        .select("h", "g", "n", "first.doc_id", "first.part", "first.line", F.monotonically_increasing_id().alias("id"))
    )
    roots = components(_links(docs, distinct)).withColumnRenamed("node", "id")
    rooted = distinct.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    kept = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "part", "line")).alias("keep"), F.sum("n").alias("all")).filter("all > 1").select("root", "keep")
    judged = durable(rooted.join(kept, "root").select("h", "g", "keep"))
    return found.join(judged, ["h", "g"]).filter(F.struct("doc_id", "part", "line") != F.col("keep")).select("doc_id", "part", "line")


def line_report(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed and removed, the numbers of the lines that go, sorted."""
    lists = removed.groupBy("doc_id", "part").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("part"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    return rows.join(lists, ["doc_id", "part"], "left").select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_near_lines(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed and removed.

    Of each component of near lines the line with the smallest doc_id, then place, stays;
    blank lines all stay. Rows without doc_id or text take no part. Rows that share doc_id
    and text keep and lose the same lines. Other columns are not read.
    """
    return line_report(docs, removed_lines(docs))


def kept_texts(docs: DataFrame, report: DataFrame) -> DataFrame:
    """doc_id and the text without the removed lines, for a table in which each doc_id is on one row."""
    both = docs.select("doc_id", "text").join(report.select("doc_id", "removed"), "doc_id")
    lines = F.filter(F.split("text", "\n"), lambda line, k: ~F.array_contains("removed", k))
    return both.select("doc_id", F.array_join(lines, "\n").alias("text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = without_near_lines(table(spark, sf_dir, "documents"))
    return report.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))
