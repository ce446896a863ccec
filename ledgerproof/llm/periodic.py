"""Periodic runs of words, by string synchronising sets.

A run is a stretch of words with smallest period q, at least EXPONENT * q and LEAST words
long, that no neighbouring word continues. Periods up to SMALL are found directly, by comparing
every word with the one q places on. Longer periods belong to a dyadic scale t with
t < q <= 2 t. There a position is selected when the hash of the t words from it is the least,
or ties with the least, of the t + 1 hashes from t places before or after; what is selected
depends on the next 2 t words alone. So in a run of period q the selected positions repeat every q
words with equal contexts of 2 t words, and since 2 t >= q the next position with an equal
context is exactly q on: that pair proposes q. Any t neighbouring positions hold a selected
one, unless the 3 t words from there have a period of t / 4 or less. Windows inside runs of such
small periods, which the scales below have found, are not selected; a run of a period over t
can't be made of them alone.

A proposal is extended word by word in both directions, so hashes decide nothing: an equal
hash of different words costs one comparison, and equal words have equal hashes.

The documents of a chunk are joined by separators that occur once, which no run can hold, and
go through each scale together. Work is n log n for n words; a chunk holds about CHUNK_BYTES
of text or one longer document, in some 80 bytes a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerproof.llm.common import table, text_chunks

EXPONENT, LEAST = 4, 6
#: Periods that are found by direct comparison; a power of two.
SMALL = 4
SPACES = r"[\x20\x09-\x0D]+"
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
#: Changes the words of a chunk before they are searched. Takes the rows, the first word and the
#: number of words of each, and the codes of all words; returns as many codes.
Rewrite = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(28))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring stretches of equal length."""
    return _mixed(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))))


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal stretch of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def _least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbouring values, n = 2 ** k + 1, by doubling."""
    least, width = values, 1
    while width < n - 1:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    return np.minimum(least[:-1], least[1:]) if n > 1 else least


def _reach(codes: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The stretch [left, right) around `at` where each word equals the one a period on."""
    right, step, last = at, 32, len(codes) - period
    while right < last:
        end = min(last, right + step)
        differs = codes[right:end] != codes[right + period : end + period]
        k = int(differs.argmax())
        if differs[k]:
            right += k
            break
        right, step = end, step * 2
    left, step = at, 32
    while left > 0:
        start = max(0, left - step)
        differs = (codes[start:left] != codes[start + period : left + period])[::-1]
        k = int(differs.argmax())
        if differs[k]:
            left -= k
            break
        left, step = start, step * 2
    return left, right


def _primes(n: int) -> Iterator[int]:
    f = 2
    while f * f <= n:
        if n % f == 0:
            yield f
            while n % f == 0:
                n //= f
        f += 1
    if n > 1:
        yield n


def _smallest(codes: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether no divisor of the period is one too; four periods leave no other candidate."""
    return all((codes[start : end - p] != codes[start + p : end]).any() for p in (period // f for f in _primes(period)))


def _proposals(hashes: np.ndarray, scale: int, periodic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring selected positions with equal contexts, `scale` to 2 * `scale` apart: position and distance.

    hashes are of the `scale` words from each position; periodic marks windows of small period.
    """
    ids = np.where(periodic, np.uint64(0xFFFFFFFFFFFFFFFF), hashes)
    ahead = ids[scale:]
    least = _least_of(ids, scale + 1)
    chosen = np.flatnonzero(((least == ids[: len(ahead)]) | (least == ahead)) & (least != np.uint64(0xFFFFFFFFFFFFFFFF)))
    context = _joined(hashes[chosen], hashes[chosen + scale])
    order = np.argsort(context, kind="stable")
    at, context = chosen[order], context[order]
    apart = at[1:] - at[:-1]
    near = np.flatnonzero((context[1:] == context[:-1]) & (apart > scale) & (apart <= 2 * scale))
    position, distance = at[near], apart[near]
    order = np.argsort(position, kind="stable")
    return position[order], distance[order]


def find_runs(codes: np.ndarray, longest: int, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of at least `exponent` (4 or more) periods, in no particular order.

    longest is the length of the longest stretch that can hold a run (the longest document).
    """
    starts, ends, periods = [], [], []

    def keep(start, end, period):
        starts.append(start), ends.append(end), periods.append(period)

    for q in range(1, min(SMALL, longest // exponent) + 1):
        left, right = _stretches(codes[q:] == codes[:-q])
        for a, b in zip(*(x[right - left >= (exponent - 1) * q].tolist() for x in (left, right))):
            if q == 1 or _smallest(codes, a, b + q, q):
                keep(a, b + q, q)
    scale, width = SMALL, 1
    hashes = _mixed(codes.astype(np.uint64) + np.uint64(1))
    while exponent * (scale + 1) <= longest:
        while width < scale:
            hashes, width = _joined(hashes[:-width], hashes[width:]), 2 * width
        # Windows that lie in a run of a period of a quarter of their length or less.
        marks = np.zeros(len(hashes) + 1, np.int32)
        for a, b, q in zip(starts, ends, periods):
            if 4 * q <= scale <= b - a:
                marks[a] += 1
                marks[b - scale + 1] -= 1
        seen: dict[int, int] = {}
        found = _proposals(hashes, scale, np.cumsum(marks[:-1]) > 0)
        for at, period in zip(*(x.tolist() for x in found)):
            if at < seen.get(period, -1):
                continue
            left, right = _reach(codes, at, period)
            seen[period] = right
            if right - left >= (exponent - 1) * period and _smallest(codes, left, right + period, period):
                keep(left, right + period, period)
        scale *= 2
    return tuple(np.array(x, np.int64) for x in (starts, ends, periods))


class Words:
    """The words of a chunk of texts: a code for each, and where each text begins."""

    def __init__(self, texts: pa.Array):
        parts = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.string()), ""), SPACES)
        flat, ends = parts.flatten(), np.asarray(parts.offsets) - parts.offsets[0].as_py()
        real = np.asarray(pc.greater(pc.binary_length(flat), 0))
        self.bounds = np.concatenate([[0], np.cumsum(real)])[ends]
        coded = flat.filter(pa.array(real)).dictionary_encode()
        self.names, self.codes = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        self.counts = np.diff(self.bounds)

    def apart(self) -> tuple[np.ndarray, np.ndarray]:
        """The codes with a separator of its own after each text, and where each text begins then."""
        texts = len(self.counts)
        places = np.arange(len(self.codes)) + np.repeat(np.arange(texts), self.counts)
        out = np.full(len(self.codes) + texts, -1, np.int64)
        out[places] = self.codes
        gaps = np.flatnonzero(out < 0)
        out[gaps] = len(self.names) + np.arange(texts)
        return out, self.bounds[:-1] + np.arange(texts)

    def text_of(self, kept: np.ndarray) -> pa.Array:
        """The kept words of each text, joined by one space."""
        offsets = np.concatenate([[0], np.cumsum(kept)])[self.bounds]
        words = self.names.take(pa.array(self.codes[kept]))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), " ")


def _analysed(batch: pa.RecordBatch, text: str, rewrite: Rewrite | None) -> list[pa.Array]:
    words = Words(batch.column(text))
    if rewrite:
        words.codes = rewrite(batch, words.bounds[:-1], words.counts, words.codes)
    codes, first = words.apart()
    starts, ends, periods = find_runs(codes, int(words.counts.max(initial=0)))
    long = ends - starts >= LEAST
    starts, ends, periods = (x[long] for x in (starts, ends, periods))
    rows = np.searchsorted(first, starts, "right") - 1
    order = np.lexsort([periods, starts])
    rows, starts, ends, periods = (x[order] for x in (rows, starts, ends, periods))
    gone = np.zeros(len(words.codes) + 1, np.int64)
    np.add.at(gone, starts + periods - rows, 1)
    np.add.at(gone, ends - rows, -1)
    fields = [pa.array(x, pa.int64()) for x in (starts - first[rows] if len(rows) else starts, ends - starts, periods)]
    runs = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(words.counts)))]).astype(np.int32)),
        pa.StructArray.from_arrays(fields, names=[f.name for f in RUNS.elementType.fields]),
    )
    return [pa.array(words.counts, pa.int64()), runs, words.text_of(np.cumsum(gone[:-1]) == 0)]


def with_runs(docs: DataFrame, text: str = "text", rewrite: Rewrite | None = None, names: tuple[str, str, str] = ("n_words", "runs", "collapsed")) -> DataFrame:
    """docs and for each row the number of words, its runs and its words without the repeats.

    runs holds (start, length, period) by start, then period; a word is left out of the last
    column when a run holds it after its first period. A missing or empty text has no words,
    no runs and an empty last column. Repeated rows and missing ids are rows like others; of
    columns whose names clash with `names`, give others.
    """
    fields = [T.StructField(n, t) for n, t in zip(names, (T.LongType(), RUNS, T.StringType()))]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, text):
                made = _analysed(part, text, rewrite)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])

    return docs.mapInArrow(compute, T.StructType([*docs.schema.fields, *fields]))


def _stuttered(batch: pa.RecordBatch, starts: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The query's planted repeats: every tenth document (by hash) repeats its words from a place on."""
    codes = codes.copy()
    for row, h in enumerate(batch.column("hash").to_pylist()):
        n = int(counts[row])
        if h is None or h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = codes[starts[row] : starts[row] + n]
        words[a:] = words[a + np.arange(n - a) % p]
    return codes


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("hash"))
    found = with_runs(docs, rewrite=_stuttered).drop("text", "hash")
    # The largest length, then the smallest start and period.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.negative("longest.start").alias("start"), F.col("longest.length").alias("length"),
        F.negative("longest.period").alias("period"), F.floor(F.lit(1000) * F.col("longest.length") / F.negative("longest.period")).cast("long").alias("exponent_milli"),
        digest(F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n"))))).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"), "n_words",
    )
