"""What the operators share: reading, fresh names, bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a task holds as Python objects at a time; one longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores ahead until it clashes with no column of df."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch that hold about `limit` bytes of the text column, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def append_columns(
    df: DataFrame, text: str, compute: Callable[[pa.Array], list], fields: list[tuple[str, T.DataType]], limit: int = CHUNK_BYTES
) -> DataFrame:
    """df and the columns that compute(texts) gives, one value for each text, chunk by chunk."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, text, limit):
                made = compute(part.column(text))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *(n for n, _ in fields)])

    return df.mapInArrow(run, schema)


def expand_rows(
    df: DataFrame, text: str, compute: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | T.StructType
) -> DataFrame:
    """The record batches that compute(chunk) gives for each chunk of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, text):
                yield from compute(part)

    return df.mapInArrow(run, schema)


def held_out(parts: int, rest: int) -> Column:
    """True where crc32 of the id as text has this remainder; a missing id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == rest, F.lit(False))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
