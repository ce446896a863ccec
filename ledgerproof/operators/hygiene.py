"""Line scans for forbidden patterns and redaction of local paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerproof.functions.text import split_lines, strip

EXCERPT = 180
REDACTED = "<local_path_redacted>"


def numbered_lines(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """(key, line_no, line): one row per line of each text."""
    lines = df.select(*key, F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    return lines.select(*key, (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


def forbidden_lines(df: DataFrame, key: Sequence[str], text: str, patterns: Sequence[str]) -> DataFrame:
    """One row per (line, pattern) hit. The pattern list is configuration and rides
    along as literals: each text is read once and nothing is joined."""
    found = F.filter(
        F.array(*[F.when(F.contains("line", F.lit(p)), F.lit(p)) for p in patterns]), lambda x: x.isNotNull()
    )
    texts = df.filter(contains_any(F.col(text), patterns))
    hits = numbered_lines(texts, key, text).withColumn("pattern", F.explode(found))
    return hits.select(*key, "line_no", "pattern", F.substring(strip(F.col("line")), 1, EXCERPT).alias("excerpt"))


def contains_any(c: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(F.contains(c, F.lit(p)), F.lit(False))
    return out


def known_end(path: Column, ends: Mapping[str, str]) -> Column:
    """What is shown for the longest of `ends` that the path ends with; NULL when none.

    One look-up per length that occurs, in a set of all ends of that length, so a path that
    ends otherwise costs the same for ten places and for ten thousand.
    """
    by_length: dict[int, dict[str, str]] = {}
    for end, shown in ends.items():
        by_length.setdefault(len(end), {})[end] = shown
    found = []
    for n in sorted(by_length, reverse=True):
        group, tail = by_length[n], F.right(path, F.lit(n))
        shown = F.lit(None).cast("string")
        for end, text in group.items():
            shown = F.when(tail == end, text).otherwise(shown)
        found.append(F.when(tail.isin(*group), shown))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def redact(
    c: Column, root: str, patterns: Sequence[str], known: Sequence[tuple[str, str]] = (), ends: Mapping[str, str] | None = None
) -> Column:
    """Root-relative where the text lies under the root; known places by a part of the name or by
    how it ends; any other text that holds a local pattern is replaced whole."""
    path = F.replace(c, F.lit("\\"), F.lit("/"))
    local = contains_any(c, patterns)
    out = F.when(path == root, ".").when(
        path.startswith(root + "/"), F.substring(path, F.lit(len(root) + 2), F.length(path))
    )
    for marker, shown in known:
        out = out.when(local & F.contains(path, F.lit(marker)), shown)
    return out.when(local, F.coalesce(known_end(path, ends or {}), F.lit(REDACTED))).otherwise(c)


def redact_table(
    df: DataFrame, root: str, patterns: Sequence[str], known: Sequence[tuple[str, str]] = (), ends: Mapping[str, str] | None = None
) -> DataFrame:
    """Redacts every string of a nested table; other values pass unchanged."""
    return df.select(
        *[_redact_value(F.col(f"`{f.name}`"), f.dataType, root, patterns, known, ends).alias(f.name) for f in df.schema.fields]
    )


def _redact_value(c: Column, kind: T.DataType, *how) -> Column:
    if isinstance(kind, T.StringType):
        return redact(c, *how)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _redact_value(x, kind.elementType, *how))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _redact_value(v, kind.valueType, *how))
    if isinstance(kind, T.StructType):
        fields = [_redact_value(c[f.name], f.dataType, *how).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c
