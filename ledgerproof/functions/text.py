"""Text expressions. Every function maps Columns to a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode counts as white space (plus the four
# ASCII separators) and the line breaks of a text reader.
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse_space(c: Column) -> Column:
    """Runs of white space become one space. A character map first, so the pattern
    that finds the runs is a plain one."""
    return F.btrim(F.regexp_replace(F.translate(c, SPACES, " " * len(SPACES)), " {2,}", " "))


def fold_case(c: Column) -> Column:
    """Lower case plus the one common case-fold expansion."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def match_key(c: Column) -> Column:
    return collapse_space(fold_case(c))


def upper_key(c: Column) -> Column:
    return collapse_space(F.upper(c))


def contains(haystack: Column, needle: Column) -> Column:
    return F.coalesce(F.contains(haystack, needle), F.lit(False))


def split_lines(c: Column) -> Column:
    """Lines without their breaks; no trailing empty line for a final break."""
    parts = F.split(c, LINE_BREAK)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)


def month_label(year_month: Column) -> Column:
    return F.date_format(F.to_date(year_month, "yyyy-MM"), "MMMM yyyy")


def nth_occurrence(text: Column, needle: Column, n: Column) -> Column:
    """0-based start of the n-th non-overlapping occurrence, NULL when absent."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pieces = F.split(text, quoted, -1)
    before = F.aggregate(
        F.slice(pieces, F.lit(1), n), F.lit(0), lambda total, piece: total + F.length(piece)
    )
    return F.when(
        (F.length(needle) > 0) & (n >= 1) & (F.size(pieces) > n), before + (n - 1) * F.length(needle)
    )


def claim_line(text: Column, span_text: Column, start: Column, end: Column) -> Column:
    """The line holding a span; search by text when the offsets do not fit."""
    valid = (start >= 0) & (end > start) & (end <= F.length(text))
    found = F.instr(text, span_text) - 1
    at = F.when(valid, start).when(found >= 0, found)
    to = F.when(valid, end).otherwise(found + F.length(span_text))
    left = F.substring_index(F.substring(text, F.lit(1), at), "\n", -1)
    right = F.substring_index(F.substring(text, to + 1, F.length(text)), "\n", 1)
    inner = F.substring(text, at + 1, to - at)
    return F.when(at.isNull(), span_text).otherwise(strip(F.concat(left, inner, right)))


def excerpt(text: Column, start: Column, end: Column, window: int, squeeze: bool = True) -> Column:
    """Key word in context with [[ ]] marks and ellipses where text was cut."""
    left = F.greatest(F.lit(0), start - window)
    right = F.least(F.length(text), end + window)
    out = F.concat(
        F.when(left > 0, "...").otherwise(""),
        F.substring(text, left + 1, start - left),
        F.lit("[["),
        F.substring(text, start + 1, end - start),
        F.lit("]]"),
        F.substring(text, end + 1, right - end),
        F.when(right < F.length(text), "...").otherwise(""),
    )
    return collapse_space(out) if squeeze else out
