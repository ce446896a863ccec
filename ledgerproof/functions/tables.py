"""Markdown tables inside generated text, parsed with array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerproof.functions.numbers import parse_amount
from ledgerproof.functions.text import collapse_space, split_lines, strip

# The columns a generated list must have.
HEADERS = ("rank", "stock_code", "product_name", "net_revenue_gbp")


def code_key(c: Column) -> Column:
    return F.upper(strip(c))


def name_key(c: Column) -> Column:
    return collapse_space(F.upper(c))


def is_table_line(line: Column) -> Column:
    return strip(line).startswith("|") & strip(line).endswith("|")


def row_cells(line: Column) -> Column:
    inner = F.regexp_replace(strip(line), r"^\|+|\|+$", "")
    return F.transform(F.split(inner, r"\|", -1), strip)


def is_separator(cells: Column) -> Column:
    return F.forall(cells, lambda c: F.rlike(F.replace(c, F.lit(" "), F.lit("")), F.lit("^[-:]+$")))


def is_header(cells: Column) -> Column:
    return F.transform(cells, F.lower) == F.array(*[F.lit(h) for h in HEADERS])


def whole_number(c: Column) -> Column:
    return F.when(F.rlike(c, F.lit(r"^[-+]?\d+$")), c.try_cast("bigint"))


def parse_table(text: Column) -> Column:
    """struct(headers, rows, issues) of the first table-shaped lines of a text.

    The first piped line is the header even when it is wrong; a row with another
    number of columns is an issue, not a row.
    """
    piped = F.transform(F.filter(split_lines(text), is_table_line), row_cells)
    data = F.filter(F.slice(piped, F.lit(2), F.greatest(F.size(piped), F.lit(1))), lambda c: ~is_separator(c))
    numbered = F.transform(
        data,
        lambda c, i: F.struct(
            (i + 1).cast("bigint").alias("row_index"),
            F.size(c).alias("width"),
            whole_number(F.get(c, F.lit(0))).alias("rank"),
            code_key(F.get(c, F.lit(1))).alias("stock_code"),
            name_key(F.get(c, F.lit(2))).alias("product_name"),
            parse_amount(F.get(c, F.lit(3))).alias("net_revenue_gbp"),
            F.get(c, F.lit(3)).alias("raw_net_revenue_gbp"),
        ),
    )
    at = lambda r: F.concat(F.lit("row "), r["row_index"].cast("string"))
    full = lambda r: r["width"] == len(HEADERS)
    problems = F.flatten(
        F.transform(
            numbered,
            lambda r: F.filter(
                F.array(
                    F.when(~full(r), F.concat(at(r), F.lit(" has "), r["width"].cast("string"), F.lit(" columns"))),
                    F.when(full(r) & r["rank"].isNull(), F.concat(at(r), F.lit(" rank is not an integer"))),
                    F.when(full(r) & r["net_revenue_gbp"].isNull(), F.concat(at(r), F.lit(" amount is not parseable"))),
                ),
                lambda x: x.isNotNull(),
            ),
        )
    )
    empty = F.size(piped) == 0
    return F.struct(
        F.when(empty, F.array().cast("array<string>")).otherwise(F.transform(F.get(piped, F.lit(0)), F.lower)).alias("headers"),
        F.filter(numbered, full).alias("rows"),
        F.when(empty, F.array(F.lit("no markdown table rows found"))).otherwise(problems).alias("issues"),
    )


def compact_codes(codes: Column) -> Column:
    return F.array_join(codes, " > ")


def compact_rows(rows: Column, amount: str) -> Column:
    """'1:CODE GBP 12.00 > ...'; a missing amount prints NA."""
    def one(r: Column) -> Column:
        shown = F.when(r[amount].isNull(), "NA").otherwise(F.concat(F.lit("GBP "), F.format_string("%.2f", r[amount])))
        return F.concat(F.coalesce(r["rank"].cast("string"), F.lit("None")), F.lit(":"), code_key(r["stock_code"]), F.lit(" "), shown)

    return F.array_join(F.transform(rows, one), " > ")
