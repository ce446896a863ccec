"""Cleaning of raw transaction lines: types, keys, quality flags, subsets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerproof.functions.text import collapse_space, strip
from ledgerproof.session import durable

# Stock codes that are charges, not goods.
NON_MERCHANDISE_CODES = ("AMAZONFEE", "B", "BANK CHARGES", "C2", "CRUK", "D", "DOT", "M", "POST", "S")

LINE_COLUMNS = (
    "invoice_no",
    "stock_code",
    "description",
    "quantity",
    "invoice_date",
    "unit_price",
    "customer_id",
    "country",
)


def typed_products(raw: DataFrame) -> DataFrame:
    """What a line takes from its product: trimmed code, collapsed description, price."""
    return raw.withColumns(
        {
            "stock_code": strip(F.col("StockCode")),
            "description": collapse_space(F.col("Description")),
            "unit_price": F.col("UnitPrice").cast("decimal(12,4)"),
        }
    ).drop("StockCode", "UnitPrice")


def typed_invoices(raw: DataFrame) -> DataFrame:
    """What a line takes from its invoice: date, calendar keys, trimmed country."""
    invoice_date = F.col("InvoiceDate").cast("timestamp")
    return raw.withColumns(
        {
            "invoice_date": invoice_date,
            "country": strip(F.col("Country")),
            "invoice_date_only": F.date_format(invoice_date, "yyyy-MM-dd"),
            "year_month": F.date_format(invoice_date, "yyyy-MM"),
        }
    ).drop("InvoiceDate")


def typed_lines(raw: DataFrame, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Lines of typed products and invoices, with their own ids and revenue."""
    quantity = F.col("Quantity").cast("bigint")
    return raw.select(
        strip(F.col("InvoiceNo")).alias("invoice_no"),
        "stock_code",
        "description",
        quantity.alias("quantity"),
        "invoice_date",
        "unit_price",
        F.col("CustomerID").cast("bigint").alias("customer_id"),
        "country",
        "invoice_date_only",
        "year_month",
        (quantity * F.col("unit_price")).cast("decimal(18,4)").alias("revenue"),
        *keep,
    )


def normalize_lines(raw: DataFrame, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Trimmed ids, collapsed descriptions, calendar keys and line revenue."""
    return typed_lines(typed_invoices(typed_products(raw)), keep)


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _no_digit() -> Column:
    return ~F.rlike("stock_code", F.lit(r"(?U)\d"))


def non_merchandise(codes: Sequence[str] = NON_MERCHANDISE_CODES) -> Column:
    return _flag(F.upper("stock_code").isin(*codes) | _no_digit())


def add_quality_flags(lines: DataFrame, codes: Sequence[str] = NON_MERCHANDISE_CODES) -> DataFrame:
    return lines.withColumns(
        {
            "is_cancel_invoice": _flag(F.upper("invoice_no").startswith("C")),
            "is_negative_quantity": _flag(F.col("quantity") < 0),
            "is_nonpositive_unit_price": _flag(F.col("unit_price") <= 0),
            "is_missing_description": F.col("description").isNull() | _flag(F.length("description") == 0),
            "has_no_digit_stock_code": _flag(_no_digit()),
            "is_non_merchandise": non_merchandise(codes),
        }
    )


def priced_lines(lines: DataFrame) -> DataFrame:
    """Lines with a price and a description, copies included."""
    return lines.filter(~(_flag(F.col("unit_price") <= 0) | F.col("description").isNull() | _flag(F.length("description") == 0)))


#: Bits of the filter of repeated fingerprints: at most 2 M words of 64, whatever the number of lines.
FILTER_BITS = 1 << 27


def repeated_filter(prints: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(_word, _set): one bit for each fingerprint that occurs more than once, modulo `bits`, in words of 64."""
    repeated = prints.groupBy("_fingerprint").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    word, bit = _place(bits)
    return repeated.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("_set"))


def _place(bits: int) -> tuple[Column, Column]:
    """The word and the bit of a fingerprint."""
    slot = F.pmod("_fingerprint", F.lit(bits))
    return F.shiftright(slot, 6), slot.bitwiseAND(F.lit(63)).cast("int")


def _fingerprinted(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lines that bring a fingerprint of these columns keep it."""
    return lines if "_fingerprint" in lines.columns else lines.withColumn("_fingerprint", F.xxhash64(*columns))


def _marked(lines: DataFrame, bits: int) -> DataFrame:
    """Adds _candidate: may the line have a copy?"""
    word, bit = _place(bits)
    marked = lines.withColumn("_word", word).join(
        F.broadcast(repeated_filter(lines.select("_fingerprint"), bits)), "_word", "left"
    )
    held = F.call_function("shiftrightunsigned", F.col("_set"), bit).bitwiseAND(F.lit(1)) == 1
    return marked.withColumn("_candidate", F.coalesce(held, F.lit(False))).drop("_word", "_set")


def _met(candidates: DataFrame, columns: Sequence[str], row_id: str, how: str) -> DataFrame:
    """Candidates with _first, the smallest row id of their group of copies."""
    copied = (
        candidates.groupBy("_fingerprint", *columns)
        .agg(F.count("*").alias("_copies"), F.min(row_id).alias("_first"))
        .filter("_copies > 1")
        .select(F.col("_fingerprint").alias("_k_fingerprint"), *[F.col(c).alias(f"_k_{c}") for c in columns], "_first")
    )
    same = F.col("_fingerprint") == F.col("_k_fingerprint")
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return candidates.join(copied, same, how)


def flag_exact_duplicates(
    lines: DataFrame, columns: Sequence[str] = LINE_COLUMNS, row_id: str = "row_id", bits: int = FILTER_BITS
) -> DataFrame:
    """True for every copy but the one with the smallest row id.

    A window over the columns would put all copies of one row in one task. Here 64-bit
    fingerprints are counted, pre-aggregated before the shuffle, so a hot row is one row of
    each map task. Repeated ones go into a filter of bounded size, which is broadcast. A line that
    the filter doesn't hold has no copy and passes by without a shuffle. The others, a few
    without a copy among them, are grouped by all columns, and the groups with copies are joined
    to them; adaptive execution splits that join where a row is hot.
    """
    marked = _marked(_fingerprinted(lines, columns), bits)
    passing = marked.filter(~F.col("_candidate")).drop("_candidate", "_fingerprint").withColumn("is_exact_duplicate", F.lit(False))
    met = (
        _met(marked.filter("_candidate").drop("_candidate"), columns, row_id, "left")
        .withColumn("is_exact_duplicate", _flag(F.col(row_id) != F.col("_first")))
        .drop("_first", "_fingerprint", "_k_fingerprint", *[f"_k_{c}" for c in columns])
    )
    return passing.unionByName(met)


def later_copies(
    lines: DataFrame, columns: Sequence[str] = LINE_COLUMNS, row_id: str = "row_id", bits: int = FILTER_BITS
) -> DataFrame:
    """(row_id): the lines that `flag_exact_duplicates` flags; no other line is shuffled or written."""
    marked = _marked(_fingerprinted(lines, columns).select(row_id, "_fingerprint", *columns), bits)
    met = _met(durable(marked.filter("_candidate").drop("_candidate")), columns, row_id, "inner")
    return met.filter(F.col(row_id) != F.col("_first")).select(row_id)


def firsts_of_invoices(lines: DataFrame, invoice: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Lines without later copies; opens_month and opens_country are true for one line of each invoice in
    each of its months, and in each of its months and countries.

    Copies agree in invoice, month, country and columns. The lines of an invoice are sorted and each is compared
    with the one before it; lines that are dealt by the invoice's number already aren't shuffled.
    """
    shown = ["year_month", "country", *columns]
    order = Window.partitionBy(*invoice).orderBy(*shown)

    def same(*names: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_before_{c}")) for c in names], F.col("_place") > 1)

    # Columns are taken from the line before one by one: a struct of them would be sorted beside them.
    compared = lines.withColumns({"_place": F.row_number().over(order), **{f"_before_{c}": F.lag(c).over(order) for c in shown}})
    kept = compared.filter(~same(*shown)).withColumns({"opens_month": ~same("year_month"), "opens_country": ~same("year_month", "country")})
    return kept.drop("_place", *[f"_before_{c}" for c in shown])


def clean_lines(raw: DataFrame) -> DataFrame:
    return add_quality_flags(flag_exact_duplicates(normalize_lines(raw)))


def positive_sales_condition() -> Column:
    return ~(
        F.col("is_exact_duplicate")
        | F.col("is_cancel_invoice")
        | F.col("is_negative_quantity")
        | F.col("is_nonpositive_unit_price")
        | F.col("is_missing_description")
    )


def positive_sales(lines: DataFrame) -> DataFrame:
    return lines.filter(positive_sales_condition())


def net_revenue_lines(lines: DataFrame) -> DataFrame:
    """Valid priced lines; returns stay in."""
    return lines.filter(
        ~(F.col("is_exact_duplicate") | F.col("is_nonpositive_unit_price") | F.col("is_missing_description"))
    )


def cancellation_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(
        (F.col("is_cancel_invoice") | F.col("is_negative_quantity")) & ~F.col("is_exact_duplicate")
    )


def merchandise(lines: DataFrame) -> DataFrame:
    return lines.filter(~F.col("is_non_merchandise"))


def exclusion_reason() -> Column:
    """The failed rules in their fixed order."""
    rules = [
        ("is_exact_duplicate", "exact_duplicate"),
        ("is_cancel_invoice", "cancel_invoice"),
        ("is_negative_quantity", "negative_quantity"),
        ("is_nonpositive_unit_price", "nonpositive_unit_price"),
        ("is_missing_description", "missing_description"),
    ]
    return F.concat_ws(";", *[F.when(F.col(flag), F.lit(name)) for flag, name in rules])


def excluded_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(~positive_sales_condition()).withColumn("exclusion_reason", exclusion_reason())
