"""Grouped summaries of cleaned lines, profiles and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(28,4)"


def keyed(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose grouping keys are all present."""
    for key in keys:
        lines = lines.filter(F.col(key).isNotNull())
    return lines


def _part(condition: Column, name: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("revenue"))), F.lit(0)).cast(MONEY).alias(name)


def _by_invoice(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial sums per invoice and customer. Lines of one invoice lie together, so most
    rows disappear before the shuffle and the distinct counts run over invoices only."""
    return keyed(lines, keys).groupBy(*keys, "invoice_no", "customer_id").agg(
        F.count("*").alias("line_count"),
        F.count("revenue").alias("priced_count"),
        F.sum("quantity").alias("total_quantity"),
        F.sum("revenue").cast(MONEY).alias("revenue"),
        _part(F.col("revenue") > 0, "gross_positive_revenue"),
        _part(F.col("revenue") < 0, "cancellation_revenue"),
    )


def _from_invoices(partial: DataFrame, keys: Sequence[str], *sums: Column) -> DataFrame:
    return partial.groupBy(*keys).agg(
        F.sum("line_count").alias("line_count"),
        F.countDistinct("invoice_no").alias("invoice_count"),
        F.countDistinct("customer_id").alias("customer_count"),
        F.sum("total_quantity").alias("total_quantity"),
        *sums,
    )


def _total(c: str, name: str) -> Column:
    return F.sum(c).cast(MONEY).alias(name)


def _from_lines(lines: DataFrame, keys: Sequence[str], *sums: Column) -> DataFrame:
    return keyed(lines, keys).groupBy(*keys).agg(
        F.count("*").alias("line_count"),
        F.countDistinct("invoice_no").alias("invoice_count"),
        F.sum("quantity").alias("total_quantity"),
        *sums,
    )


def sales_summary(
    sales: DataFrame, keys: Sequence[str], customers: bool = True, extra: Sequence[Column] = ()
) -> DataFrame:
    total = _total("revenue", "total_revenue")
    if customers:
        return _from_invoices(_by_invoice(sales, keys), keys, total, *extra)
    return _from_lines(sales, keys, total, *extra)


def net_summary(
    lines: DataFrame, keys: Sequence[str], customers: bool = True, extra: Sequence[Column] = ()
) -> DataFrame:
    """Net revenue with its gross-positive and cancellation parts."""
    net = _total("revenue", "net_revenue")
    if customers:
        parts = [_total(c, c) for c in ("gross_positive_revenue", "cancellation_revenue")]
        return _from_invoices(_by_invoice(lines, keys), keys, net, *parts, *extra)
    parts = [_part(F.col("revenue") > 0, "gross_positive_revenue"), _part(F.col("revenue") < 0, "cancellation_revenue")]
    return _from_lines(lines, keys, net, *parts, *extra)


def amounts() -> list[Column]:
    """Net revenue with its gross-positive and cancellation parts."""
    parts = [_part(F.col("revenue") > 0, "gross_positive_revenue"), _part(F.col("revenue") < 0, "cancellation_revenue")]
    return [_total("revenue", "net_revenue"), *parts]


def month_totals(totals: DataFrame) -> DataFrame:
    """Month summary of totals by month and country, in which an invoice opens each of its months once."""
    return keyed(totals, ["year_month"]).groupBy("year_month").agg(
        F.sum("opens_month").alias("invoice_count"), *[_total(c, c) for c in ("net_revenue", "gross_positive_revenue", "cancellation_revenue")])


def invoice_totals(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per keys and invoice, from which summaries by some of the keys can be made."""
    return lines.groupBy(*keys, "invoice_no").agg(*amounts())


def invoice_summary(invoices: DataFrame, keys: Sequence[str], unique: bool = False) -> DataFrame:
    """`net_summary` of `invoice_totals`: invoices and amounts. `unique`: by all keys of the totals, so
    each row is one invoice; by fewer keys an invoice may have several rows, and only keys and numbers
    are shuffled to count it once."""
    rows = keyed(invoices, keys)
    amounts = [_total(c, c) for c in ("net_revenue", "gross_positive_revenue", "cancellation_revenue")]
    if unique:
        return rows.groupBy(*keys).agg(F.count("invoice_no").alias("invoice_count"), *amounts)
    counts = rows.groupBy(*keys).agg(F.countDistinct("invoice_no").alias("invoice_count"))
    return rows.groupBy(*keys).agg(*amounts).join(counts, list(keys))


def monthly_sales(sales: DataFrame) -> DataFrame:
    mean = F.sum("revenue").cast("double") / F.sum("priced_count")
    return sales_summary(sales, ["year_month"], extra=[mean.alias("avg_line_revenue")])


def monthly_coverage(lines: DataFrame, first: str, last: str, partial: str, note: str) -> DataFrame:
    month = F.col("year_month")
    return (
        keyed(lines, ["year_month"])
        .groupBy("year_month")
        .agg(
            F.min("invoice_date").alias("first_invoice_datetime"),
            F.max("invoice_date").alias("last_invoice_datetime"),
            F.countDistinct("invoice_date_only").alias("transaction_days"),
            F.count("*").alias("line_count"),
            F.countDistinct("invoice_no").alias("invoice_count"),
        )
        .withColumn("recommended_for_monthly_trend_questions", month.between(first, last))
        .withColumn("notes", F.when(month == partial, note).otherwise(""))
    )


def _dates(prefix: str) -> list[Column]:
    return [
        F.min("invoice_date_only").alias(f"first_{prefix}_date"),
        F.max("invoice_date_only").alias(f"last_{prefix}_date"),
    ]


def product_sales(sales: DataFrame) -> DataFrame:
    return sales_summary(sales, ["stock_code", "description"], False, _dates("sale"))


def product_net(lines: DataFrame) -> DataFrame:
    return net_summary(lines, ["stock_code", "description"], False, _dates("transaction"))


def table_profile(raw: DataFrame, lines: DataFrame) -> DataFrame:
    """(metric, value) rows: shape, nulls, copies, distinct counts, conditional counts.

    Distinct counts run as one two-step aggregate per column instead of one aggregate
    that expands every row once per column.
    """
    columns = [c for c in raw.columns if c != "row_id"]
    flat = raw.select(*columns).agg(
        F.count("*").alias("raw_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns],
    )
    flags = lines.agg(
        F.count_if("is_cancel_invoice").alias("cancel_invoice_rows"),
        F.count_if("is_negative_quantity").alias("negative_quantity_rows"),
        F.count_if(F.col("quantity") == 0).alias("zero_quantity_rows"),
        F.count_if(F.col("unit_price") < 0).alias("negative_unit_price_rows"),
        F.count_if(F.col("unit_price") == 0).alias("zero_unit_price_rows"),
        F.count_if("is_non_merchandise").alias("non_merchandise_rows"),
    )
    distinct_rows = raw.groupBy(*columns).agg(F.count("*").alias("n"))
    copies = distinct_rows.agg((F.sum("n") - F.count("*")).alias("duplicate_rows"))
    parts = [_as_rows(flat), _as_rows(flags), _as_rows(copies)]
    for name, column in [
        ("invoice_count", "InvoiceNo"),
        ("stock_code_count", "StockCode"),
        ("description_count", "Description"),
        ("country_count", "Country"),
        ("customer_count", "CustomerID"),
    ]:
        parts.append(_as_rows(raw.agg(F.countDistinct(column).alias(name))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _as_rows(one_row: DataFrame) -> DataFrame:
    wide = one_row.select(*[F.col(c).cast("bigint").alias(c) for c in one_row.columns])
    return wide.unpivot([], wide.columns, "metric", "value")


def subset_totals(lines: DataFrame) -> DataFrame:
    """Row counts and revenue of the published subsets in one pass over the flags."""
    dup, miss = F.col("is_exact_duplicate"), F.col("is_missing_description")
    price, cancel = F.col("is_nonpositive_unit_price"), F.col("is_cancel_invoice")
    negative, goods = F.col("is_negative_quantity"), ~F.col("is_non_merchandise")
    net = ~(dup | price | miss)
    sales = net & ~cancel & ~negative
    rows = {
        "positive_sales_rows": sales,
        "merchandise_sales_rows": sales & goods,
        "valid_net_revenue_rows": net,
        "merchandise_net_revenue_rows": net & goods,
        "cancellation_or_return_rows": (cancel | negative) & ~dup,
        "excluded_rows": ~sales,
    }
    sums = {
        "positive_sales_revenue": sales,
        "merchandise_sales_revenue": sales & goods,
        "net_revenue": net,
        "merchandise_net_revenue": net & goods,
    }
    aggs = [F.count_if(c).cast("double").alias(k) for k, c in rows.items()]
    aggs += [
        F.round(F.coalesce(F.sum(F.when(c, F.col("revenue"))), F.lit(0)).cast(MONEY), 2).cast("double").alias(k)
        for k, c in sums.items()
    ]
    wide = lines.agg(*aggs)
    return wide.unpivot([], wide.columns, "metric", "value")


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def count_maps(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """One sorted count map per group; the map is as long as the value's domain."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*group).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(value), F.col("n"))))).alias(f"{value}_counts")
    )
