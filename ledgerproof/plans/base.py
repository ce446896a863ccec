"""Cleaning, subsets, roll-ups, profile and their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerproof.operators import normalize, quality, rollups
from ledgerproof.plans import views
from ledgerproof.plans.register import query
from ledgerproof.plans.views import LINES, RAW, SUMMARIES, sql_net
from ledgerproof.session import durable, scratch_path, unstored
from ledgerproof.sources import files

MONEY_COLUMNS = (
    "revenue", "unit_price", "UnitPrice", "total_revenue", "net_revenue",
    "gross_positive_revenue", "cancellation_revenue",
)


def plain(df: DataFrame) -> DataFrame:
    """Money as DOUBLE at the output edge; sums stay exact decimals before it."""
    return df.withColumns({c: F.col(c).cast("double") for c in df.columns if c in MONEY_COLUMNS})


def plain_sql(with_clause: str, source: str, columns: str = "*") -> str:
    return f"WITH {with_clause} SELECT {columns} FROM ({source})"


def money_sql(with_clause: str, source: str, money: str) -> str:
    replaced = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in money.split())
    return f"WITH {with_clause} SELECT * REPLACE ({replaced}) FROM ({source})"


NET_MONEY = "net_revenue gross_positive_revenue cancellation_revenue"
LINE_MONEY = "revenue unit_price"


# ----------------------------------------------------------------- scans and sinks


@query("s01_transaction_scan", money_sql(RAW, "SELECT * EXCLUDE (row_id) FROM raw", "UnitPrice"))
def s01(spark, root):
    path = scratch_path(spark, "transactions")
    views.retail_raw(spark, root).drop("row_id").write.parquet(path)
    return plain(files.read_transactions(spark, path))


SUMMARY_SCHEMA = (
    "year_month string, country string, line_count bigint, invoice_count bigint, customer_count bigint, "
    "total_quantity bigint, net_revenue decimal(28,4), gross_positive_revenue decimal(28,4), "
    "cancellation_revenue decimal(28,4)"
)


@query("s02_summary_scan", money_sql(SUMMARIES, "SELECT * FROM country_month", NET_MONEY))
def s02(spark, root):
    path = scratch_path(spark, "country-month")
    unstored(views.country_month_net)(spark, root).write.csv(path, header=True)
    return plain(files.read_summary(spark, path, SUMMARY_SCHEMA))


@query(
    "s03_text_cell_scan",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, length(text) AS text_length, CAST(n_chars AS VARCHAR) AS n_chars "
    "FROM documents",
)
def s03(spark, root):
    path = scratch_path(spark, "cells")
    files.write_csv(views.documents(spark, root), path, ["doc_id", "text", "n_chars"])
    cells = files.read_text_cells(spark, path, ["doc_id", "text", "n_chars"])
    return cells.select("doc_id", F.length("text").cast("bigint").alias("text_length"), "n_chars")


@query(
    "s04_json_lines_scan",
    "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def s04(spark, root):
    path = scratch_path(spark, "events")
    events = views.table(spark, root, "events")
    files.write_json_lines(events.withColumn("props", F.from_json("props", "k bigint")), path)
    read = files.read_json_lines(spark, path, "event_id bigint, event_type string, props struct<k: bigint>")
    return read.select("event_id", "event_type", F.col("props.k").alias("k"))


@query(
    "s05_strict_json_lines_scan",
    """SELECT CASE WHEN event_type = 'error' THEN left(props, length(props) - 1) ELSE props END AS raw_line,
       event_type = 'error' AS is_malformed,
       CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""",
)
def s05(spark, root):
    path = scratch_path(spark, "lines")
    cut = F.substring(F.col("props"), F.lit(1), F.length("props") - 1)
    views.table(spark, root, "events").select(
        F.when(F.col("event_type") == "error", cut).otherwise(F.col("props")).alias("value")
    ).write.text(path)
    read = files.scan_json_lines(spark, path, "k bigint")
    return read.select("raw_line", "is_malformed", F.when(~F.col("is_malformed"), F.col("record.k")).alias("k"))


@query(
    "s06_json_document_scan",
    "SELECT r_name AS family, n_name AS baseline FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def s06(spark, root):
    path = scratch_path(spark, "suite")
    nations, regions = views.table(spark, root, "nation"), views.table(spark, root, "region")
    families = (
        nations.join(regions, nations.n_regionkey == regions.r_regionkey)
        .groupBy("r_name")
        .agg(F.sort_array(F.collect_list("n_name")).alias("members"))
        .agg(F.map_from_entries(F.collect_list(F.struct("r_name", "members"))).alias("families"))
    )
    families.write.json(path)
    suite = files.read_json_document(spark, path, "families map<string, array<string>>")
    return suite.select(F.explode("families").alias("family", "members")).select(
        "family", F.explode("members").alias("baseline")
    )


@query(
    "s07_csv_sink",
    plain_sql(
        LINES,
        "SELECT invoice_no, stock_code, description, CAST(quantity AS VARCHAR) AS quantity, '' AS note FROM excluded",
    ).replace(" SELECT * FROM (SELECT invoice_no", ", excluded AS (SELECT * FROM lines WHERE NOT (NOT is_exact_duplicate AND NOT is_cancel_invoice AND NOT is_negative_quantity AND NOT is_nonpositive_unit_price AND NOT is_missing_description)) SELECT * FROM (SELECT invoice_no"),
)
def s07(spark, root):
    path, columns = scratch_path(spark, "excluded"), ["invoice_no", "stock_code", "description", "quantity", "note"]
    files.write_csv(normalize.excluded_lines(views.retail_lines(spark, root)), path, columns)
    cells = files.read_text_cells(spark, path, columns)
    return cells.fillna("", ["description", "note"])


@query(
    "s08_nested_csv_sink",
    """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)
       SELECT source, '{' || string_agg('"' || lang || '":' || n, ',' ORDER BY lang) || '}' AS lang_counts
       FROM c GROUP BY source""",
)
def s08(spark, root):
    path = scratch_path(spark, "nested")
    files.write_csv(
        rollups.count_maps(views.documents(spark, root), ["source"], "lang"), path, ["source", "lang_counts"]
    )
    return files.read_text_cells(spark, path, ["source", "lang_counts"])


@query(
    "s09_json_lines_sink",
    """SELECT o_orderkey AS doc_key,
       concat('{"doc_key":', o_orderkey, ',"priority":',
              CASE WHEN o_orderstatus = 'O' THEN 'null' ELSE concat('"', o_orderpriority, '"') END, '}') AS line
       FROM orders""",
)
def s09(spark, root):
    path = scratch_path(spark, "nulls")
    files.write_json_lines(
        views.table(spark, root, "orders").select(
            F.col("o_orderkey").alias("doc_key"),
            F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("priority"),
        ),
        path,
    )
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.doc_key").cast("bigint").alias("doc_key"), F.col("value").alias("line"))


# --------------------------------------------------------------- columns and subsets

KEEP = "invoice_no, stock_code, description, quantity, invoice_date, unit_price, customer_id, country"


def lines_sql(source: str, columns: str) -> str:
    return f"WITH {LINES} SELECT {columns} FROM {source}"


@query("p01_normalize_lines", money_sql(LINES, f"SELECT {KEEP}, row_id FROM typed", "unit_price"))
def p01(spark, root):
    lines = normalize.normalize_lines(views.retail_raw(spark, root))
    return plain(lines.select(*normalize.LINE_COLUMNS, "row_id"))


@query(
    "p02_collapse_description",
    f"WITH {LINES} SELECT description, count(*) AS n FROM typed GROUP BY description",
)
def p02(spark, root):
    return rollups.value_counts(normalize.normalize_lines(views.retail_raw(spark, root)), "description")


@query(
    "p03_calendar_keys",
    f"WITH {LINES} SELECT invoice_date_only, year_month, count(*) AS n FROM typed GROUP BY ALL",
)
def p03(spark, root):
    lines = normalize.normalize_lines(views.retail_raw(spark, root))
    return rollups.value_counts(lines, "invoice_date_only", "year_month")


@query("p04_line_revenue", money_sql(LINES, "SELECT row_id, quantity, unit_price, revenue FROM typed", LINE_MONEY))
def p04(spark, root):
    lines = normalize.normalize_lines(views.retail_raw(spark, root))
    return plain(lines.select("row_id", "quantity", "unit_price", "revenue"))


FLAGS = (
    "is_exact_duplicate", "is_cancel_invoice", "is_negative_quantity", "is_nonpositive_unit_price",
    "is_missing_description", "has_no_digit_stock_code", "is_non_merchandise",
)


@query("p05_quality_flags", lines_sql("lines", "row_id, " + ", ".join(FLAGS[1:])))
def p05(spark, root):
    lines = normalize.add_quality_flags(normalize.normalize_lines(views.retail_raw(spark, root)))
    return lines.select("row_id", *FLAGS[1:])


REASON = """concat_ws(';', CASE WHEN is_exact_duplicate THEN 'exact_duplicate' END,
  CASE WHEN is_cancel_invoice THEN 'cancel_invoice' END, CASE WHEN is_negative_quantity THEN 'negative_quantity' END,
  CASE WHEN is_nonpositive_unit_price THEN 'nonpositive_unit_price' END,
  CASE WHEN is_missing_description THEN 'missing_description' END)"""
NOT_SALES = """(is_exact_duplicate OR is_cancel_invoice OR is_negative_quantity
  OR is_nonpositive_unit_price OR is_missing_description)"""


@query("p06_exclusion_reason", lines_sql("lines", f"row_id, {REASON} AS exclusion_reason"))
def p06(spark, root):
    return views.retail_lines(spark, root).select("row_id", normalize.exclusion_reason().alias("exclusion_reason"))


@query("w01_exact_duplicate_flag", lines_sql("lines", "row_id, is_exact_duplicate"))
def w01(spark, root):
    return normalize.flag_exact_duplicates(views.typed_lines(spark, root)).select("row_id", "is_exact_duplicate")


def subset_query(name: str, source: str, fn, where: str = "true") -> None:
    sql = f"WITH {LINES} SELECT row_id, CAST(revenue AS DOUBLE) AS revenue FROM {source} WHERE {where}"
    query(name, sql)(lambda spark, root: plain(fn(spark, root).select("row_id", "revenue")))


subset_query("f01_positive_sales", "sales", views.sales)
subset_query("f02_net_revenue_lines", "net", views.net)
subset_query(
    "f03_cancellations", "lines", lambda s, r: normalize.cancellation_lines(views.retail_lines(s, r)),
    "(is_cancel_invoice OR is_negative_quantity) AND NOT is_exact_duplicate",
)
subset_query("f04_merchandise_net", "goods_net", views.goods_net)


@query("f05_excluded_lines", lines_sql("lines", f"row_id, {REASON} AS exclusion_reason") + f" WHERE {NOT_SALES}")
def f05(spark, root):
    return normalize.excluded_lines(views.retail_lines(spark, root)).select("row_id", "exclusion_reason")


PERIOD = views.PERIOD


@query(
    "f06_period_window",
    f"WITH {SUMMARIES} SELECT year_month, CAST(net_revenue AS DOUBLE) AS net_revenue FROM monthly_net WHERE {PERIOD}",
)
def f06(spark, root):
    month = F.col("year_month")
    ends = views.bounds(spark, root)
    in_period = views.net(spark, root).filter(month.between(ends.first, ends.last))
    return plain(rollups.net_summary(in_period, ["year_month"]).select("year_month", "net_revenue"))


@query(
    "f07_entity_exclusion",
    f"WITH {SUMMARIES} SELECT year_month, country, CAST(net_revenue AS DOUBLE) AS net_revenue "
    f"FROM country_month WHERE country NOT IN ('{views.HOME_COUNTRY}')",
)
def f07(spark, root):
    kept = views.country_month_net(spark, root).filter(~F.col("country").isin(views.HOME_COUNTRY))
    return plain(kept.select("year_month", "country", "net_revenue"))


# ------------------------------------------------------------------------- roll-ups


def sales_sql(source: str, keys: str, customers: bool = True, extra: str = "") -> str:
    people = "count(DISTINCT customer_id) AS customer_count," if customers else ""
    return f"""WITH {LINES} SELECT {keys}, count(*) AS line_count, count(DISTINCT invoice_no) AS invoice_count, {people}
      CAST(sum(quantity) AS BIGINT) AS total_quantity, CAST(sum(revenue) AS DOUBLE) AS total_revenue {extra}
      FROM {source} GROUP BY {keys}"""


def net_sql(source: str, keys: str, customers: bool = True, extra: str = "") -> str:
    return money_sql(LINES, sql_net(source, keys, customers, extra), NET_MONEY)


@query(
    "a01_monthly_sales",
    sales_sql("sales", "year_month", extra=", round(CAST(sum(revenue) AS DOUBLE) / count(*), 6) AS avg_line_revenue"),
)
def a01(spark, root):
    out = plain(rollups.monthly_sales(views.sales(spark, root)))
    return out.withColumn("avg_line_revenue", F.round("avg_line_revenue", 6))


@query(
    "a02_monthly_coverage",
    f"""WITH {LINES} SELECT year_month, min(invoice_date) AS first_invoice_datetime,
    max(invoice_date) AS last_invoice_datetime, count(DISTINCT invoice_date_only) AS transaction_days,
    count(*) AS line_count, count(DISTINCT invoice_no) AS invoice_count,
    {PERIOD} AS recommended_for_monthly_trend_questions,
    CASE WHEN year_month {views.IS_PARTIAL} THEN (SELECT note FROM bounds) ELSE '' END AS notes
    FROM net GROUP BY year_month""",
)
def a02(spark, root):
    ends = views.bounds(spark, root)
    return rollups.monthly_coverage(views.net(spark, root), ends.first, ends.last, ends.partial, ends.note)


query("a03_monthly_net", net_sql("net", "year_month"))(lambda s, r: plain(unstored(views.monthly_net)(s, r)))
query("a04_country_month_sales", sales_sql("sales", "year_month, country"))(
    lambda s, r: plain(rollups.sales_summary(views.sales(s, r), ["year_month", "country"]))
)
query("a05_country_month_net", net_sql("net", "year_month, country"))(
    lambda s, r: plain(unstored(views.country_month_net)(s, r))
)
PRODUCT_MONTH = "year_month, stock_code, description"
query("a06_product_month_sales", sales_sql("goods_sales", PRODUCT_MONTH, False))(
    lambda s, r: plain(rollups.sales_summary(views.goods_sales(s, r), PRODUCT_MONTH.split(", "), False))
)
query("a07_product_month_net", net_sql("goods_net", PRODUCT_MONTH, False))(
    lambda s, r: plain(unstored(views.product_month_net)(s, r))
)
query(
    "a08_product_sales",
    sales_sql("goods_sales", "stock_code, description", False,
              ", min(invoice_date_only) AS first_sale_date, max(invoice_date_only) AS last_sale_date"),
)(lambda s, r: plain(rollups.product_sales(views.goods_sales(s, r))))
query(
    "a09_product_net",
    net_sql("goods_net", "stock_code, description", False,
            ", min(invoice_date_only) AS first_transaction_date, max(invoice_date_only) AS last_transaction_date"),
)(lambda s, r: plain(rollups.product_net(views.goods_net(s, r))))
query("a10_country_sales", sales_sql("sales", "country"))(
    lambda s, r: plain(rollups.sales_summary(views.sales(s, r), ["country"]))
)
query("a11_country_net", net_sql("net", "country"))(
    lambda s, r: plain(rollups.net_summary(views.net(s, r), ["country"]))
)

RAW_COLUMNS = "InvoiceNo StockCode Description Quantity InvoiceDate UnitPrice CustomerID Country".split()
PROFILE = {
    "raw_rows": "SELECT count(*) FROM raw",
    **{f"missing_{c}": f"SELECT count(*) FROM raw WHERE {c} IS NULL" for c in RAW_COLUMNS},
    "duplicate_rows": "SELECT (SELECT count(*) FROM raw) - count(*) FROM (SELECT DISTINCT * EXCLUDE (row_id) FROM raw)",
    "invoice_count": "SELECT count(DISTINCT InvoiceNo) FROM raw",
    "stock_code_count": "SELECT count(DISTINCT StockCode) FROM raw",
    "description_count": "SELECT count(DISTINCT Description) FROM raw",
    "country_count": "SELECT count(DISTINCT Country) FROM raw",
    "customer_count": "SELECT count(DISTINCT CustomerID) FROM raw",
    "cancel_invoice_rows": "SELECT count(*) FROM lines WHERE is_cancel_invoice",
    "negative_quantity_rows": "SELECT count(*) FROM lines WHERE is_negative_quantity",
    "zero_quantity_rows": "SELECT count(*) FROM lines WHERE quantity = 0",
    "negative_unit_price_rows": "SELECT count(*) FROM lines WHERE unit_price < 0",
    "zero_unit_price_rows": "SELECT count(*) FROM lines WHERE unit_price = 0",
    "non_merchandise_rows": "SELECT count(*) FROM lines WHERE is_non_merchandise",
}


@query(
    "a12_table_profile",
    f"WITH {LINES} " + " UNION ALL ".join(f"SELECT '{k}' AS metric, ({v}) AS value" for k, v in PROFILE.items()),
)
def a12(spark, root):
    raw = durable(views.retail_raw(spark, root))
    lines = normalize.add_quality_flags(normalize.normalize_lines(raw))
    return rollups.table_profile(raw, lines)


SUBSETS = {
    "positive_sales_rows": ("sales", "count(*)"),
    "merchandise_sales_rows": ("goods_sales", "count(*)"),
    "valid_net_revenue_rows": ("net", "count(*)"),
    "merchandise_net_revenue_rows": ("goods_net", "count(*)"),
    "cancellation_or_return_rows": (
        "lines WHERE (is_cancel_invoice OR is_negative_quantity) AND NOT is_exact_duplicate", "count(*)"),
    "excluded_rows": (f"lines WHERE {NOT_SALES}", "count(*)"),
    "positive_sales_revenue": ("sales", "round(sum(revenue), 2)"),
    "merchandise_sales_revenue": ("goods_sales", "round(sum(revenue), 2)"),
    "net_revenue": ("net", "round(sum(revenue), 2)"),
    "merchandise_net_revenue": ("goods_net", "round(sum(revenue), 2)"),
}


@query(
    "a12_subset_totals",
    f"WITH {LINES} "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS metric, CAST({agg} AS DOUBLE) AS value FROM {src}" for k, (src, agg) in SUBSETS.items()
    ),
)
def a12_subsets(spark, root):
    return rollups.subset_totals(views.retail_lines(spark, root))


# --------------------------------------------------------------------------- checks


def stored_lines(spark, root) -> DataFrame:
    """The cleaned lines as a stored table: every check below reads it."""
    return durable(views.retail_lines(spark, root))


def seeded_checks(lines: DataFrame) -> DataFrame:
    """The row checks on published subsets into which some excluded lines slipped."""
    slipped = F.col("quantity") % 13 == 0
    sales = lines.filter(normalize.positive_sales_condition() | slipped)
    net = normalize.net_revenue_lines(lines).unionByName(lines.filter(F.col("is_exact_duplicate") & slipped))
    return row_checks(lines, sales, net, "slipped_")


def row_checks(lines: DataFrame, sales: DataFrame | None = None, net: DataFrame | None = None, prefix: str = "") -> DataFrame:
    sales, net = sales or normalize.positive_sales(lines), net or normalize.net_revenue_lines(lines)
    positive = ~F.col("is_cancel_invoice") & (F.col("quantity") >= 0)
    priced = (F.col("unit_price") > 0) & (F.length("description") > 0) & ~F.col("is_exact_duplicate")
    return quality.violations(
        sales, {f"{prefix}sales_not_returned": positive, f"{prefix}sales_priced": priced}
    ).unionByName(quality.violations(net, {f"{prefix}net_priced": priced}))


SLIPPED = f"""published_sales AS (SELECT * FROM sales UNION ALL SELECT * FROM lines WHERE quantity % 13 = 0 AND {NOT_SALES}),
published_net AS (SELECT * FROM net UNION ALL SELECT * FROM lines WHERE quantity % 13 = 0 AND is_exact_duplicate)"""
POSITIVE_SQL = "NOT is_cancel_invoice AND quantity >= 0"
PRICED_SQL = "unit_price > 0 AND length(description) > 0 AND NOT is_exact_duplicate"
ROW_CHECKS = " UNION ALL ".join(
    f"""SELECT '{name}' AS check_name, count(*) FILTER (NOT coalesce({ok}, false)) = 0 AS passed, count(*) FILTER (NOT coalesce({ok}, false)) AS detail FROM {source}"""
    for name, ok, source in [
        ("sales_not_returned", POSITIVE_SQL, "sales"), ("sales_priced", PRICED_SQL, "sales"), ("net_priced", PRICED_SQL, "net"),
        ("slipped_sales_not_returned", POSITIVE_SQL, "published_sales"), ("slipped_sales_priced", PRICED_SQL, "published_sales"), ("slipped_net_priced", PRICED_SQL, "published_net"),
    ]
)


@query("v09_subset_predicates", f"WITH {LINES}, {SLIPPED} {ROW_CHECKS}")
def v09(spark, root):
    lines = stored_lines(spark, root)
    return row_checks(lines).unionByName(seeded_checks(lines))


def grain_checks(lines: DataFrame) -> DataFrame:
    net = normalize.net_revenue_lines(lines)
    goods = normalize.merchandise(net)
    by_line = quality.reconcile(
        net, "revenue",
        {
            "monthly_net": (rollups.net_summary(net, ["year_month"]), "net_revenue"),
            "country_month_net": (rollups.net_summary(net, ["year_month", "country"]), "net_revenue"),
            "country_net": (rollups.net_summary(net, ["country"]), "net_revenue"),
        },
        0.01,
    )
    products = quality.reconcile(
        goods, "revenue",
        {
            "product_month_net": (rollups.net_summary(goods, PRODUCT_MONTH.split(", "), False), "net_revenue"),
            "product_net": (rollups.product_net(goods), "net_revenue"),
        },
        0.01,
    )
    flagged = lines.agg(
        F.count("*").alias("total"),
        F.count_if(normalize.positive_sales_condition()).alias("kept"),
        F.count_if(F.length(normalize.exclusion_reason()) > 0).alias("excluded"),
    )
    conserved = flagged.select(
        F.lit("row_conservation").alias("check_name"),
        (F.col("total") == F.col("kept") + F.col("excluded")).alias("passed"),
    )
    return reduce(DataFrame.unionByName, [by_line, products, conserved])


RECONCILED_CTE = "t AS (SELECT (SELECT sum(revenue) FROM net) AS n, (SELECT sum(revenue) FROM goods_net) AS g)"
RECONCILED = f"""SELECT 'monthly_net' AS check_name, abs((SELECT sum(net_revenue) FROM monthly_net) - n) <= 0.01 AS passed FROM t
    UNION ALL SELECT 'country_month_net', abs((SELECT sum(net_revenue) FROM country_month) - n) <= 0.01 FROM t
    UNION ALL SELECT 'country_net', abs((SELECT sum(s) FROM (SELECT sum(revenue) s FROM net GROUP BY country)) - n) <= 0.01 FROM t
    UNION ALL SELECT 'product_month_net', abs((SELECT sum(net_revenue) FROM product_month) - g) <= 0.01 FROM t
    UNION ALL SELECT 'product_net', abs((SELECT sum(s) FROM (SELECT sum(revenue) s FROM goods_net GROUP BY stock_code, description)) - g) <= 0.01 FROM t
    UNION ALL SELECT 'row_conservation', (SELECT count(*) FROM lines) = (SELECT count(*) FROM sales) + (SELECT count(*) FROM lines WHERE {NOT_SALES})"""


@query(
    "v07_reconciliation",
    f"WITH {SUMMARIES}, {RECONCILED_CTE} {RECONCILED}",
)
def v07(spark, root):
    return grain_checks(stored_lines(spark, root))



COMPONENTS = ("monthly_net", "country_month", "product_month")


def component_checks(lines: DataFrame) -> DataFrame:
    net = normalize.net_revenue_lines(lines)
    frames = [
        rollups.net_summary(net, ["year_month"]),
        rollups.net_summary(net, ["year_month", "country"]),
        rollups.net_summary(normalize.merchandise(net), PRODUCT_MONTH.split(", "), False),
    ]
    parts = F.col("gross_positive_revenue") + F.col("cancellation_revenue")
    same = quality.relative_identity(parts.cast("double"), F.col("net_revenue").cast("double"))
    return reduce(
        DataFrame.unionByName,
        [quality.violations(frame, {f"{name}_components": same}) for name, frame in zip(COMPONENTS, frames)],
    )


COMPONENT_CHECKS = " UNION ALL ".join(
    f"""SELECT '{t}_components' AS check_name, count(*) FILTER (NOT ok) = 0 AS passed, count(*) FILTER (NOT ok) AS detail
    FROM (SELECT abs(gross_positive_revenue + cancellation_revenue - net_revenue) <= 1e-8 + 1e-5 * abs(net_revenue) AS ok FROM {t})"""
    for t in COMPONENTS
)


@query(
    "v08_component_identity",
    f"WITH {SUMMARIES} {COMPONENT_CHECKS}",
)
def v08(spark, root):
    return component_checks(stored_lines(spark, root))


@query(
    "v26_check_roll_up",
    f"""WITH {SUMMARIES}, {SLIPPED}, {RECONCILED_CTE}, every_check AS (SELECT check_name, passed FROM ({ROW_CHECKS}) UNION ALL {RECONCILED} UNION ALL SELECT check_name, passed FROM ({COMPONENT_CHECKS}))
    SELECT count(*) AS num_checks, count(*) FILTER (NOT passed) AS num_failures, bool_and(passed) AS all_passed FROM every_check""",
)
def v26(spark, root):
    names, lines = ["check_name", "passed"], stored_lines(spark, root)
    checks = reduce(
        DataFrame.unionByName,
        [f(lines).select(*names) for f in (row_checks, seeded_checks, grain_checks, component_checks)],
    )
    return quality.roll_up(checks)
