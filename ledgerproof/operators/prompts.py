"""Prompt tables: evidence order, Markdown rendering and the text templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerproof.functions.numbers import currency, fixed2
from ledgerproof.operators.ordering import sorted_stretches

# Display names of evidence columns and the template texts.
DISPLAY = {
    "country": "country",
    "stock_code": "stock_code",
    "description": "product_name",
    "year_month": "year_month",
    "net_revenue": "net_revenue_gbp",
    "gross_positive_revenue": "gross_positive_revenue_gbp",
    "cancellation_revenue": "cancellation_return_revenue_gbp",
    "invoice_count": "invoice_count",
}
PRODUCT_TYPES = ("top_product_month", "top3_products_month", "product_revenue_share_month")
COUNTRY_TYPES = ("top_country_month", "country_comparison_month")
AMOUNTS = ("net_revenue", "gross_positive_revenue", "cancellation_revenue")
COLUMNS = {
    "product": ("stock_code", "description", *AMOUNTS),
    "country": ("country", *AMOUNTS, "invoice_count"),
    "month": ("year_month", *AMOUNTS, "invoice_count"),
}
SYSTEM_TEXT = (
    "You are a cautious business analyst. Use only the evidence provided in the user message. "
    "Do not use outside knowledge. Do not invent causes, marketing explanations, inventory recommendations, "
    "or strategic advice unless directly supported by the evidence. If a conclusion is not supported, do not state it. "
    "Answer concisely and include the key calculation or comparison when useful."
)
DEFINITIONS = (
    "- net_revenue = gross_positive_revenue + cancellation_return_revenue.\n"
    "- cancellation_return_revenue is negative when cancellations or returns reduce revenue.\n"
    "- All currency amounts are in GBP."
)
PRODUCT_DEFINITION = (
    "\n- merchandise net revenue excludes non-product charges such as postage, discounts, bank charges, and manual adjustments."
)
SHARE_DEFINITION = ("\n- Total merchandise net revenue for the month is ", "; use this as the denominator for share calculations.")
RETURN_NOTE = "- Report the reduction as a positive amount even though cancellation_return_revenue is negative."
CHANGE_NOTE = "- For percentage change, divide the absolute change by the previous month's net revenue."
NO_NOTE = "- No additional scope notes."
FREE_TAIL = (
    "Response requirements:\n"
    "- Answer in 2 to 4 sentences.\n"
    "- Use GBP for currency amounts.\n"
    "- Include the relevant country, product, month, ranking, or percentage requested.\n"
    "- Do not add unsupported causes or recommendations.\n"
)
TABLE_COLUMNS = ("rank", "stock_code", "product_name", "net_revenue_gbp")
CONTRACT_TAIL = (
    "Structured response requirements:\n"
    "- First determine the top 3 rows by net_revenue_gbp in descending order.\n"
    "- Return exactly one markdown table and no extra prose.\n"
    "- The table must use exactly these columns: rank, stock_code, product_name, net_revenue_gbp.\n"
    "- Each output row must copy stock_code, product_name, and net_revenue_gbp from one evidence row.\n"
    "- Do not use gross_positive_revenue_gbp or cancellation_return_revenue_gbp as the ranked metric.\n"
    "- Do not include any product outside the evidence table.\n\n"
    "Required output table:\n"
    "| rank | stock_code | product_name | net_revenue_gbp |\n"
    "| --- | --- | --- | --- |\n"
    "| 1 | ... | ... | GBP ... |\n"
    "| 2 | ... | ... | GBP ... |\n"
    "| 3 | ... | ... | GBP ... |\n"
)
CONTROL_NOTE = (
    "Diagnostic control note:\n"
    "- For this control run only, the evidence table is already sorted by net_revenue_gbp in descending order.\n"
    "- This condition is used to test copying and rank binding, not final benchmark fairness.\n\n"
)


CONTROL_POLICY = "sorted_by_net_revenue_desc_control"


def _family(question_type: Column) -> Column:
    return (
        F.when(question_type.isin(*PRODUCT_TYPES), "product")
        .when(question_type.isin(*COUNTRY_TYPES), "country")
        .otherwise("month")
    )


def row_order_policy(question_type: Column) -> Column:
    return (
        F.when(question_type.isin(*PRODUCT_TYPES), "deterministic_hash_by_question_and_product")
        .when(question_type.isin(*COUNTRY_TYPES), "alphabetical_by_country")
        .when(question_type == "monthly_revenue_change", "chronological_by_year_month")
        .when(question_type == "return_impact_month", "single_month_row")
        .otherwise("source_order")
    )


def _or_none(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def order_key(policy: Column, question_id: Column, row: Column) -> Column:
    """The text a row sorts by. The hash order tells nothing about the answer."""
    hashed = F.sha2(
        F.concat(question_id, F.lit("|"), _or_none(row["stock_code"]), F.lit("|"), _or_none(row["description"])), 256
    )
    return (
        F.when(policy == "deterministic_hash_by_question_and_product", hashed)
        .when(policy == "alphabetical_by_country", F.lower(row["country"]))
        .when(policy == "chronological_by_year_month", row["year_month"])
        .otherwise("")
    )


def ordered_evidence(rows: Column, policy: Column, question_id: Column) -> Column:
    """Evidence rows in policy order; equal keys keep their source order."""
    keyed = F.transform(
        rows, lambda r, i: F.struct(order_key(policy, question_id, r).alias("k"), i.alias("i"), r.alias("r"))
    )
    return F.transform(F.array_sort(keyed), lambda x: x["r"])


def metric_descending(rows: Column) -> Column:
    """The control order: largest net revenue first, ties in source order."""
    keyed = F.transform(rows, lambda r, i: F.struct((-r["net_revenue"]).alias("k"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda x: x["r"])


def _cell(row: Column, name: str) -> Column:
    c = fixed2(row[name]) if name in AMOUNTS else row[name].cast("string")
    return F.when(row[name].isNull(), "").otherwise(c)


def table_line(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown(rows: Column, columns: tuple[str, ...]) -> Column:
    head = [F.lit(table_head(columns))]
    body = F.transform(rows, lambda r: table_line([_cell(r, n) for n in columns]))
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(F.concat(F.array(*head), body), "\n"))


def table_head(columns: tuple[str, ...]) -> str:
    names = " | ".join(DISPLAY.get(c, c) for c in columns)
    return f"| {names} |\n| {' | '.join('---' for _ in columns)} |"


def evidence_table(rows: Column, question_type: Column) -> Column:
    family = _family(question_type)
    return (
        F.when(family == "product", markdown(rows, COLUMNS["product"]))
        .when(family == "country", markdown(rows, COLUMNS["country"]))
        .otherwise(markdown(rows, COLUMNS["month"]))
    )


def definitions(question_type: Column, total: Column) -> Column:
    share = F.concat(F.lit(SHARE_DEFINITION[0]), currency(total), F.lit(SHARE_DEFINITION[1]))
    return F.concat(
        F.lit(DEFINITIONS),
        F.when(question_type.contains("product"), PRODUCT_DEFINITION).otherwise(""),
        F.when((question_type == "product_revenue_share_month") & total.isNotNull(), share).otherwise(""),
    )


def scope_notes(question_type: Column, filters: Column, partial_month: str, partial_note: str) -> Column:
    excluded = filters["exclude_countries"]
    notes = F.concat_ws(
        "\n",
        F.when(F.length(excluded) > 0,
               F.concat(F.lit("- Exclude these countries when selecting the answer: "), excluded, F.lit("."))),
        F.when(filters["year_month"] == partial_month, F.lit(f"- {partial_note}")),
        F.when(question_type == "return_impact_month", RETURN_NOTE),
        F.when(question_type == "monthly_revenue_change", CHANGE_NOTE),
    )
    return F.when(notes == "", NO_NOTE).otherwise(notes)


def user_text(table: Column, partial_month: str, partial_note: str, tail: Column) -> Column:
    kind, c = F.col("question_type"), F.col
    return F.concat(
        F.lit("Business question:\n"), c("question"),
        F.lit("\n\nMetric definitions:\n"), definitions(kind, c("evidence.total_merchandise_net_revenue")),
        F.lit("\n\nScope notes:\n"), scope_notes(kind, c("evidence.filters"), partial_month, partial_note),
        F.lit("\n\nEvidence table:\n"), table, F.lit("\n\n"), tail,
    )


def _finish(df: DataFrame, suffix: str, partial_month: str, partial_note: str, tail: Column) -> DataFrame:
    table = evidence_table(F.col("prompt_evidence_rows"), F.col("question_type"))
    user = user_text(F.col("evidence_table_markdown"), partial_month, partial_note, tail)
    return (
        df.withColumn("evidence_table_markdown", table)
        .withColumn("prompt_id", F.concat(F.lit("p_"), F.expr("substring(question_id, 3)"), F.lit(suffix)))
        .withColumn("user_prompt", user)
        .withColumn("full_prompt", F.concat(F.lit(f"System:\n{SYSTEM_TEXT}\n\nUser:\n"), F.col("user_prompt")))
    )


def prompts(questions: DataFrame, partial_month: str, partial_note: str) -> DataFrame:
    """One prompt row per question, evidence in its leak-free order."""
    policy = row_order_policy(F.col("question_type"))
    rows = ordered_evidence(F.col("evidence.rows"), policy, F.col("question_id"))
    ordered = questions.withColumn("row_order_policy", policy).withColumn("prompt_evidence_rows", rows)
    return _finish(ordered, "", partial_month, partial_note, F.lit(FREE_TAIL))


def table_contract_prompts(questions: DataFrame, partial_month: str, partial_note: str, control: bool = False) -> DataFrame:
    """The fixed-table answer contract; `control` shows evidence already sorted."""
    ranked = questions.filter(F.col("question_type") == "top3_products_month")
    if control:
        rows, policy, suffix = metric_descending(F.col("evidence.rows")), F.lit(CONTROL_POLICY), "_top3_sorted_control"
    else:
        policy, suffix = row_order_policy(F.col("question_type")), "_top3_structured"
        rows = ordered_evidence(F.col("evidence.rows"), policy, F.col("question_id"))
    tail = F.lit(CONTROL_NOTE + CONTRACT_TAIL if control else CONTRACT_TAIL)
    ordered = ranked.withColumn("row_order_policy", policy).withColumn("prompt_evidence_rows", rows)
    expected = F.transform(
        F.filter("gold_facts", lambda f: f["fact_type"] == "ranking")[0]["ranking"],
        lambda x: F.struct(
            x["rank"].alias("rank"), x["stock_code"].alias("stock_code"), x["description"].alias("product_name"),
            currency(x["merchandise_net_revenue"]).alias("net_revenue_gbp"),
        ),
    )
    return _finish(ordered, suffix, partial_month, partial_note, tail).withColumn("expected_output_rows", expected)


def prompt_checks() -> dict[str, Column]:
    """Conditions that each prompt must meet on its own: question shown, answer not shown, policy of its type."""
    c = F.col
    return {
        "question_shown": F.contains("full_prompt", "question"),
        "answer_not_shown": ~F.contains("full_prompt", "gold_short_answer"),
        "gold_not_named": ~F.rlike(F.lower("full_prompt"), F.lit("gold_answer|gold short answer")),
        "evidence_present": F.contains("full_prompt", F.lit("Evidence table:")) & (F.size("prompt_evidence_rows") > 0),
        "table_is_markdown": c("evidence_table_markdown").startswith("| "),
        "policy_fits_type": c("row_order_policy") == row_order_policy(c("question_type")),
        "share_total_shown": (c("question_type") != "product_revenue_share_month")
        | F.contains("full_prompt", F.lit("Total merchandise net revenue for the month is GBP")),
    }


def evidence_lines(made: DataFrame) -> DataFrame:
    """One row per evidence row of each prompt: its place, what its stated policy sorts by, and the gold metric."""
    placed = made.select("prompt_id", "question_id", "row_order_policy", F.posexplode("prompt_evidence_rows").alias("place", "row"))
    row = F.col("row")
    return placed.select(
        "prompt_id", "row_order_policy", "place", order_key(F.col("row_order_policy"), F.col("question_id"), row).alias("sort_key"),
        row["net_revenue"].alias("metric"),
    )


def order_report(made: DataFrame) -> DataFrame:
    """Per prompt with evidence: policy, rows, neighbours that break the stated policy, and the
    longest stretch of rows that falls by the gold metric.

    The keys are made again from the rows, so an order that was stored wrongly shows. The
    control's policy is the metric itself.
    """
    lines = evidence_lines(made)
    key = ["prompt_id", "row_order_policy"]
    stated = sorted_stretches(lines, key, "place", "sort_key").select(*key, "rows", F.col("breaks").alias("key_breaks"))
    metric = sorted_stretches(lines, key, "place", "metric", descending=True)
    metric = metric.select(*key, F.col("breaks").alias("metric_breaks"), F.col("longest_run").alias("falling_rows"))
    control = F.col("row_order_policy") == CONTROL_POLICY
    return stated.join(metric, key).select(
        *key, "rows", F.when(control, F.col("metric_breaks")).otherwise(F.col("key_breaks")).alias("policy_breaks"), "falling_rows"
    )


POLICIES = {
    "hash_order": "deterministic_hash_by_question_and_product", "countries_alphabetical": "alphabetical_by_country",
    "months_chronological": "chronological_by_year_month", "control_falls_by_metric": CONTROL_POLICY,
}


def policy_checks(report: DataFrame) -> DataFrame:
    """One check row per policy; detail counts the neighbours that break it. A policy of one row allows no second."""
    breaks = [
        F.coalesce(F.sum(F.when(F.col("row_order_policy") == p, F.col("policy_breaks"))), F.lit(0)).alias(n) for n, p in POLICIES.items()
    ]
    breaks.append(F.count_if((F.col("row_order_policy") == "single_month_row") & (F.col("rows") > 1)).alias("one_row_for_one_month"))
    counted = report.agg(*breaks)
    return counted.unpivot([], counted.columns, "check_name", "detail").select("check_name", (F.col("detail") == 0).alias("passed"), "detail")


def order_leaks(report: DataFrame) -> DataFrame:
    """Prompts, but for the control, whose evidence of more than one row is already in the answer's order."""
    return report.filter((F.col("row_order_policy") != CONTROL_POLICY) & (F.col("rows") > 1) & (F.col("falling_rows") == F.col("rows")))


def fill_template(template: Column, name: str, value: Column) -> Column:
    return F.replace(template, F.lit(f"{{{name}}}"), value)
