"""Prompt tables and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerproof.functions.numbers import fixed2
from ledgerproof.operators import gold, prompts, quality
from ledgerproof.plans import views
from ledgerproof.plans.gold import NET2, QUESTIONS, questions
from ledgerproof.plans.register import query
from ledgerproof.plans.views import bounds, sql_currency, sql_fixed2
from ledgerproof.session import durable



def q(text: str) -> str:
    """A text constant for the check engine."""
    return "'" + text.replace("'", "''") + "'"


AMOUNT_CELLS = ", ".join(sql_fixed2(f"round({c}, 2)") for c in prompts.AMOUNTS)


def line(*cells: str) -> str:
    return f"concat('| ', concat_ws(' | ', {', '.join(cells)}), ' |')"


PRODUCT_LINE = line("m.stock_code", "m.description", AMOUNT_CELLS)
COUNTRY_LINE = line("m.country", AMOUNT_CELLS, "CAST(m.invoice_count AS VARCHAR)")
MONTH_LINE = line("m.year_month", AMOUNT_CELLS, "CAST(m.invoice_count AS VARCHAR)")
HASH = "sha256(concat(question_id, '|', m.stock_code, '|', m.description))"
PRODUCT_IN = "question_type IN ('top_product_month', 'top3_products_month', 'product_revenue_share_month')"

EVIDENCE = f"""
{QUESTIONS},
comparison_rows AS (SELECT select_ord, m.*, row_number() OVER (PARTITION BY select_ord, m.country ORDER BY part) AS rn FROM (
    SELECT select_ord, p.year_month AS ym, c.country AS co, 0 AS part FROM picked p JOIN country_month c
      ON c.year_month = p.year_month AND c.country IN (country_a, country_b)
    UNION ALL SELECT select_ord, p.year_month, c.country, 1 FROM picked p JOIN cm_all c ON c.year_month = p.year_month AND c.rank <= 3) x
  JOIN country_month m ON m.year_month = ym AND m.country = co),
evidence AS (
  SELECT question_id, lower(m.country) AS k, CAST(0 AS BIGINT) AS i, {COUNTRY_LINE} AS line, net_revenue FROM questions JOIN cm_all m ON ord = concat('0|', m.year_month) AND rank = 1 WHERE question_type = 'top_country_month'
  UNION ALL SELECT question_id, lower(m.country), rank, {COUNTRY_LINE}, net_revenue FROM questions JOIN cm_pool m ON ord = concat('0|', m.year_month) WHERE question_type = 'top_country_month'
  UNION ALL SELECT question_id, lower(m.country), rank, {COUNTRY_LINE}, net_revenue FROM questions JOIN cm_all m ON ord = concat('1|', m.year_month) WHERE question_type = 'top_country_month'
  UNION ALL SELECT question_id, lower(m.country), rn, {COUNTRY_LINE}, net_revenue FROM questions JOIN comparison_rows m ON ord = lpad(CAST(select_ord AS VARCHAR), 9, '0') AND rn = 1 WHERE question_type = 'country_comparison_month'
  UNION ALL SELECT question_id, {HASH}, rank, {PRODUCT_LINE}, net_revenue FROM questions JOIN pm_all m ON m.year_month = right(ord, 7) WHERE {PRODUCT_IN}
  UNION ALL SELECT question_id, m.year_month, 0, {MONTH_LINE}, net_revenue FROM questions JOIN change ON ord = current_month JOIN monthly_net m ON m.year_month IN (previous_month, current_month) WHERE question_type = 'monthly_revenue_change'
  UNION ALL SELECT question_id, '', 0, {MONTH_LINE}, net_revenue FROM questions JOIN monthly_net m ON m.year_month = ord WHERE question_type = 'return_impact_month'),
heads AS (SELECT question_id, CASE WHEN {PRODUCT_IN} THEN {q(prompts.table_head(prompts.COLUMNS['product']))}
    WHEN question_type IN ('top_country_month', 'country_comparison_month') THEN {q(prompts.table_head(prompts.COLUMNS['country']))}
    ELSE {q(prompts.table_head(prompts.COLUMNS['month']))} END AS head FROM questions),
tables AS (SELECT question_id, concat(any_value(head), chr(10), string_agg(line, chr(10) ORDER BY k, i)) AS shown,
    concat(any_value(head), chr(10), string_agg(line, chr(10) ORDER BY net_revenue DESC, i)) AS sorted
    FROM evidence JOIN heads USING (question_id) GROUP BY question_id)
"""


def user_sql(table: str, tail: str) -> str:
    return f"""concat({q('Business question:' + chr(10))}, question, {q(chr(10) * 2 + 'Metric definitions:' + chr(10) + prompts.DEFINITIONS)},
    CASE WHEN contains(question_type, 'product') THEN {q(prompts.PRODUCT_DEFINITION)} ELSE '' END,
    CASE WHEN question_type = 'product_revenue_share_month' THEN concat({q(prompts.SHARE_DEFINITION[0])},
      {sql_currency("(SELECT den FROM month_total t WHERE t.year_month = right(ord, 7))")}, {q(prompts.SHARE_DEFINITION[1])}) ELSE '' END,
    {q(chr(10) * 2 + 'Scope notes:' + chr(10))},
    coalesce(nullif(concat_ws(chr(10),
      CASE WHEN question_type = 'top_country_month' AND ord LIKE '0|%' THEN '- Exclude these countries when selecting the answer: {views.HOME_COUNTRY}.' END,
      CASE WHEN question_type NOT IN ('monthly_revenue_change', 'country_comparison_month') AND right(ord, 7) {views.IS_PARTIAL} THEN concat('- ', (SELECT prompt FROM bounds)) END,
      CASE WHEN question_type = 'return_impact_month' THEN {q(prompts.RETURN_NOTE)} END,
      CASE WHEN question_type = 'monthly_revenue_change' THEN {q(prompts.CHANGE_NOTE)} END), ''), {q(prompts.NO_NOTE)}),
    {q(chr(10) * 2 + 'Evidence table:' + chr(10))}, {table}, {q(chr(10) * 2 + tail)})"""


def noted(spark, root) -> tuple[str, str]:
    """The partial month and the note about it."""
    return bounds(spark, root).partial, bounds(spark, root).prompt


def made(spark, root):
    return prompts.prompts(questions(spark, root), *noted(spark, root))


POLICY_SQL = f"""CASE WHEN {PRODUCT_IN} THEN 'deterministic_hash_by_question_and_product'
  WHEN question_type IN ('top_country_month', 'country_comparison_month') THEN 'alphabetical_by_country'
  WHEN question_type = 'monthly_revenue_change' THEN 'chronological_by_year_month' ELSE 'single_month_row' END"""


@query(
    "w08_leak_free_row_order",
    f"WITH {EVIDENCE} SELECT question_id, {POLICY_SQL} AS row_order_policy, shown AS evidence_table FROM questions JOIN tables USING (question_id)",
)
def w08(spark, root):
    return made(spark, root).select(
        "question_id", "row_order_policy", F.col("evidence_table_markdown").alias("evidence_table")
    )


@query(
    "w09_metric_control_order",
    f"WITH {EVIDENCE} SELECT question_id, sorted AS evidence_table FROM questions JOIN tables USING (question_id) WHERE question_type = 'top3_products_month'",
)
def w09(spark, root):
    made = prompts.table_contract_prompts(questions(spark, root), *noted(spark, root), control=True)
    return made.select("question_id", F.col("evidence_table_markdown").alias("evidence_table"))


@query(
    "t11_markdown_table",
    f"""WITH {views.SUMMARIES} SELECT year_month, concat({q(prompts.table_head(prompts.COLUMNS['country']))}, chr(10),
      string_agg({COUNTRY_LINE}, chr(10) ORDER BY net_revenue DESC, country)) AS table_text FROM country_month m GROUP BY year_month""",
)
def t11(spark, root):
    place = F.struct(-F.col("net_revenue"), F.col("country"))
    tables = gold.evidence_rows(views.country_month_net(spark, root), ["year_month"], place)
    return tables.select("year_month", prompts.markdown(F.col("evidence"), prompts.COLUMNS["country"]).alias("table_text"))


@query(
    "g11_prompt_table",
    f"""WITH {EVIDENCE} SELECT concat('p_', substring(question_id, 3)) AS prompt_id, split,
    concat({q('System:' + chr(10) + prompts.SYSTEM_TEXT + chr(10) * 2 + 'User:' + chr(10))}, {user_sql('shown', prompts.FREE_TAIL)}) AS full_prompt
    FROM questions JOIN tables USING (question_id)""",
)
def g11(spark, root):
    return made(spark, root).select("prompt_id", "split", "full_prompt")


EXPECTED_SQL = f"""(SELECT string_agg(concat_ws('|', rank, stock_code, description, {sql_currency(NET2)}), chr(10) ORDER BY rank)
  FROM pm_all p WHERE p.year_month = ord AND rank <= 3) AS expected_rows"""


@query(
    "g12_prompt_variants",
    f"""WITH {EVIDENCE} SELECT concat('p_', substring(question_id, 3), '_top3_structured') AS prompt_id,
      {user_sql('shown', prompts.CONTRACT_TAIL)} AS user_prompt, {EXPECTED_SQL}
      FROM questions JOIN tables USING (question_id) WHERE question_type = 'top3_products_month'
    UNION ALL SELECT concat('p_', substring(question_id, 3), '_top3_sorted_control'),
      {user_sql('sorted', prompts.CONTROL_NOTE + prompts.CONTRACT_TAIL)}, {EXPECTED_SQL}
      FROM questions JOIN tables USING (question_id) WHERE question_type = 'top3_products_month'""",
)
def g12(spark, root):
    asked = questions(spark, root)
    row = lambda x: F.concat_ws("|", x["rank"].cast("string"), x["stock_code"], x["product_name"], x["net_revenue_gbp"])
    return gold.union_all(
        [
            prompts.table_contract_prompts(asked, *noted(spark, root), control).select(
                "prompt_id", "user_prompt", F.array_join(F.transform("expected_output_rows", row), "\n").alias("expected_rows")
            )
            for control in (False, True)
        ]
    )


@query(
    "p09_nested_records",
    f"""WITH {EVIDENCE}, told AS (SELECT question_id, string_agg(concat_ws('=', field, kind, value), '; ' ORDER BY field) AS answer FROM (
      SELECT question_id, field, CASE WHEN fact_type = 'ranking' THEN 'ranking' WHEN num_value IS NULL THEN 'text' ELSE 'number' END AS kind,
        CASE WHEN fact_type = 'ranking' THEN display_value WHEN num_value IS NULL THEN str_value ELSE {sql_fixed2('num_value')} END AS value FROM facts) GROUP BY question_id)
    SELECT question_id, question_type, split, answer, evidence_source, rows_shown, '{gold.GUIDANCE["answer_style"]}' AS answer_style,
      CASE WHEN question_type = 'product_revenue_share_month' THEN {sql_fixed2("(SELECT den FROM month_total t WHERE t.year_month = right(ord, 7))")} END AS total
    FROM questions JOIN told USING (question_id) JOIN (SELECT question_id, string_agg(line, chr(10) ORDER BY line) AS rows_shown FROM evidence GROUP BY 1) USING (question_id)""",
)
def p09_records(spark, root):
    """The records of all seven types, as JSON and back, with the answer's fields and the evidence rows told from the variants."""
    made = gold.nested_records(questions(spark, root))
    records = gold.parsed_records(durable(gold.record_json(made)))
    entry = F.concat_ws("=", "field", "kind", "text")
    told = gold.answer_fields(records).groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("field", entry.alias("e")))).getField("e"), "; ").alias("answer"))

    def cell(row, name):
        number = F.try_variant_get(row, f"$.{name}", "double")
        return fixed2(number) if name in prompts.AMOUNTS else F.try_variant_get(row, f"$.{name}", "string")

    def line_of(row):
        shapes = [F.when(F.col("evidence.source_file") == s, prompts.table_line([cell(row, n) for n in fields])) for s, fields in gold.SHOWN_FIELDS.items()]
        return F.coalesce(*shapes)

    total = F.try_variant_get("evidence.metadata", "$.total_merchandise_net_revenue", "double")
    return records.join(told, "question_id").select(
        "question_id", "question_type", "split", "answer", F.col("evidence.source_file").alias("evidence_source"),
        F.array_join(F.array_sort(F.transform("evidence.rows", line_of)), "\n").alias("rows_shown"), F.col("generation_guidance.answer_style").alias("answer_style"),
        F.when(total.isNotNull(), fixed2(total)).alias("total"))


# ------------------------------------------------------- checks, with planted faults

TOTAL_TEXT = "Total merchandise net revenue for the month is GBP"
DIGIT = "right(question_id, 1)"


def spoiled(frame):
    """The prompts with faults planted by the last digit of the question's number."""
    c, digit = F.col, F.substring("question_id", -1, 1)
    rows = c("prompt_evidence_rows")
    return frame.withColumns(
        {
            "full_prompt": F.when(digit == "1", F.replace("full_prompt", "question", F.lit("")))
            .when(digit == "2", F.concat("full_prompt", "gold_short_answer"))
            .when(digit == "3", F.concat("full_prompt", F.lit(" GOLD_answer")))
            .when(digit == "9", F.replace("full_prompt", F.lit(TOTAL_TEXT), F.lit("")))
            .otherwise(c("full_prompt")),
            "evidence_table_markdown": F.when(digit == "5", F.concat(F.lit("x"), "evidence_table_markdown")).otherwise(c("evidence_table_markdown")),
            "row_order_policy": F.when(digit == "6", "source_order").otherwise(c("row_order_policy")),
            "prompt_evidence_rows": F.when(digit == "4", F.filter(rows, lambda r: F.lit(False)))
            .when(digit == "7", F.reverse(rows))
            .when(digit == "8", prompts.metric_descending(c("evidence.rows")))
            .when((digit == "0") & (c("question_type") == "return_impact_month"), F.concat(rows, rows))
            .otherwise(rows),
        }
    )


# The evidence of each prompt in the order that it has after the faults are planted, and the same for the control.
ORDER_SQL = f"""
{EVIDENCE},
known AS (SELECT question_id, question_type, k, net_revenue, row_number() OVER (PARTITION BY question_id ORDER BY k, i) AS rn,
    row_number() OVER (PARTITION BY question_id ORDER BY net_revenue DESC, i) AS falling
    FROM evidence JOIN questions USING (question_id) WHERE {DIGIT} <> '4'),
shown_lines AS (SELECT false AS control, *, CASE {DIGIT} WHEN '7' THEN -rn WHEN '8' THEN falling ELSE rn END AS place FROM known
    UNION ALL SELECT true, *, CASE WHEN {DIGIT} = '7' THEN -falling ELSE falling END FROM known WHERE question_type = 'top3_products_month'),
pairs_shown AS (SELECT *, coalesce(lag(k) OVER w > k, false) AS key_break, coalesce(lag(net_revenue) OVER w < net_revenue, false) AS metric_break
    FROM shown_lines WINDOW w AS (PARTITION BY control, question_id ORDER BY place))
"""


def check_sql(counts: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS check_name, ({c}) = 0 AS passed, CAST(({c}) AS BIGINT) AS detail" for n, c in counts.items())


def planted_sql(digit: str, where: str = "true") -> str:
    return f"SELECT count(*) FROM questions WHERE {DIGIT} = '{digit}' AND {where}"


def break_sql(kind: str, where: str) -> str:
    return f"SELECT count(*) FROM pairs_shown WHERE {kind} AND {DIGIT} <> '6' AND {where}"


LEAK_SQL = """SELECT count(*) FROM (SELECT question_id FROM pairs_shown WHERE NOT control AND question_type = 'top3_products_month'
  GROUP BY question_id HAVING count(*) > 1 AND NOT bool_or(metric_break))"""


@query(
    "v17_answer_leak",
    f"WITH {ORDER_SQL} " + check_sql(
        {
            "question_shown": planted_sql("1"), "answer_not_shown": planted_sql("2"), "gold_not_named": planted_sql("3"),
            "evidence_present": planted_sql("4"), "table_is_markdown": planted_sql("5"),
            "share_total_shown": planted_sql("9", "question_type = 'product_revenue_share_month'"), "evidence_not_in_answer_order": LEAK_SQL,
        }
    ),
)
def v17(spark, root):
    """The answer is neither in the text nor given away by the order of the evidence."""
    checks = {k: v for k, v in prompts.prompt_checks().items() if k != "policy_fits_type"}
    asked = questions(spark, root)
    told = quality.violations(spoiled(prompts.prompts(asked, *noted(spark, root))), checks)
    ranked = spoiled(prompts.table_contract_prompts(asked, *noted(spark, root)))
    leaks = prompts.order_leaks(prompts.order_report(ranked)).agg(F.count(F.lit(1)).alias("detail"))
    return told.unionByName(leaks.select(F.lit("evidence_not_in_answer_order").alias("check_name"), (F.col("detail") == 0).alias("passed"), "detail"))


@query(
    "v18_row_order_policy",
    f"WITH {ORDER_SQL} " + check_sql(
        {
            "policy_fits_type": planted_sql("6"),
            "hash_order": break_sql("key_break", f"NOT control AND {PRODUCT_IN}"),
            "countries_alphabetical": break_sql("key_break", "question_type IN ('top_country_month', 'country_comparison_month')"),
            "months_chronological": break_sql("key_break", "question_type = 'monthly_revenue_change'"),
            "control_falls_by_metric": break_sql("metric_break", "control"),
            "one_row_for_one_month": planted_sql("0", "question_type = 'return_impact_month'"),
        }
    ),
)
def v18(spark, root):
    """Each prompt's rows follow its stated policy: hash, alphabet, calendar, or the metric in the control."""
    asked = questions(spark, root)
    shown = spoiled(prompts.prompts(asked, *noted(spark, root)))
    control = spoiled(prompts.table_contract_prompts(asked, *noted(spark, root), control=True))
    fits = {k: v for k, v in prompts.prompt_checks().items() if k == "policy_fits_type"}
    columns = ["prompt_id", "question_id", "row_order_policy", "prompt_evidence_rows"]
    report = prompts.order_report(shown.select(*columns).unionByName(control.select(*columns)))
    return quality.violations(shown, fits).unionByName(prompts.policy_checks(report))


@query(
    "t17_template_fill",
    f"""WITH {QUESTIONS} SELECT question_id, fact_ord,
    replace('The gold value of the ' || field || ' is {{gold_display}}.', '{{gold_display}}', display_value) AS reason FROM facts""",
)
def t17(spark, root):
    facts = gold.gold_fact_rows(questions(spark, root))
    template = F.concat(F.lit("The gold value of the "), F.col("field"), F.lit(" is {gold_display}."))
    return facts.select(
        "question_id", "fact_ord", prompts.fill_template(template, "gold_display", F.col("display_value")).alias("reason")
    )
