"""Ranked, compared and share-based gold answers and the question table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerproof.functions.numbers import money
from ledgerproof.functions.text import month_label
from ledgerproof.operators import gold, normalize, ordering, quality, rollups
from ledgerproof.plans import views
from ledgerproof.plans.register import query
from ledgerproof.plans.views import (
    COUNTRY_PAIRS, HOME_COUNTRY, IS_PARTIAL, PAIR_FLOOR, PAIR_QUOTA, PERIOD, SUMMARIES, Bounds, bounds, sql_currency, sql_fixed2, sql_month_label,
)
from ledgerproof.session import durable, unstored



def pct(c: str) -> str:
    return f"concat({sql_fixed2(c)}, '%')"


def top_sql(name: str, source: str, tie: str, n: int, where: str = "true") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year_month
      ORDER BY net_revenue DESC, {tie}) AS rank FROM {source} WHERE {where}) WHERE rank <= {n})"""


PAIR_VALUES = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(COUNTRY_PAIRS))
NOT_HOME = f"country <> '{HOME_COUNTRY}'"
RANK_ITEM = "concat(rank, '. ', stock_code)"
LIST_ITEM = f"concat(rank, '. ', stock_code, ' (', description, '), ', {sql_currency('round(net_revenue, 2)')})"

# The seven answer tables, in check SQL.
GOLD = f"""
{SUMMARIES},
{top_sql('cm_all', 'country_month', 'country', 8, PERIOD)},
{top_sql('cm_pool', 'country_month', 'country', 7, f"{PERIOD} AND {NOT_HOME}")},
{top_sql('pm_all', 'product_month', 'stock_code, description', 8)},
pairs(pair_ord, country_a, country_b) AS (VALUES {PAIR_VALUES}),
candidates AS (SELECT a.year_month, pair_ord, country_a, country_b, round(a.net_revenue, 2) AS value_a,
   round(b.net_revenue, 2) AS value_b FROM pairs JOIN country_month a ON a.country = country_a
   JOIN country_month b ON b.country = country_b AND b.year_month = a.year_month
   WHERE a.{PERIOD} AND (abs(round(a.net_revenue, 2)) >= {PAIR_FLOOR} OR abs(round(b.net_revenue, 2)) >= {PAIR_FLOOR})),
rounds AS (SELECT *, row_number() OVER (PARTITION BY year_month ORDER BY pair_ord) AS round FROM candidates),
picked AS (SELECT *, row_number() OVER (ORDER BY round, year_month) AS select_ord FROM rounds),
compared AS (SELECT select_ord, year_month, {sql_month_label('year_month')} AS month_label, country_a, country_b,
   value_a, value_b, CASE WHEN value_a >= value_b THEN country_a ELSE country_b END AS higher_country,
   CASE WHEN value_a >= value_b THEN country_b ELSE country_a END AS lower_country,
   abs(value_a - value_b) AS delta FROM picked),
changed AS (SELECT * FROM (SELECT lag(year_month) OVER w AS previous_month, year_month AS current_month,
   lag(round(net_revenue, 2)) OVER w AS p, round(net_revenue, 2) AS c FROM monthly_net WHERE {PERIOD}
   WINDOW w AS (ORDER BY year_month)) WHERE previous_month IS NOT NULL),
change AS (SELECT previous_month, current_month, p, c, c - p AS d,
   round(CAST(c - p AS DOUBLE) / abs(CAST(p AS DOUBLE)) * 100, 2) AS percent_change,
   CASE WHEN c - p >= 0 THEN 'increase' ELSE 'decrease' END AS direction FROM changed),
month_total AS (SELECT year_month, round(sum(net_revenue), 2) AS den FROM product_month WHERE {PERIOD} GROUP BY 1),
share AS (SELECT year_month, top_n, num, den, round(CAST(num AS DOUBLE) / CAST(den AS DOUBLE) * 100, 2) AS share_percent,
   rank_text, focus FROM (
     SELECT year_month, n AS top_n, round(sum(net_revenue), 2) AS num,
       string_agg({RANK_ITEM}, ' > ' ORDER BY rank) AS rank_text,
       CASE WHEN n = 1 THEN concat('the top product (', min(stock_code), ' - ', min(description), ')')
            ELSE 'the top 3 products' END AS focus
     FROM pm_all, (VALUES (1), (3)) AS k(n) WHERE rank <= n AND {PERIOD} GROUP BY year_month, n)
   JOIN month_total USING (year_month)),
impact AS (SELECT year_month, {sql_month_label('year_month')} AS month_label, round(gross_positive_revenue, 2) AS gross,
   round(cancellation_revenue, 2) AS cancelled, abs(round(cancellation_revenue, 2)) AS reduction,
   round(CAST(abs(round(cancellation_revenue, 2)) AS DOUBLE) / CAST(round(gross_positive_revenue, 2) AS DOUBLE) * 100, 2) AS rate,
   round(net_revenue, 2) AS net_value FROM monthly_net WHERE year_month <= (SELECT last_month FROM bounds))
"""

LABEL = sql_month_label("year_month")
PM_LABEL = f"concat({LABEL}, CASE WHEN year_month {IS_PARTIAL} THEN (SELECT through FROM bounds) ELSE '' END)"
NET2 = "round(net_revenue, 2)"


def num(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


def fact_sql(field, fact_type, display, name=None, text="NULL", number="NULL"):
    kind = {"currency_amount": "absolute_or_relative", "percentage": "percentage_points", "ranking": "ordered_exact_match"}
    shown = name if name and name.startswith("concat(") else f"'{name or field}'"
    return (f"{{'field': '{field}', 'fact_type': '{fact_type}', 'str_value': CAST({text} AS VARCHAR), "
            f"'num_value': CAST({number} AS DOUBLE), 'display_value': {display}, 'display_name': {shown}, "
            f"'tolerance_kind': '{kind.get(fact_type, 'exact_normalized_match')}'}}")


def money_fact(field, c, name=None):
    return fact_sql(field, "currency_amount", sql_currency(c), name, number=c)


def text_fact(field, fact_type, c, name=None):
    return fact_sql(field, fact_type, c, name, text=c)


def month_fact(c="year_month", field="year_month", name="month"):
    return text_fact(field, "month", c, name)


BEFORE, NOW = sql_month_label("previous_month"), sql_month_label("current_month")
QUESTION_PARTS = [
    ("top_country_month", "concat('0|', year_month)", "medium",
     f"concat('Which country had the highest net revenue in ', {LABEL}, ', excluding {HOME_COUNTRY}?')",
     f"concat(country, ' had the highest net revenue in ', {LABEL}, ' (excluding {HOME_COUNTRY}) at ', {sql_currency(NET2)}, '.')",
     [month_fact(), text_fact("country", "country", "country"), money_fact("net_revenue", NET2)],
     "country_month_net_revenue_summary", "cm_pool WHERE rank = 1"),
    ("top_country_month", "concat('1|', year_month)", "easy",
     f"concat('Which country had the highest net revenue in ', {LABEL}, '?')",
     f"concat(country, ' had the highest net revenue in ', {LABEL}, ' (all countries) at ', {sql_currency(NET2)}, '.')",
     [month_fact(), text_fact("country", "country", "country"), money_fact("net_revenue", NET2)],
     "country_month_net_revenue_summary", "cm_all WHERE rank = 1"),
    ("top_product_month", "year_month", "medium",
     f"concat('Which product had the highest merchandise net revenue in ', {PM_LABEL}, '? Provide the stock code, product name, and net revenue.')",
     f"concat(stock_code, ' (', description, ') had the highest merchandise net revenue in ', {PM_LABEL}, ' at ', {sql_currency(NET2)}, '.')",
     [month_fact(), text_fact("stock_code", "product_stock_code", "stock_code", "stock code"),
      text_fact("description", "product_name", "description", "product name"), money_fact("merchandise_net_revenue", NET2)],
     "product_month_net_revenue_summary", "pm_all WHERE rank = 1"),
    ("country_comparison_month", "lpad(CAST(select_ord AS VARCHAR), 9, '0')", "medium",
     "concat('In ', month_label, ', did ', country_a, ' or ', country_b, ' generate more net revenue, and by how much?')",
     f"concat(higher_country, ' generated more net revenue than ', lower_country, ' by ', {sql_currency('delta')}, ' in ', month_label, '.')",
     [month_fact(), text_fact("higher_country", "country", "higher_country", "higher country"),
      text_fact("lower_country", "country", "lower_country", "lower country"),
      money_fact("country_a_net_revenue", "value_a", "concat(country_a, ' net revenue')"),
      money_fact("country_b_net_revenue", "value_b", "concat(country_b, ' net revenue')"),
      money_fact("revenue_delta", "delta", "difference")],
     "country_month_net_revenue_summary", "compared"),
    ("monthly_revenue_change", "current_month", "hard",
     f"concat('How did net revenue change from ', {BEFORE}, ' to ', {NOW}, '? Provide the absolute change and percentage change.')",
     f"concat('Net revenue ', direction, 'd by ', {sql_currency('abs(d)')}, ' (', {pct('percent_change')}, ') from ', {BEFORE}, ' to ', {NOW}, '.')",
     [month_fact("previous_month", "previous_month", "previous month"), month_fact("current_month", "current_month", "current month"),
      money_fact("previous_net_revenue", "p"), money_fact("current_net_revenue", "c"), money_fact("absolute_change", "d"),
      fact_sql("percent_change", "percentage", pct("percent_change"), number="percent_change"),
      text_fact("direction", "comparison_direction", "direction")],
     "monthly_net_revenue_summary", "change"),
    ("top3_products_month", "year_month", "medium",
     f"concat('What were the top 3 products by merchandise net revenue in ', {PM_LABEL}, '? Give the rank, stock code, product name, and net revenue.')",
     f"concat('Top 3 products in ', {PM_LABEL}, ': ', listed, '.')",
     [month_fact(), fact_sql("top_products", "ranking", "rank_text")],
     "product_month_net_revenue_summary",
     f"(SELECT year_month, string_agg({LIST_ITEM}, '; ' ORDER BY rank) AS listed, string_agg({RANK_ITEM}, ' > ' ORDER BY rank) AS rank_text FROM pm_all WHERE rank <= 3 GROUP BY year_month)"),
    ("product_revenue_share_month", "concat(lpad(CAST(top_n AS VARCHAR), 3, '0'), '|', year_month)", "hard",
     f"concat('What percentage of merchandise net revenue in ', {LABEL}, ' came from ', CASE WHEN top_n = 1 THEN 'the top product?' ELSE 'the top 3 products combined?' END)",
     f"concat('In ', {LABEL}, ', ', focus, ' contributed ', {sql_currency('num')}, ' out of ', {sql_currency('den')}, ', or ', {pct('share_percent')}, ' of merchandise net revenue.')",
     [month_fact(), fact_sql("top_products", "ranking", "rank_text"),
      money_fact("numerator_merchandise_net_revenue", "num", "share numerator"),
      money_fact("total_merchandise_net_revenue", "den", "share denominator"),
      fact_sql("share_percent", "percentage", pct("share_percent"), number="share_percent")],
     "product_month_net_revenue_summary", "share"),
    ("return_impact_month", "year_month", "hard",
     "concat('In ', month_label, ', how much did cancellations and returns reduce gross positive revenue, and what was the final net revenue?')",
     f"concat('Cancellations and returns reduced gross positive revenue by ', {sql_currency('reduction')}, ' (', {pct('rate')}, ' of gross), leaving net revenue of ', {sql_currency('net_value')}, '.')",
     [month_fact(), money_fact("gross_positive_revenue", "gross"), money_fact("cancellation_revenue", "cancelled"),
      money_fact("reduction_amount", "reduction"), fact_sql("reduction_rate_percent", "percentage", pct("rate"), number="rate"),
      money_fact("net_revenue", "net_value")],
     "monthly_net_revenue_summary", "impact"),
]

QUESTIONS = f"""
{GOLD},
loose AS ({' UNION ALL '.join(
    f"SELECT '{t}' AS question_type, {gold.QUESTION_TYPES.index(t)} AS type_ord, {o} AS ord, '{d}' AS difficulty, {q} AS question, {a} AS gold_short_answer, '{s}' AS evidence_source, [{', '.join(f)}] AS facts FROM {src}"
    for t, o, d, q, a, f, s, src in QUESTION_PARTS)}),
placed AS (SELECT *, row_number() OVER (PARTITION BY type_ord ORDER BY ord) AS position,
   row_number() OVER (ORDER BY type_ord, ord) AS question_no FROM loose),
questions AS (SELECT *, format('q_{{:04d}}', question_no) AS question_id,
   CASE WHEN position % 5 IN (1, 2, 3) THEN 'train' WHEN position % 5 = 4 THEN 'dev' ELSE 'test' END AS split FROM placed),
facts AS (SELECT question_id, question_type, split, fact_ord, f.* FROM (
   SELECT question_id, question_type, split, generate_subscripts(facts, 1) - 1 AS fact_ord, unnest(facts) AS f FROM questions))
"""


# ---------------------------------------------------------------- shared DataFrames


def period(df: DataFrame, ends: Bounds) -> DataFrame:
    return gold.in_period(df, ends.first, ends.last)


def questions(spark, root) -> DataFrame:
    """The numbered question table over all seven builders."""
    return question_table(bounds(spark, root), *views.summaries(spark, root))


def question_table(ends: Bounds, countries: DataFrame, products: DataFrame, months: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """No question shows more than the first products of a month and its total, so these are worked out once.
    Names are given where products are numbers."""
    leaders = durable(gold.leading_products(products, names=names))
    totals = durable(gold.month_totals(products))
    inner_countries, inner_leaders = period(countries, ends), period(leaders, ends)
    return gold.assign_ids(
        gold.union_all(
            [
                gold.country_questions(inner_countries, [HOME_COUNTRY]),
                gold.country_questions(inner_countries, []),
                gold.product_questions(leaders, ends.partial, ends.through),
                gold.comparison_questions(inner_countries, COUNTRY_PAIRS, PAIR_FLOOR),
                gold.change_questions(period(months, ends)),
                gold.top3_questions(leaders, ends.partial, ends.through),
                gold.share_questions(inner_leaders, 1, totals),
                gold.share_questions(inner_leaders, 3, totals),
                gold.return_questions(gold.in_period(months, None, ends.last)),
            ]
        )
    )


# ------------------------------------------------------------------ window operators


@query(
    "w02_top_country_per_month",
    f"""WITH {GOLD} SELECT year_month, country, {num(NET2)} AS net_revenue, 'excluding {HOME_COUNTRY}' AS scope FROM cm_pool WHERE rank = 1
    UNION ALL SELECT year_month, country, {num(NET2)}, 'all countries' FROM cm_all WHERE rank = 1""",
)
def w02(spark, root):
    countries = period(views.country_month_net(spark, root), bounds(spark, root))
    both = [gold.top_country(countries, x) for x in ([HOME_COUNTRY], [])]
    return gold.union_all(both).select("year_month", "country", "net_revenue", "scope")


@query(
    "w03_top_k_ranked_array",
    f"WITH {GOLD} SELECT year_month, string_agg({RANK_ITEM}, ' > ' ORDER BY rank) AS ranking FROM pm_all WHERE rank <= 3 GROUP BY 1",
)
def w03(spark, root):
    ranked = gold.ranked_products(unstored(views.product_month_net)(spark, root), 3)
    item = F.transform("top_products", lambda x: F.concat(x["rank"].cast("string"), F.lit(". "), x["stock_code"]))
    return ranked.select("year_month", F.array_join(item, " > ").alias("ranking"))


@query(
    "w04_evidence_slice",
    f"WITH {GOLD} SELECT year_month, rank, stock_code, description, {num(NET2)} AS net_revenue FROM pm_all",
)
def w04(spark, root):
    head = gold.head_rows(unstored(views.product_month_net)(spark, root), gold.EVIDENCE_ROWS, ["stock_code", "description"])
    return head.select("year_month", "rank", "stock_code", "description", money(F.col("net_revenue")).alias("net_revenue"))


CHANGE_SQL = f"""WITH {GOLD} SELECT previous_month, current_month, {num('p')} AS previous_net_revenue,
    {num('c')} AS current_net_revenue, {num('d')} AS absolute_change, percent_change, direction FROM change"""


@query("w05_consecutive_months", f"WITH {GOLD} SELECT previous_month, current_month FROM change")
def w05(spark, root):
    return gold.monthly_change(period(unstored(views.monthly_net)(spark, root), bounds(spark, root))).select("previous_month", "current_month")


@query(
    "w06_round_robin_quota",
    f"WITH {GOLD} SELECT select_ord, round, year_month, country_a, country_b FROM picked WHERE select_ord <= {PAIR_QUOTA}",
)
def w06(spark, root):
    candidates = gold.country_pairs(period(views.country_month_net(spark, root), bounds(spark, root)), COUNTRY_PAIRS, PAIR_FLOOR)
    picked = gold.round_robin(candidates, "year_month", "pair_ord", PAIR_QUOTA)
    return picked.select("select_ord", "round", "year_month", "country_a", "country_b")


@query(
    "w07_ordinal_ids_and_split",
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS position,
       row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS question_no FROM orders)
       SELECT o_orderkey, position, question_no, format('q_{:04d}', question_no) AS question_id,
       CASE WHEN position % 5 IN (1, 2, 3) THEN 'train' WHEN position % 5 = 4 THEN 'dev' ELSE 'test' END AS split FROM p""",
)
def w07(spark, root):
    orders = views.table(spark, root, "orders").select(
        "o_orderkey", "o_orderpriority", F.struct("o_orderdate", "o_orderkey").alias("ord")
    )
    numbered = gold.assign_ids(orders, "o_orderpriority", "ord")
    return numbered.select("o_orderkey", "position", "question_no", "question_id", "split")


@query(
    "u01_append_evidence",
    f"""WITH {GOLD} SELECT year_month, country, {num(NET2)} AS net_revenue, CAST(0 AS BIGINT) AS rank FROM cm_all WHERE rank = 1
    UNION ALL SELECT year_month, country, {num(NET2)}, rank FROM cm_pool""",
)
def u01(spark, root):
    rows = gold.top_country_evidence(period(views.country_month_net(spark, root), bounds(spark, root)), [HOME_COUNTRY])
    return rows.select("year_month", "country", money(F.col("net_revenue")).alias("net_revenue"), "rank")


@query(
    "u02_first_kept_by_subset",
    f"""WITH {GOLD}, parts AS (
      SELECT select_ord, p.year_month, m.country, m.net_revenue, 0 AS part FROM picked p JOIN country_month m
        ON m.year_month = p.year_month AND m.country IN (country_a, country_b)
      UNION ALL SELECT select_ord, p.year_month, m.country, m.net_revenue, 1 FROM picked p JOIN cm_all m
        ON m.year_month = p.year_month AND m.rank <= 3)
    SELECT select_ord, country, part, {num(NET2)} AS net_revenue FROM (SELECT *, row_number() OVER (
      PARTITION BY select_ord, country ORDER BY part, net_revenue DESC) AS rn FROM parts) WHERE rn = 1""",
)
def u02(spark, root):
    countries = period(views.country_month_net(spark, root), bounds(spark, root))
    picked = gold.round_robin(gold.country_pairs(countries, COUNTRY_PAIRS, PAIR_FLOOR), "year_month", "pair_ord")
    rows = gold.comparison_evidence(picked, countries)
    return rows.select("select_ord", "country", "part", money(F.col("net_revenue")).alias("net_revenue"))


PAIR_SQL = f"""SELECT year_month, pair_ord, country_a, country_b, {num('value_a')} AS value_a, {num('value_b')} AS value_b"""


def pair_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "year_month", "pair_ord", "country_a", "country_b",
        F.col("value_a").cast("double").alias("value_a"), F.col("value_b").cast("double").alias("value_b"),
    )


@query(
    "j07_entity_pairs_in_month",
    f"""WITH {SUMMARIES}, pairs(pair_ord, country_a, country_b) AS (VALUES {PAIR_VALUES})
    {PAIR_SQL} FROM (SELECT a.year_month, pair_ord, country_a, country_b, round(a.net_revenue, 2) AS value_a,
    round(b.net_revenue, 2) AS value_b FROM pairs JOIN country_month a ON a.country = country_a
    JOIN country_month b ON b.country = country_b AND b.year_month = a.year_month)""",
)
def j07(spark, root):
    return pair_columns(gold.country_pairs(views.country_month_net(spark, root), COUNTRY_PAIRS, 0))


@query("f08_minimum_size_pairs", f"WITH {GOLD} {PAIR_SQL} FROM candidates")
def f08(spark, root):
    return pair_columns(gold.country_pairs(period(views.country_month_net(spark, root), bounds(spark, root)), COUNTRY_PAIRS, PAIR_FLOOR))


@query(
    "j13_last_duplicate_wins",
    """SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (
       PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def j13(spark, root):
    orders = views.table(spark, root, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return ordering.last_wins(orders, ["o_custkey"], "o_orderkey")


# --------------------------------------------------------------------------- answers


@query(
    "g01_top_country_month",
    f"""WITH {QUESTIONS} SELECT question, gold_short_answer, difficulty FROM questions WHERE question_type = 'top_country_month'""",
)
def g01(spark, root):
    countries = period(views.country_month_net(spark, root), bounds(spark, root))
    both = [gold.country_questions(countries, x) for x in ([HOME_COUNTRY], [])]
    return gold.union_all(both).select("question", "gold_short_answer", "difficulty")


@query(
    "g02_top_product_month",
    f"""WITH {GOLD} SELECT year_month, {LABEL} AS month_label,
    CASE WHEN year_month {IS_PARTIAL} THEN (SELECT through FROM bounds) ELSE '' END AS scope_note, stock_code, description,
    {num(NET2)} AS merchandise_net_revenue FROM pm_all WHERE rank = 1""",
)
def g02(spark, root):
    return gold.top_product(unstored(views.product_month_net)(spark, root), bounds(spark, root).partial, bounds(spark, root).through)


@query(
    "g03_country_comparison_month",
    f"""WITH {GOLD} SELECT select_ord, year_month, month_label, country_a, country_b,
    {num('value_a')} AS country_a_net_revenue, {num('value_b')} AS country_b_net_revenue, higher_country, lower_country,
    {num('delta')} AS revenue_delta FROM compared""",
)
def g03(spark, root):
    countries = period(views.country_month_net(spark, root), bounds(spark, root))
    picked = gold.round_robin(gold.country_pairs(countries, COUNTRY_PAIRS, PAIR_FLOOR), "year_month", "pair_ord")
    return gold.country_comparison(picked)


@query("g04_monthly_revenue_change", CHANGE_SQL)
def g04(spark, root):
    return gold.monthly_change(period(unstored(views.monthly_net)(spark, root), bounds(spark, root)))


@query(
    "g05_top3_products_month",
    f"""WITH {GOLD} SELECT year_month, {PM_LABEL} AS month_label, rank, stock_code, description,
    {num(NET2)} AS merchandise_net_revenue FROM pm_all WHERE rank <= 3""",
)
def g05(spark, root):
    ranked = gold.ranked_products(unstored(views.product_month_net)(spark, root), 3)
    note = F.when(F.col("year_month") == bounds(spark, root).partial, bounds(spark, root).through).otherwise("")
    return ranked.select(
        "year_month", F.concat(month_label(F.col("year_month")), note).alias("month_label"), F.inline("top_products")
    )


@query(
    "g06_product_revenue_share",
    f"""WITH {GOLD} SELECT year_month, {LABEL} AS month_label, CAST(top_n AS BIGINT) AS top_n,
    {num('num')} AS numerator_merchandise_net_revenue, {num('den')} AS total_merchandise_net_revenue, share_percent FROM share""",
)
def g06(spark, root):
    products = period(views.product_month_net(spark, root), bounds(spark, root))
    return gold.union_all([gold.revenue_share(products, n) for n in (1, 3)]).drop("top_products")


@query(
    "g07_return_impact",
    f"""WITH {GOLD} SELECT year_month, month_label, {num('gross')} AS gross_positive_revenue,
    {num('cancelled')} AS cancellation_revenue, {num('reduction')} AS reduction_amount, rate AS reduction_rate_percent,
    {num('net_value')} AS net_revenue FROM impact""",
)
def g07(spark, root):
    return gold.return_impact(gold.in_period(unstored(views.monthly_net)(spark, root), None, bounds(spark, root).last))


FACT_COLUMNS = ["question_id", "fact_ord", "field", "fact_type", "str_value", "num_value", "display_value",
                "display_name", "tolerance_kind"]


@query("g08_typed_facts", f"WITH {QUESTIONS} SELECT {', '.join(FACT_COLUMNS)} FROM facts")
def g08(spark, root):
    return gold.gold_fact_rows(questions(spark, root)).select(*FACT_COLUMNS)




@query(
    "g09_question_table",
    f"WITH {QUESTIONS} SELECT question_id, question_type, difficulty, split, question, gold_short_answer, evidence_source FROM questions",
)
def g09(spark, root):
    return gold.preview(questions(spark, root), None)


@query(
    "g10_month_label",
    f"WITH {SUMMARIES} SELECT year_month, {LABEL} AS month_label FROM monthly_net",
)
def g10(spark, root):
    months = views.net(spark, root).select("year_month").distinct()
    return months.select("year_month", month_label(F.col("year_month")).alias("month_label"))


@query("a13_value_counts", f"WITH {QUESTIONS} SELECT question_type, count(*) AS n FROM questions GROUP BY 1")
def a13(spark, root):
    return rollups.value_counts(questions(spark, root), "question_type")


@query("a14_type_by_split_counts", f"WITH {QUESTIONS} SELECT question_type, split, count(*) AS n FROM questions GROUP BY ALL")
def a14(spark, root):
    return rollups.value_counts(questions(spark, root), "question_type", "split")


CELL_SQL = f"""cells AS (
  SELECT 'product' AS kind, year_month AS unit, rank AS row_pos, unnest([
     {{'key': 'stock_code', 'v': stock_code}}, {{'key': 'description', 'v': description}},
     {{'key': 'net_revenue', 'v': {sql_fixed2(NET2)}}},
     {{'key': 'gross_positive_revenue', 'v': {sql_fixed2('round(gross_positive_revenue, 2)')}}},
     {{'key': 'cancellation_revenue', 'v': {sql_fixed2('round(cancellation_revenue, 2)')}}}]) AS c FROM pm_all)"""


@query(
    "p09_nested_evidence_cells",
    f"""WITH {QUESTIONS}, {CELL_SQL} SELECT question_id, row_pos, c.key AS key, c.v AS str_value
    FROM questions q JOIN cells ON q.ord = unit WHERE question_type = 'top3_products_month'""",
)
def p09(spark, root):
    asked = questions(spark, root).filter("question_type = 'top3_products_month'")
    return gold.evidence_cells(asked).select("question_id", "row_pos", "key", "str_value")


@query(
    "p10_flat_preview",
    f"""WITH {QUESTIONS} SELECT question_id, split, question_type, difficulty, left(question, 60) AS question,
    left(gold_short_answer, 60) AS gold_short_answer, evidence_source FROM questions""",
)
def p10(spark, root):
    return gold.preview(questions(spark, root), 60)


# ---------------------------------------------------------------------------- checks

REQUIRED = ["question_id", "question_type", "difficulty", "split", "question", "gold_short_answer", "gold_facts", "evidence"]


#: Each required field is missing in the questions whose number ends in its place in the list.
LOST = {c: str(i) for i, c in enumerate(REQUIRED[1:], 1)}


@query(
    "v01_required_fields",
    f"WITH {QUESTIONS} " + " UNION ALL ".join(
        f"SELECT 'required_{c}' AS check_name, count(*) FILTER (right(question_id, 1) = '{LOST.get(c, '')}') = 0 AS passed, count(*) FILTER (right(question_id, 1) = '{LOST.get(c, '')}') AS detail FROM questions"
        for c in REQUIRED) + " UNION ALL SELECT 'required_reviewer', false, -1",
)
def v01(spark, root):
    """Over questions with planted gaps, and with a field that no question has."""
    digit = F.substring("question_id", -1, 1)
    spoiled = questions(spark, root).withColumns({c: F.when(digit != d, F.col(c)) for c, d in LOST.items()})
    return quality.required_columns(spoiled, [*REQUIRED, "reviewer"])


@query(
    "v02_unique_key",
    """SELECT 'order_line' AS check_name, count(*) = 0 AS passed, count(*) AS detail FROM (
         SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
       UNION ALL SELECT 'order', count(*) = 0, count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)""",
)
def v02(spark, root):
    lines, orders = views.table(spark, root, "lineitem"), views.table(spark, root, "orders")
    return quality.unique_key(lines, ["l_orderkey", "l_linenumber"], "order_line").unionByName(
        quality.unique_key(orders, ["o_orderkey"], "order")
    )


@query(
    "v04_domain_membership",
    """SELECT 'lang' AS check_name, count(*) FILTER (lang NOT IN ('en', 'fr')) = 0 AS passed,
       count(*) FILTER (lang NOT IN ('en', 'fr')) AS detail FROM documents
       UNION ALL SELECT 'n_chars', count(*) FILTER (n_chars <= 0) = 0, count(*) FILTER (n_chars <= 0) FROM documents""",
)
def v04(spark, root):
    docs = views.documents(spark, root)
    return quality.violations(docs, {"lang": quality.domain("lang", ["en", "fr"]), "n_chars": F.col("n_chars") > 0})


ANSWER_KEY = ["question_type", "variant", "month", "field"]
EVIDENCE_TOTAL = "evidence_total_merchandise_net_revenue"


def answer_values(question_type: str, rows: DataFrame, variant: Column, **fields: Column) -> DataFrame:
    """(question_type, variant, month, field, text, num): one row per field of each answer."""
    kinds = dict(rows.select(*[c.alias(n) for n, c in fields.items()]).dtypes)
    values = [F.struct(F.lit(n).alias("field"), (c if kinds[n] == "string" else F.lit(None)).cast("string").alias("text"),
                       (F.lit(None) if kinds[n] == "string" else c).cast("double").alias("num")) for n, c in fields.items()]
    return rows.select(F.lit(question_type).alias("question_type"), variant.alias("variant"), F.col("year_month").alias("month"), F.inline(F.array(*values)))


def answers_from_lines(spark, root) -> DataFrame:
    """Every field of every answer there should be, from the cleaned lines: neither the summaries nor
    the builders that the questions came from are used."""
    ends, c, none = bounds(spark, root), F.col, F.lit("")
    revenue, zero = c("revenue"), F.lit(0)
    countries = durable(views.numbered_lines(spark, root).groupBy("year_month", "country").agg(
        F.sum(revenue).alias("net"), F.sum(F.when(revenue > 0, revenue).otherwise(zero)).alias("gross"), F.sum(F.when(revenue < 0, revenue).otherwise(zero)).alias("lost")))
    products = durable(normalize.merchandise(views.numbered_lines(spark, root)).groupBy("year_month", "product").agg(F.sum(revenue).alias("net")))
    months = countries.groupBy("year_month").agg(*[F.round(F.sum(n), 2).alias(n) for n in ("net", "gross", "lost")])
    inner_countries, inner_products, inner_months = (period(d, ends) for d in (countries, products, months))

    def leaders(df: DataFrame, n: int, *tie: str) -> DataFrame:
        return ordering.top_n(df, n, ["year_month"], [c("net").desc(), *map(c, tie)])

    named = ordering.contenders(products, 3, ["year_month"], "net").join(views.product_names(spark, root), "product")
    first_products = durable(leaders(named, 3, "stock_code", "description").drop("rank"))

    def ranked(df: DataFrame, n: int) -> DataFrame:
        item = F.struct("rank", "stock_code", "description", F.round("net", 2).cast("double").alias("merchandise_net_revenue"))
        first = leaders(df, n, "stock_code", "description").groupBy("year_month")
        return first.agg(F.round(F.sum("net"), 2).alias("num"), gold.listed(F.array_sort(F.collect_list(item))).alias("listed"))

    def percentage(part: Column, whole: Column) -> Column:
        return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, 2)

    found = []
    for excluded in (HOME_COUNTRY, ""):
        top = leaders(inner_countries.filter(c("country") != excluded), 1, "country")
        found.append(answer_values("top_country_month", top, F.lit(excluded), year_month=c("year_month"), country=c("country"), net_revenue=F.round("net", 2)))
    found.append(answer_values(
        "top_product_month", leaders(first_products, 1, "stock_code", "description"), none, year_month=c("year_month"),
        stock_code=c("stock_code"), description=c("description"), merchandise_net_revenue=F.round("net", 2)))
    pairs = F.broadcast(spark.createDataFrame(COUNTRY_PAIRS, "country_a string, country_b string"))
    of = {x: inner_countries.select("year_month", c("country").alias(f"country_{x}"), F.round("net", 2).alias(x)) for x in "ab"}
    compared = pairs.join(of["a"], "country_a").join(of["b"], ["country_b", "year_month"]).filter((F.abs("a") >= PAIR_FLOOR) | (F.abs("b") >= PAIR_FLOOR))
    first_wins = c("a") >= c("b")
    found.append(answer_values(
        "country_comparison_month", compared, F.concat_ws(", ", "country_a", "country_b"), year_month=c("year_month"),
        higher_country=F.when(first_wins, c("country_a")).otherwise(c("country_b")), lower_country=F.when(first_wins, c("country_b")).otherwise(c("country_a")),
        country_a_net_revenue=c("a"), country_b_net_revenue=c("b"), revenue_delta=F.greatest("a", "b") - F.least("a", "b")))
    placed = inner_months.select("year_month", "net", F.lit(0).alias("all"), F.replace("year_month", F.lit("-")).cast("int").alias("at"))
    latest = ordering.with_previous(placed, ["all"], "at", ["year_month", "net"], "before").filter("before IS NOT NULL").select(
        "year_month", "net", c("before.year_month").alias("previous"), c("before.net").alias("p"))
    found.append(answer_values(
        "monthly_revenue_change", latest, none, previous_month=c("previous"), current_month=c("year_month"), previous_net_revenue=c("p"), current_net_revenue=c("net"),
        absolute_change=c("net") - c("p"), percent_change=percentage(c("net") - c("p"), F.abs("p")), direction=F.when(c("net") < c("p"), "decrease").otherwise("increase")))
    found.append(answer_values("top3_products_month", ranked(first_products, 3), none, year_month=c("year_month"), top_products=c("listed")))
    total = inner_products.groupBy("year_month").agg(F.round(F.sum("net"), 2).alias("den"))
    for n in (1, 3):
        found.append(answer_values(
            "product_revenue_share_month", ranked(period(first_products, ends), n).join(total, "year_month"), F.lit(str(n)), year_month=c("year_month"), top_products=c("listed"),
            numerator_merchandise_net_revenue=c("num"), total_merchandise_net_revenue=c("den"), share_percent=percentage(c("num"), c("den")), **{EVIDENCE_TOTAL: c("den")}))
    found.append(answer_values(
        "return_impact_month", gold.in_period(months, None, ends.last), none, year_month=c("year_month"), gross_positive_revenue=c("gross"), cancellation_revenue=c("lost"),
        reduction_amount=F.abs("lost"), reduction_rate_percent=percentage(F.abs("lost"), c("gross")), net_revenue=c("net")))
    return gold.union_all(found)


def published_answers(questions: DataFrame) -> DataFrame:
    """The fields of the stored answers, with the number of their question, by what its filters ask for."""
    asked = F.col("evidence.filters")
    variant = F.coalesce(*[asked[n] for n in ("exclude_countries", "countries", "top_n")], F.lit(""))
    keyed = questions.select("question_no", "question_type", variant.alias("variant"), F.coalesce(asked["year_month"], asked["current_month"]).alias("month"), "gold_facts", "evidence")
    key = keyed.columns[:4]
    facts = keyed.select(*key, F.explode("gold_facts").alias("f")).select(*key, "f.field", F.coalesce("f.str_value", gold.listed(F.col("f.ranking"))).alias("text"), F.col("f.num_value").alias("num"))
    totals = keyed.filter("question_type = 'product_revenue_share_month'").select(
        *key, F.lit(EVIDENCE_TOTAL).alias("field"), F.lit(None).cast("string").alias("text"), F.col("evidence.total_merchandise_net_revenue").alias("num"))
    return facts.unionByName(totals)


def with_wrong_answers(published: DataFrame) -> DataFrame:
    """Some questions lost, some under a month that has none, some values and ranks wrong."""
    no, text = F.col("question_no"), F.col("text")
    return published.filter(no % 11 != 0).withColumns({
        "month": F.when(no % 13 == 0, "1900-01").otherwise(F.col("month")),
        "text": F.when(no % 7 == 0, F.concat(text, F.lit("?")))
        .when((no % 5 == 0) & (F.col("field") == "top_products"), F.array_join(F.reverse(F.split(text, "; ")), "; ")).otherwise(text),
        "num": F.col("num") + F.when(no % 7 == 0, 1).otherwise(0),
    })


def recomputed(published: DataFrame, expected: DataFrame) -> DataFrame:
    """Published against recomputed values; one without the other is bad."""
    both = published.withColumn("given", F.lit(True)).join(
        expected.select(*ANSWER_KEY, F.col("text").alias("true_text"), F.col("num").alias("true_num"), F.lit(True).alias("due")), ANSWER_KEY, "full")
    number = F.col("num").eqNullSafe(F.col("true_num")) | quality.identity(F.col("num"), F.col("true_num"), 0.01)
    right = F.col("given") & F.col("due") & F.col("text").eqNullSafe(F.col("true_text")) & number
    return both.groupBy("question_type", "field").agg(F.count("*").alias("checked"), F.count_if(~F.coalesce(right, F.lit(False))).alias("bad"))


@query(
    "v10_recompute_gold",
    f"""WITH {QUESTIONS}, due AS (SELECT question_no, question_type, question_id AS key, field, num_value AS true_num, true AS due
    FROM facts JOIN (SELECT question_id, question_no FROM questions) USING (question_id)
    WHERE (question_type, field) IN (('top_product_month', 'merchandise_net_revenue'), ('return_impact_month', 'net_revenue'),
      ('return_impact_month', 'gross_positive_revenue'), ('monthly_revenue_change', 'current_net_revenue'),
      ('product_revenue_share_month', 'total_merchandise_net_revenue'))),
    given AS (SELECT question_type, CASE WHEN question_no % 13 = 0 THEN 'none' ELSE key END AS key, field,
      true_num + CASE WHEN question_no % 7 = 0 THEN 1 ELSE 0 END AS num, true AS given FROM due WHERE question_no % 11 <> 0)
    SELECT question_type, field, count(*) AS checked, count(*) FILTER (NOT coalesce(given AND due AND abs(num - true_num) <= 0.01, false)) AS bad
    FROM given FULL JOIN due USING (question_type, key, field) GROUP BY ALL""",
)
def v10(spark, root):
    """Five amounts with planted faults, against the lines; v10_recompute_all_types has every field of every type."""
    named = [
        ("top_product_month", "merchandise_net_revenue"), ("return_impact_month", "net_revenue"), ("return_impact_month", "gross_positive_revenue"),
        ("monthly_revenue_change", "current_net_revenue"), ("product_revenue_share_month", "total_merchandise_net_revenue"),
    ]
    inside = reduce(lambda a, b: a | b, [(F.col("question_type") == t) & (F.col("field") == f) for t, f in named])
    published = with_wrong_answers(published_answers(questions(spark, root)))
    return recomputed(published.filter(inside), answers_from_lines(spark, root).filter(inside))


@query(
    "v10_recompute_all_types",
    f"""WITH {QUESTIONS}, plain AS (SELECT question_no, question_type, question_id AS key, field,
      CASE WHEN fact_type = 'ranking' THEN display_value ELSE str_value END AS text, num_value AS num
      FROM facts JOIN (SELECT question_id, question_no FROM questions) USING (question_id)),
    told AS (SELECT * FROM plain UNION ALL SELECT * REPLACE ('{EVIDENCE_TOTAL}' AS field) FROM plain
      WHERE question_type = 'product_revenue_share_month' AND field = 'total_merchandise_net_revenue'),
    given AS (SELECT 'published' AS answers, * EXCLUDE (question_no), true AS given FROM told
      UNION ALL SELECT 'seeded', question_type, CASE WHEN question_no % 13 = 0 THEN 'none' ELSE key END, field,
        CASE WHEN question_no % 7 = 0 THEN text || '?'
             WHEN question_no % 5 = 0 AND field = 'top_products' THEN array_to_string(list_reverse(string_split(text, ' > ')), ' > ') ELSE text END,
        num + CASE WHEN question_no % 7 = 0 THEN 1 ELSE 0 END, true FROM told WHERE question_no % 11 <> 0),
    due AS (SELECT answers, question_type, key, field, text AS true_text, num AS true_num, true AS due FROM told, (VALUES ('published'), ('seeded')) AS v(answers))
    SELECT answers, question_type, field, count(*) AS checked, count(*) FILTER (NOT coalesce(given AND due AND text IS NOT DISTINCT FROM true_text
      AND (num IS NOT DISTINCT FROM true_num OR abs(num - true_num) <= 0.01), false)) AS bad
    FROM given FULL JOIN due USING (answers, question_type, key, field) GROUP BY ALL""",
)
def v10_all_types(spark, root):
    published, expected = published_answers(questions(spark, root)), durable(answers_from_lines(spark, root))
    told = {"published": published, "seeded": with_wrong_answers(published)}
    return gold.union_all([recomputed(p, expected).withColumn("answers", F.lit(n)) for n, p in told.items()])


@query(
    "v11_expected_counts",
    f"""WITH {QUESTIONS}, months AS (SELECT count(*) AS n FROM monthly_net WHERE {PERIOD}),
    expected AS (SELECT 'top_country_month' AS question_type, 2 * n AS expected FROM months
      UNION ALL SELECT 'monthly_revenue_change', n - 1 FROM months
      UNION ALL SELECT 'product_revenue_share_month', 2 * n FROM months
      UNION ALL SELECT 'country_comparison_month', (SELECT count(*) FROM candidates)
      UNION ALL SELECT 'top_product_month', (SELECT count(DISTINCT year_month) FROM product_month)
      UNION ALL SELECT 'top3_products_month', (SELECT count(DISTINCT year_month) FROM product_month)
      UNION ALL SELECT 'return_impact_month', (SELECT count(*) FROM impact))
    SELECT question_type, coalesce(actual, 0) AS actual, CAST(coalesce(expected, 0) AS BIGINT) AS expected,
      coalesce(actual, 0) = coalesce(expected, 0) AS passed
    FROM (SELECT question_type, count(*) AS actual FROM questions GROUP BY 1) FULL JOIN expected USING (question_type)""",
)
def v11(spark, root):
    ends = bounds(spark, root)
    countries, products, months, names = views.summaries(spark, root)

    def counted(rows: DataFrame, **times: Column) -> DataFrame:
        """(question_type, expected) from the number n of these rows."""
        kinds = [F.struct(F.lit(k).alias("question_type"), t.cast("bigint").alias("expected")) for k, t in times.items()]
        return rows.agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(*kinds)))

    n = F.col("n")
    rows = gold.union_all(
        [
            counted(period(months, ends), top_country_month=2 * n, monthly_revenue_change=n - 1, product_revenue_share_month=2 * n),
            counted(products.select("year_month").distinct(), top_product_month=n, top3_products_month=n),
            counted(gold.country_pairs(period(countries, ends), COUNTRY_PAIRS, PAIR_FLOOR), country_comparison_month=n),
            counted(gold.in_period(months, None, ends.last), return_impact_month=n),
        ]
    )
    return quality.expected_counts(question_table(ends, countries, products, months, names), "question_type", rows)
