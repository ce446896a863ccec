"""Generated answers and lists checked against facts and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerproof.functions.numbers import currency, money
from ledgerproof.functions.tables import compact_rows, parse_table
from ledgerproof.operators import checking, gold, prompts, spans
from ledgerproof.operators.ordering import top_n
from ledgerproof.plans import views
from ledgerproof.plans.gold import GOLD, NET2, questions
from ledgerproof.plans.prompts import EVIDENCE, noted
from ledgerproof.plans.register import query
from ledgerproof.plans.spans import END, TOKEN, sql_tenth, trace_rows
from ledgerproof.plans.views import sql_currency, sql_fixed2, sql_key
from ledgerproof.session import stored_once

# ------------------------------------------------------------------ answers to facts


def answers(asked: DataFrame) -> DataFrame:
    """Answers that state the gold text with digits changed, as is, or in capitals."""
    said = F.col("gold_short_answer")
    shown = (
        F.when(F.col("split") == "train", F.replace(said, F.lit("1"), F.lit("7")))
        .when(F.col("split") == "dev", said)
        .otherwise(F.concat(F.lit("In summary: "), F.upper(said), F.lit(" (see 12,3456.00)")))
    )
    return asked.select("question_id", shown.alias("generated_text"))


RANKED_IN = "question_type IN ('top3_products_month', 'product_revenue_share_month')"
ANSWERS = f"""
{EVIDENCE},
answers AS (SELECT question_id, question_type, split, gold_short_answer, CASE split WHEN 'train' THEN replace(gold_short_answer, '1', '7') WHEN 'dev' THEN gold_short_answer
   ELSE concat('In summary: ', upper(gold_short_answer), ' (see 12,3456.00)') END AS generated_text FROM questions),
norms AS (SELECT *, {sql_key('generated_text')} AS norm, list_transform(regexp_extract_all(generated_text, '[-+]?\\d[\\d,]*(?:\\.\\d+)?'),
   lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)) AS nums FROM answers),
rank_places AS (SELECT question_id, rank, strpos(norm, {sql_key('stock_code')}) AS a, strpos(norm, {sql_key('description')}) AS b
   FROM questions JOIN norms USING (question_id) JOIN pm_all ON year_month = right(ord, 7)
   AND rank <= CASE WHEN questions.question_type = 'top3_products_month' THEN 3 ELSE TRY_CAST(left(ord, 3) AS INTEGER) END WHERE questions.{RANKED_IN}),
rank_found AS (SELECT question_id, list(CASE WHEN a > 0 AND b > 0 THEN least(a, b) ELSE greatest(a, b) END ORDER BY rank) AS places FROM rank_places GROUP BY 1),
checked AS (SELECT f.question_id, f.question_type, fact_ord, field, fact_type, str_value, display_name, coalesce(CASE
   WHEN fact_type = 'currency_amount' THEN list_bool_or(list_transform(nums, lambda x: abs(abs(x) - abs(num_value)) <= greatest(1.0, abs(num_value) * 0.5 / 100)))
   WHEN fact_type = 'percentage' THEN list_bool_or(list_transform(nums, lambda x: abs(abs(x) - abs(num_value)) <= 0.5))
   WHEN fact_type = 'ranking' THEN list_min(places) > 0 AND places = list_sort(places)
   WHEN fact_type = 'month' THEN contains(norm, {sql_key('str_value')}) OR contains(norm, {sql_key(views.sql_month_label('str_value'))})
   ELSE contains(norm, {sql_key('str_value')}) END, false) AS matched
   FROM facts f JOIN norms USING (question_id) LEFT JOIN rank_found USING (question_id)),
sides AS (SELECT n.question_id, n.norm, {sql_key('higher_country')} AS hi, {sql_key('lower_country')} AS lo FROM norms n JOIN questions q USING (question_id)
   JOIN compared ON ord = lpad(CAST(select_ord AS VARCHAR), 9, '0') WHERE q.question_type = 'country_comparison_month'),
directions AS (SELECT question_id, NOT ({' OR '.join(f"contains(norm, lo || '{p}')" for p in checking.AHEAD)})
   AND ({' OR '.join(f"contains(norm, hi || '{p}')" for p in checking.AHEAD)}) AS stated FROM sides),
every_fact AS (SELECT question_id, fact_ord, fact_type, display_name, matched FROM checked
   UNION ALL SELECT question_id, 1000, 'comparison_direction', 'comparison direction', stated FROM directions),
kinds AS (SELECT question_id, CASE WHEN fact_type IN ('country', 'product_stock_code', 'product_name') THEN 'entity_or_product_mismatch'
   WHEN fact_type IN ('currency_amount', 'percentage') THEN 'numeric_mismatch' WHEN fact_type = 'ranking' THEN 'ranking_mismatch'
   WHEN fact_type = 'comparison_direction' THEN 'direction_mismatch' ELSE 'time_period_mismatch' END AS kind FROM every_fact WHERE NOT matched
   UNION SELECT question_id, 'malformed_number_format' FROM answers WHERE regexp_matches(generated_text, '\\b\\d{{1,3}},\\d{{4,}}(?:\\.\\d+)?\\b')),
reviewed AS (SELECT *, CASE WHEN hit = total AND NOT contains(coalesce(error_types, ''), 'malformed') THEN 'likely_correct' WHEN hit = 0 THEN 'likely_wrong' ELSE 'partially_correct' END AS auto_status
   FROM (SELECT question_id, count(*) FILTER (matched) AS hit, count(*) AS total, string_agg(display_name, ', ' ORDER BY fact_ord) FILTER (matched) AS matched_fields,
     string_agg(display_name, ', ' ORDER BY fact_ord) FILTER (NOT matched) AS missing_fields FROM every_fact GROUP BY 1)
   LEFT JOIN (SELECT question_id, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS error_types FROM kinds GROUP BY 1) USING (question_id))
"""


def reviewed(asked: DataFrame) -> DataFrame:
    return checking.review_answers(asked, gold.gold_fact_rows(asked), answers(asked))


def fact_query(name: str, kinds: tuple[str, ...]) -> None:
    shown = ", ".join(f"'{k}'" for k in kinds)
    sql = f"WITH {ANSWERS} SELECT question_id, fact_ord, fact_type, matched FROM checked WHERE fact_type IN ({shown})"

    def run(spark, root):
        asked = questions(spark, root)
        facts = gold.gold_fact_rows(asked).filter(F.col("fact_type").isin(*kinds))
        return checking.match_facts(facts, answers(asked)).select("question_id", "fact_ord", "fact_type", "matched")

    query(name, sql)(run)


fact_query("t06_text_fact_match", checking.TEXT_FACTS)
fact_query("t05_fact_amount_match", checking.NUMBER_FACTS)
fact_query("w19_ranking_order_in_text", ("ranking",))


@query("t07_direction_phrase", f"WITH {ANSWERS} SELECT question_id, stated FROM directions")
def t07(spark, root):
    asked = questions(spark, root).filter("question_type = 'country_comparison_month'")
    facts = gold.gold_fact_rows(asked).groupBy("question_id").pivot("field", ["higher_country", "lower_country"]).agg(F.first("str_value"))
    joined = facts.join(answers(asked), "question_id")
    stated = checking.direction_stated(F.col("higher_country"), F.col("lower_country"), F.col("generated_text"))
    return joined.select("question_id", stated.alias("stated"))


def joined_text(c: str):
    return F.when(F.size(c) > 0, F.array_join(c, ", ")).alias(c)


@query(
    "k01_fact_level_review",
    f"WITH {ANSWERS} SELECT question_id, hit AS matched_key_fact_count, total AS total_key_fact_count, matched_fields, missing_fields, error_types, auto_status FROM reviewed",
)
def k01(spark, root):
    return reviewed(questions(spark, root)).select(
        "question_id", "matched_key_fact_count", "total_key_fact_count", *[joined_text(c) for c in ("matched_fields", "missing_fields", "error_types")],
        "auto_status")


@query("a29_array_element_counts", f"WITH {ANSWERS} SELECT kind AS error_type, count(*) AS n FROM (SELECT DISTINCT * FROM kinds) GROUP BY kind")
def a29(spark, root):
    exploded = reviewed(questions(spark, root)).select(F.explode("error_types").alias("error_type"))
    return exploded.groupBy("error_type").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ evidence matches


def evidence_cells(made: DataFrame) -> DataFrame:
    """Cells of the prompt's evidence rows, with the row's display name."""
    shown = made.withColumn("evidence", F.struct(F.col("prompt_evidence_rows").alias("rows")))
    cells = gold.evidence_cells(shown)
    labels = cells.groupBy("question_id", "row_pos").agg(
        F.max(F.when(F.col("key") == "stock_code", F.col("str_value"))).alias("code"),
        F.max(F.when(F.col("key") == "country", F.col("str_value"))).alias("country"))
    label = F.coalesce("code", "country", F.concat(F.lit("row_"), F.col("row_pos").cast("string")))
    return cells.join(labels, ["question_id", "row_pos"]).withColumn("row_label", label)


def fact_spans(asked: DataFrame) -> DataFrame:
    """Facts' display texts looked up in the answers, labelled by the fact match."""
    facts = checking.match_facts(gold.gold_fact_rows(asked), answers(asked))
    start = F.instr("generated_text", F.col("display_value")) - 1
    label = F.when(F.col("matched"), "correct_key_fact").when(F.col("fact_type") == "month", "unsupported_claim").otherwise("hallucinated_key_fact")
    return facts.join(asked.select("question_id", "gold_short_answer"), "question_id").select(
        "question_id", "fact_ord", "fact_type", F.col("display_value").alias("span_text"), label.alias("label"),
        start.alias("span_start_char"), (start + F.length("display_value")).alias("span_end_char"), "generated_text", "gold_short_answer")


SQL_AMOUNT = r"TRY_CAST(nullif(regexp_extract(regexp_replace({c}, 'GBP|gbp|£|[,%]', '', 'g'), '-?\d+(?:\.\d+)?'), '') AS DOUBLE)"
MATCHES = f"""
{ANSWERS},
rows_ AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY k, i) AS row_pos, string_split(line[3:-3], ' | ') AS c, question_type
   FROM evidence JOIN questions USING (question_id)),
cells AS (SELECT question_id, row_pos, unnest(c) AS v, unnest(CASE WHEN question_type LIKE '%product%' THEN ['stock_code', 'description', 'net_revenue', 'gross_positive_revenue', 'cancellation_revenue']
   WHEN question_type LIKE '%country%' THEN ['country', 'net_revenue', 'gross_positive_revenue', 'cancellation_revenue', 'invoice_count']
   ELSE ['year_month', 'net_revenue', 'gross_positive_revenue', 'cancellation_revenue', 'invoice_count'] END) AS key,
   CASE WHEN question_type LIKE '%product%' OR question_type LIKE '%country%' THEN c[1] ELSE concat('row_', row_pos) END AS row_label FROM rows_),
cell_values AS (SELECT *, lower(v) AS lv, {SQL_AMOUNT.format(c='v')} AS vn FROM cells),
span_values AS (SELECT question_id, fact_ord, fact_type, lower(display_value) AS s, {SQL_AMOUNT.format(c='display_value')} AS sn FROM facts),
row_hits AS (SELECT question_id, fact_ord, row_pos, row_label, string_agg(DISTINCT key, ',' ORDER BY key) AS keys FROM span_values JOIN cell_values USING (question_id)
   WHERE contains(lv, s) OR (length(lv) >= 4 AND contains(s, lv)) OR (fact_type <> 'ranking' AND abs(sn - vn) <= 0.02) GROUP BY ALL),
matches AS (SELECT question_id, fact_ord, string_agg(concat('row_', row_pos, ':', row_label, ':', keys), '; ' ORDER BY row_pos) AS matches FROM row_hits GROUP BY ALL)
"""

@query("j05_evidence_match", f"WITH {MATCHES} SELECT question_id, fact_ord, matches FROM matches")
def j05(spark, root):
    asked = questions(spark, root)
    cells = evidence_cells(prompts.prompts(asked, *noted(spark, root)))
    spans_ = gold.gold_fact_rows(asked).select("question_id", "fact_ord", "fact_type", F.col("display_value").alias("span_text"))
    found = checking.evidence_matches(spans_, cells, ["question_id", "fact_ord"])
    return found.select("question_id", "fact_ord", F.array_join("matches", "; ").alias("matches"))


VERDICT_SQL = "CASE WHEN matched THEN 'supported' WHEN c.fact_type = 'month' THEN 'unmatched' ELSE 'contradicted' END"


@query(
    "k04_evidence_verdicts",
    f"""WITH {MATCHES} SELECT c.question_id, c.fact_ord, {VERDICT_SQL} AS verdict,
    CASE WHEN strpos(generated_text, display_value) > 0 THEN generated_text ELSE display_value END AS claim_text,
    contains(lower(gold_short_answer), lower(display_value)) AS gold_contains_span, coalesce(matches, '') AS matches,
    {VERDICT_SQL} = 'contradicted' AND c.fact_type = 'ranking' AS ranking_reason
    FROM checked c JOIN facts f ON f.question_id = c.question_id AND f.fact_ord = c.fact_ord JOIN answers a ON a.question_id = c.question_id
    LEFT JOIN matches m ON m.question_id = c.question_id AND m.fact_ord = c.fact_ord""",
)
def k04(spark, root):
    asked = questions(spark, root)
    cells = evidence_cells(prompts.prompts(asked, *noted(spark, root)))
    rows = checking.verdict_rows(fact_spans(asked), cells, ["question_id", "fact_ord"])
    return rows.select(
        "question_id", "fact_ord", "verdict", "claim_text", "gold_contains_span", F.array_join("matches", "; ").alias("matches"),
        (F.col("verdict_reason") == checking.REASONS["contradicted_ranking"]).alias("ranking_reason"))


# --------------------------------------------------------------------- ranked lists


@stored_once
def product_leaders(spark, root, metric: str) -> DataFrame:
    return gold.leading_products(views.product_amounts(spark, root), metric, views.product_names(spark, root))


def list_answers(spark, root, metric: str) -> DataFrame:
    """Each month's top three by a metric as a Markdown answer with some slips, beside
    the gold list and the evidence rows."""
    products = product_leaders(spark, root, "net_revenue")
    tie = [F.col("stock_code"), F.col("description")]
    picked = top_n(product_leaders(spark, root, metric), 3, ["year_month"], [F.col(metric).desc(), *tie])
    m, rank = F.substring("year_month", 6, 2), F.col("rank")
    amount = F.when(m == "09", "n/a").otherwise(currency(money(F.col(metric))))
    shown_rank = F.when(m == "07", "first").otherwise(rank.cast("string"))
    row = F.when((m == "05") & (rank == 3), "| 3 | only two |").otherwise(
        F.concat(F.lit("| "), F.concat_ws(" | ", shown_rank, F.lower("stock_code"), "description", amount), F.lit(" |")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", row.alias("t")))), lambda x: x["t"])
    head = (
        F.when(m == "02", "| Rank | Stock_Code | Product_Name | Net_Revenue_GBP |")
        .when(m == "04", "| position | code | product | amount |")
        .otherwise("| rank | stock_code | product_name | net_revenue_gbp |"))
    said = picked.groupBy("year_month").agg(lines.alias("lines")).select(
        "year_month",
        F.concat_ws("\n", F.concat(F.lit("Answer for "), "year_month"), head, F.lit("| --- | --- | --- | --- |"),
                    F.array_join("lines", "\n"), F.lit("Done.")).alias("generated_text"))
    best = gold.ranked_products(products, 3).withColumnRenamed("top_products", "gold_rows")
    shown = gold.evidence_rows(gold.head_rows(products, gold.EVIDENCE_ROWS, ["stock_code", "description"]), ["year_month"], rank)
    return said.join(best, "year_month").join(shown, "year_month").select(
        F.col("year_month").alias("question_id"), "generated_text", "gold_rows", F.col("evidence").alias("evidence_rows"))


def list_sql(name: str, metric: str) -> str:
    row = f"""CASE WHEN right(year_month, 2) = '05' AND r = 3 THEN '| 3 | only two |' ELSE concat('| ', concat_ws(' | ',
      CASE WHEN right(year_month, 2) = '07' THEN 'first' ELSE CAST(r AS VARCHAR) END, lower(stock_code), description,
      CASE WHEN right(year_month, 2) = '09' THEN 'n/a' ELSE {sql_currency(f'round({metric}, 2)')} END), ' |') END"""
    return f"""{name}_texts AS (SELECT year_month AS qid, concat_ws(chr(10), concat('Answer for ', year_month),
      CASE WHEN right(year_month, 2) = '02' THEN '| Rank | Stock_Code | Product_Name | Net_Revenue_GBP |' WHEN right(year_month, 2) = '04' THEN '| position | code | product | amount |'
      ELSE '| rank | stock_code | product_name | net_revenue_gbp |' END, '| --- | --- | --- | --- |', string_agg({row}, chr(10) ORDER BY r), 'Done.') AS body
      FROM (SELECT *, row_number() OVER (PARTITION BY year_month ORDER BY {metric} DESC, stock_code, description) AS r FROM product_month) WHERE r <= 3 GROUP BY year_month),
    {name}_lines AS (SELECT qid, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT qid, string_split(body, chr(10)) AS l FROM {name}_texts)),
    {name}_piped AS (SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY pos) AS idx,
      list_transform(string_split(regexp_replace(trim(line), '^\\|+|\\|+$', '', 'g'), '|'), lambda x: trim(x)) AS cells FROM {name}_lines WHERE line LIKE '|%|'),
    {name}_data AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pos) AS row_index, cells, len(cells) AS width, TRY_CAST(cells[1] AS BIGINT) AS rank,
      upper(cells[2]) AS stock_code, upper(cells[3]) AS product_name, CASE WHEN len(cells) = 4 THEN {SQL_AMOUNT.format(c='cells[4]')} END AS amount FROM {name}_piped
      WHERE idx > 1 AND NOT regexp_full_match(array_to_string(cells, ''), '[-:]+')),
    {name}_rows AS (SELECT * FROM {name}_data WHERE width = 4),
    {name}_issues AS (SELECT qid, string_agg(issue, '; ' ORDER BY row_index, o) AS parse_issues FROM (
      SELECT qid, row_index, 1 AS o, concat('row ', row_index, ' has ', width, ' columns') AS issue FROM {name}_data WHERE width <> 4
      UNION ALL SELECT qid, row_index, 2, concat('row ', row_index, ' rank is not an integer') FROM {name}_rows WHERE rank IS NULL
      UNION ALL SELECT qid, row_index, 3, concat('row ', row_index, ' amount is not parseable') FROM {name}_rows WHERE amount IS NULL) GROUP BY qid),
    {name}_base AS (SELECT t.qid, t.body, lower(array_to_string((SELECT cells FROM {name}_piped p WHERE p.qid = t.qid AND idx = 1), ',')) = 'rank,stock_code,product_name,net_revenue_gbp' AS header_valid,
      coalesce(got, []) AS got, coalesce(amounts, []) AS amounts, coalesce(ranks, []) AS ranks, want, prices, seen, nets, coalesce(parse_issues, '') AS parse_issues
      FROM {name}_texts t LEFT JOIN (SELECT qid, list(stock_code ORDER BY row_index) AS got, list(amount ORDER BY row_index) AS amounts, list(rank ORDER BY row_index) AS ranks FROM {name}_rows GROUP BY qid) g USING (qid)
      LEFT JOIN {name}_issues USING (qid)
      JOIN (SELECT year_month AS qid, list(upper(stock_code) ORDER BY rank) AS want, list(CAST({NET2} AS DOUBLE) ORDER BY rank) AS prices FROM pm_all WHERE rank <= 3 GROUP BY 1) USING (qid)
      JOIN (SELECT year_month AS qid, list(upper(stock_code) ORDER BY rank) AS seen, list(CAST({NET2} AS DOUBLE) ORDER BY rank) AS nets FROM pm_all GROUP BY 1) USING (qid)),
    {name}_eval AS (SELECT *, header_valid AND row_count = 3 AND rank_sequence_valid AND parse_issues = '' AS format_valid, evidence_membership_count = row_count AND row_count > 0 AS all_generated_from_evidence FROM (
      SELECT qid AS question_id, header_valid, len(got) AS row_count, coalesce(ranks = [1, 2, 3], false) AS rank_sequence_valid, got = want AS exact_order_match,
      list_sort(list_distinct(got)) = list_sort(list_distinct(want)) AND len(got) = len(want) AS set_match,
      len(list_filter(range(1, least(len(got), len(want)) + 1), lambda i: got[i] = want[i])) AS correct_rank_count,
      len(list_filter(got, lambda g: list_contains(want, g))) AS gold_presence_count, len(list_filter(got, lambda g: list_contains(seen, g))) AS evidence_membership_count,
      len(list_filter(range(1, len(got) + 1), lambda i: coalesce(abs(amounts[i] - nets[list_position(seen, got[i])]) <= 0.01, false))) AS copied_evidence_amount_count,
      len(list_filter(range(1, least(len(got), len(want)) + 1), lambda i: got[i] = want[i] AND coalesce(abs(amounts[i] - prices[i]) <= 0.01, false))) AS correct_rank_amount_count,
      len(list_filter(amounts, lambda a: a IS NOT NULL)) = len(got) AND len(got) >= 2
        AND len(list_filter(range(1, len(got)), lambda i: coalesce(amounts[i] < amounts[i + 1] - 0.01, true))) = 0 AS is_sorted_by_generated_amount_desc,
      coalesce(list_min(list_filter(range(1, least(len(got), len(seen)) + 1), lambda i: got[i] <> seen[i])) - 1, least(len(got), len(seen))) AS evidence_prefix_match_count,
      round(list_avg(list_transform(list_filter(got, lambda g: list_contains(seen, g)), lambda g: list_position(seen, g))), 3) AS mean_generated_evidence_position,
      array_to_string(got, ' > ') AS generated_stock_codes, array_to_string(want, ' > ') AS gold_stock_codes, parse_issues FROM {name}_base))"""


LISTS = f"{GOLD}, {list_sql('a', 'gross_positive_revenue')}, {list_sql('b', 'net_revenue')}"
EVAL = [
    "question_id", "header_valid", "row_count", "rank_sequence_valid", "exact_order_match", "set_match", "correct_rank_count", "gold_presence_count",
    "evidence_membership_count", "copied_evidence_amount_count", "correct_rank_amount_count", "is_sorted_by_generated_amount_desc",
    "evidence_prefix_match_count", "mean_generated_evidence_position", "generated_stock_codes", "gold_stock_codes", "parse_issues",
    "format_valid", "all_generated_from_evidence",
]


@stored_once
def lists(spark, root, metric: str = "gross_positive_revenue") -> DataFrame:
    return list_answers(spark, root, metric)


@query("t12_table_rows_from_text", f"WITH {LISTS} SELECT qid AS question_id, row_index, rank, stock_code, product_name, amount FROM a_rows")
def t12(spark, root):
    parsed = lists(spark, root).select("question_id", F.explode(parse_table(F.col("generated_text"))["rows"]).alias("r"))
    return parsed.select("question_id", "r.row_index", "r.rank", "r.stock_code", "r.product_name", F.col("r.net_revenue_gbp").alias("amount"))


CELLS_SQL = """offs AS (SELECT qid, pos, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY qid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM a_lines),
  tl AS (SELECT *, list_filter(range(0, length(line)), lambda i: substring(line, i + 1, 1) = '|') AS pipes FROM offs WHERE line LIKE '|%|'
    AND lower(line) <> '| rank | stock_code | product_name | net_revenue_gbp |' AND NOT regexp_full_match(line, '[-:| ]+')),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS n FROM tl WHERE len(pipes) = 5),
  cell_rows AS (SELECT qid, n, base, line, pipes, unnest(['rank', 'stock_code', 'product_name', 'net_revenue_gbp']) AS column_name, unnest([1, 2, 3, 4]) AS k FROM numbered),
  placed_cells AS (SELECT qid, n, column_name, trim(substring(line, pipes[k] + 2, pipes[k + 1] - pipes[k] - 1)) AS text_, base + pipes[k] + 2 AS s FROM cell_rows)"""


@query(
    "t13_table_cell_offsets",
    f"""WITH {LISTS}, {CELLS_SQL} SELECT qid AS question_id, n AS table_row_index, column_name, text_ AS text, CAST(s AS BIGINT) AS start_char,
    CAST(s + length(text_) AS BIGINT) AS end_char, CAST(NULL AS VARCHAR) AS issue FROM placed_cells
    UNION ALL SELECT qid, NULL, NULL, NULL, NULL, NULL, 'unexpected markdown pipe count' FROM tl WHERE len(pipes) <> 5""",
)
def t13(spark, root):
    names = ["rank", "stock_code", "product_name", "net_revenue_gbp"]
    whole = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n if n != "rank" else "rank_cell").alias("c")) for n in names])
    rows = checking.table_cells(lists(spark, root))
    good = rows.filter("issue IS NULL").select("question_id", "table_row_index", "issue", F.explode(whole).alias("x")).select(
        "question_id", "table_row_index", "x.column_name", F.col("x.c.text").alias("text"), F.col("x.c.start").alias("start_char"),
        F.col("x.c.end").alias("end_char"), "issue")
    return good.unionByName(rows.filter("issue IS NOT NULL").select("question_id", "issue"), allowMissingColumns=True)


@query(
    "t14_compact_rows",
    f"""WITH {LISTS} SELECT qid AS question_id, string_agg(concat(coalesce(CAST(rank AS VARCHAR), 'None'), ':', stock_code, ' ',
    CASE WHEN amount IS NULL THEN 'NA' ELSE concat('GBP ', {sql_fixed2('amount')}) END), ' > ' ORDER BY row_index) AS compact,
    string_agg(stock_code, ' > ' ORDER BY row_index) AS codes FROM a_rows GROUP BY qid""",
)
def t14(spark, root):
    parsed = lists(spark, root).withColumn("t", parse_table(F.col("generated_text")))
    return parsed.select(
        "question_id", compact_rows(F.col("t.rows"), "net_revenue_gbp").alias("compact"),
        F.array_join(F.transform("t.rows", lambda r: r["stock_code"]), " > ").alias("codes"))


@query(
    "j06_positional_pairs",
    f"""WITH {LISTS} SELECT qid AS question_id, unnest(range(1, least(len(got), len(want)) + 1)) AS place, got[place] AS generated, want[place] AS gold FROM a_base""",
)
def j06(spark, root):
    parsed = lists(spark, root).withColumn("t", parse_table(F.col("generated_text")))
    pairs = checking.paired_positions(
        F.transform("t.rows", lambda r: r["stock_code"]), F.transform("gold_rows", lambda r: F.upper(r["stock_code"])))
    return parsed.select("question_id", F.posexplode(pairs).alias("place", "p")).select(
        "question_id", (F.col("place") + 1).cast("bigint").alias("place"), F.col("p.g").alias("generated"), F.col("p.r").alias("gold"))


@query(
    "j08_omitted_members",
    f"""WITH {LISTS} SELECT year_month AS question_id, rank AS expected_rank, upper(stock_code) AS stock_code FROM pm_all p WHERE rank <= 3
    AND NOT EXISTS (SELECT 1 FROM a_rows a WHERE a.qid = p.year_month AND a.stock_code = upper(p.stock_code))""",
)
def j08(spark, root):
    return checking.omitted_members(lists(spark, root)).select("question_id", "expected_rank", "stock_code")


@query("k02_ranked_list_evaluation", f"WITH {LISTS} SELECT {', '.join(EVAL)} FROM a_eval")
def k02(spark, root):
    return checking.evaluate_lists(lists(spark, root)).select(*EVAL)


def totals_sql(source: str, extra: str = "") -> str:
    return f"""SELECT {extra} count(*) AS record_count, count(*) * 3 AS total_gold_rank_rows,
      {', '.join(f'count(*) FILTER ({f}) AS {f}_rows' for f in checking.LIST_FLAGS)},
      {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}_total' for n in checking.LIST_COUNTS)} FROM {source}"""


@query("a25_list_accuracy_totals", f"WITH {LISTS} {totals_sql('a_eval')}")
def a25(spark, root):
    return checking.list_totals(checking.evaluate_lists(lists(spark, root)))


def conditions(spark, root) -> tuple[DataFrame, DataFrame]:
    return tuple(checking.evaluate_lists(list_answers(spark, root, m)) for m in ("gross_positive_revenue", "net_revenue"))


@query(
    "a27_condition_rates",
    f"""WITH {LISTS} SELECT *, round(CAST(exact_order_match_rows AS DOUBLE) / record_count, 6) AS exact_order_rate,
    round(CAST(correct_rank_count_total AS DOUBLE) / total_gold_rank_rows, 6) AS correct_rank_rate,
    round(CAST(evidence_membership_count_total AS DOUBLE) / row_count_total, 6) AS evidence_membership_rate
    FROM ({totals_sql('a_eval', "'by_gross' AS condition,")} UNION ALL {totals_sql('b_eval', "'by_net' AS condition,")})""",
)
def a27(spark, root):
    a, b = conditions(spark, root)
    both = a.withColumn("condition", F.lit("by_gross")).unionByName(b.withColumn("condition", F.lit("by_net")))
    return checking.condition_rates(both)


@query(
    "j14_side_by_side_runs",
    f"""WITH {LISTS} SELECT question_id, a.exact_order_match AS left_exact, a.correct_rank_count AS left_ranks, b.exact_order_match AS right_exact,
    b.correct_rank_count AS right_ranks, coalesce(b.correct_rank_count, 0) - coalesce(a.correct_rank_count, 0) AS rank_gain
    FROM (SELECT * FROM a_eval WHERE format_valid) a FULL JOIN b_eval b USING (question_id)""",
)
def j14(spark, root):
    a, b = conditions(spark, root)
    return checking.compare_conditions(a.filter("format_valid"), b)


@query(
    "k05_condition_comparison",
    f"""WITH {LISTS} SELECT count(*) AS questions, count(*) FILTER (NOT a.exact_order_match) AS left_failed, count(*) FILTER (NOT b.exact_order_match) AS right_failed,
    CAST(sum(b.correct_rank_count - a.correct_rank_count) AS BIGINT) AS rank_gain,
    string_agg(question_id, ',' ORDER BY question_id) FILTER (NOT b.exact_order_match) AS right_failed_ids
    FROM a_eval a JOIN b_eval b USING (question_id)""",
)
def k05(spark, root):
    a, b = conditions(spark, root)
    failed = F.array_sort(F.collect_list(F.when(~F.col("right_exact"), F.col("question_id"))))
    return checking.compare_conditions(a, b).agg(
        F.count("*").alias("questions"), F.count_if(~F.col("left_exact")).alias("left_failed"), F.count_if(~F.col("right_exact")).alias("right_failed"),
        F.sum("rank_gain").alias("rank_gain"), F.array_join(failed, ",").alias("right_failed_ids"))


# ------------------------------------------------------------------ cell-level signals

ENTROPY_LIMIT, MARGIN_LIMIT = 0.8, 0.95
SIGNALS = f"""{LISTS}, {CELLS_SQL},
row_spans AS (SELECT qid, n, 'row_full' AS span_scope, trim(substring(line, 2, length(line) - 2)) AS text_, base + 2 AS s FROM numbered
  UNION ALL SELECT qid, n, column_name, text_, s FROM placed_cells WHERE column_name <> 'rank'),
ranked_rows AS (SELECT c.qid, c.n, coalesce(CASE WHEN regexp_full_match(c.text_, '[-+]?\\d+') THEN TRY_CAST(c.text_ AS BIGINT) END, c.n) AS rank, upper(d.text_) AS code, upper(e.text_) AS name, {SQL_AMOUNT.format(c='f.text_')} AS amount
  FROM placed_cells c JOIN placed_cells d ON d.qid = c.qid AND d.n = c.n AND d.column_name = 'stock_code' JOIN placed_cells e ON e.qid = c.qid AND e.n = c.n AND e.column_name = 'product_name'
  JOIN placed_cells f ON f.qid = c.qid AND f.n = c.n AND f.column_name = 'net_revenue_gbp' WHERE c.column_name = 'rank'),
labelled AS (SELECT r.qid, r.n, r.rank, CASE WHEN coalesce(code = upper(stock_code) AND name = upper(description) AND abs(amount - CAST({NET2} AS DOUBLE)) <= 0.01, false) THEN 'correct' ELSE 'incorrect_rank_binding' END AS label,
  CASE WHEN stock_code IS NULL THEN 'rank outside gold top3' WHEN code = upper(stock_code) THEN 'rank-bound row matches gold' ELSE concat('should be ', upper(stock_code), ', generated ', code) END AS reason
  FROM ranked_rows r LEFT JOIN pm_all p ON p.year_month = r.qid AND p.rank = r.rank AND p.rank <= 3),
list_pieces AS (SELECT qid, generate_subscripts(t, 1) - 1 AS position, unnest(t) AS token_text FROM (SELECT qid, regexp_extract_all(concat(body, '{END}'), '{TOKEN}') AS t FROM a_texts)),
list_tokens AS (SELECT *, e - length(token_text) AS b FROM (SELECT *, sum(length(token_text)) OVER (PARTITION BY qid ORDER BY position) AS e,
  {sql_tenth('position % 11')} AS entropy, {sql_tenth('(position + length(token_text)) % 10')} AS margin FROM list_pieces) WHERE token_text <> '{END}'),
signals AS (SELECT s.qid AS question_id, s.n AS table_row_index, l.rank, s.span_scope, l.label, l.reason, s.text_ AS span_text, CAST(s.s AS BIGINT) AS span_start_char, count(*) AS token_count,
  CAST(max(entropy) AS DOUBLE) AS max_token_entropy, CAST(min(margin) AS DOUBLE) AS min_top2_margin, max(entropy) >= {ENTROPY_LIMIT} AS by_entropy, 1 - min(margin) >= {MARGIN_LIMIT} AS by_margin
  FROM row_spans s JOIN labelled l ON l.qid = s.qid AND l.n = s.n JOIN list_tokens t ON t.qid = s.qid AND t.e > s.s AND t.b < s.s + length(s.text_)
  GROUP BY ALL)
"""
SIGNAL_COLUMNS = ["question_id", "table_row_index", "rank", "span_scope", "label", "reason", "span_text", "span_start_char", "token_count",
                  "max_token_entropy", "min_top2_margin", "by_entropy", "by_margin"]


def signals(spark, root) -> DataFrame:
    """Table cells as spans with their token scores and two detector flags."""
    said = lists(spark, root)
    gold_rows = said.select("question_id", F.inline("gold_rows"))
    marked = checking.signal_spans(checking.table_cells(said), gold_rows)
    keyed = marked.withColumn("qid", F.col("question_id")).withColumn(
        "annotation_id", F.concat_ws("|", "question_id", F.col("table_row_index").cast("string"), "span_scope"))
    raw = said.select(F.col("question_id").alias("qid"), F.lit("en").alias("lang"), F.concat("generated_text", F.lit(END)).alias("raw"))
    tokens = spans.token_offsets(trace_rows(raw).withColumn("display_text", F.col("token_text")))
    scored = spans.span_features(spans.overlap_join(keyed.select("annotation_id", "qid", "span_start_char", "span_end_char"), tokens))
    return keyed.join(scored, "annotation_id").withColumns(
        {"by_entropy": F.col("max_token_entropy") >= ENTROPY_LIMIT, "by_margin": 1 - F.col("min_top2_margin") >= MARGIN_LIMIT})


@query("k03_cell_level_signals", f"WITH {SIGNALS} SELECT {', '.join(SIGNAL_COLUMNS)} FROM signals")
def k03(spark, root):
    return signals(spark, root).select(*SIGNAL_COLUMNS)


RATES = """coalesce(label, 'all') AS label, coalesce(span_scope, 'all') AS span_scope, count(*) AS span_count, count(*) FILTER (by_entropy) AS flagged_by_entropy,
  count(*) FILTER (by_margin) AS flagged_by_margin, round(CAST(count(*) FILTER (by_entropy) AS DOUBLE) / count(*), 6) AS rate_by_entropy, round(CAST(count(*) FILTER (by_margin) AS DOUBLE) / count(*), 6) AS rate_by_margin"""


@query("a26_flag_rate_groups", f"WITH {SIGNALS} SELECT {RATES} FROM signals s GROUP BY GROUPING SETS ((s.label), (s.span_scope), (s.label, s.span_scope))")
def a26(spark, root):
    return checking.flag_rates(signals(spark, root), ["by_entropy", "by_margin"])
