"""Questions with exact answers, built from the net summaries.

Each builder returns one row per question with typed answer columns. `as_question`
adds the shared record: text, typed facts and evidence rows. Summaries are grouped
before anything is ranked, and ranking keeps n rows per group on the map side, so
only months x n rows travel.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerproof.functions.numbers import currency, fixed2, money, percent
from ledgerproof.functions.text import month_label
from ledgerproof.operators.ordering import contenders, first_wins, running_totals, top_n
from ledgerproof.session import durable

CURRENCY = "GBP"
EVIDENCE_ROWS = 8
EVIDENCE_FIELDS = (
    "country", "stock_code", "description", "year_month",
    "net_revenue", "gross_positive_revenue", "cancellation_revenue", "invoice_count",
)
AMOUNT_FIELDS = EVIDENCE_FIELDS[4:7]
SHOWN_FIELDS = {
    "country_month_net_revenue_summary": ("country", *AMOUNT_FIELDS, "invoice_count"),
    "product_month_net_revenue_summary": ("stock_code", "description", *AMOUNT_FIELDS),
    "monthly_net_revenue_summary": ("year_month", *AMOUNT_FIELDS, "invoice_count"),
}
RANKING = "array<struct<rank:bigint,stock_code:string,description:string,merchandise_net_revenue:double>>"


# ------------------------------------------------------------------------ facts


def _fact(field, fact_type, display, name, kind, text=None, number=None, ranking=None, limits=(None, None, None)):
    def opt(c, t):
        return F.lit(None).cast(t) if c is None else (c if isinstance(c, Column) else F.lit(c)).cast(t)

    absolute, relative, points = limits
    return F.struct(
        F.lit(field).alias("field"),
        F.lit(fact_type).alias("fact_type"),
        opt(text, "string").alias("str_value"),
        opt(number, "double").alias("num_value"),
        opt(ranking, RANKING).alias("ranking"),
        display.alias("display_value"),
        (name if isinstance(name, Column) else F.lit(name or field)).alias("display_name"),
        F.lit(kind).alias("tolerance_kind"),
        opt(absolute, "double").alias("absolute"),
        opt(relative, "double").alias("relative_percent"),
        opt(points, "double").alias("percentage_points"),
    )


def currency_fact(field: str, value: Column, name: str | Column | None = None) -> Column:
    return _fact(
        field, "currency_amount", currency(value), name, "absolute_or_relative", number=value, limits=(1.0, 0.5, None)
    )


def percent_fact(field: str, value: Column, name: str | None = None) -> Column:
    return _fact(
        field, "percentage", percent(value), name, "percentage_points", number=value, limits=(None, None, 0.5)
    )


def text_fact(field: str, fact_type: str, value: Column, name: str | None = None) -> Column:
    return _fact(field, fact_type, value, name, "exact_normalized_match", text=value)


def rank_fact(field: str, ranking: Column) -> Column:
    shown = F.array_join(
        F.transform(ranking, lambda x: F.concat(x["rank"].cast("string"), F.lit(". "), x["stock_code"])), " > "
    )
    return _fact(field, "ranking", shown, None, "ordered_exact_match", ranking=ranking)


def month_fact(c: Column, field: str = "year_month", name: str = "month") -> Column:
    return text_fact(field, "month", c, name)


# --------------------------------------------------------------------- evidence


def evidence_rows(ranked: DataFrame, key: Sequence[str], position: Column) -> DataFrame:
    """(key, evidence): at most a handful of rows per question, in position order.
    The position may be a struct; rows keep their ordinal as `pos`."""
    def cell(name):
        if name not in ranked.columns:
            return F.lit(None).cast("bigint" if name == "invoice_count" else "string" if name in EVIDENCE_FIELDS[:4] else "double")
        c = F.col(name)
        return money(c) if name.endswith("revenue") else c

    row = F.struct(position.alias("pos"), *[cell(n).alias(n) for n in EVIDENCE_FIELDS])
    return ranked.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("evidence"))


def head_rows(summary: DataFrame, n: int, tie: Sequence[str], metric: str = "net_revenue") -> DataFrame:
    """The first n rows of each month by metric, largest first."""
    return top_n(summary, n, ["year_month"], [F.col(metric).desc(), *[F.col(c) for c in tie]])


def leading_products(product_month: DataFrame, metric: str = "net_revenue", names: DataFrame | None = None) -> DataFrame:
    """The first products of each month by metric, as many as evidence shows; shorter lists are heads of these.
    With names (product, stock_code, description) given, products are numbers and only these few get their names."""
    left = contenders(product_month, EVIDENCE_ROWS, ["year_month"], metric)
    if names is not None:
        left = left.join(names, "product")
    return head_rows(left, EVIDENCE_ROWS, ["stock_code", "description"], metric).drop("rank")


def in_period(df: DataFrame, first: str | None, last: str | None) -> DataFrame:
    if first is not None:
        df = df.filter(F.col("year_month") >= first)
    return df if last is None else df.filter(F.col("year_month") <= last)


# --------------------------------------------------------------------- builders
# The sentences of questions and answers, and the names of fields, are the output itself.


def top_country(country_month: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    pool = country_month.filter(~F.col("country").isin(*excluded)) if excluded else country_month
    scope = "excluding " + ", ".join(excluded) if excluded else "all countries"
    return head_rows(pool, 1, ["country"]).select(
        "year_month",
        month_label(F.col("year_month")).alias("month_label"),
        F.lit(scope).alias("scope"),
        "country",
        money(F.col("net_revenue")).alias("net_revenue"),
    )


def top_country_evidence(country_month: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """The overall leader, then the leaders of the pool. The leader may repeat when
    nothing in its month is excluded."""
    if not excluded:
        return head_rows(country_month, EVIDENCE_ROWS, ["country"])
    pool = country_month.filter(~F.col("country").isin(*excluded))
    leader = head_rows(country_month, 1, ["country"]).withColumn("rank", F.lit(0).cast("bigint"))
    return leader.unionByName(head_rows(pool, EVIDENCE_ROWS - 1, ["country"]))


def top_product(product_month: DataFrame, partial_month: str, partial_note: str) -> DataFrame:
    return head_rows(product_month, 1, ["stock_code", "description"]).select(
        "year_month",
        month_label(F.col("year_month")).alias("month_label"),
        F.when(F.col("year_month") == partial_month, partial_note).otherwise("").alias("scope_note"),
        "stock_code",
        "description",
        money(F.col("net_revenue")).alias("merchandise_net_revenue"),
    )


def ranked_products(product_month: DataFrame, n: int) -> DataFrame:
    """(year_month, top_products): the ranked array of the first n products."""
    item = F.struct("rank", "stock_code", "description", money(F.col("net_revenue")).alias("merchandise_net_revenue"))
    return (
        head_rows(product_month, n, ["stock_code", "description"])
        .groupBy("year_month")
        .agg(F.array_sort(F.collect_list(item)).alias("top_products"))
    )


def country_pairs(country_month: DataFrame, pairs: Sequence[tuple[str, str]], floor: float) -> DataFrame:
    """Pairs of named countries that traded in the same month and are not both tiny.

    The pair list is configuration; it rides along as literals.
    """
    named = F.explode(
        F.array(*[F.struct(F.lit(i).alias("pair_ord"), F.lit(a).alias("country_a"), F.lit(b).alias("country_b"))
                  for i, (a, b) in enumerate(pairs)])
    )
    names = sorted({name for pair in pairs for name in pair})
    values = country_month.filter(F.col("country").isin(*names)).select(
        "year_month", "country", F.round("net_revenue", 2).alias("value")
    )
    left = values.select("year_month", named.alias("p"), "country", "value").filter("country = p.country_a")
    right = values.select("year_month", F.col("country").alias("country_b"), F.col("value").alias("value_b"))
    joined = left.select(
        "year_month", "p.pair_ord", "p.country_a", "p.country_b", F.col("value").alias("value_a")
    ).join(right, ["year_month", "country_b"])
    return joined.filter((F.abs("value_a") >= floor) | (F.abs("value_b") >= floor))


def round_robin(candidates: DataFrame, group: str, order: str, quota: int | None = None) -> DataFrame:
    """One candidate per group per round, until the quota is met if there is one; too few
    candidates for a quota stop the job. `select_ord` counts the picks."""
    rounds = candidates.withColumn(
        "round", F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("bigint")
    )
    if quota is None:
        return running_totals(rounds, [F.col("round"), F.col(group), F.col(order)], position="select_ord")
    # The quota bounds the rows of the window.
    picked = rounds.orderBy("round", group).limit(quota).withColumn(
        "select_ord", F.row_number().over(Window.orderBy("round", group)).cast("bigint"))
    short = F.count(F.lit(1)).over(Window.partitionBy()) < quota
    message = F.lit(f"fewer than {quota} candidates")
    return picked.withColumn("select_ord", F.when(short, F.raise_error(message).cast("bigint")).otherwise(F.col("select_ord")))


def country_comparison(selected: DataFrame) -> DataFrame:
    """Winner, loser and difference; ties go to the first-named country."""
    a_wins = F.col("value_a") >= F.col("value_b")
    return selected.select(
        "select_ord",
        "year_month",
        month_label(F.col("year_month")).alias("month_label"),
        "country_a",
        "country_b",
        F.col("value_a").cast("double").alias("country_a_net_revenue"),
        F.col("value_b").cast("double").alias("country_b_net_revenue"),
        F.when(a_wins, F.col("country_a")).otherwise(F.col("country_b")).alias("higher_country"),
        F.when(a_wins, F.col("country_b")).otherwise(F.col("country_a")).alias("lower_country"),
        F.abs(F.col("value_a") - F.col("value_b")).cast("double").alias("revenue_delta"),
    )


def comparison_evidence(selected: DataFrame, country_month: DataFrame, lead: int = 3) -> DataFrame:
    """The two named countries, then the month's leaders; a country is kept once."""
    key = ["select_ord", "year_month"]
    named = selected.select(*key, F.explode(F.array("country_a", "country_b")).alias("country"))
    pair = named.join(country_month, ["year_month", "country"]).withColumn("part", F.lit(0))
    leaders = head_rows(country_month, lead, ["country"]).drop("rank")
    top = selected.select(*key).join(leaders, "year_month").withColumn("part", F.lit(1))
    order = [F.col("part"), F.col("net_revenue").desc(), F.col("country")]
    return first_wins(pair.unionByName(top), [*key, "country"], order)


def monthly_change(monthly: DataFrame) -> DataFrame:
    """Change between neighbours of the selected months. The window is over calendar
    months, a few hundred rows at any data size."""
    order = Window.orderBy("year_month")
    value = F.round("net_revenue", 2)
    paired = monthly.select(
        F.lag("year_month").over(order).alias("previous_month"),
        F.col("year_month").alias("current_month"),
        F.lag(value).over(order).alias("p"),
        value.alias("c"),
    ).filter("previous_month IS NOT NULL")
    change = F.col("c") - F.col("p")
    return paired.select(
        "previous_month",
        "current_month",
        F.col("p").cast("double").alias("previous_net_revenue"),
        F.col("c").cast("double").alias("current_net_revenue"),
        change.cast("double").alias("absolute_change"),
        F.round(F.try_divide(change.cast("double"), F.abs("p").cast("double")) * 100, 2).alias("percent_change"),
        F.when(change >= 0, "increase").otherwise("decrease").alias("direction"),
    )


def month_totals(product_month: DataFrame) -> DataFrame:
    return product_month.groupBy("year_month").agg(F.round(F.sum("net_revenue"), 2).alias("den"))


def revenue_share(product_month: DataFrame, n: int, total: DataFrame | None = None) -> DataFrame:
    """Share of the first n products in the month total. With the totals given, the products
    may be the first ones of each month only."""
    top = head_rows(product_month, n, ["stock_code", "description"])
    item = F.struct("rank", "stock_code", "description", money(F.col("net_revenue")).alias("merchandise_net_revenue"))
    numerator = top.groupBy("year_month").agg(
        F.round(F.sum("net_revenue"), 2).alias("num"), F.array_sort(F.collect_list(item)).alias("top_products")
    )
    total = month_totals(product_month) if total is None else total
    share = F.try_divide(F.col("num").cast("double"), F.col("den").cast("double")) * 100
    return numerator.join(total, "year_month").select(
        "year_month",
        month_label(F.col("year_month")).alias("month_label"),
        F.lit(n).cast("bigint").alias("top_n"),
        "top_products",
        F.col("num").cast("double").alias("numerator_merchandise_net_revenue"),
        F.col("den").cast("double").alias("total_merchandise_net_revenue"),
        F.round(share, 2).alias("share_percent"),
    )


def return_impact(monthly: DataFrame) -> DataFrame:
    gross, lost = F.round("gross_positive_revenue", 2), F.abs(F.round("cancellation_revenue", 2))
    return monthly.select(
        "year_month",
        month_label(F.col("year_month")).alias("month_label"),
        gross.cast("double").alias("gross_positive_revenue"),
        money(F.col("cancellation_revenue")).alias("cancellation_revenue"),
        lost.cast("double").alias("reduction_amount"),
        F.round(F.try_divide(lost.cast("double"), gross.cast("double")) * 100, 2).alias("reduction_rate_percent"),
        money(F.col("net_revenue")).alias("net_revenue"),
    )


# ---------------------------------------------------------------- shared records

QUESTION_TYPES = (
    "top_country_month",
    "top_product_month",
    "country_comparison_month",
    "monthly_revenue_change",
    "top3_products_month",
    "product_revenue_share_month",
    "return_impact_month",
)


def as_question(
    gold: DataFrame,
    evidence: DataFrame,
    key: Sequence[str],
    question_type: str,
    order: Sequence[Column],
    difficulty: str,
    question: Column,
    answer: Column,
    facts: Sequence[Column],
    source_file: str,
    filters: Column,
    total: Column | None = None,
) -> DataFrame:
    """The shared nested record of one question type."""
    shown = SHOWN_FIELDS[source_file]

    def evidence_row(e: Column) -> Column:
        return F.struct(*[(e[n] if n in shown else F.when(F.lit(False), e[n])).alias(n) for n in EVIDENCE_FIELDS])

    return gold.join(evidence, list(key)).select(
        F.lit(question_type).alias("question_type"),
        F.lit(QUESTION_TYPES.index(question_type)).alias("type_ord"),
        F.concat_ws("|", *[c.cast("string") for c in order]).alias("ord"),
        F.lit(difficulty).alias("difficulty"),
        question.alias("question"),
        answer.alias("gold_short_answer"),
        F.array(*facts).alias("gold_facts"),
        F.struct(
            F.lit(source_file).alias("source_file"),
            filters.alias("filters"),
            F.transform("evidence", evidence_row).alias("rows"),
            (total if total is not None else F.lit(None).cast("double")).alias("total_merchandise_net_revenue"),
        ).alias("evidence"),
    )


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _filters(**items) -> Column:
    pairs = []
    for name, value in items.items():
        pairs += [F.lit(name), value if isinstance(value, Column) else F.lit(value)]
    return F.create_map(*pairs)


def country_questions(country_month: DataFrame, excluded: Sequence[str]) -> DataFrame:
    gold = top_country(country_month, excluded)
    shown = top_country_evidence(country_month, excluded)
    label, c = F.col("month_label"), F.col
    tail = f", excluding {', '.join(excluded)}?" if excluded else "?"
    return as_question(
        gold, evidence_rows(shown, ["year_month"], c("rank")), ["year_month"], "top_country_month",
        [F.lit(0 if excluded else 1), c("year_month")], "medium" if excluded else "easy",
        _text("Which country had the highest net revenue in ", label, tail),
        _text(c("country"), " had the highest net revenue in ", label, " (", c("scope"), ") at ", currency(c("net_revenue")), "."),
        [month_fact(c("year_month")), text_fact("country", "country", c("country")), currency_fact("net_revenue", c("net_revenue"))],
        "country_month_net_revenue_summary",
        _filters(year_month=c("year_month"), exclude_countries=", ".join(excluded)),
    )


def product_questions(product_month: DataFrame, partial_month: str, partial_note: str) -> DataFrame:
    gold, c = top_product(product_month, partial_month, partial_note), F.col
    shown = head_rows(product_month, EVIDENCE_ROWS, ["stock_code", "description"])
    label = _text(c("month_label"), c("scope_note"))
    return as_question(
        gold, evidence_rows(shown, ["year_month"], c("rank")), ["year_month"], "top_product_month", [c("year_month")], "medium",
        _text("Which product had the highest merchandise net revenue in ", label,
              "? Provide the stock code, product name, and net revenue."),
        _text(c("stock_code"), " (", c("description"), ") had the highest merchandise net revenue in ", label, " at ",
              currency(c("merchandise_net_revenue")), "."),
        [month_fact(c("year_month")), text_fact("stock_code", "product_stock_code", c("stock_code"), "stock code"),
         text_fact("description", "product_name", c("description"), "product name"),
         currency_fact("merchandise_net_revenue", c("merchandise_net_revenue"))],
        "product_month_net_revenue_summary",
        _filters(year_month=c("year_month"), metric="merchandise_net_revenue"),
    )


def comparison_questions(country_month: DataFrame, pairs, floor: float, quota: int | None = None) -> DataFrame:
    c = F.col
    selected = round_robin(country_pairs(country_month, pairs, floor), "year_month", "pair_ord", quota)
    gold = country_comparison(selected)
    place = F.struct(c("part"), -c("net_revenue"), c("country"))
    shown = evidence_rows(comparison_evidence(selected, country_month), ["select_ord"], place)
    return as_question(
        gold, shown, ["select_ord"], "country_comparison_month", [F.lpad(c("select_ord").cast("string"), 9, "0")], "medium",
        _text("In ", c("month_label"), ", did ", c("country_a"), " or ", c("country_b"),
              " generate more net revenue, and by how much?"),
        _text(c("higher_country"), " generated more net revenue than ", c("lower_country"), " by ",
              currency(c("revenue_delta")), " in ", c("month_label"), "."),
        [month_fact(c("year_month")), text_fact("higher_country", "country", c("higher_country"), "higher country"),
         text_fact("lower_country", "country", c("lower_country"), "lower country"),
         currency_fact("country_a_net_revenue", c("country_a_net_revenue"), _text(c("country_a"), " net revenue")),
         currency_fact("country_b_net_revenue", c("country_b_net_revenue"), _text(c("country_b"), " net revenue")),
         currency_fact("revenue_delta", c("revenue_delta"), "difference")],
        "country_month_net_revenue_summary",
        _filters(year_month=c("year_month"), countries=_text(c("country_a"), ", ", c("country_b"))),
    )


def change_questions(monthly: DataFrame) -> DataFrame:
    gold, c = monthly_change(monthly), F.col
    months = gold.select("current_month", F.explode(F.array("previous_month", "current_month")).alias("year_month"))
    shown = evidence_rows(months.join(monthly, "year_month"), ["current_month"], c("year_month"))
    before, now = month_label(c("previous_month")), month_label(c("current_month"))
    return as_question(
        gold, shown, ["current_month"], "monthly_revenue_change", [c("current_month")], "hard",
        _text("How did net revenue change from ", before, " to ", now,
              "? Provide the absolute change and percentage change."),
        _text("Net revenue ", c("direction"), "d by ", currency(F.abs("absolute_change")), " (",
              percent(c("percent_change")), ") from ", before, " to ", now, "."),
        [month_fact(c("previous_month"), "previous_month", "previous month"),
         month_fact(c("current_month"), "current_month", "current month"),
         currency_fact("previous_net_revenue", c("previous_net_revenue")),
         currency_fact("current_net_revenue", c("current_net_revenue")),
         currency_fact("absolute_change", c("absolute_change")), percent_fact("percent_change", c("percent_change")),
         text_fact("direction", "comparison_direction", c("direction"))],
        "monthly_net_revenue_summary",
        _filters(previous_month=c("previous_month"), current_month=c("current_month")),
    )


def listed(ranking: Column) -> Column:
    return F.array_join(
        F.transform(ranking, lambda x: _text(x["rank"].cast("string"), ". ", x["stock_code"], " (", x["description"], "), ",
                                             currency(x["merchandise_net_revenue"]))), "; ")


def top3_questions(product_month: DataFrame, partial_month: str, partial_note: str) -> DataFrame:
    c = F.col
    note = F.when(c("year_month") == partial_month, partial_note).otherwise("")
    gold = ranked_products(product_month, 3).withColumn("label", _text(month_label(c("year_month")), note))
    shown = head_rows(product_month, EVIDENCE_ROWS, ["stock_code", "description"])
    return as_question(
        gold, evidence_rows(shown, ["year_month"], c("rank")), ["year_month"], "top3_products_month", [c("year_month")], "medium",
        _text("What were the top 3 products by merchandise net revenue in ", c("label"),
              "? Give the rank, stock code, product name, and net revenue."),
        _text("Top 3 products in ", c("label"), ": ", listed(c("top_products")), "."),
        [month_fact(c("year_month")), rank_fact("top_products", c("top_products"))],
        "product_month_net_revenue_summary",
        _filters(year_month=c("year_month"), metric="merchandise_net_revenue", top_k="3"),
    )


def share_questions(product_month: DataFrame, n: int, total: DataFrame | None = None) -> DataFrame:
    gold, c = revenue_share(product_month, n, total), F.col
    shown = head_rows(product_month, EVIDENCE_ROWS, ["stock_code", "description"])
    first = c("top_products")[0]
    one = _text("the top product (", first["stock_code"], " - ", first["description"], ")")
    focus = one if n == 1 else F.lit(f"the top {n} products")
    asked = "the top product?" if n == 1 else f"the top {n} products combined?"
    num, den = c("numerator_merchandise_net_revenue"), c("total_merchandise_net_revenue")
    return as_question(
        gold, evidence_rows(shown, ["year_month"], c("rank")), ["year_month"], "product_revenue_share_month",
        [F.lit(f"{n:03d}"), c("year_month")], "hard",
        _text("What percentage of merchandise net revenue in ", c("month_label"), " came from ", asked),
        _text("In ", c("month_label"), ", ", focus, " contributed ", currency(num), " out of ", currency(den), ", or ",
              percent(c("share_percent")), " of merchandise net revenue."),
        [month_fact(c("year_month")), rank_fact("top_products", c("top_products")),
         currency_fact("numerator_merchandise_net_revenue", num, "share numerator"),
         currency_fact("total_merchandise_net_revenue", den, "share denominator"),
         percent_fact("share_percent", c("share_percent"))],
        "product_month_net_revenue_summary",
        _filters(year_month=c("year_month"), metric="merchandise_net_revenue", top_n=str(n)),
        den,
    )


def return_questions(monthly: DataFrame) -> DataFrame:
    gold, c = return_impact(monthly), F.col
    shown = evidence_rows(monthly, ["year_month"], c("year_month"))
    return as_question(
        gold, shown, ["year_month"], "return_impact_month", [c("year_month")], "hard",
        _text("In ", c("month_label"), ", how much did cancellations and returns reduce gross positive revenue, "
              "and what was the final net revenue?"),
        _text("Cancellations and returns reduced gross positive revenue by ", currency(c("reduction_amount")), " (",
              percent(c("reduction_rate_percent")), " of gross), leaving net revenue of ", currency(c("net_revenue")), "."),
        [month_fact(c("year_month")), currency_fact("gross_positive_revenue", c("gross_positive_revenue")),
         currency_fact("cancellation_revenue", c("cancellation_revenue")),
         currency_fact("reduction_amount", c("reduction_amount")),
         percent_fact("reduction_rate_percent", c("reduction_rate_percent")),
         currency_fact("net_revenue", c("net_revenue"))],
        "monthly_net_revenue_summary",
        _filters(year_month=c("year_month")),
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def assign_ids(questions: DataFrame, type_order: str = "type_ord", order: str = "ord") -> DataFrame:
    """Global ordinal ids and a 3:1:1 split by position inside the type.

    The input is stored first: range sampling, sizes and numbering all read it.
    """
    questions = durable(questions)
    numbered = running_totals(questions, [F.col(order)], [type_order], position="position")
    sizes = questions.groupBy(type_order).agg(F.count("*").alias("n"))
    before = Window.orderBy(type_order).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(type_order, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    slot = F.pmod(F.col("position"), F.lit(5))
    return (
        numbered.join(starts, type_order)
        .withColumn("question_no", F.col("start") + F.col("position"))
        .withColumn("question_id", F.format_string("q_%04d", "question_no"))
        .withColumn("split", F.when(slot.isin(1, 2, 3), "train").when(slot == 4, "dev").otherwise("test"))
        .drop("start")
    )


def gold_fact_rows(questions: DataFrame) -> DataFrame:
    """One row per (question, fact)."""
    facts = questions.select("question_id", "question_type", F.posexplode("gold_facts").alias("fact_ord", "fact"))
    return facts.select("question_id", "question_type", F.col("fact_ord").cast("bigint").alias("fact_ord"), "fact.*")


# What every record tells the writer of an answer.
GUIDANCE = {"answer_style": "concise business analysis", "must_use_only_provided_evidence": True, "default_metric": "net_revenue"}
RECORD_SCHEMA = (
    "question_id string, question_type string, difficulty string, split string, question string, gold_short_answer string, gold_answer variant, "
    "evidence struct<source_file: string, filters: variant, rows: array<variant>, metadata: variant>, "
    "generation_guidance struct<answer_style: string, must_use_only_provided_evidence: boolean, default_metric: string>"
)


def nested_records(questions: DataFrame) -> DataFrame:
    """One nested record per question of any type.

    Answers, filters and evidence rows of different types have different fields. Each is an
    object of variant type with the fields that it has, so all types stand in one column. An
    answer's value is a text, a number, or for a ranking an array of objects.
    """
    c = F.col
    value = lambda f: F.when(f["ranking"].isNotNull(), F.to_variant_object(f["ranking"])).when(
        f["num_value"].isNotNull(), f["num_value"].cast("variant")).otherwise(f["str_value"].cast("variant"))
    answer = F.to_variant_object(F.map_from_entries(F.transform("gold_facts", lambda f: F.struct(f["field"].alias("key"), value(f).alias("value")))))

    def row(r: Column) -> Column:
        shaped = [F.when(c("evidence.source_file") == source, F.to_variant_object(F.struct(*[r[n].alias(n) for n in fields]))) for source, fields in SHOWN_FIELDS.items()]
        return F.coalesce(*shaped)

    total = F.to_variant_object(F.struct(c("evidence.total_merchandise_net_revenue").alias("total_merchandise_net_revenue")))
    return questions.select(
        "question_id", "question_type", "difficulty", "split", "question", "gold_short_answer", answer.alias("gold_answer"),
        F.struct(
            c("evidence.source_file").alias("source_file"), F.to_variant_object(c("evidence.filters")).alias("filters"),
            F.transform("evidence.rows", row).alias("rows"),
            F.when(c("evidence.total_merchandise_net_revenue").isNotNull(), total).alias("metadata"),
        ).alias("evidence"),
        F.struct(*[F.lit(v).alias(k) for k, v in GUIDANCE.items()]).alias("generation_guidance"),
    )


def record_json(records: DataFrame) -> DataFrame:
    """(question_id, record): each record as one JSON object."""
    return records.select("question_id", F.to_json(F.struct(*records.columns)).alias("record"))


def parsed_records(lines: DataFrame) -> DataFrame:
    """The records again from their JSON."""
    return lines.select(F.from_json("record", RECORD_SCHEMA).alias("r")).select("r.*")


def answer_fields(records: DataFrame) -> DataFrame:
    """(question_id, question_type, field, kind, text): one row per field of each answer; kind is text, number or ranking."""
    fields = records.select("question_id", "question_type", "gold_answer").lateralJoin(
        records.sparkSession.tvf.variant_explode(F.col("gold_answer").outer()))
    kind = F.schema_of_variant("value")
    items = F.try_variant_get("value", "$", "array<struct<rank:bigint,stock_code:string>>")
    shown = F.array_join(F.transform(items, lambda x: F.concat(x["rank"].cast("string"), F.lit(". "), x["stock_code"])), " > ")
    number = F.try_variant_get("value", "$", "double")
    is_rank, is_text = kind.startswith("ARRAY"), kind == "STRING"
    return fields.select(
        "question_id", "question_type", F.col("key").alias("field"), F.when(is_rank, "ranking").when(is_text, "text").otherwise("number").alias("kind"),
        F.when(is_rank, shown).when(is_text, F.try_variant_get("value", "$", "string")).otherwise(fixed2(number)).alias("text"))


def evidence_cells(questions: DataFrame) -> DataFrame:
    """One row per non-NULL cell of a question's evidence rows."""
    rows = questions.select("question_id", F.posexplode("evidence.rows").alias("row_pos", "r"))
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("col_pos"), F.lit(n).alias("key"),
                     (F.when(F.col("r")[n].isNotNull(), fixed2(F.col("r")[n])) if n.endswith("revenue")
                      else F.col("r")[n].cast("string")).alias("str_value"),
                     F.col("r")[n].try_cast("double").alias("num_value"))
            for i, n in enumerate(EVIDENCE_FIELDS)
        ]
    )
    return (
        rows.select("question_id", (F.col("row_pos") + 1).cast("bigint").alias("row_pos"), F.explode(cells).alias("c"))
        .select("question_id", "row_pos", "c.*")
        .filter("str_value IS NOT NULL")
    )


def preview(questions: DataFrame, width: int | None = 600) -> DataFrame:
    """Flat sample columns; text cut at the width if there is one, line breaks turned to spaces."""

    def flat(c: str) -> Column:
        return F.regexp_replace(F.col(c) if width is None else F.substring(c, 1, width), "\n", " ").alias(c)

    return questions.select(
        "question_id", "split", "question_type", "difficulty",
        flat("question"), flat("gold_short_answer"),
        F.col("evidence.source_file").alias("evidence_source"),
    )
