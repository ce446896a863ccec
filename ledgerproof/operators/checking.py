"""Checking generated answers against facts, lists and evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerproof.functions.numbers import (
    extract_numbers, has_broken_grouping, magnitude_match, parse_amount, ratio, rounded, tolerance_limit, within,
)
from ledgerproof.functions.tables import (
    HEADERS, code_key, compact_codes, compact_rows, is_header, is_separator, is_table_line, name_key, parse_table,
    row_cells, whole_number,
)
from ledgerproof.functions.text import LINE_BREAK, claim_line, collapse_space, match_key, month_label, strip
from ledgerproof.operators.ordering import running_offsets

AMOUNT_TOLERANCE = 0.01
EVIDENCE_TOLERANCE = 0.02
SHORTEST_REVERSE_MATCH = 4
TEXT_FACTS = ("country", "product_stock_code", "product_name", "month", "comparison_direction")
NUMBER_FACTS = ("currency_amount", "percentage")


# --------------------------------------------------------------- fact matching


def ranking_in_order(items: Column, norm: Column) -> Column:
    """Each item's code or name is present and first places never go back."""
    def place(x: Column) -> Column:
        code, name = F.instr(norm, match_key(x["stock_code"])), F.instr(norm, match_key(x["description"]))
        return F.when((code > 0) & (name > 0), F.least(code, name)).otherwise(F.greatest(code, name))

    places = F.transform(items, place)
    return F.forall(places, lambda p: p > 0) & (places == F.array_sort(places))


def text_fact_found(fact_type: Column, value: Column, norm: Column) -> Column:
    plain = F.contains(norm, match_key(value))
    label = F.contains(norm, match_key(month_label(value)))
    return F.when(fact_type == "month", plain | label).otherwise(plain)


def match_facts(facts: DataFrame, answers: DataFrame) -> DataFrame:
    """Every fact with whether the answer of its question states it."""
    prepared = answers.select(
        "question_id", "generated_text", match_key(F.col("generated_text")).alias("_norm"),
        extract_numbers(F.col("generated_text")).alias("_numbers"),
    )
    c = F.col
    limit = tolerance_limit(c("num_value"), c("absolute"), c("relative_percent"), c("percentage_points"))
    found = (
        F.when(c("fact_type").isin(*NUMBER_FACTS), magnitude_match(c("_numbers"), c("num_value"), limit))
        .when(c("fact_type") == "ranking", ranking_in_order(c("ranking"), c("_norm")))
        .when(c("fact_type").isin(*TEXT_FACTS), text_fact_found(c("fact_type"), c("str_value"), c("_norm")))
        .otherwise(False)
    )
    return facts.join(prepared, "question_id").withColumn("matched", F.coalesce(found, F.lit(False))).drop("_norm", "_numbers")


def error_type_of(fact_type: Column) -> Column:
    return (
        F.when(fact_type.isin("country", "product_stock_code", "product_name"), "entity_or_product_mismatch")
        .when(fact_type.isin(*NUMBER_FACTS), "numeric_mismatch")
        .when(fact_type == "ranking", "ranking_mismatch")
        .when(fact_type == "comparison_direction", "direction_mismatch")
        .when(fact_type == "month", "time_period_mismatch")
        .otherwise("other_fact_mismatch")
    )


# Phrases that state which side is ahead.
AHEAD = (" generated more", " had more", " generated higher", " more net revenue")


def direction_stated(higher: Column, lower: Column, text: Column) -> Column:
    """True when the higher side is said to lead; the wrong phrase wins."""
    norm = match_key(text)

    def said(who: Column) -> Column:
        out = F.lit(False)
        for phrase in AHEAD:
            out = out | F.contains(norm, F.concat(match_key(who), F.lit(phrase)))
        return out

    return F.when(said(lower), False).otherwise(said(higher))


def review_answers(questions: DataFrame, facts: DataFrame, answers: DataFrame) -> DataFrame:
    """Matched and missing facts, error types and an automatic status per question."""
    matched = match_facts(facts, answers).select(
        "question_id", "fact_ord", "fact_type", "field", "str_value", "display_name", "matched")
    sides = matched.groupBy("question_id").agg(
        F.max(F.when(F.col("field") == "higher_country", F.col("str_value"))).alias("higher"),
        F.max(F.when(F.col("field") == "lower_country", F.col("str_value"))).alias("lower"),
        F.array_sort(F.collect_list(F.struct("fact_ord", "display_name", "fact_type", "matched"))).alias("facts"),
    )
    base = questions.select("question_id", "split", "question_type", "difficulty", "question", "gold_short_answer").join(
        answers.select("question_id", "generated_text"), "question_id").join(sides, "question_id")
    compares = F.col("question_type") == "country_comparison_month"
    extra = F.struct(
        F.lit(1 << 30).cast("bigint").alias("fact_ord"), F.lit("comparison direction").alias("display_name"),
        F.lit("comparison_direction").alias("fact_type"),
        direction_stated(F.col("higher"), F.col("lower"), F.col("generated_text")).alias("matched"))
    every = F.when(compares, F.concat("facts", F.array(extra))).otherwise(F.col("facts"))
    broken = has_broken_grouping(F.col("generated_text"))
    names = lambda c: F.transform(c, lambda x: x["display_name"])
    out = base.withColumn("facts", every).withColumns(
        {
            "_hit": F.filter("facts", lambda x: x["matched"]),
            "_miss": F.filter("facts", lambda x: ~x["matched"]),
        }
    )
    kinds = F.concat(
        F.transform("_miss", lambda x: error_type_of(x["fact_type"])),
        F.when(broken, F.array(F.lit("malformed_number_format"))).otherwise(F.array().cast("array<string>")))
    hit, total = F.size("_hit"), F.size("facts")
    status = (
        F.when((hit == total) & ~broken, "likely_correct").when(hit == 0, "likely_wrong").otherwise("partially_correct"))
    return out.withColumns(
        {
            "auto_status": status,
            "matched_key_fact_count": hit.cast("bigint"),
            "total_key_fact_count": total.cast("bigint"),
            "matched_fields": names("_hit"),
            "missing_fields": names("_miss"),
            "error_types": F.array_sort(F.array_distinct(kinds)),
        }
    ).drop("_hit", "_miss", "facts", "higher", "lower")


# ---------------------------------------------------------------- ranked lists


def parsed_tables(answers: DataFrame) -> DataFrame:
    return answers.withColumn("table", parse_table(F.col("generated_text")))


def paired_positions(generated: Column, gold: Column) -> Column:
    """Positions present in both arrays, as pairs; stops at the shorter one."""
    n = F.least(F.size(generated), F.size(gold))
    return F.zip_with(F.slice(generated, F.lit(1), n), F.slice(gold, F.lit(1), n), lambda g, r: F.struct(g.alias("g"), r.alias("r")))


def _count(array: Column, condition) -> Column:
    return F.size(F.filter(array, condition)).cast("bigint")


def evaluate_lists(answers: DataFrame) -> DataFrame:
    """Ranked-list checks per answer. `answers` holds generated_text, gold_rows
    (rank, stock_code, description, merchandise_net_revenue) and evidence_rows
    (stock_code, net_revenue); every array belongs to one question and is short."""
    c = F.col
    got, gold, shown = c("table.rows"), c("gold_rows"), c("evidence_rows")
    parsed = parsed_tables(answers).withColumns(
        {
            "got": F.transform(got, lambda r: r["stock_code"]),
            "want": F.transform(gold, lambda r: code_key(r["stock_code"])),
            "seen": F.transform(shown, lambda r: code_key(r["stock_code"])),
        }
    )
    rows, pairs = c("table.rows"), paired_positions(c("table.rows"), c("gold_rows"))
    # A code listed twice in the evidence counts with its last row.
    amount_of = lambda code: F.try_element_at(F.filter(shown, lambda e: code_key(e["stock_code"]) == code), F.lit(-1))["net_revenue"]
    last_place = lambda code: F.size("seen") + 1 - F.array_position(F.reverse("seen"), code)
    amounts = F.filter(F.transform(rows, lambda r: r["net_revenue_gbp"]), lambda x: x.isNotNull())
    places = F.transform(F.filter("got", lambda g: F.array_contains("seen", g)), last_place)
    same = F.transform(paired_positions(c("got"), c("seen")), lambda p: p["g"] == p["r"])
    first_miss = F.array_position(same, F.lit(False))
    falling = F.forall(
        F.zip_with(F.slice(amounts, F.lit(1), F.greatest(F.size(amounts) - 1, F.lit(0))),
                   F.slice(amounts, F.lit(2), F.greatest(F.size(amounts) - 1, F.lit(0))),
                   lambda a, b: a >= b - AMOUNT_TOLERANCE), lambda x: x)
    n = F.size(rows)
    return parsed.withColumns(
        {
            "header_valid": c("table.headers") == F.array(*[F.lit(h) for h in HEADERS]),
            "row_count": n.cast("bigint"),
            "rank_sequence_valid": F.coalesce(
                F.transform(rows, lambda r: r["rank"]).eqNullSafe(F.array(*[F.lit(i).cast("bigint") for i in (1, 2, 3)])), F.lit(False)),
            "exact_order_match": c("got") == c("want"),
            "set_match": (F.array_sort(F.array_distinct("got")) == F.array_sort(F.array_distinct("want"))) & (F.size("got") == F.size("want")),
            "correct_rank_count": _count(paired_positions(c("got"), c("want")), lambda p: p["g"] == p["r"]),
            "gold_presence_count": _count(c("got"), lambda g: F.array_contains("want", g)),
            "evidence_membership_count": _count(c("got"), lambda g: F.array_contains("seen", g)),
            "copied_evidence_amount_count": _count(rows, lambda r: within(r["net_revenue_gbp"], amount_of(r["stock_code"]), AMOUNT_TOLERANCE)),
            "correct_rank_amount_count": _count(
                pairs, lambda p: (p["g"]["stock_code"] == code_key(p["r"]["stock_code"]))
                & within(p["g"]["net_revenue_gbp"], p["r"]["merchandise_net_revenue"], AMOUNT_TOLERANCE)),
            "is_sorted_by_generated_amount_desc": (F.size(amounts) == n) & (n >= 2) & falling,
            "evidence_prefix_match_count": F.when(first_miss == 0, F.size(same)).otherwise(first_miss - 1).cast("bigint"),
            "mean_generated_evidence_position": F.round(
                F.try_divide(F.aggregate(places, F.lit(0.0), lambda a, x: a + x), F.size(places).cast("double")), 3),
            "generated_stock_codes": compact_codes(c("got")),
            "gold_stock_codes": compact_codes(c("want")),
            "generated_table_compact": compact_rows(rows, "net_revenue_gbp"),
            "gold_table_compact": compact_rows(gold, "merchandise_net_revenue"),
            "parse_issues": F.array_join("table.issues", "; "),
        }
    ).withColumns(
        {
            "format_valid": c("header_valid") & (c("row_count") == 3) & c("rank_sequence_valid") & (F.size("table.issues") == 0),
            "all_generated_from_evidence": (c("evidence_membership_count") == c("row_count")) & (c("row_count") > 0),
        }
    )


LIST_FLAGS = ("format_valid", "exact_order_match", "set_match", "all_generated_from_evidence", "is_sorted_by_generated_amount_desc")
LIST_COUNTS = ("row_count", "correct_rank_count", "gold_presence_count", "evidence_membership_count",
               "copied_evidence_amount_count", "correct_rank_amount_count", "evidence_prefix_match_count")


def list_totals(evaluated: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return evaluated.groupBy(*group).agg(
        F.count("*").alias("record_count"),
        (F.count("*") * 3).alias("total_gold_rank_rows"),
        *[F.count_if(f).alias(f"{f}_rows") for f in LIST_FLAGS],
        *[F.sum(n).alias(f"{n}_total") for n in LIST_COUNTS],
    )


def condition_rates(evaluated: DataFrame) -> DataFrame:
    """One row per prompt condition with its rates."""
    c, totals = F.col, list_totals(evaluated, ["condition"])
    return totals.withColumns(
        {
            "exact_order_rate": rounded(ratio(c("exact_order_match_rows"), c("record_count"))),
            "correct_rank_rate": rounded(ratio(c("correct_rank_count_total"), c("total_gold_rank_rows"))),
            "evidence_membership_rate": rounded(ratio(c("evidence_membership_count_total"), c("row_count_total"))),
        }
    )


def compare_conditions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two runs on the same ids: per-question gain; an id may miss on one side."""
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select("question_id", F.col("exact_order_match").alias(f"{p}_exact"), F.col("correct_rank_count").alias(f"{p}_ranks"))

    return side(left, "left").join(side(right, "right"), "question_id", "full").withColumn(
        "rank_gain", F.coalesce("right_ranks", F.lit(0)) - F.coalesce("left_ranks", F.lit(0)))


def omitted_members(answers: DataFrame) -> DataFrame:
    """Gold rows whose code the answer does not list."""
    parsed = parsed_tables(answers)
    gold = parsed.select("question_id", F.explode("gold_rows").alias("g")).select(
        "question_id", F.col("g.rank").alias("expected_rank"), code_key(F.col("g.stock_code")).alias("stock_code"))
    listed = parsed.select("question_id", F.explode("table.rows").alias("r")).select("question_id", F.col("r.stock_code").alias("stock_code"))
    return gold.join(listed, ["question_id", "stock_code"], "left_anti")


# ------------------------------------------------------------- cells with offsets

_BREAK_CHARS = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
LINE_WITH_BREAK = rf"[^{_BREAK_CHARS}]*(?:\r\n|[{_BREAK_CHARS}])|[^{_BREAK_CHARS}]+"


def table_lines(answers: DataFrame) -> DataFrame:
    """(question_id, line_pos, line, line_start): every line with its offset."""
    pieces = answers.select(
        "question_id", F.posexplode(F.regexp_extract_all("generated_text", F.lit(f"({LINE_WITH_BREAK})"), F.lit(1))).alias("line_pos", "raw"))
    sized = pieces.withColumn("_w", F.length("raw"))
    placed = running_offsets(sized, ["question_id"], "line_pos", "_w", "line_start")
    return placed.withColumn("line", F.regexp_replace("raw", f"({LINE_BREAK})$", "")).drop("_w", "raw")


def table_cells(answers: DataFrame) -> DataFrame:
    """One row per data line of a table with the offsets of every cell; a line with
    another number of pipes has `issue` set and no cells."""
    lines = table_lines(answers).filter(is_table_line(F.col("line"))).withColumn("cells", row_cells(F.col("line")))
    data = lines.filter(~is_header(F.col("cells")) & ~is_separator(F.col("cells")))
    line, c = F.col("line"), F.col
    pipes = F.filter(F.sequence(F.lit(0), F.length(line) - 1), lambda i: F.substring(line, i + 1, F.lit(1)) == "|")
    counted = data.withColumn("pipes", pipes).withColumn("fits", F.size("pipes") == len(HEADERS) + 1)
    numbered = running_offsets(counted.filter("fits").withColumn("_one", F.lit(1)), ["question_id"], "line_pos", "_one", "_before")

    def span(low: Column, high: Column) -> Column:
        raw = F.substring(line, low + 1, high - low)
        lead = F.length(raw) - F.length(F.regexp_replace(raw, r"^\s+", ""))
        body = strip(raw)
        return F.struct(
            body.alias("text"),
            (c("line_start") + low + lead).cast("bigint").alias("start"),
            (c("line_start") + low + lead + F.length(body)).cast("bigint").alias("end"),
        )

    at = lambda i: F.get("pipes", F.lit(i))
    spans = {h: span(at(i) + 1, at(i + 1)) for i, h in enumerate(HEADERS)}
    good = numbered.select(
        "question_id", "line_pos", (c("_before") + 1).cast("bigint").alias("table_row_index"),
        span(at(0) + 1, at(len(HEADERS))).alias("row_full"), *[s.alias(h) for h, s in spans.items()],
        F.lit(None).cast("string").alias("issue"))
    bad = counted.filter("NOT fits").select(
        "question_id", "line_pos", F.lit("unexpected markdown pipe count").alias("issue"))
    rows = good.unionByName(bad, allowMissingColumns=True)
    return rows.withColumnsRenamed({"rank": "rank_cell", "line_pos": "line_no"}).withColumn(
        "rank", F.coalesce(whole_number(c("rank_cell.text")), c("table_row_index")))


SPAN_FACTS = {"row_full": "ranking_row", "stock_code": "product_stock_code", "product_name": "product_name", "net_revenue_gbp": "currency_amount"}


def signal_spans(cells: DataFrame, gold: DataFrame) -> DataFrame:
    """Four spans per table row, labelled by the gold row at that rank. A row is
    correct only if code, name and amount all match."""
    c = F.col
    want = gold.select(
        "question_id", c("rank").alias("rank"), code_key(c("stock_code")).alias("want_code"),
        name_key(c("description")).alias("want_name"), c("merchandise_net_revenue").alias("want_amount"))
    rows = cells.filter("issue IS NULL").withColumn("got_code", code_key(c("stock_code.text")))
    joined = rows.join(want, ["question_id", "rank"], "left")
    right = (
        (c("got_code") == c("want_code")) & (name_key(c("product_name.text")) == c("want_name"))
        & within(parse_amount(c("net_revenue_gbp.text")), c("want_amount"), AMOUNT_TOLERANCE))
    spans = F.array(*[
        F.struct(F.lit(s).alias("span_scope"), F.lit(f).alias("fact_type"), c(s)["text"].alias("span_text"),
                 c(s)["start"].alias("span_start_char"), c(s)["end"].alias("span_end_char"))
        for s, f in SPAN_FACTS.items()])
    return joined.withColumn("y", F.when(F.coalesce(right, F.lit(False)), 0).otherwise(1)).select(
        "question_id", "table_row_index", "rank", "y", F.when(c("y") == 0, "correct").otherwise("incorrect_rank_binding").alias("label"),
        F.when(c("want_code").isNull(), "rank outside gold top3").when(c("got_code") == c("want_code"), "rank-bound row matches gold")
        .otherwise(F.concat(F.lit("should be "), c("want_code"), F.lit(", generated "), c("got_code"))).alias("reason"),
        F.inline(spans))


def flag_rates(signals: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Flag rates by label, by scope and by both, in one grouping-sets pass."""
    counts = signals.groupingSets([["label"], ["span_scope"], ["label", "span_scope"]], "label", "span_scope").agg(
        F.count("*").alias("span_count"), *[F.count_if(f).alias(f"flagged_{f}") for f in flags])
    return counts.select(
        F.coalesce("label", F.lit("all")).alias("label"), F.coalesce("span_scope", F.lit("all")).alias("span_scope"), "span_count",
        *[F.col(f"flagged_{f}") for f in flags],
        *[rounded(ratio(F.col(f"flagged_{f}"), F.col("span_count"))).alias(f"rate_{f}") for f in flags])


# ------------------------------------------------------------------- evidence


def evidence_matches(spans: DataFrame, cells: DataFrame, span_key: Sequence[str]) -> DataFrame:
    """(span key, matches): evidence rows whose cells contain the span, are contained in
    it, or carry the same number. Pairs stay inside one question's short evidence."""
    c = F.col
    prepared = spans.select(*span_key, "question_id", "fact_type", collapse_space(F.lower("span_text")).alias("s"),
                            parse_amount(c("span_text")).alias("sn"))
    table = cells.select("question_id", "row_pos", "key", collapse_space(F.lower("str_value")).alias("v"),
                         parse_amount(c("str_value")).alias("vn"), "row_label")
    contains = (F.length("s") > 0) & F.contains("v", "s")
    reverse = (F.length("v") >= SHORTEST_REVERSE_MATCH) & F.contains("s", "v")
    number = (c("fact_type") != "ranking") & (F.abs(c("sn") - c("vn")) <= EVIDENCE_TOLERANCE)
    hits = prepared.join(table, "question_id").filter(contains | reverse | F.coalesce(number, F.lit(False)))
    per_row = hits.groupBy(*span_key, "row_pos", "row_label").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys"))
    shown = F.concat(F.lit("row_"), c("row_pos").cast("string"), F.lit(":"), c("row_label"), F.lit(":"), c("keys"))
    return per_row.groupBy(*span_key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_pos", shown.alias("t")))), lambda x: x["t"]).alias("matches"))


def verdict(label: Column) -> Column:
    return (
        F.when(label == "correct_key_fact", "supported").when(label == "hallucinated_key_fact", "contradicted")
        .when(label == "unsupported_claim", "unmatched").otherwise("needs_review"))


# The reason texts of each verdict.
REASONS = {
    "supported": "Supported by the locked presentation review and consistent with the gold answer or prompt evidence for this business-fact span.",
    "contradicted_ranking": "Contradicted in context: ranking markers are checked with the generated product or amount binding, not as standalone numbers.",
    "contradicted": "Contradicted in context: the generated claim is not supported by the gold answer for the product, rank, amount, or conclusion binding.",
    "unmatched": "No matching support was found in the public demo gold/evidence fields.",
    "needs_review": "The pilot rules are insufficient for this span, so it remains review-only.",
}


def verdict_reason(verdict_: Column, fact_type: Column) -> Column:
    out = F.when((verdict_ == "contradicted") & (fact_type == "ranking"), REASONS["contradicted_ranking"])
    for name in ("supported", "contradicted", "unmatched"):
        out = out.when(verdict_ == name, REASONS[name])
    return out.otherwise(REASONS["needs_review"])


def verdict_rows(spans: DataFrame, cells: DataFrame, span_key: Sequence[str]) -> DataFrame:
    """Verdict from the stored label; evidence matches stand beside it, not behind it."""
    c = F.col
    matched = evidence_matches(spans, cells, span_key)
    made = spans.join(matched, list(span_key), "left")
    return made.withColumns(
        {
            "verdict": verdict(c("label")),
            "claim_text": claim_line(c("generated_text"), c("span_text"), c("span_start_char"), c("span_end_char")),
            "gold_contains_span": F.contains(collapse_space(F.lower("gold_short_answer")), collapse_space(F.lower("span_text"))),
            "matches": F.coalesce("matches", F.array().cast("array<string>")),
        }
    ).withColumn("verdict_reason", verdict_reason(c("verdict"), c("fact_type")))
