"""Review tables, queues, span annotations from specs, packets, locks and label audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerproof.functions.numbers import exact_mean, ratio
from ledgerproof.functions.text import excerpt, nth_occurrence
from ledgerproof.operators.detectors import EXCLUDED, NEGATIVE, POSITIVE
from ledgerproof.operators.ordering import running_totals, top_n
from ledgerproof.operators.quality import one_row

LABELS = ("correct_key_fact", "hallucinated_key_fact", "unsupported_claim", "ambiguous_or_unverifiable", "ignore")
HELD_OUT = ("dev", "test")


# -------------------------------------------------------------------- selection


def select_by_ids(df: DataFrame, ids: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Rows named by an id list (key, pos): list order and repeats are kept in `pos`."""
    if limit is not None:
        ids = ids.orderBy("pos").limit(limit)
    return ids.join(df, key)


def missing_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Listed ids the table lacks; a job that needs all of them gates on this."""
    return ids.join(df.select(key), key, "left_anti")


def sequential_ids(df: DataFrame, order_by: Sequence[Column], pattern: str, name: str) -> DataFrame:
    numbered = running_totals(df, order_by, position="_no")
    return numbered.withColumn(name, F.format_string(pattern, "_no")).drop("_no")


def key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(relation, n): sizes of both sets, union, intersection and differences, and
    whether left is a subset of, or equal to, right. One full join of distinct keys."""
    a = left.select(key).distinct().withColumn("_a", F.lit(True))
    b = right.select(key).distinct().withColumn("_b", F.lit(True))
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    wide = a.join(b, key, "full").agg(
        F.count_if(in_a).alias("left"), F.count_if(in_b).alias("right"), F.count("*").alias("union"),
        F.count_if(in_a & in_b).alias("intersection"), F.count_if(in_a & ~in_b).alias("left_only"),
        F.count_if(in_b & ~in_a).alias("right_only"))
    both = wide.withColumns(
        {
            "left_is_subset": (F.col("left_only") == 0).cast("bigint"),
            "equal": ((F.col("left_only") == 0) & (F.col("right_only") == 0)).cast("bigint"),
        })
    return both.unpivot([], both.columns, "relation", "n")


# ----------------------------------------------------------------- review, queue


def annotation_priority(token_limit: int = 160) -> Column:
    held, likely = F.col("split").isin(*HELD_OUT), F.col("auto_status") == "likely_correct"
    long_or_broken = F.array_contains("error_types", "malformed_number_format") | (F.col("generated_token_count") >= token_limit)
    return F.when((held & ~likely) | long_or_broken, "high").when(held | ~likely, "medium").otherwise("low")


def annotation_focus(token_limit: int = 160, shown: int = 6) -> Column:
    missing, kinds = F.col("missing_fields"), F.col("error_types")
    listed = lambda c: F.array_join(F.slice(c, 1, shown), ", ")
    parts = F.concat_ws(
        " | ",
        F.when(F.size(missing) > 0, F.concat(F.lit("check fields: "), listed(missing))),
        F.when(F.size(kinds) > 0, F.concat(F.lit("error types: "), listed(kinds))),
        F.when(F.col("generated_token_count") >= token_limit, "answer hit max_new_tokens; inspect truncation"),
    )
    clean = (F.size(missing) == 0) & (F.size(kinds) == 0)
    return F.when(clean, "confirm correct key facts and unsupported extra claims").otherwise(parts)


def review_table(reviewed: DataFrame, prompts: DataFrame, token_limit: int = 160) -> DataFrame:
    """Reviewed answers with their prompt, priority, focus and batch."""
    joined = reviewed.join(prompts.select("question_id", "prompt_id", "row_order_policy"), "question_id")
    return joined.withColumns(
        {
            "annotation_priority": annotation_priority(token_limit),
            "suggested_annotation_focus": annotation_focus(token_limit),
            "annotation_batch": F.when(F.col("split").isin(*HELD_OUT), "heldout_annotation").otherwise("train_annotation"),
        })


def queue_phase() -> Column:
    held, high = F.col("split").isin(*HELD_OUT), F.col("annotation_priority") == "high"
    return (
        F.when(held & high, "phase_1_heldout_high").when(held, "phase_2_heldout_remaining")
        .when(high, "phase_3_train_high").otherwise("phase_4_train_remaining"))


def annotation_queue(review: DataFrame) -> DataFrame:
    """Contiguous ranks by phase and numeric id, the first batch and a record template."""
    number = F.split("question_id", "_")[1].cast("bigint")
    phased = review.withColumns({"queue_phase": queue_phase(), "_number": number})
    ranked = running_totals(phased, [F.col("queue_phase"), F.col("_number")], position="queue_rank").drop("_number")
    template = F.to_json(
        F.struct(
            F.concat(F.lit("ann_"), "question_id", F.lit("_001")).alias("annotation_id"), F.lit("").alias("confidence"),
            F.lit("").alias("fact_type"), F.lit("").alias("label"), F.lit("").alias("notes"), "prompt_id", "question_id",
            F.lit("").alias("reason"), F.lit(None).cast("int").alias("span_end_char"), F.lit(None).cast("int").alias("span_start_char"),
            F.lit("").alias("span_text")),
        {"ignoreNullFields": "false"})
    return ranked.withColumns(
        {"is_initial_batch": F.col("queue_phase") == "phase_1_heldout_high", "annotation_record_template_json": template})


def column_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, n) for several columns in one pass."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot([], list(columns), "column_name", "value").groupBy("column_name", "value").agg(F.count("*").alias("n"))


def run_summary(runs: DataFrame, group: Sequence[str]) -> DataFrame:
    return runs.groupBy(*group).agg(
        F.count("*").alias("record_count"), F.sum("generated_token_count").alias("total_generated_tokens"),
        exact_mean(F.col("elapsed_seconds"), 3).alias("avg_elapsed_seconds"))


# ------------------------------------------------------------------- annotations


def first_fact(facts: Column, field: Column) -> Column:
    """The first fact of that field in a nested list; NULL when none."""
    return F.get(F.filter(facts, lambda x: x["field"] == field), F.lit(0))


def annotations_from_specs(specs: DataFrame, answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Span rows from (question_id, spec_ord, span_text, occurrence, gold_field, fact_type,
    label, reason_template, notes). A phrase or field that is not found sets `failure`."""
    numbered = running_totals(specs, [F.col("spec_ord")], ["question_id"], position="_no")
    joined = numbered.join(answers.select("question_id", "generated_text"), "question_id", "left").join(
        questions.select("question_id", "gold_facts"), "question_id", "left")
    start = nth_occurrence(F.col("generated_text"), F.col("span_text"), F.col("occurrence"))
    found = joined.withColumns({"_start": start, "_fact": first_fact(F.col("gold_facts"), F.col("gold_field"))})
    display = F.col("_fact.display_value")
    return found.select(
        F.concat_ws("_", F.lit("ann"), "question_id", F.lpad(F.col("_no").cast("string"), 3, "0")).alias("annotation_id"),
        "question_id", "span_text", F.col("_start").cast("bigint").alias("span_start_char"),
        (F.col("_start") + F.length("span_text")).cast("bigint").alias("span_end_char"), "fact_type", "label",
        display.alias("gold_display_value"),
        F.replace("reason_template", F.lit("{gold_display}"), F.coalesce(display, F.lit(""))).alias("reason"), "notes",
        F.when(F.col("generated_text").isNull(), "missing generation").when(F.col("_start").isNull(), "phrase not found")
        .when(F.col("_fact").isNull(), "no gold fact field").alias("failure"))


def source_batch(id_prefix: str, rounds: Sequence[str], default: str) -> Column:
    out = F.when(F.col("annotation_id").startswith(id_prefix), "seed")
    for name in rounds:
        out = out.when(F.contains("notes", F.lit(name)), name)
    return out.otherwise(default)


# --------------------------------------------------------------- packets and locks


def confirmation_packet(examples: DataFrame, regression_ids: DataFrame, spans: DataFrame) -> DataFrame:
    """Union of example and regression spans with roles, tags and checklist length.
    Roles per span are at most detectors x error types."""
    role = F.struct("baseline", "error_type", "example_rank")
    roles = examples.groupBy("row_id").agg(F.array_sort(F.collect_list(role)).alias("detector_roles"))
    ids = examples.select("row_id").union(regression_ids.select("row_id")).distinct()
    marked = regression_ids.select("row_id").distinct().withColumn("is_offset_regression", F.lit(True))
    joined = ids.join(spans, "row_id").join(roles, "row_id", "left").join(marked, "row_id", "left").withColumns(
        {
            "is_offset_regression": F.coalesce("is_offset_regression", F.lit(False)),
            "has_error_example": F.col("detector_roles").isNotNull(),
        })
    tags = F.filter(
        F.array(
            F.when(F.col("has_error_example"), "detector_error_example"),
            F.when(F.col("is_offset_regression"), "offset_regression_check"),
            F.when(F.col("question_type") == "top3_products_month", "top3_confident_miss_pattern"),
            F.when(F.col("fact_type") == "currency_amount", "currency_amount_pattern")),
        lambda x: x.isNotNull())
    items = F.lit(4) + F.col("has_error_example").cast("int") + F.col("is_offset_regression").cast("int")
    tagged = joined.withColumns({"focus_tags": tags, "checklist_items": items.cast("bigint")})
    return sequential_ids(tagged, [F.col("row_id")], "confirm_%03d", "confirmation_item_id")


def packet_excerpt(text: Column, start: Column, end: Column) -> Column:
    return excerpt(text, start, end, 130, squeeze=False)


def detector_role_text(roles: Column, none: str = "No detector-error row; offset check only.") -> Column:
    shown = F.transform(roles, lambda r: F.concat_ws(" ", r["error_type"], F.lit("via"), r["baseline"]))
    return F.when(F.coalesce(F.size(roles), F.lit(0)) > 0, F.array_join(shown, "; ")).otherwise(none)


def coverage_gaps(packet: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """Packet items without a note and notes without an item."""
    lost = packet.select(key).join(notes.select(key), key, "left_anti").withColumn("gap", F.lit("missing_note"))
    extra = notes.select(key).join(packet.select(key), key, "left_anti").withColumn("gap", F.lit("extra_note"))
    return lost.unionByName(extra)


# What a reviewed example is used for, and the reason given.
PUBLISH_USE = {
    "paired_contrast_example": "primary_demo",
    "strong_false_negative_example": "primary_demo",
    "span_level_caveat": "caveat_demo",
    "offset_check_only": "qa_regression_only",
}
LOCK_REASON = {
    "paired_contrast_example": "Locked as a primary paired example because it contains nearby supported and hallucinated spans.",
    "strong_false_negative_example": "Locked as a primary miss example because detectors missed a clear hallucinated business fact.",
    "span_level_caveat": "Locked for caveat use only because the selected span is supported but the surrounding answer has other errors.",
    "offset_check_only": "Locked as a QA regression example for rank-marker offset correctness.",
}


def _mapped(c: Column, table: Mapping[str, str], default: str) -> Column:
    out = F.when(F.lit(False), "")
    for key, value in table.items():
        out = out.when(c == key, value)
    return out.otherwise(default)


def unresolved(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("source_action") != "none") | (F.col("label_verdict") != "label_supported"))


def lock_decisions(rows: DataFrame) -> DataFrame:
    """Locks every row; one unresolved row, or one without a note, stops the job."""
    settled = (F.col("source_action") == "none") & (F.col("label_verdict") == "label_supported") & F.col("presentation_use").isNotNull()
    open_ = ~F.coalesce(settled, F.lit(False))
    stop = F.raise_error(F.concat(F.lit("cannot lock unresolved row "), F.col("confirmation_item_id"))).cast("boolean")
    use = F.col("presentation_use")
    return rows.withColumns(
        {
            "labels_locked": F.when(open_, stop).otherwise(F.lit(True)),
            "publish_use": _mapped(use, PUBLISH_USE, "supporting_detail"),
            "lock_reason": _mapped(use, LOCK_REASON, "Locked after assistant full review."),
            "span_level_caveat": use == "span_level_caveat",
        })


def decision_mismatches(decisions: DataFrame, annotations: DataFrame) -> DataFrame:
    """(decision_id, annotation_id, expected_label, actual_label) that disagree; a missing
    annotation has a NULL actual label."""
    named = decisions.select("decision_id", "expected_label", F.explode("annotation_ids").alias("annotation_id"))
    joined = named.join(annotations.select("annotation_id", F.col("label").alias("actual_label")), "annotation_id", "left")
    return joined.filter(~F.col("actual_label").eqNullSafe(F.col("expected_label")))


# ------------------------------------------------------------------------ audits

# The names of the audit and coverage rules below, and a span that is only a list marker.
BARE_RANK = r"(?i)^\*{0,2}\d+(?:st|nd|rd|th)?[.)]?\*{0,2}$"


def policy_flags(annotations: DataFrame, questions: DataFrame, source: str | None = None, splits: Sequence[str] = ()) -> DataFrame:
    """(question_id, annotation_id, severity, rule): one filter per rule, all rules of one
    level in one pass over their table.

    `source` is a part of the path that each annotation's source_file, carried from its scan,
    must have. Each of `splits` must have a span of a positive label; a split without one, also
    one that no question is in, is named in question_id.
    """
    c = F.col

    def flags(df: DataFrame, rules: Sequence[tuple[str, str, Column]], annotation: Column) -> DataFrame:
        hits = F.filter(
            F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, cond in rules]),
            lambda x: x.isNotNull())
        return df.select("question_id", annotation.alias("annotation_id"), F.explode(hits).alias("f")).select(
            "question_id", "annotation_id", "f.severity", "f.rule")

    same_kind = (c("reference_fact_type") == c("fact_type")) | (
        (c("fact_type") == "malformed_number") & (c("reference_fact_type") == "currency_amount"))
    bare = (c("fact_type") == "ranking") & F.rlike(F.trim("span_text"), F.lit(BARE_RANK)) & F.contains("notes", F.lit("list_rank_marker"))
    lineage = [] if source is None else [("failure", "unexpected_source_file", ~F.coalesce(F.contains("source_file", F.lit(source)), F.lit(False)))]
    by_span = flags(
        annotations,
        [("warning", "gold_reference_fact_type_mismatch", ~same_kind), ("info", "bare_rank_marker_allowed", bare), *lineage],
        c("annotation_id"))
    totals = annotations.groupBy("question_id").agg(
        F.count_if(c("label").isin(*POSITIVE)).alias("positive"), F.count_if(c("label").isin(*NEGATIVE)).alias("correct"),
        F.count_if(c("label") == "unsupported_claim").alias("unsupported"), F.count_if(c("fact_type") == "ranking").alias("ranked"),
        F.count_if(c("fact_type") == "percentage").alias("percentages"))
    counted = totals.join(questions.select("question_id", "question_type", *(["split"] if splits else [])), "question_id")
    by_question = flags(
        counted,
        [
            ("warning", "correct_only_question", c("positive") == 0),
            ("warning", "no_correct_key_fact", c("correct") == 0),
            ("warning", "unsupported_claim_review", c("unsupported") > 0),
            ("warning", "top3_without_ranking_span", (c("question_type") == "top3_products_month") & (c("ranked") == 0)),
            ("warning", "share_question_without_percentage", (c("question_type") == "product_revenue_share_month") & (c("percentages") == 0)),
        ],
        F.lit(None).cast("string"))
    if not splits:
        return by_span.unionByName(by_question)
    # A row without positives for each split that is wanted, so that one without questions is there too.
    wanted = totals.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in splits])).alias("split"), F.lit(0).alias("positive"))
    positives = counted.select("split", F.col("positive").cast("int").alias("positive")).filter(c("split").isin(*splits))
    bare_splits = wanted.unionByName(positives).groupBy("split").agg(F.sum("positive").alias("n")).filter("n = 0")
    by_split = bare_splits.select(
        c("split").alias("question_id"), F.lit(None).cast("string").alias("annotation_id"), F.lit("failure").alias("severity"),
        F.lit("split_has_no_positive_spans").alias("rule"))
    return by_span.unionByName(by_question).unionByName(by_split)


def _label_columns() -> list[Column]:
    label = F.col("label")
    return [
        F.count("label").alias("span_count"),
        F.count_if(label.isin(*NEGATIVE)).alias("negative_span_count"),
        F.count_if(label.isin(*POSITIVE)).alias("positive_span_count"),
        F.count_if(label.isin(*EXCLUDED)).alias("excluded_span_count"),
        *[F.count_if(label == x).alias(x) for x in LABELS],
    ]


def question_coverage(questions: DataFrame, annotations: DataFrame) -> DataFrame:
    """Label columns per question; a question without spans shows zeros. Label columns are
    counted before the join, so a question's spans never meet in one task."""
    counts = annotations.groupBy("question_id").agg(
        *_label_columns(), F.array_join(F.array_sort(F.collect_set("fact_type")), "|").alias("fact_types"))
    names = [c for c in counts.columns if c not in ("question_id", "fact_types")]
    return questions.join(counts, "question_id", "left").fillna(0, names).fillna("", ["fact_types"])


def fact_type_coverage(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("fact_type").agg(*_label_columns(), F.countDistinct("question_id").alias("question_count"))


def type_coverage(by_question: DataFrame) -> DataFrame:
    counts = ("span_count", "negative_span_count", "positive_span_count", "excluded_span_count")
    return by_question.groupBy("question_type").agg(F.count("*").alias("question_count"), *[F.sum(c).alias(c) for c in counts])


def thin_question_types(by_question: DataFrame, least: int = 2) -> DataFrame:
    """(question_type, question_count) of types with fewer than `least` questions."""
    return by_question.groupBy("question_type").agg(F.count(F.lit(1)).alias("question_count")).filter(F.col("question_count") < least)


def coverage_rules(by_question: DataFrame, by_fact_type: DataFrame, gaps: DataFrame) -> DataFrame:
    """(rule, level, broken, measure): readiness failures and warnings. `gaps` lists ids that the
    annotations lack or have too many (`quality.id_differences`)."""
    totals = by_question.agg(
        F.sum("span_count").alias("spans"), F.sum("positive_span_count").alias("p"), F.sum("negative_span_count").alias("n"),
        F.sum("unsupported_claim").alias("u"), F.count_if(F.col("span_count") < 3).alias("thin"), F.countDistinct("split").alias("splits"))
    rare = by_fact_type.agg(F.count_if(F.col("span_count") < 5).alias("rare"))
    few = thin_question_types(by_question).agg(F.count(F.lit(1)).alias("few"))
    lists = gaps.agg(F.count_if(F.col("gap") == "missing").alias("missing"), F.count_if(F.col("gap") == "extra").alias("extra"))
    c = F.col
    balance = F.round(ratio(F.least("p", "n"), F.greatest("p", "n")), 4)
    rules = [
        ("no_missing_questions", "failure", c("missing") > 0, c("missing")),
        ("no_extra_questions", "failure", c("extra") > 0, c("extra")),
        ("at_least_100_spans", "failure", c("spans") < 100, c("spans")),
        ("both_classes", "failure", (c("p") == 0) | (c("n") == 0), F.least("p", "n")),
        ("three_spans_per_question", "failure", c("thin") > 0, c("thin")),
        ("class_balance", "warning", balance < 0.5, balance),
        ("unsupported_claims_rare", "warning", c("u") < 5, c("u")),
        ("qualitative_fact_types", "warning", c("rare") > 0, c("rare")),
        ("two_questions_per_type", "warning", c("few") > 0, c("few")),
        ("single_split", "warning", c("splits") == 1, c("splits")),
    ]
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(level).alias("level"), b.alias("broken"), m.cast("double").alias("measure"))
                     for r, level, b, m in rules])
    return one_row([totals, rare, few, lists]).select(F.inline(rows))


def theme_coverage(questions: DataFrame, themes: Mapping[str, Sequence[str]], examples: int = 3) -> tuple[DataFrame, DataFrame]:
    """Question counts per theme, and the first questions of each theme. A type may
    belong to several themes; the theme list is configuration."""
    pairs = [F.struct(F.lit(t).alias("theme"), F.lit(q).alias("kind")) for t, qs in themes.items() for q in qs]
    tagged = questions.select("*", F.explode(F.array(*pairs)).alias("t")).filter("t.kind = question_type").select("*", "t.theme").drop("t")
    counts = tagged.groupBy("theme").agg(F.count("*").alias("coverage"))
    first = top_n(tagged, examples, ["theme"], [F.col("question_id")], "example_rank")
    return counts, first.select("theme", "example_rank", "question_id", "question_type")


def all_checks(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
