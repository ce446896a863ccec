"""Detector evaluation over long score rows (baseline, split, row_id, y, score).

Rows are first counted per distinct score, so the heaviest tie is one row; every
ordered pass then runs in slices (see `ordering`). Nothing is compared pairwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerproof.functions.numbers import exact_mean, ratio, rounded
from ledgerproof.operators.ordering import exact_median, running_totals, top_n

# The label classes.
POSITIVE = ("hallucinated_key_fact", "unsupported_claim")
NEGATIVE = ("correct_key_fact",)
EXCLUDED = ("ambiguous_or_unverifiable", "ignore")

GROUP = ("baseline", "split")
METRICS = ("precision", "recall", "specificity", "f1", "accuracy")
COUNTS = ("tp", "fp", "tn", "fn")


# ----------------------------------------------------------------------- labels


def binary_label(label: Column, policy: str = "drop") -> Column:
    """drop: excluded labels become NULL; raise: an unknown label stops the job;
    rest_positive: anything that is not correct counts as positive."""
    if policy == "rest_positive":
        return F.when(label.isin(*NEGATIVE), 0).otherwise(1)
    known = F.when(label.isin(*POSITIVE), 1).when(label.isin(*NEGATIVE), 0)
    if policy == "drop":
        return known
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), label)).cast("int")
    return known.when(label.isin(*EXCLUDED), None).otherwise(unknown)


def derived_scores(df: DataFrame, one_minus: Mapping[str, str], negated: Mapping[str, str]) -> DataFrame:
    """1 - margin and -delta columns; a missing or non-finite input stops the job."""
    def checked(c: str) -> Column:
        bad = F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
        return F.when(bad, F.raise_error(F.lit(f"not a finite score: {c}")).cast("double")).otherwise(F.col(c).cast("double"))

    return df.withColumns(
        {**{n: 1 - checked(c) for n, c in one_minus.items()}, **{n: -checked(c) for n, c in negated.items()}}
    )


def numeric_rows(df: DataFrame, floats: Sequence[str], ints: Sequence[str]) -> DataFrame:
    """Typed metric rows from text cells; integers may arrive as '3.0'."""
    typed = {c: F.col(c).try_cast("double") for c in floats}
    typed.update({c: F.col(c).try_cast("double").try_cast("bigint") for c in ints})
    return df.withColumns(typed)


def unparsable_scores(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The first row per field whose score does not parse."""
    text = df.select(key, *[F.col(f).cast("string").alias(f) for f in fields])
    long = text.unpivot([key], list(fields), "field", "value")
    return top_n(long.filter(F.col("value").try_cast("double").isNull()), 1, ["field"], [F.col(key)]).drop("rank")


def long_scores(df: DataFrame, fields: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Score columns turned into rows once; one pass over the table."""
    return df.select(*keep, *fields).unpivot(list(keep), list(fields), "baseline", "score")


def with_question_attributes(spans: DataFrame, questions: DataFrame, attributes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Spans with their question's attributes, and the spans that have no question."""
    joined = spans.join(questions.select("question_id", *attributes, F.lit(True).alias("_hit")), "question_id", "left")
    found = joined.filter("_hit").drop("_hit")
    return found, joined.filter("_hit IS NULL").select(*spans.columns)


# ---------------------------------------------------------------------- metrics


def with_metrics(df: DataFrame) -> DataFrame:
    """Precision, recall, specificity, F1 and accuracy; an empty denominator gives 0."""
    c = F.col
    first = df.withColumns(
        {
            "precision": ratio(c("tp"), c("tp") + c("fp")),
            "recall": ratio(c("tp"), c("tp") + c("fn")),
            "specificity": ratio(c("tn"), c("tn") + c("fp")),
            "accuracy": ratio(c("tp") + c("tn"), c("tp") + c("fp") + c("tn") + c("fn")),
        }
    )
    return first.withColumn("f1", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def round_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns({m: rounded(F.col(m)) for m in METRICS if m in df.columns})


def confusion(rows: DataFrame, thresholds: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Counts at each detector's threshold, positive when score >= threshold. There is
    one threshold per configured detector, so adaptive execution broadcasts that side by its measured size."""
    hit, pos = F.col("score") >= F.col("threshold"), F.col("y") == 1
    return rows.join(thresholds.select("baseline", "threshold"), "baseline").groupBy(*group, "threshold").agg(
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & ~pos).alias("tn"),
        F.count_if(~hit & pos).alias("fn"),
    )


def sweep(rows: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Confusion counts at every distinct score of each group, from running counts."""
    counts = rows.groupBy(*group, "score").agg(F.count("*").alias("n"), F.sum("y").cast("bigint").alias("pos"))
    totals = rows.groupBy(*group).agg(
        F.count("*").alias("total"), F.sum("y").cast("bigint").alias("total_pos")
    )
    running = running_totals(
        counts, [F.col("score").desc()], group, {"cum_n": F.col("n"), "cum_pos": F.col("pos")}, "threshold_rank"
    )
    c = F.col
    return running.join(totals, list(group)).withColumns(
        {
            "tp": c("cum_pos"),
            "fp": c("cum_n") - c("cum_pos"),
            "fn": c("total_pos") - c("cum_pos"),
            "tn": c("total") - c("total_pos") - (c("cum_n") - c("cum_pos")),
        }
    )


def best_thresholds(swept: DataFrame, group: Sequence[str] = GROUP, policy: str = "max_f1") -> DataFrame:
    """max_f1: F1, precision, recall, accuracy, then the lowest threshold.
    recall_first: rounded F1, recall, fewest false positives, then the highest."""
    scored, c = with_metrics(swept), F.col
    if policy == "max_f1":
        order = [c(m).desc() for m in ("f1", "precision", "recall", "accuracy")] + [c("score").asc()]
    else:
        order = [rounded(c("f1")).desc(), rounded(c("recall")).desc(), c("fp").asc(), c("score").desc()]
    best = top_n(scored, 1, group, order, "_best")
    return best.select(*group, c("score").alias("threshold"), *COUNTS, *METRICS)


def auroc(swept: DataFrame, group: Sequence[str] = GROUP, one_class: float | None = None) -> DataFrame:
    """Rank-sum AUROC with averaged ties; `one_class` when a class is missing."""
    c = F.col
    below = c("total") - c("cum_n")
    rank = below.cast("double") + (c("n") + 1).cast("double") / 2
    sums = swept.groupBy(*group).agg(
        F.sum(c("pos") * rank).alias("s"), F.first("total_pos").alias("p"), F.first("total").alias("t")
    )
    p, n = c("p").cast("double"), (c("t") - c("p")).cast("double")
    value = (c("s") - p * (p + 1) / 2) / (p * n)
    return sums.select(*group, F.when((p > 0) & (n > 0), value).otherwise(F.lit(one_class).cast("double")).alias("auroc"))


def average_precision(rows: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Average precision; ties keep row order, so the row id is the second key."""
    ordered = running_totals(rows, [F.col("score").desc(), F.col("row_id")], group, {"hits": F.col("y")}, "place")
    precision = F.when(F.col("y") == 1, F.col("hits").cast("double") / F.col("place"))
    return ordered.groupBy(*group).agg(F.sum(precision).alias("s"), F.sum("y").alias("p")).select(
        *group, F.try_divide(F.col("s"), F.col("p")).alias("auprc")
    )


def evaluate_splits(rows: DataFrame, choose: str = "dev", report: Sequence[str] = ("dev", "test")) -> DataFrame:
    """Thresholds chosen on one split, applied unchanged to the reported ones."""
    used = rows.filter(F.col("split").isin(choose, *report))
    swept = sweep(used)
    chosen = best_thresholds(swept.filter(F.col("split") == choose)).select("baseline", "threshold")
    shown = used.filter(F.col("split").isin(*report))
    counted = round_metrics(with_metrics(confusion(shown, chosen)))
    ranked = auroc(swept).join(average_precision(used), list(GROUP))
    return counted.join(ranked, list(GROUP)).select(
        "baseline",
        F.col("split").alias("evaluated_split"),
        F.lit(choose).alias("threshold_source_split"),
        rounded(F.col("threshold")).alias("threshold"),
        *METRICS,
        rounded(F.col("auroc")).alias("auroc"),
        rounded(F.col("auprc")).alias("auprc"),
        *COUNTS,
        (F.col("tp") + F.col("fn")).alias("positive_count"),
        (F.col("fp") + F.col("tn")).alias("negative_count"),
    )


def confusion_long(metrics: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, actual, predicted, n): four rows per metric row."""
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(k).cast("bigint").alias("n"))
            for a, p, k in [("positive", "positive", "tp"), ("positive", "negative", "fn"),
                            ("negative", "positive", "fp"), ("negative", "negative", "tn")]
        ]
    )
    return metrics.select(*key, F.inline(cells))


def reference_detectors(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """All-positive and all-negative rows with the prevalence of positives."""
    totals = rows.groupBy(*group).agg(F.sum("y").cast("bigint").alias("p"), F.count("*").alias("t"))
    p, n, zero = F.col("p"), F.col("t") - F.col("p"), F.lit(0).cast("bigint")
    both = F.array(
        F.struct(F.lit("all_positive").alias("baseline"), p.alias("tp"), n.alias("fp"), zero.alias("tn"), zero.alias("fn")),
        F.struct(F.lit("all_negative").alias("baseline"), zero.alias("tp"), zero.alias("fp"), n.alias("tn"), p.alias("fn")),
    )
    wide = totals.select(*group, rounded(ratio(p, F.col("t"))).alias("positive_prevalence"), F.inline(both))
    return round_metrics(with_metrics(wide))


# -------------------------------------------------------------------- comparing


def score_group(family: Column, baseline: Column, groups: Mapping[str, Sequence[str]], simple: str, other: str) -> Column:
    out = F.when(family == "simple", simple)
    for name, members in groups.items():
        out = out.when(baseline.isin(*members), name)
    return out.otherwise(other)


def paired_metrics(metrics: DataFrame, splits: tuple[str, str] = ("dev", "test")) -> tuple[DataFrame, DataFrame]:
    """Dev and test rows side by side per detector, and the detectors missing a half."""
    halves = metrics.groupBy("family", "baseline").pivot("evaluated_split", list(splits)).agg(
        F.first(F.struct("threshold", *METRICS, "auroc", "auprc", *COUNTS, "threshold_source_split"))
    )
    whole = F.col(splits[0]).isNotNull() & F.col(splits[1]).isNotNull()
    return halves.filter(whole), halves.filter(~whole).select("family", "baseline")


def comparison(metrics: DataFrame, group_name: Column) -> DataFrame:
    """One comparison row per detector; all-positive-like is recall >= 0.95 with
    specificity <= 0.05 on the test split."""
    pairs, _ = paired_metrics(metrics)
    d, t = F.col("dev"), F.col("test")
    return pairs.select(
        "family",
        "baseline",
        group_name.alias("score_group"),
        t["threshold"].alias("threshold"),
        d["f1"].alias("dev_f1"),
        *[t[m].alias(f"test_{m}") for m in ("auprc", "auroc", *METRICS, *COUNTS)],
        ((t["recall"] >= 0.95) & (t["specificity"] <= 0.05)).alias("all_positive_like"),
    )


def best_row(rows: DataFrame, metric: str, group: Sequence[str] = ()) -> DataFrame:
    """Best by metric, then test F1, then test AUPRC, then name. Rows are one per
    configured detector."""
    order = [F.col(metric).desc(), F.col("test_f1").desc(), F.col("test_auprc").desc(), F.col("baseline")]
    if group:
        return top_n(rows, 1, group, order, "_r").drop("_r")
    return rows.orderBy(*order).limit(1)


def family_summary(rows: DataFrame) -> DataFrame:
    by_auprc = best_row(rows, "test_auprc", ["family"]).select(
        "family", F.col("baseline").alias("best_auprc_baseline"), F.col("test_auprc").alias("best_auprc"),
        F.col("test_f1").alias("best_auprc_f1"))
    by_f1 = best_row(rows, "test_f1", ["family"]).select(
        "family", F.col("baseline").alias("best_f1_baseline"), F.col("test_f1").alias("best_f1"),
        F.col("test_auprc").alias("best_f1_auprc"))
    counts = rows.groupBy("family").agg(
        F.count("*").alias("baseline_count"), F.count_if("all_positive_like").alias("all_positive_like_count"))
    return counts.join(by_auprc, "family").join(by_f1, "family")


def metric_gaps(summary: DataFrame, left: str, right: str) -> DataFrame:
    """(metric, gap): left family's best minus right family's best."""
    def best(family: str, metric: str) -> Column:
        return F.max(F.when(F.col("family") == family, F.col(metric)))

    gaps = [
        F.struct(F.lit(name).alias("metric"), rounded(best(left, c) - best(right, c)).alias("gap"))
        for name, c in [("test_auprc", "best_auprc"), ("test_f1", "best_f1")]
    ]
    return summary.agg(F.array(*gaps).alias("g")).select(F.inline("g"))


def score_summary(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """min, mean, median and max of the score per group."""
    plain = rows.groupBy(*group).agg(
        F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"),
        exact_mean(F.col("score")).alias("mean"))
    return plain.join(exact_median(rows, group, "score"), list(group))


def class_overlap(rows: DataFrame, group: Sequence[str] = ("baseline",)) -> DataFrame:
    wrong, right = F.when(F.col("y") == 1, F.col("score")), F.when(F.col("y") == 0, F.col("score"))
    return rows.groupBy(*group).agg(F.min(wrong).alias("min_wrong"), F.max(right).alias("max_right")).withColumn(
        "overlap", F.coalesce(F.col("min_wrong") <= F.col("max_right"), F.lit(False)))


def average_ranks(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Ascending rank of each distinct score, ties averaged: (group, score, n, average_rank)."""
    counts = rows.groupBy(*group, "score").agg(F.count("*").alias("n"))
    running = running_totals(counts, [F.col("score")], group, {"upto": F.col("n")}, "_p").drop("_p")
    return running.select(
        *group, "score", "n",
        ((F.col("upto") - F.col("n") + 1).cast("double") + F.col("upto").cast("double")).alias("_two"),
    ).withColumn("average_rank", F.col("_two") / 2).drop("_two")


# ----------------------------------------------------------------------- errors


def flag_predictions(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Every span under every selected detector: threshold, margin, prediction."""
    chosen = thresholds
    margin = F.col("score") - F.col("threshold")
    return rows.join(chosen, "baseline").withColumns(
        {"score_margin": rounded(margin), "predicted": (margin >= 0).cast("int")})


def error_type() -> Column:
    return F.when((F.col("y") == 1) & (F.col("predicted") == 0), "false_negative").when(
        (F.col("y") == 0) & (F.col("predicted") == 1), "false_positive")


def class_name(c: Column) -> Column:
    return F.when(c == 1, "positive").otherwise("negative")


def outcome(y: Column, predicted: Column) -> Column:
    return F.when(y == 1, F.when(predicted == 1, "caught").otherwise("missed")).otherwise(
        F.when(predicted == 1, "false alarm").otherwise("cleared"))


def error_rows(flagged: DataFrame) -> DataFrame:
    return flagged.withColumns(
        {"error_type": error_type(), "actual_class": class_name(F.col("y")), "predicted_class": class_name(F.col("predicted"))}
    ).filter("error_type IS NOT NULL")


def with_context(errors: DataFrame, context: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Joins lookup tables in turn; rows that miss a partner stay visible with a reason."""
    out = errors.withColumn("missing_context", F.lit(None).cast("string"))
    for number, (table, key) in enumerate(context):
        mark = f"_hit{number}"
        out = out.join(table.withColumn(mark, F.lit(True)), key, "left").withColumn(
            "missing_context", F.coalesce("missing_context", F.when(F.col(mark).isNull(), F.lit(key)))
        ).drop(mark)
    return out


def transition_counts(flagged: DataFrame) -> DataFrame:
    """(baseline, transition, n) with zero transitions present."""
    pair = F.concat(class_name(F.col("y")), F.lit("->"), class_name(F.col("predicted")))
    names = [f"{a}->{b}" for a in ("negative", "positive") for b in ("negative", "positive")]
    counts = flagged.groupBy("baseline").agg(*[F.count_if(pair == n).alias(n) for n in names])
    return counts.unpivot(["baseline"], names, "transition", "n")


def error_totals(errors: DataFrame) -> DataFrame:
    return errors.groupBy("baseline").agg(
        F.count_if(F.col("error_type") == "false_positive").alias("false_positive_count"),
        F.count_if(F.col("error_type") == "false_negative").alias("false_negative_count"),
        F.count("*").alias("error_count"))


def error_group_counts(errors: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Counts per detector, error type and each attribute in one grouping-sets pass."""
    values = F.array(*[F.struct(F.lit(a).alias("group_field"), F.col(a).cast("string").alias("group_value")) for a in attributes])
    base = errors.groupBy("baseline", "error_type", *attributes).agg(F.count("*").alias("n"))
    return base.select("baseline", "error_type", "n", F.inline(values)).groupBy(
        "baseline", "error_type", "group_field", "group_value").agg(F.sum("n").alias("n"))


def examples(errors: DataFrame, bucket: Sequence[str], n: int, key: Column) -> DataFrame:
    return top_n(errors, n, bucket, [key.desc(), F.col("row_id")], "example_rank")


def selected_by_role(picks: Sequence[tuple[str, DataFrame]], merge: bool = True) -> DataFrame:
    """Detectors with their roles. Merged: one row per detector with its roles joined;
    else the first role wins."""
    rows = [
        f.select("baseline", F.lit(i).alias("_o"), F.lit(role).alias("role")) for i, (role, f) in enumerate(picks)
    ]
    roles = F.transform(F.array_sort(F.collect_list(F.struct("_o", "role"))), lambda x: x["role"])
    grouped = reduce(DataFrame.unionByName, rows).groupBy("baseline").agg(roles.alias("r"))
    return grouped.select("baseline", (F.array_join("r", "+") if merge else F.col("r")[0]).alias("role"))


def error_family() -> Column:
    """The fixed ladder of families; an error type that it doesn't know stops the job.
    Rows without an error have none."""
    kind, fact, question = F.col("error_type"), F.col("fact_type"), F.col("question_type")
    wrong = (
        F.when(question == "top3_products_month", "confident_wrong_top3_ranked_item")
        .when(fact.isin("product_name", "product_stock_code"), "confident_wrong_product_identity")
        .when(fact.isin("currency_amount", "percentage", "malformed_number"), "confident_wrong_numeric_value")
        .otherwise("confident_wrong_other_fact")
    )
    flagged = (
        F.when(fact.isin("currency_amount", "percentage"), "correct_numeric_flagged_uncertain")
        .when(fact == "business_definition", "correct_business_definition_flagged_uncertain")
        .when(fact.isin("country", "month", "date_range", "comparison_direction", "product_name", "product_stock_code"),
              "correct_context_fact_flagged_uncertain")
        .when(fact == "ranking", "correct_ranking_flagged_uncertain")
        .otherwise("correct_other_fact_flagged_uncertain")
    )
    unknown = F.raise_error(F.concat(F.lit("unknown error type "), kind)).cast("string")
    return F.when(kind == "false_negative", wrong).when(kind == "false_positive", flagged).when(kind.isNotNull(), unknown)


def severity() -> Column:
    margin = F.col("score_margin")
    return rounded(F.when(F.col("error_type") == "false_negative", -margin).otherwise(margin))


def histogram_text(df: DataFrame, group: Sequence[str], value: str, order: str = "row_id") -> DataFrame:
    """'a:3; b:1' per group: count descending, then first seen."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(order).alias("f"))
    item = F.struct((-F.col("n")).alias("k"), "f", F.concat_ws(":", F.col(value), F.col("n").cast("string")).alias("t"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"])
    return counts.groupBy(*group).agg(F.array_join(listed, "; ").alias(f"{value}_histogram"))


def family_statistics(errors: DataFrame, values: Sequence[str]) -> DataFrame:
    """Rows, distinct spans and questions, and histograms per error family."""
    out = errors.groupBy("error_family").agg(
        F.count("*").alias("error_rows"),
        F.countDistinct("row_id").alias("distinct_spans"),
        F.countDistinct("question_id").alias("distinct_questions"),
    )
    for value in values:
        out = out.join(histogram_text(errors, ["error_family"], value), "error_family")
    return out


def case_table(outcomes: DataFrame) -> DataFrame:
    """Spans numbered under their question, with the question's span count. Rows stay
    rows: a question with very many spans is not gathered in one place."""
    counts = outcomes.groupBy("question_id").agg(F.count("*").alias("span_count"))
    return running_totals(outcomes, [F.col("row_id")], ["question_id"], position="span_no").join(counts, "question_id")
