"""Detector scores, thresholds, metrics, comparisons and error reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerproof.functions.numbers import rounded
from ledgerproof.functions.text import excerpt
from ledgerproof.operators import detectors as det
from ledgerproof.operators import quality, rollups
from ledgerproof.operators.ordering import running_totals
from ledgerproof.plans import views
from ledgerproof.plans.register import query
from ledgerproof.plans.spans import FACT_TYPES, FEATURES, SQL_FACTS, annotations, features, pick
from ledgerproof.plans.views import sql_collapse, sql_mean
from ledgerproof.session import stored_once

FIELDS = ["d1", "d2", "d3", "d4", "d5"]
QUESTION_KINDS = ["top3_products_month", "top_country_month", "return_impact_month"]
SQL_KINDS = "[" + ", ".join(f"'{x}'" for x in QUESTION_KINDS) + "]"


def wide_scores(spark, root) -> DataFrame:
    """Scored spans: the first vector entries are detector scores."""
    v, n = F.col("vec_id"), F.col("vec_id")
    split = F.when(v % 5 < 3, "train").when(v % 5 == 3, "dev").otherwise("test")
    scores = [F.round(F.get("embedding", i).cast("double"), 2).alias(f) for i, f in enumerate(FIELDS)]
    return views.table(spark, root, "embeddings").select(
        n.alias("row_id"), F.expr("vec_id div 10").alias("question_id"), split.alias("split"),
        (F.col("label") % 2).cast("int").alias("y"), pick(FACT_TYPES, (v % 4).cast("int")).alias("fact_type"),
        pick(QUESTION_KINDS, (F.expr("vec_id div 10") % 3).cast("int")).alias("question_type"), *scores,
    )


KEEP = ["row_id", "question_id", "split", "y", "fact_type", "question_type"]


def scores(spark, root) -> DataFrame:
    return det.long_scores(wide_scores(spark, root), FIELDS, KEEP)


M6 = ", ".join(f"round({m}, 6) AS {m}" for m in det.METRICS)


def metrics_sql(source: str, extra: str = "") -> str:
    return f"""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 {extra} FROM (
      SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision,
      CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall,
      CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0 END AS specificity,
      CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) AS accuracy FROM {source})"""


WIDE = f"""
wide AS (SELECT vec_id AS row_id, vec_id // 10 AS question_id, CASE WHEN vec_id % 5 < 3 THEN 'train' WHEN vec_id % 5 = 3 THEN 'dev' ELSE 'test' END AS split,
  label % 2 AS y, {SQL_FACTS}[vec_id % 4 + 1] AS fact_type, {SQL_KINDS}[(vec_id // 10) % 3 + 1] AS question_type,
  {', '.join(f'round(CAST(embedding[{i + 1}] AS DOUBLE), 2) AS {f}' for i, f in enumerate(FIELDS))} FROM embeddings),
scores AS ({' UNION ALL '.join(f"SELECT row_id, question_id, split, y, fact_type, question_type, '{f}' AS baseline, {f} AS score FROM wide" for f in FIELDS)})
"""
SWEEP = f"""
{WIDE},
sweep AS (SELECT DISTINCT baseline, split, score, tp, fp, p - tp AS fn, n - fp AS tn FROM (
  SELECT baseline, split, score, CAST(sum(y) OVER w AS BIGINT) AS tp, CAST(sum(1 - y) OVER w AS BIGINT) AS fp,
    CAST(sum(y) OVER g AS BIGINT) AS p, CAST(sum(1 - y) OVER g AS BIGINT) AS n FROM scores
  WINDOW w AS (PARTITION BY baseline, split ORDER BY score DESC), g AS (PARTITION BY baseline, split))),
swept AS ({metrics_sql('sweep')}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY baseline, split
  ORDER BY f1 DESC, precision DESC, recall DESC, accuracy DESC, score) AS rn FROM swept) WHERE rn = 1),
chosen AS (SELECT baseline, score AS threshold FROM best WHERE split = 'dev'),
flagged AS (SELECT *, round(score - threshold, 6) AS score_margin, CAST(score - threshold >= 0 AS INTEGER) AS predicted FROM scores JOIN chosen USING (baseline)),
confusion AS (SELECT baseline, split, threshold, count(*) FILTER (predicted = 1 AND y = 1) AS tp, count(*) FILTER (predicted = 1 AND y = 0) AS fp,
  count(*) FILTER (predicted = 0 AND y = 0) AS tn, count(*) FILTER (predicted = 0 AND y = 1) AS fn FROM flagged GROUP BY ALL),
metrics AS ({metrics_sql('confusion')}),
ranks AS (SELECT baseline, split, y, rank() OVER w + (count(*) OVER (PARTITION BY baseline, split, score) - 1) / 2.0 AS r FROM scores
  WINDOW w AS (PARTITION BY baseline, split ORDER BY score)),
auroc AS (SELECT baseline, split, (CAST(sum(r) FILTER (y = 1) AS DOUBLE) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auroc FROM ranks GROUP BY ALL),
ordered AS (SELECT baseline, split, y, row_number() OVER w AS place, sum(y) OVER w AS hits FROM scores
  WINDOW w AS (PARTITION BY baseline, split ORDER BY score DESC, row_id)),
ap AS (SELECT baseline, split, sum(CAST(hits AS DOUBLE) / place) FILTER (y = 1) / sum(y) AS auprc FROM ordered GROUP BY ALL),
report AS (SELECT CASE WHEN baseline < 'd4' THEN 'simple' ELSE 'energy' END AS family, baseline, split AS evaluated_split, 'dev' AS threshold_source_split,
  round(threshold, 6) AS threshold, {M6}, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, tp, fp, tn, fn, tp + fn AS positive_count, fp + tn AS negative_count
  FROM metrics JOIN auroc USING (baseline, split) JOIN ap USING (baseline, split) WHERE split IN ('dev', 'test')),
errors AS (SELECT *, CASE WHEN y = 1 THEN 'false_negative' ELSE 'false_positive' END AS error_type FROM flagged WHERE split = 'test' AND y <> predicted)
"""


def chosen(rows: DataFrame) -> DataFrame:
    dev = rows.filter("split = 'dev'")
    return det.best_thresholds(det.sweep(dev)).select("baseline", "threshold")


def flagged(spark, root) -> DataFrame:
    rows = scores(spark, root)
    return det.flag_predictions(rows, chosen(rows))


def errors(spark, root) -> DataFrame:
    return det.error_rows(flagged(spark, root).filter("split = 'test'"))


def report(spark, root) -> DataFrame:
    out = det.evaluate_splits(scores(spark, root))
    return out.withColumn("family", F.when(F.col("baseline") < "d4", "simple").otherwise("energy"))


# -------------------------------------------------------------------------- labels


@query(
    "p07_binary_label",
    f"""WITH {FEATURES} SELECT annotation_id, CASE WHEN label IN ('hallucinated_key_fact', 'unsupported_claim') THEN 1
      WHEN label = 'correct_key_fact' THEN 0 END AS dropping, CASE WHEN label = 'correct_key_fact' THEN 0 ELSE 1 END AS rest_positive FROM annotations""",
)
def p07(spark, root):
    notes, label = annotations(spark, root), F.col("label")
    return notes.filter(det.binary_label(label, "raise").isNull() | (det.binary_label(label, "raise") >= 0)).select(
        "annotation_id", det.binary_label(label).alias("dropping"), det.binary_label(label, "rest_positive").alias("rest_positive")
    )


@query(
    "p08_derived_scores",
    f"""WITH {FEATURES} SELECT annotation_id, round(1 - mean_top2_margin, 6) AS one_minus_mean_top2_margin,
    round(1 - min_top2_margin, 6) AS one_minus_min_top2_margin, -mean_token_logprob AS negative_mean_logprob FROM features""",
)
def p08(spark, root):
    made = det.derived_scores(
        features(spark, root),
        {"one_minus_mean_top2_margin": "mean_top2_margin", "one_minus_min_top2_margin": "min_top2_margin"},
        {"negative_mean_logprob": "mean_token_logprob"},
    )
    return made.select(
        "annotation_id", rounded(F.col("one_minus_mean_top2_margin")).alias("one_minus_mean_top2_margin"),
        rounded(F.col("one_minus_min_top2_margin")).alias("one_minus_min_top2_margin"), "negative_mean_logprob",
    )


@query(
    "p11_typed_metric_rows",
    "SELECT c_custkey, c_acctbal AS f1, CAST(c_nationkey AS BIGINT) AS tp FROM customer",
)
def p11(spark, root):
    cells = views.table(spark, root, "customer").select(
        "c_custkey", F.col("c_acctbal").cast("string").alias("f1"), F.concat("c_nationkey", F.lit(".0")).alias("tp"))
    return det.numeric_rows(cells, ["f1"], ["tp"])


@query(
    "v22_scores_parse",
    """SELECT 'props' AS field, min(event_id) AS event_id, CAST(NULL AS VARCHAR) AS note FROM events WHERE TRY_CAST(props AS DOUBLE) IS NULL""",
)
def v22(spark, root):
    bad = det.unparsable_scores(views.table(spark, root, "events"), "event_id", ["value", "props"])
    return bad.select("field", "event_id", F.lit(None).cast("string").alias("note"))


@query(
    "j01_attribute_lookup",
    f"""WITH {WIDE}, q AS (SELECT doc_id AS question_id, lang, source FROM documents WHERE lang <> 'fr')
    SELECT row_id, question_id, lang, source, q.question_id IS NOT NULL AS matched FROM wide LEFT JOIN q USING (question_id)""",
)
def j01(spark, root):
    docs = views.documents(spark, root).filter("lang <> 'fr'")
    asked = docs.select(F.col("doc_id").alias("question_id"), "lang", "source")
    found, lost = det.with_question_attributes(wide_scores(spark, root).select("row_id", "question_id"), asked, ["lang", "source"])
    none = F.lit(None).cast("string")
    return found.withColumn("matched", F.lit(True)).unionByName(
        lost.select("row_id", "question_id", none.alias("lang"), none.alias("source"), F.lit(False).alias("matched")))


# ------------------------------------------------------------------------- metrics


@query(
    "e01_confusion_at_threshold",
    f"""WITH {WIDE} SELECT baseline, split, CAST(0.02 AS DOUBLE) AS threshold, count(*) FILTER (score >= 0.02 AND y = 1) AS tp,
    count(*) FILTER (score >= 0.02 AND y = 0) AS fp, count(*) FILTER (score < 0.02 AND y = 0) AS tn, count(*) FILTER (score < 0.02 AND y = 1) AS fn
    FROM scores GROUP BY baseline, split""",
)
def e01(spark, root):
    rows = scores(spark, root)
    fixed = rows.select("baseline").distinct().withColumn("threshold", F.lit(0.02))
    return det.confusion(rows, fixed)


@query("e02_metrics_from_confusion", f"WITH {SWEEP} SELECT baseline, split, {M6} FROM metrics")
def e02(spark, root):
    rows = scores(spark, root)
    return det.round_metrics(det.with_metrics(det.confusion(rows, chosen(rows)))).select("baseline", "split", *det.METRICS)


@query("e03_auroc_rank_sum", f"WITH {SWEEP} SELECT baseline, split, round(auroc, 6) AS auroc FROM auroc")
def e03(spark, root):
    swept = det.sweep(scores(spark, root))
    return det.auroc(swept).withColumn("auroc", rounded(F.col("auroc")))


@query(
    "e04_pairwise_auc",
    f"""WITH {WIDE}, c AS (SELECT baseline, split, score, sum(y) AS p, sum(1 - y) AS n FROM scores GROUP BY ALL)
    SELECT a.baseline, a.split, round(CAST(sum(a.p * b.n * CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS DOUBLE)
      / (SELECT sum(y) * sum(1 - y) FROM scores s WHERE s.baseline = a.baseline AND s.split = a.split), 6) AS auc
    FROM c a JOIN c b ON a.baseline = b.baseline AND a.split = b.split GROUP BY a.baseline, a.split""",
)
def e04(spark, root):
    swept = det.sweep(scores(spark, root))
    return det.auroc(swept, one_class=0.0).select("baseline", "split", rounded(F.col("auroc")).alias("auc"))


@query("e05_average_precision", f"WITH {SWEEP} SELECT baseline, split, round(auprc, 6) AS auprc FROM ap")
def e05(spark, root):
    return det.average_precision(scores(spark, root)).withColumn("auprc", rounded(F.col("auprc")))


BEST = "baseline, split, score AS threshold, tp, fp, tn, fn, round(f1, 6) AS f1"


@query("e06_threshold_sweep", f"WITH {SWEEP} SELECT {BEST} FROM best")
def e06(spark, root):
    best = det.best_thresholds(det.sweep(scores(spark, root)))
    return best.select("baseline", "split", "threshold", *det.COUNTS, rounded(F.col("f1")).alias("f1"))


@query(
    "e07_recall_first_sweep",
    f"""WITH {SWEEP} SELECT {BEST} FROM (SELECT *, row_number() OVER (PARTITION BY baseline, split
      ORDER BY round(f1, 6) DESC, round(recall, 6) DESC, fp, score DESC) AS k FROM swept) WHERE k = 1""",
)
def e07(spark, root):
    best = det.best_thresholds(det.sweep(scores(spark, root)), policy="recall_first")
    return best.select("baseline", "split", "threshold", *det.COUNTS, rounded(F.col("f1")).alias("f1"))


@query("e08_split_safe_evaluation", f"WITH {SWEEP} SELECT * EXCLUDE (family) FROM report")
def e08(spark, root):
    return det.evaluate_splits(scores(spark, root))


@query(
    "e09_confusion_long",
    f"""WITH {SWEEP} SELECT baseline, evaluated_split, unnest(['positive', 'positive', 'negative', 'negative']) AS actual,
    unnest(['positive', 'negative', 'positive', 'negative']) AS predicted, unnest([tp, fn, fp, tn]) AS n FROM report""",
)
def e09(spark, root):
    return det.confusion_long(det.evaluate_splits(scores(spark, root)), ["baseline", "evaluated_split"])


@query(
    "e19_reference_detectors",
    f"""WITH {WIDE}, t AS (SELECT split, CAST(sum(y) AS BIGINT) AS p, count(*) AS n FROM wide GROUP BY split),
    r AS (SELECT split, round(CAST(p AS DOUBLE) / n, 6) AS positive_prevalence, 'all_positive' AS baseline, p AS tp, n - p AS fp, 0 AS tn, 0 AS fn FROM t
      UNION ALL SELECT split, round(CAST(p AS DOUBLE) / n, 6), 'all_negative', 0, 0, n - p, p FROM t)
    SELECT split, positive_prevalence, baseline, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, {M6} FROM ({metrics_sql('r')})""",
)
def e19(spark, root):
    return det.reference_detectors(wide_scores(spark, root), ["split"])


# ----------------------------------------------------------------------- comparing

PAIRED = """paired AS (SELECT family, baseline, t.threshold, d.f1 AS dev_f1, t.auprc AS test_auprc, t.auroc AS test_auroc, t.precision AS test_precision,
  t.recall AS test_recall, t.specificity AS test_specificity, t.f1 AS test_f1, t.accuracy AS test_accuracy, t.tp AS test_tp, t.fp AS test_fp, t.tn AS test_tn, t.fn AS test_fn,
  t.recall >= 0.95 AND t.specificity <= 0.05 AS all_positive_like,
  CASE WHEN family = 'simple' THEN 'simple_uncertainty' WHEN baseline = 'd4' THEN 'probability_mass_control' ELSE 'energy_other' END AS score_group
  FROM (SELECT * FROM report WHERE evaluated_split = 'dev') d JOIN (SELECT * FROM report WHERE evaluated_split = 'test') t USING (family, baseline))"""


@stored_once
def compared(spark, root) -> DataFrame:
    group = det.score_group(
        F.col("family"), F.col("baseline"), {"probability_mass_control": ["d4"]}, "simple_uncertainty", "energy_other")
    return det.comparison(report(spark, root), group)


@query(
    "j10_dev_test_pairing",
    f"""WITH {SWEEP} SELECT d.baseline, d.threshold AS dev_threshold, t.threshold AS test_threshold, d.f1 AS dev_f1, t.f1 AS test_f1
    FROM report d JOIN report t ON d.baseline = t.baseline WHERE d.evaluated_split = 'dev' AND t.evaluated_split = 'test'""",
)
def j10(spark, root):
    pairs, _ = det.paired_metrics(report(spark, root))
    return pairs.select(
        "baseline", F.col("dev.threshold").alias("dev_threshold"), F.col("test.threshold").alias("test_threshold"),
        F.col("dev.f1").alias("dev_f1"), F.col("test.f1").alias("test_f1"))


query("e10_family_comparison", f"WITH {SWEEP}, {PAIRED} SELECT * FROM paired")(compared)

BEST_BY = """(SELECT *, row_number() OVER (PARTITION BY family ORDER BY {m} DESC, test_f1 DESC, test_auprc DESC, baseline) AS k FROM paired)"""
SUMMARY = f"""summary AS (SELECT family, c.n AS baseline_count, c.a AS all_positive_like_count, p.baseline AS best_auprc_baseline, p.test_auprc AS best_auprc,
  p.test_f1 AS best_auprc_f1, f.baseline AS best_f1_baseline, f.test_f1 AS best_f1, f.test_auprc AS best_f1_auprc
  FROM (SELECT family, count(*) AS n, count(*) FILTER (all_positive_like) AS a FROM paired GROUP BY family) c
  JOIN {BEST_BY.format(m='test_auprc')} p USING (family) JOIN {BEST_BY.format(m='test_f1')} f USING (family) WHERE p.k = 1 AND f.k = 1)"""


@query("e11_family_summary", f"WITH {SWEEP}, {PAIRED}, {SUMMARY} SELECT * FROM summary")
def e11(spark, root):
    return det.family_summary(compared(spark, root))


@query(
    "e12_metric_gaps",
    f"""WITH {SWEEP}, {PAIRED}, {SUMMARY} SELECT unnest(['test_auprc', 'test_f1']) AS metric,
    unnest([round(a.best_auprc - b.best_auprc, 6), round(a.best_f1 - b.best_f1, 6)]) AS gap
    FROM summary a, summary b WHERE a.family = 'energy' AND b.family = 'simple'""",
)
def e12(spark, root):
    return det.metric_gaps(det.family_summary(compared(spark, root)), "energy", "simple")


@query(
    "w15_best_row",
    f"""WITH {SWEEP}, {PAIRED} (SELECT 'test_auprc' AS metric, baseline, test_auprc AS value FROM paired ORDER BY test_auprc DESC, test_f1 DESC, baseline LIMIT 1)
    UNION ALL (SELECT 'test_f1', baseline, test_f1 FROM paired ORDER BY test_f1 DESC, test_auprc DESC, baseline LIMIT 1)""",
)
def w15(spark, root):
    rows = compared(spark, root)
    return det.best_row(rows, "test_auprc").select(
        F.lit("test_auprc").alias("metric"), "baseline", F.col("test_auprc").alias("value")
    ).unionByName(det.best_row(rows, "test_f1").select(F.lit("test_f1").alias("metric"), "baseline", F.col("test_f1").alias("value")))


@query(
    "e13_class_overlap",
    f"""WITH {WIDE} SELECT baseline, min(score) FILTER (y = 1) AS min_wrong, max(score) FILTER (y = 0) AS max_right,
    min(score) FILTER (y = 1) <= max(score) FILTER (y = 0) AS overlap FROM scores GROUP BY baseline""",
)
def e13(spark, root):
    return det.class_overlap(scores(spark, root))


@query(
    "a18_score_summaries",
    f"""WITH {WIDE} SELECT baseline, y, count(*) AS n, min(score) AS low, max(score) AS high, {sql_mean('score')} AS mean,
    round(median(score), 6) AS median FROM scores GROUP BY baseline, y""",
)
def a18(spark, root):
    return det.score_summary(scores(spark, root), ["baseline", "y"]).withColumn("median", rounded(F.col("median")))


@query(
    "w12_average_tie_ranks",
    f"""WITH {WIDE} SELECT baseline, score, count(*) AS n, CAST(min(r) + (count(*) - 1) / 2.0 AS DOUBLE) AS average_rank
    FROM (SELECT baseline, score, rank() OVER (PARTITION BY baseline ORDER BY score) AS r FROM scores) GROUP BY baseline, score""",
)
def w12(spark, root):
    return det.average_ranks(scores(spark, root), ["baseline"])


@query(
    "w13_rank_per_field",
    f"""WITH {WIDE} SELECT baseline, row_id, score, row_number() OVER (PARTITION BY baseline ORDER BY score DESC, row_id) AS rank FROM scores""",
)
def w13(spark, root):
    ranked = running_totals(scores(spark, root), [F.col("score").desc(), F.col("row_id")], ["baseline"], position="rank")
    return ranked.select("baseline", "row_id", "score", "rank")


# -------------------------------------------------------------------------- errors


@query("j11_detectors_by_spans", f"WITH {SWEEP} SELECT row_id, baseline, split, score, threshold, score_margin, predicted FROM flagged")
def j11(spark, root):
    return flagged(spark, root).select("row_id", "baseline", "split", "score", "threshold", "score_margin", "predicted")


ERROR_COLUMNS = ["row_id", "baseline", "error_type", "score", "threshold", "score_margin", "actual_class", "predicted_class"]
CLASSES = """CASE WHEN y = 1 THEN 'positive' ELSE 'negative' END AS actual_class, CASE WHEN predicted = 1 THEN 'positive' ELSE 'negative' END AS predicted_class"""


@query("e14_error_rows", f"WITH {SWEEP} SELECT row_id, baseline, error_type, score, threshold, score_margin, {CLASSES} FROM errors")
def e14(spark, root):
    return errors(spark, root).select(*ERROR_COLUMNS)


def error_context(spark, root) -> DataFrame:
    docs = views.documents(spark, root)
    notes = docs.select(F.col("doc_id").alias("row_id"), (F.col("doc_id") % 50).alias("span_start_char"))
    answers = docs.filter("lang <> 'es'").select(F.col("doc_id").alias("question_id"), F.col("text").alias("generated_text"))
    reviews = views.table(spark, root, "labels").select(F.col("doc_id").alias("question_id"), "quality")
    return det.with_context(errors(spark, root), [(notes, "row_id"), (answers, "question_id"), (reviews, "question_id")])


EXCERPT = sql_collapse("""concat(CASE WHEN s > 110 THEN '...' ELSE '' END, substring(text, greatest(s - 110, 0) + 1, s - greatest(s - 110, 0)),
  '[[', substring(text, s + 1, 5), ']]', substring(text, s + 6, 110), CASE WHEN s + 115 < length(text) THEN '...' ELSE '' END)""")


@query(
    "j04_error_context",
    f"""WITH {SWEEP}, c AS (SELECT e.*, e.row_id % 50 AS s, n.doc_id AS note, d.text, l.quality FROM errors e
      LEFT JOIN documents n ON n.doc_id = e.row_id LEFT JOIN documents d ON d.doc_id = e.question_id AND d.lang <> 'es' LEFT JOIN labels l ON l.doc_id = e.question_id)
    SELECT row_id, baseline, error_type, CASE WHEN note IS NULL THEN 'row_id' WHEN text IS NULL OR quality IS NULL THEN 'question_id' END AS missing_context,
    CASE WHEN text IS NOT NULL THEN {EXCERPT} END AS excerpt FROM c""",
)
def j04(spark, root):
    start = F.col("span_start_char")
    return error_context(spark, root).select(
        "row_id", "baseline", "error_type", "missing_context",
        F.when(F.col("generated_text").isNotNull(), excerpt(F.col("generated_text"), start, start + 5, 110)).alias("excerpt"))


@query(
    "a22_error_group_counts",
    f"""WITH {SWEEP} SELECT baseline, error_type, 'fact_type' AS group_field, fact_type AS group_value, count(*) AS n FROM errors GROUP BY ALL
    UNION ALL SELECT baseline, error_type, 'question_type', question_type, count(*) FROM errors GROUP BY ALL""",
)
def a22(spark, root):
    return det.error_group_counts(errors(spark, root), ["fact_type", "question_type"])


@query(
    "a23_confusion_transitions",
    f"""WITH {SWEEP}, t AS (SELECT unnest(['negative->negative', 'negative->positive', 'positive->negative', 'positive->positive']) AS transition),
    f AS (SELECT baseline, concat(CASE WHEN y = 1 THEN 'positive' ELSE 'negative' END, '->', CASE WHEN predicted = 1 THEN 'positive' ELSE 'negative' END) AS transition FROM flagged WHERE split = 'test')
    SELECT b.baseline, t.transition, count(f.transition) AS n FROM (SELECT DISTINCT baseline FROM flagged) b CROSS JOIN t
    LEFT JOIN f ON f.baseline = b.baseline AND f.transition = t.transition GROUP BY ALL""",
)
def a23(spark, root):
    return det.transition_counts(flagged(spark, root).filter("split = 'test'"))


@query(
    "a23_error_totals",
    f"""WITH {SWEEP} SELECT baseline, count(*) FILTER (error_type = 'false_positive') AS false_positive_count,
    count(*) FILTER (error_type = 'false_negative') AS false_negative_count, count(*) AS error_count FROM errors GROUP BY baseline""",
)
def a23_totals(spark, root):
    return det.error_totals(errors(spark, root))


@query(
    "w14_top_n_per_bucket",
    f"""WITH {SWEEP} SELECT baseline, error_type, row_id, score_margin, example_rank FROM (SELECT *, row_number() OVER (
      PARTITION BY baseline, error_type ORDER BY abs(score_margin) DESC, row_id) AS example_rank FROM errors) WHERE example_rank <= 5""",
)
def w14(spark, root):
    picked = det.examples(errors(spark, root), ["baseline", "error_type"], 5, F.abs("score_margin"))
    return picked.select("baseline", "error_type", "row_id", "score_margin", "example_rank")


@query(
    "e15_detectors_by_role",
    f"""WITH {SWEEP}, {PAIRED}, r AS ((SELECT 1 AS o, 'best_auprc' AS role, baseline FROM paired ORDER BY test_auprc DESC, test_f1 DESC, baseline LIMIT 1)
      UNION ALL (SELECT 2, 'best_f1', baseline FROM paired ORDER BY test_f1 DESC, test_auprc DESC, baseline LIMIT 1)
      UNION ALL (SELECT 3, 'best_recall', baseline FROM paired ORDER BY test_recall DESC, test_f1 DESC, test_auprc DESC, baseline LIMIT 1))
    SELECT baseline, string_agg(role, '+' ORDER BY o) AS merged, arg_min(role, o) AS first_role FROM r GROUP BY baseline""",
)
def e15(spark, root):
    rows = compared(spark, root)
    picks = [(role, det.best_row(rows, m)) for role, m in [("best_auprc", "test_auprc"), ("best_f1", "test_f1"), ("best_recall", "test_recall")]]
    merged = det.selected_by_role(picks).withColumnRenamed("role", "merged")
    return merged.join(det.selected_by_role(picks, merge=False).withColumnRenamed("role", "first_role"), "baseline")


FAMILY_SQL = """CASE WHEN error_type = 'false_negative' THEN CASE WHEN question_type = 'top3_products_month' THEN 'confident_wrong_top3_ranked_item'
    WHEN fact_type IN ('product_name', 'product_stock_code') THEN 'confident_wrong_product_identity'
    WHEN fact_type IN ('currency_amount', 'percentage', 'malformed_number') THEN 'confident_wrong_numeric_value' ELSE 'confident_wrong_other_fact' END
  WHEN fact_type IN ('currency_amount', 'percentage') THEN 'correct_numeric_flagged_uncertain'
  WHEN fact_type IN ('month', 'product_name') THEN 'correct_context_fact_flagged_uncertain' ELSE 'correct_ranking_flagged_uncertain' END"""
CLASSIFIED = f"""classified AS (SELECT *, {FAMILY_SQL} AS error_family,
  round(CASE WHEN error_type = 'false_negative' THEN -score_margin ELSE score_margin END, 6) AS severity FROM errors)"""


def classified(spark, root) -> DataFrame:
    return errors(spark, root).withColumns({"error_family": det.error_family(), "severity": det.severity()})


@query("e16_error_family_severity", f"WITH {SWEEP}, {CLASSIFIED} SELECT row_id, baseline, error_family, severity FROM classified")
def e16(spark, root):
    return classified(spark, root).select("row_id", "baseline", "error_family", "severity")


def histogram_sql(value: str) -> str:
    return f"""(SELECT error_family, string_agg(concat(v, ':', n), '; ' ORDER BY n DESC, f) AS {value}_histogram FROM (
      SELECT error_family, {value} AS v, count(*) AS n, min(row_id) AS f FROM classified GROUP BY ALL) GROUP BY error_family)"""


HISTOGRAMS = ["error_type", "fact_type", "question_type"]


@query(
    "a24_error_family_statistics",
    f"""WITH {SWEEP}, {CLASSIFIED} SELECT * FROM (SELECT error_family, count(*) AS error_rows, count(DISTINCT row_id) AS distinct_spans,
      count(DISTINCT question_id) AS distinct_questions FROM classified GROUP BY error_family) """
    + " ".join(f"JOIN {histogram_sql(v)} USING (error_family)" for v in HISTOGRAMS),
)
def a24(spark, root):
    return det.family_statistics(classified(spark, root), HISTOGRAMS)


OUTCOME = """CASE WHEN y = 1 THEN CASE WHEN predicted = 1 THEN 'caught' ELSE 'missed' END ELSE CASE WHEN predicted = 1 THEN 'false alarm' ELSE 'cleared' END END"""
OUTCOMES = f"""outcomes AS (SELECT row_id, question_id, y, split, any_value(fact_type) AS fact_type, {', '.join(f"max(CASE WHEN baseline = '{b}' THEN {OUTCOME} END) AS {b}_outcome" for b in ('d1', 'd2', 'd4'))}
  FROM flagged GROUP BY row_id, question_id, y, split)"""
ANY = "(d1_outcome = 'missed' OR d2_outcome = 'missed' OR d4_outcome = 'missed')"
EVERY = "(d1_outcome = 'missed' AND d2_outcome = 'missed' AND d4_outcome = 'missed')"


def outcomes(spark, root) -> DataFrame:
    made = flagged(spark, root).withColumn("outcome", det.outcome(F.col("y"), F.col("predicted")))
    shown = ["d1", "d2", "d4"]
    wide = made.groupBy("row_id", "question_id", "y", "split", "fact_type").pivot("baseline", shown).agg(F.first("outcome"))
    missed = [F.col(b) == "missed" for b in shown]
    return wide.withColumns({"any_missed": missed[0] | missed[1] | missed[2], "all_missed": missed[0] & missed[1] & missed[2]})


@query(
    "e17_outcome_label",
    f"WITH {SWEEP}, {OUTCOMES} SELECT row_id, d1_outcome AS d1, d2_outcome AS d2, d4_outcome AS d4, {ANY} AS any_missed, {EVERY} AS all_missed FROM outcomes",
)
def e17(spark, root):
    return outcomes(spark, root).select("row_id", "d1", "d2", "d4", "any_missed", "all_missed")


@query(
    "e18_case_table",
    f"""WITH {SWEEP}, {OUTCOMES} SELECT question_id, count(*) OVER (PARTITION BY question_id) AS span_count, row_number() OVER (PARTITION BY question_id ORDER BY row_id) AS span_no,
    row_id, fact_type, d1_outcome AS d1, d2_outcome AS d2, d4_outcome AS d4 FROM outcomes""",
)
def e18(spark, root):
    return det.case_table(outcomes(spark, root)).select("question_id", "span_count", "span_no", "row_id", "fact_type", "d1", "d2", "d4")


@query(
    "a28_contradicted_miss_counts",
    f"""WITH {SWEEP}, {OUTCOMES} SELECT count(*) AS contradicted_spans, count(*) FILTER ({ANY}) AS any_missed, count(*) FILTER ({EVERY}) AS all_missed,
    count(*) FILTER (d1_outcome = 'missed') AS d1_missed, count(*) FILTER (d2_outcome = 'missed') AS d2_missed, count(*) FILTER (d4_outcome = 'missed') AS d4_missed
    FROM outcomes WHERE y = 1""",
)
def a28(spark, root):
    return outcomes(spark, root).filter("y = 1").agg(
        F.count("*").alias("contradicted_spans"), F.count_if("any_missed").alias("any_missed"), F.count_if("all_missed").alias("all_missed"),
        *[F.count_if(F.col(b) == "missed").alias(f"{b}_missed") for b in ("d1", "d2", "d4")])


# ---------------------------------------------------------------------------- maps


@query(
    "a15_group_count_maps",
    f"""WITH {FEATURES}, c AS (SELECT qid, label, count(*) AS n FROM annotations GROUP BY ALL)
    SELECT qid, string_agg(concat(label, ':', n), ',' ORDER BY label) AS counts FROM c GROUP BY qid""",
)
def a15(spark, root):
    maps = rollups.count_maps(annotations(spark, root), ["qid"], "label")
    entry = F.transform(F.map_entries("label_counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return maps.select("qid", F.array_join(F.array_sort(entry), ",").alias("counts"))


@query(
    "a16_merged_count_maps",
    f"""WITH {FEATURES}, c AS (SELECT lang, label, count(*) AS n FROM annotations JOIN generations USING (qid) GROUP BY ALL)
    SELECT lang, string_agg(concat(label, ':', n), ',' ORDER BY label) AS counts, CAST(sum(n) AS BIGINT) AS spans,
    round(CAST(sum(CASE WHEN label IN ('hallucinated_key_fact', 'unsupported_claim') THEN n ELSE 0 END) AS DOUBLE) / sum(n), 4) AS positive_rate FROM c GROUP BY lang""",
)
def a16(spark, root):
    """Question maps merged per language: the map entries are summed, not the rows."""
    maps = rollups.count_maps(annotations(spark, root), ["qid"], "label")
    langs = views.documents(spark, root).select(F.col("doc_id").cast("string").alias("qid"), "lang")
    merged = maps.join(langs, "qid").select("lang", F.explode("label_counts").alias("label", "n")).groupBy("lang", "label").agg(F.sum("n").alias("n"))
    item = F.array_sort(F.collect_list(F.concat_ws(":", "label", F.col("n").cast("string"))))
    positive = F.sum(F.when(F.col("label").isin(*det.POSITIVE), F.col("n")).otherwise(0))
    return merged.groupBy("lang").agg(
        F.array_join(item, ",").alias("counts"), F.sum("n").alias("spans"),
        F.round(positive.cast("double") / F.sum("n"), 4).alias("positive_rate"))


# -------------------------------------------------------------------------- checks


@query(
    "v05_range_and_finiteness",
    f"WITH {SWEEP}, seeded AS (SELECT * REPLACE (CASE WHEN baseline = 'd2' THEN f1 + 1 ELSE f1 END AS f1, CASE WHEN baseline = 'd3' THEN CAST('nan' AS DOUBLE) ELSE auroc END AS auroc) FROM report) "
    + " UNION ALL ".join(
        f"SELECT '{m}_in_range' AS check_name, count(*) FILTER (isnan({m}) OR {m} < 0 OR {m} > 1) = 0 AS passed, count(*) FILTER (isnan({m}) OR {m} < 0 OR {m} > 1) AS detail FROM seeded"
        for m in ("precision", "recall", "specificity", "f1", "accuracy", "auroc", "auprc")
    ),
)
def v05(spark, root):
    """A report with an F1 beyond one and one that isn't a number."""
    names, b = [*det.METRICS, "auroc", "auprc"], F.col("baseline")
    seeded = report(spark, root).withColumns(
        {"f1": F.when(b == "d2", F.col("f1") + 1).otherwise(F.col("f1")), "auroc": F.when(b == "d3", F.lit(float("nan"))).otherwise(F.col("auroc"))})
    return quality.violations(seeded, {f"{m}_in_range": quality.finite_between(m, 0, 1) for m in names})


@query(
    "v19_both_classes_per_split",
    f"""WITH {WIDE} SELECT split, count(*) AS row_count, CAST(sum(y) AS BIGINT) AS positive_count, count(*) - CAST(sum(y) AS BIGINT) AS negative_count,
    sum(y) > 0 AND sum(y) < count(*) AS passed FROM wide GROUP BY split""",
)
def v19(spark, root):
    counts = wide_scores(spark, root).groupBy("split").agg(F.count("*").alias("row_count"), F.sum("y").cast("bigint").alias("positive_count"))
    negative = F.col("row_count") - F.col("positive_count")
    return counts.withColumn("negative_count", negative).withColumn("passed", (F.col("positive_count") > 0) & (negative > 0))


def failing(check: str, condition: str, source: str) -> str:
    """A check row in SQL: how many rows of the source break the condition."""
    bad = f"count(*) FILTER (NOT coalesce({condition}, false))"
    return f"SELECT '{check}' AS check_name, {bad} = 0 AS passed, {bad} AS detail FROM {source}"


@query(
    "v20_confusion_consistency",
    f"""WITH {SWEEP}, seeded AS (SELECT * REPLACE (CASE WHEN baseline = 'd1' AND evaluated_split = 'test' THEN tp + 1 ELSE tp END AS tp,
      CASE WHEN baseline = 'd2' AND evaluated_split = 'test' THEN threshold + 0.5 ELSE threshold END AS threshold,
      CASE WHEN baseline = 'd3' THEN 'test' ELSE threshold_source_split END AS threshold_source_split) FROM report),
    joined AS (SELECT t.*, d.threshold AS dev_threshold, n FROM seeded t JOIN seeded d ON t.baseline = d.baseline AND t.evaluated_split = 'test' AND d.evaluated_split = 'dev'
      JOIN (SELECT baseline, count(*) AS n FROM scores WHERE split = 'test' GROUP BY 1) r ON r.baseline = t.baseline)
    {failing('counts_add_up', 'tp + fp + tn + fn = n', 'joined')} UNION ALL {failing('threshold_reused', 'threshold = dev_threshold', 'joined')}
    UNION ALL {failing('source_is_dev', "threshold_source_split = 'dev'", 'joined')}""",
)
def v20(spark, root):
    """A report with one count, one threshold and one threshold source that are wrong."""
    b, test = F.col("baseline"), F.col("evaluated_split") == "test"
    seeded = report(spark, root).withColumns({
        "tp": F.when((b == "d1") & test, F.col("tp") + 1).otherwise(F.col("tp")),
        "threshold": F.when((b == "d2") & test, F.col("threshold") + 0.5).otherwise(F.col("threshold")),
        "threshold_source_split": F.when(b == "d3", "test").otherwise(F.col("threshold_source_split"))})
    pairs, _ = det.paired_metrics(seeded)
    rows = scores(spark, root).filter("split = 'test'").groupBy("baseline").agg(F.count("*").alias("rows"))
    t, d = F.col("test"), F.col("dev")
    return quality.violations(
        pairs.join(rows, "baseline"),
        {
            "counts_add_up": t["tp"] + t["fp"] + t["tn"] + t["fn"] == F.col("rows"),
            "threshold_reused": t["threshold"] == d["threshold"],
            "source_is_dev": t["threshold_source_split"] == "dev",
        },
    )


@query(
    "v21_error_row_consistency",
    f"""WITH {SWEEP}, seeded AS (SELECT *, CASE WHEN row_id % 7 = 0 THEN -score_margin ELSE score_margin END AS m, CASE WHEN row_id % 11 = 0 THEN 1 - y ELSE y END AS class_ FROM errors),
    counted AS (SELECT baseline, count(*) FILTER (error_type = 'false_positive') AS fps, count(*) FILTER (error_type = 'false_negative') AS fns FROM errors WHERE baseline <> 'd1' OR row_id % 13 <> 0 GROUP BY 1),
    totals AS (SELECT * FROM report JOIN counted USING (baseline) WHERE evaluated_split = 'test')
    {failing('margin_sign', "CASE WHEN error_type = 'false_negative' THEN m < 0 ELSE m >= 0 END", 'seeded')}
    UNION ALL {failing('type_fits_classes', "(error_type = 'false_negative') = (class_ = 1)", 'seeded')}
    UNION ALL {failing('totals_match', 'fp = fps AND fn = fns', 'totals')}""",
)
def v21(spark, root):
    """Error rows with some margins and classes turned round, and with rows of one detector lost."""
    c = F.col
    turned = F.when(c("actual_class") == "positive", "negative").otherwise("positive")
    found = errors(spark, root)
    bad = found.withColumns({
        "score_margin": F.when(c("row_id") % 7 == 0, -c("score_margin")).otherwise(c("score_margin")),
        "actual_class": F.when(c("row_id") % 11 == 0, turned).otherwise(c("actual_class"))})
    sign = F.when(c("error_type") == "false_negative", c("score_margin") < 0).otherwise(c("score_margin") >= 0)
    fits = F.when(c("error_type") == "false_negative", c("actual_class") == "positive").otherwise(c("actual_class") == "negative")
    tested = report(spark, root).filter("evaluated_split = 'test'").select("baseline", "fp", "fn")
    totals = det.error_totals(found.filter("baseline <> 'd1' OR row_id % 13 <> 0")).join(tested, "baseline")
    agree = (c("fp") == c("false_positive_count")) & (c("fn") == c("false_negative_count"))
    return quality.violations(bad, {"margin_sign": sign, "type_fits_classes": fits}).unionByName(
        quality.violations(totals, {"totals_match": agree}))
