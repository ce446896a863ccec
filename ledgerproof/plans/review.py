"""Review, queue, packet and lock tables, label audits and cross-table checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerproof.operators import detectors as det
from ledgerproof.operators import gold, prompts, quality, review
from ledgerproof.plans import views
from ledgerproof.plans.checking import ANSWERS, answers, reviewed
from ledgerproof.plans.detectors import SWEEP, errors, wide_scores
from ledgerproof.plans.gold import questions
from ledgerproof.plans.prompts import POLICY_SQL, noted
from ledgerproof.plans.register import query
from ledgerproof.plans.spans import TOKENS, annotations, annotations_of, generations_of, pick, segments_of
from ledgerproof.plans.views import sql_mean
from ledgerproof.session import durable

TOKEN_LIMIT = 40


# ------------------------------------------------------------------ selection and sets


@query(
    "j09_selection_by_id_list",
    """SELECT event_id AS pos, user_id, c_name, c_name IS NOT NULL AS found FROM (SELECT event_id, user_id * 20 AS user_id FROM events) LEFT JOIN customer ON c_custkey = user_id""",
)
def j09(spark, root):
    ids = views.table(spark, root, "events").select(F.col("event_id").alias("pos"), (F.col("user_id") * 20).alias("user_id"))
    people = views.table(spark, root, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    found = review.select_by_ids(people, ids, "user_id").withColumn("found", F.lit(True))
    lost = review.missing_ids(people, ids, "user_id").withColumn("c_name", F.lit(None).cast("string")).withColumn("found", F.lit(False))
    return found.unionByName(lost)


@query(
    "u03_distinct_key_union",
    "SELECT doc_id FROM documents WHERE lang = 'fr' UNION SELECT doc_id FROM labels",
)
def u03(spark, root):
    french = views.documents(spark, root).filter("lang = 'fr'").select("doc_id")
    return french.union(views.table(spark, root, "labels").select("doc_id")).distinct()


@query(
    "u04_key_set_relations",
    """WITH a AS (SELECT DISTINCT doc_id AS k FROM labels), b AS (SELECT DISTINCT doc_id AS k FROM documents WHERE lang <> 'fr'),
    n AS (SELECT (SELECT count(*) FROM a) AS l, (SELECT count(*) FROM b) AS r, (SELECT count(*) FROM a JOIN b USING (k)) AS i)
    SELECT unnest(['left', 'right', 'union', 'intersection', 'left_only', 'right_only', 'left_is_subset', 'equal']) AS relation,
    unnest([l, r, l + r - i, i, l - i, r - i, CAST(l = i AS BIGINT), CAST(l = i AND r = i AS BIGINT)]) AS n FROM n""",
)
def u04(spark, root):
    spoken = views.documents(spark, root).filter("lang <> 'fr'")
    return review.key_sets(views.table(spark, root, "labels"), spoken, "doc_id")


@query("j12_first_fact_by_field", f"WITH {ANSWERS} SELECT question_id, min(display_value) AS display_value FROM facts WHERE field = 'net_revenue' GROUP BY question_id")
def j12(spark, root):
    fact = review.first_fact(F.col("gold_facts"), F.lit("net_revenue"))
    found = questions(spark, root).select("question_id", fact["display_value"].alias("display_value"))
    return found.filter("display_value IS NOT NULL")


# ------------------------------------------------------------------------ review table

REVIEW = f"""
{ANSWERS},
review AS (SELECT *, CASE WHEN (held AND auto_status <> 'likely_correct') OR contains(coalesce(error_types, ''), 'malformed') OR tokens >= {TOKEN_LIMIT} THEN 'high'
    WHEN held OR auto_status <> 'likely_correct' THEN 'medium' ELSE 'low' END AS annotation_priority,
  CASE WHEN missing_fields IS NULL AND error_types IS NULL THEN 'confirm correct key facts and unsupported extra claims' ELSE concat_ws(' | ',
    'check fields: ' || array_to_string(string_split(missing_fields, ', ')[1:6], ', '), 'error types: ' || array_to_string(string_split(error_types, ', ')[1:6], ', '),
    CASE WHEN tokens >= {TOKEN_LIMIT} THEN 'answer hit max_new_tokens; inspect truncation' END) END AS suggested_annotation_focus,
  CASE WHEN held THEN 'heldout_annotation' ELSE 'train_annotation' END AS annotation_batch FROM (
    SELECT r.*, q.split, q.split IN ('dev', 'test') AS held, q.question_type, q.ord, q.difficulty, concat('p_', substring(question_id, 3)) AS prompt_id, {POLICY_SQL} AS row_order_policy,
    len(regexp_extract_all(generated_text, '[^ ]+')) AS tokens FROM reviewed r JOIN questions q USING (question_id) JOIN answers a USING (question_id))),
queued AS (SELECT *, row_number() OVER (ORDER BY queue_phase, CAST(string_split(question_id, '_')[2] AS BIGINT)) AS queue_rank FROM (
  SELECT *, CASE WHEN held AND annotation_priority = 'high' THEN 'phase_1_heldout_high' WHEN held THEN 'phase_2_heldout_remaining'
    WHEN annotation_priority = 'high' THEN 'phase_3_train_high' ELSE 'phase_4_train_remaining' END AS queue_phase FROM review))
""".replace("q.question_type, q.ord, q.difficulty, concat('p_', substring(question_id, 3)) AS prompt_id, CASE WHEN question_type", "q.question_type, q.ord, q.difficulty, concat('p_', substring(question_id, 3)) AS prompt_id, CASE WHEN q.question_type").replace(
    "WHEN question_type IN ('top_country_month', 'country_comparison_month') THEN 'alphabetical_by_country'\n  WHEN question_type =", "WHEN q.question_type IN ('top_country_month', 'country_comparison_month') THEN 'alphabetical_by_country'\n  WHEN q.question_type =")


def review_of(asked: DataFrame, partial: tuple[str, str]) -> DataFrame:
    made = prompts.prompts(asked, *partial)
    words = F.size(F.regexp_extract_all("generated_text", F.lit("([^ ]+)"), F.lit(1))).cast("bigint")
    return review.review_table(reviewed(asked).withColumn("generated_token_count", words), made, TOKEN_LIMIT)


R1 = ["question_id", "prompt_id", "row_order_policy", "auto_status", "annotation_priority", "suggested_annotation_focus", "annotation_batch"]


@query("r01_review_table", f"WITH {REVIEW} SELECT {', '.join(R1)}, tokens AS generated_token_count FROM review")
def r01(spark, root):
    return review_of(questions(spark, root), noted(spark, root)).select(*R1, "generated_token_count")


TEMPLATE = """concat('{"annotation_id":"ann_', question_id, '_001","confidence":"","fact_type":"","label":"","notes":"","prompt_id":"', prompt_id, '","question_id":"', question_id,
  '","reason":"","span_end_char":null,"span_start_char":null,"span_text":""}')"""


@query(
    "r02_annotation_queue",
    f"WITH {REVIEW} SELECT queue_rank, queue_phase, question_id, queue_phase = 'phase_1_heldout_high' AS is_initial_batch, {TEMPLATE} AS annotation_record_template_json FROM queued",
)
def r02(spark, root):
    queue = review.annotation_queue(review_of(questions(spark, root), noted(spark, root)))
    return queue.select("queue_rank", "queue_phase", "question_id", "is_initial_batch", "annotation_record_template_json")


@query(
    "w16_priority_queue_order",
    """SELECT o_orderkey, queue_phase, row_number() OVER (ORDER BY queue_phase, o_orderkey) AS queue_rank FROM (SELECT o_orderkey,
    CASE WHEN o_orderstatus <> 'O' AND o_orderpriority = '1-URGENT' THEN 'phase_1_heldout_high' WHEN o_orderstatus <> 'O' THEN 'phase_2_heldout_remaining'
    WHEN o_orderpriority = '1-URGENT' THEN 'phase_3_train_high' ELSE 'phase_4_train_remaining' END AS queue_phase FROM orders)""",
)
def w16(spark, root):
    rows = views.table(spark, root, "orders").select(
        F.concat(F.lit("o_"), "o_orderkey").alias("question_id"), "o_orderkey", F.lit("").alias("prompt_id"),
        F.when(F.col("o_orderstatus") != "O", "dev").otherwise("train").alias("split"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("low").alias("annotation_priority"))
    return review.annotation_queue(rows).select("o_orderkey", "queue_phase", "queue_rank")


@query(
    "w17_sequential_ids",
    "SELECT doc_id, format('confirm_{:03d}', row_number() OVER (ORDER BY source, doc_id)) AS item_id FROM documents",
)
def w17(spark, root):
    docs = views.documents(spark, root).select("doc_id", "source")
    return review.sequential_ids(docs, [F.col("source"), F.col("doc_id")], "confirm_%03d", "item_id").select("doc_id", "item_id")


COUNTED = ["auto_status", "annotation_priority", "annotation_batch"]


@query(
    "a33_status_counts",
    f"WITH {REVIEW} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM review GROUP BY {c}" for c in COUNTED),
)
def a33(spark, root):
    return review.column_counts(review_of(questions(spark, root), noted(spark, root)), COUNTED)


@query(
    "a30_run_summary",
    f"""SELECT role, count(*) AS record_count, CAST(sum(length(text)) AS BIGINT) AS total_generated_tokens, {sql_mean('t', 3)} AS avg_elapsed_seconds
    FROM (SELECT *, CAST(length(text) AS DECIMAL(18,3)) / 1000 AS t FROM conversations) GROUP BY role""",
)
def a30(spark, root):
    runs = views.table(spark, root, "conversations").select(
        "role", F.length("text").cast("bigint").alias("generated_token_count"), (F.length("text").cast("decimal(18,3)") / 1000).alias("elapsed_seconds"))
    return review.run_summary(runs, ["role"])


THEMES = {
    "net_revenue_reconciliation": ["monthly_revenue_change", "country_comparison_month", "return_impact_month"],
    "returns_impact": ["return_impact_month", "product_revenue_share_month"],
    "product_concentration": ["top_product_month", "top3_products_month", "product_revenue_share_month"],
    "country_exposure": ["top_country_month", "country_comparison_month"],
}
THEME_VALUES = ", ".join(f"('{t}', '{q}')" for t, qs in THEMES.items() for q in qs)
THEMED = f"WITH {ANSWERS}, themes(theme, kind) AS (VALUES {THEME_VALUES}), tagged AS (SELECT theme, question_id, question_type FROM questions JOIN themes ON kind = question_type)"


@query("a32_theme_coverage", f"{THEMED} SELECT theme, count(*) AS coverage FROM tagged GROUP BY theme")
def a32(spark, root):
    return review.theme_coverage(questions(spark, root), THEMES)[0]


@query(
    "a32_theme_examples",
    f"{THEMED} SELECT * FROM (SELECT theme, row_number() OVER (PARTITION BY theme ORDER BY question_id) AS example_rank, question_id, question_type FROM tagged) WHERE example_rank <= 3",
)
def a32_examples(spark, root):
    return review.theme_coverage(questions(spark, root), THEMES)[1]


# ------------------------------------------------------------------- span annotations


def specs(asked: DataFrame) -> DataFrame:
    """Every fact's display text, first and second occurrence, as a labelled phrase."""
    facts = gold.gold_fact_rows(asked)
    each = facts.withColumn("occurrence", F.explode(F.array(F.lit(1), F.lit(2))))
    return each.select(
        "question_id", (F.col("fact_ord") * 10 + F.col("occurrence")).alias("spec_ord"), F.col("display_value").alias("span_text"), "occurrence",
        F.col("field").alias("gold_field"), "fact_type", F.lit("correct_key_fact").alias("label"),
        F.lit("The gold value is {gold_display}.").alias("reason_template"), F.concat(F.lit("draft_round"), F.col("occurrence").cast("string")).alias("notes"))


R3 = ["annotation_id", "span_text", "span_start_char", "span_end_char", "reason", "failure"]
SPECS = f"""
{ANSWERS},
specs AS (SELECT question_id, question_type, fact_type, fact_ord * 10 + o AS spec_ord, display_value AS span_text, o AS occurrence, concat('draft_round', o) AS notes FROM facts, (VALUES (1), (2)) AS v(o)),
spotted AS (SELECT s.*, generated_text, string_split(generated_text, span_text) AS parts FROM specs s JOIN answers USING (question_id)),
made AS (SELECT *, concat('ann_', question_id, '_', lpad(CAST(row_number() OVER (PARTITION BY question_id ORDER BY spec_ord) AS VARCHAR), 3, '0')) AS annotation_id,
  CASE WHEN len(parts) > occurrence THEN CAST(list_sum(list_transform(parts[1:occurrence], lambda x: length(x))) + (occurrence - 1) * length(span_text) AS BIGINT) END AS span_start_char FROM spotted)
"""


def spec_annotations(asked: DataFrame) -> DataFrame:
    return review.annotations_from_specs(specs(asked), answers(asked), asked)


@query(
    "r03_annotations_from_specs",
    f"""WITH {SPECS} SELECT annotation_id, span_text, span_start_char, span_start_char + length(span_text) AS span_end_char,
    concat('The gold value is ', span_text, '.') AS reason, CASE WHEN span_start_char IS NULL THEN 'phrase not found' END AS failure FROM made""",
)
def r03(spark, root):
    return spec_annotations(questions(spark, root)).select(*R3)


@query(
    "r04_annotation_preview",
    f"""WITH {SPECS} SELECT annotation_id, split, m.question_type, CASE WHEN occurrence = 2 THEN 'draft_round2' ELSE 'draft_round1' END AS source_batch
    FROM made m JOIN questions USING (question_id)""",
)
def r04(spark, root):
    asked = questions(spark, root)
    batch = review.source_batch("ann_seed_", ["draft_round4", "draft_round3", "draft_round2"], "draft_round1")
    return spec_annotations(asked).join(asked.select("question_id", "split", "question_type"), "question_id").select(
        "annotation_id", "split", "question_type", batch.alias("source_batch"))


# -------------------------------------------------------------------- packet and locks

PACKET = f"""
{SWEEP},
examples AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY baseline, error_type ORDER BY abs(score_margin) DESC, row_id) AS example_rank FROM errors) WHERE example_rank <= 5),
regressions AS (SELECT row_id FROM wide WHERE fact_type = 'ranking' AND question_type = 'top3_products_month'),
packet AS (SELECT w.*, e.roles, e.roles IS NOT NULL AS has_error_example, r.row_id IS NOT NULL AS is_offset_regression,
  format('confirm_{{:03d}}', row_number() OVER (ORDER BY w.row_id)) AS confirmation_item_id FROM wide w
  LEFT JOIN (SELECT row_id, string_agg(concat_ws(' ', error_type, 'via', baseline), '; ' ORDER BY baseline, error_type, example_rank) AS roles FROM examples GROUP BY row_id) e USING (row_id)
  LEFT JOIN regressions r ON r.row_id = w.row_id WHERE e.roles IS NOT NULL OR r.row_id IS NOT NULL)
"""


def packet(spark, root) -> DataFrame:
    picked = det.examples(errors(spark, root), ["baseline", "error_type"], 5, F.abs("score_margin"))
    spans = wide_scores(spark, root).select("row_id", "question_id", "split", "y", "fact_type", "question_type")
    regressions = spans.filter("fact_type = 'ranking' AND question_type = 'top3_products_month'")
    return review.confirmation_packet(picked, regressions, spans)


@query(
    "r05_confirmation_packet",
    f"""WITH {PACKET} SELECT confirmation_item_id, row_id, is_offset_regression, has_error_example, concat_ws(',', CASE WHEN has_error_example THEN 'detector_error_example' END,
    CASE WHEN is_offset_regression THEN 'offset_regression_check' END, CASE WHEN question_type = 'top3_products_month' THEN 'top3_confident_miss_pattern' END,
    CASE WHEN fact_type = 'currency_amount' THEN 'currency_amount_pattern' END) AS focus_tags,
    CAST(4 + CAST(has_error_example AS INTEGER) + CAST(is_offset_regression AS INTEGER) AS BIGINT) AS checklist_items FROM packet""",
)
def r05(spark, root):
    return packet(spark, root).select(
        "confirmation_item_id", "row_id", "is_offset_regression", "has_error_example", F.array_join("focus_tags", ",").alias("focus_tags"), "checklist_items")


USES = ["paired_contrast_example", "strong_false_negative_example", "span_level_caveat", "offset_check_only", "supporting"]
SQL_USES = "[" + ", ".join(f"'{u}'" for u in USES) + "]"


def notes(spark, root, splits: tuple[str, ...] = ("test",)) -> DataFrame:
    """Reviewer notes for every span of these splits."""
    return wide_scores(spark, root).filter(F.col("split").isin(*splits)).select(
        "row_id", pick(USES, (F.col("row_id") / 5 % 5).cast("int")).alias("presentation_use"),
        F.lit("none").alias("source_action"), F.lit("label_supported").alias("label_verdict"))


NOTES = f"notes AS (SELECT row_id, {SQL_USES}[row_id // 5 % 5 + 1] AS presentation_use FROM wide WHERE split = 'test')"


@query(
    "r06_review_note_coverage",
    f"""WITH {PACKET}, {NOTES} SELECT p.row_id, coalesce(roles, 'No detector-error row; offset check only.') AS detector_role_text, presentation_use,
      CASE WHEN n.row_id IS NULL THEN 'missing_note' END AS gap FROM packet p LEFT JOIN notes n USING (row_id)
    UNION ALL SELECT row_id, NULL, presentation_use, 'extra_note' FROM notes WHERE row_id NOT IN (SELECT row_id FROM packet)""",
)
def r06(spark, root):
    items, said = packet(spark, root), notes(spark, root).select("row_id", "presentation_use")
    gaps = review.coverage_gaps(items, said, "row_id")
    text = review.detector_role_text(F.col("detector_roles"))
    joined = items.select("row_id", text.alias("detector_role_text")).join(said, "row_id", "full").join(gaps, "row_id", "left")
    return joined.select("row_id", "detector_role_text", "presentation_use", "gap")


def case(table: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE presentation_use {whens} ELSE '{default}' END"


@query(
    "r07_lock_decisions",
    f"""WITH {PACKET}, {NOTES.replace(" WHERE split = 'test'", "")} SELECT row_id, presentation_use IS NOT NULL AS labels_locked, {case(review.PUBLISH_USE, 'supporting_detail')} AS publish_use,
    {case(review.LOCK_REASON, 'Locked after assistant full review.')} AS lock_reason, presentation_use = 'span_level_caveat' AS span_level_caveat FROM packet LEFT JOIN notes USING (row_id)""",
)
def r07(spark, root):
    rows = packet(spark, root).join(notes(spark, root, ("train", "dev", "test")), "row_id", "left")
    return review.lock_decisions(rows).select("row_id", "labels_locked", "publish_use", "lock_reason", "span_level_caveat")


@query(
    "r08_resolved_decisions",
    f"""WITH {TOKENS}, d AS (SELECT doc_id AS decision_id, concat('ann_', doc_id, '_', p) AS annotation_id, 'correct_key_fact' AS expected_label
      FROM documents, (VALUES ('000000'), ('000002'), ('000004')) AS v(p))
    SELECT decision_id, d.annotation_id, expected_label, label AS actual_label FROM d LEFT JOIN annotations a USING (annotation_id)
    WHERE label IS DISTINCT FROM expected_label""",
)
def r08(spark, root):
    name = lambda p: F.concat(F.lit("ann_"), F.col("doc_id").cast("string"), F.lit(f"_{p}"))
    decisions = views.documents(spark, root).select(
        F.col("doc_id").alias("decision_id"), F.lit("correct_key_fact").alias("expected_label"),
        F.array(name("000000"), name("000002"), name("000004")).alias("annotation_ids"))
    return review.decision_mismatches(decisions, annotations(spark, root))


# ------------------------------------------------------------------------------ audits

KINDS = {"en": "top3_products_month", "fr": "product_revenue_share_month"}


def asked_documents(spark, root) -> DataFrame:
    kind = F.when(F.col("lang") == "en", KINDS["en"]).when(F.col("lang") == "fr", KINDS["fr"]).otherwise("top_country_month")
    return views.documents(spark, root).select(
        F.col("doc_id").cast("string").alias("question_id"), kind.alias("question_type"), F.col("source").alias("split"))


def audited(spark, root) -> DataFrame:
    return as_audited(annotations(spark, root))


def as_audited(spans: DataFrame) -> DataFrame:
    kinds = ["currency_amount", "product_name", "ranking"]
    return spans.withColumnRenamed("qid", "question_id").withColumns(
        {
            "reference_fact_type": pick(kinds, F.length("span_text") % 3),
            "notes": F.when(F.length("span_text") % 2 == 0, "list_rank_marker").otherwise("seen"),
            "fact_type": F.when(F.length("span_text") % 7 == 0, "percentage").otherwise(F.col("fact_type")),
        })


AUDIT = f"""
{TOKENS},
asked AS (SELECT CAST(doc_id AS VARCHAR) AS question_id, source AS split, CASE lang WHEN 'en' THEN '{KINDS["en"]}' WHEN 'fr' THEN '{KINDS["fr"]}' ELSE 'top_country_month' END AS question_type FROM documents),
spans AS (SELECT * REPLACE (CASE WHEN length(span_text) % 7 = 0 THEN 'percentage' ELSE fact_type END AS fact_type), qid AS question_id, ['currency_amount', 'product_name', 'ranking'][length(span_text) % 3 + 1] AS reference_fact_type FROM annotations),
per_question AS (SELECT question_id, count(*) AS span_count, count(*) FILTER (label = 'correct_key_fact') AS negative_span_count,
  count(*) FILTER (label IN ('hallucinated_key_fact', 'unsupported_claim')) AS positive_span_count, count(*) FILTER (label IN ('ambiguous_or_unverifiable', 'ignore')) AS excluded_span_count,
  {', '.join(f"count(*) FILTER (label = '{x}') AS {x}" for x in review.LABELS)}, string_agg(DISTINCT fact_type, '|' ORDER BY fact_type) AS fact_types,
  count(*) FILTER (fact_type = 'ranking') AS ranked, count(*) FILTER (fact_type = 'percentage') AS percentages FROM spans GROUP BY question_id)
"""


#: Splits that must have positives; no question is in the last.
AUDITED_SPLITS = ["src0", "src7", "src19", "held_back"]


def traced_documents(spark, root) -> DataFrame:
    """The documents with the file that each came from. Every ninth came late, by another file."""
    docs = views.documents(spark, root).select("doc_id", "lang", "text", F.col("_metadata.file_path").alias("source_file"))
    late = durable(docs.filter("doc_id % 9 = 0").drop("source_file"))
    return docs.filter("doc_id % 9 <> 0").unionByName(late.select("*", F.col("_metadata.file_path").alias("source_file")))


@query(
    "r09_policy_flags",
    f"""WITH {AUDIT} SELECT question_id, annotation_id, 'failure' AS severity, 'unexpected_source_file' AS rule FROM spans WHERE CAST(question_id AS BIGINT) % 9 = 0
    UNION ALL SELECT split, NULL, 'failure', 'split_has_no_positive_spans' FROM (SELECT unnest({AUDITED_SPLITS}) AS split) WHERE split NOT IN (
      SELECT split FROM asked JOIN per_question USING (question_id) WHERE positive_span_count > 0)
    UNION ALL SELECT question_id, annotation_id, 'warning', 'gold_reference_fact_type_mismatch' FROM spans WHERE reference_fact_type <> fact_type
    UNION ALL SELECT question_id, annotation_id, 'info', 'bare_rank_marker_allowed' FROM spans WHERE fact_type = 'ranking' AND length(span_text) % 2 = 0 AND regexp_matches(trim(span_text), '(?i)^\\*{{0,2}}\\d+(?:st|nd|rd|th)?[.)]?\\*{{0,2}}$')
    UNION ALL SELECT question_id, NULL, 'warning', 'correct_only_question' FROM per_question WHERE positive_span_count = 0
    UNION ALL SELECT question_id, NULL, 'warning', 'no_correct_key_fact' FROM per_question WHERE negative_span_count = 0
    UNION ALL SELECT question_id, NULL, 'warning', 'unsupported_claim_review' FROM per_question WHERE unsupported_claim > 0
    UNION ALL SELECT question_id, NULL, 'warning', 'top3_without_ranking_span' FROM per_question JOIN asked USING (question_id) WHERE question_type = '{KINDS["en"]}' AND ranked = 0
    UNION ALL SELECT question_id, NULL, 'warning', 'share_question_without_percentage' FROM per_question JOIN asked USING (question_id) WHERE question_type = '{KINDS["fr"]}' AND percentages = 0""",
)
def r09(spark, root):
    cut = durable(segments_of(generations_of(traced_documents(spark, root), "source_file"), "source_file"))
    spans = as_audited(annotations_of(cut, "source_file"))
    return review.policy_flags(spans, asked_documents(spark, root), "/documents.parquet", AUDITED_SPLITS)


COVERAGE = ["span_count", "negative_span_count", "positive_span_count", "excluded_span_count", *review.LABELS]


def coverage(spark, root) -> DataFrame:
    return review.question_coverage(asked_documents(spark, root), audited(spark, root))


@query(
    "a20_question_coverage",
    f"WITH {AUDIT} SELECT question_id, question_type, split, coalesce(fact_types, '') AS fact_types, {', '.join(f'coalesce({c}, 0) AS {c}' for c in COVERAGE)} FROM asked LEFT JOIN per_question USING (question_id)",
)
def a20(spark, root):
    return coverage(spark, root).select("question_id", "question_type", "split", "fact_types", *COVERAGE)


@query(
    "a20_fact_type_coverage",
    f"""WITH {AUDIT} SELECT fact_type, count(DISTINCT question_id) AS question_count, count(*) AS span_count, count(*) FILTER (label = 'correct_key_fact') AS negative_span_count,
    count(*) FILTER (label IN ('hallucinated_key_fact', 'unsupported_claim')) AS positive_span_count, count(*) FILTER (label IN ('ambiguous_or_unverifiable', 'ignore')) AS excluded_span_count,
    {', '.join(f"count(*) FILTER (label = '{x}') AS {x}" for x in review.LABELS)} FROM spans GROUP BY fact_type""",
)
def a20_facts(spark, root):
    return review.fact_type_coverage(audited(spark, root))


@query(
    "a20_question_type_coverage",
    f"""WITH {AUDIT} SELECT question_type, count(*) AS question_count, {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}' for c in COVERAGE[:4])}
    FROM asked LEFT JOIN per_question USING (question_id) GROUP BY question_type""",
)
def a20_types(spark, root):
    return review.type_coverage(coverage(spark, root))


RARE_KIND = "median_order_month"


def pilot(spark, root) -> tuple[DataFrame, DataFrame]:
    """Coverage of the annotated questions, one of them of a type of its own, and the ids that were
    to be annotated: not every eleventh document, and names that no document has."""
    rare = F.when(F.col("question_id") == "7", RARE_KIND).otherwise(F.col("question_type"))
    annotated = coverage(spark, root).withColumn("question_type", rare)
    docs = views.documents(spark, root)
    wanted = docs.filter("doc_id % 11 <> 0").select(F.col("doc_id").cast("string").alias("question_id"))
    return annotated, wanted.unionByName(docs.filter("doc_id % 13 = 0").select(F.concat(F.lit("lost_"), "doc_id").alias("question_id")))


PILOT = f"""
{AUDIT},
pilot AS (SELECT * REPLACE (CASE WHEN question_id = '7' THEN '{RARE_KIND}' ELSE question_type END AS question_type) FROM asked),
gaps AS (SELECT concat('lost_', doc_id) AS question_id, 'missing' AS gap FROM documents WHERE doc_id % 13 = 0
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'extra' FROM documents WHERE doc_id % 11 = 0),
few AS (SELECT question_type, count(*) AS question_count FROM pilot GROUP BY 1 HAVING count(*) < 2)
"""


@query("a21_missing_and_extra_ids", f"WITH {PILOT} SELECT question_id, gap FROM gaps")
def a21_ids(spark, root):
    annotated, wanted = pilot(spark, root)
    return quality.id_differences(wanted, annotated, "question_id")


@query("a21_thin_question_types", f"WITH {PILOT} SELECT question_type, question_count FROM few")
def a21_types(spark, root):
    return review.thin_question_types(pilot(spark, root)[0])


@query(
    "a21_balance_and_warnings",
    f"""WITH {PILOT}, t AS (SELECT sum(span_count) AS spans, sum(positive_span_count) AS p, sum(negative_span_count) AS n, sum(unsupported_claim) AS u FROM per_question),
    thin AS (SELECT count(*) FILTER (coalesce(span_count, 0) < 3) AS thin, count(DISTINCT split) AS splits FROM asked LEFT JOIN per_question USING (question_id)),
    rare AS (SELECT count(*) AS rare FROM (SELECT 1 FROM spans GROUP BY fact_type HAVING count(*) < 5)),
    lists AS (SELECT count(*) FILTER (gap = 'missing') AS missing, count(*) FILTER (gap = 'extra') AS extra, (SELECT count(*) FROM few) AS few FROM gaps),
    m AS (SELECT *, round(CAST(least(p, n) AS DOUBLE) / greatest(p, n), 4) AS balance FROM t, thin, rare, lists)
    SELECT unnest(['no_missing_questions', 'no_extra_questions', 'at_least_100_spans', 'both_classes', 'three_spans_per_question', 'class_balance', 'unsupported_claims_rare', 'qualitative_fact_types', 'two_questions_per_type', 'single_split']) AS rule,
    unnest(['failure', 'failure', 'failure', 'failure', 'failure', 'warning', 'warning', 'warning', 'warning', 'warning']) AS level,
    unnest([missing > 0, extra > 0, spans < 100, p = 0 OR n = 0, thin > 0, balance < 0.5, u < 5, rare > 0, few > 0, splits = 1]) AS broken,
    unnest([CAST(missing AS DOUBLE), CAST(extra AS DOUBLE), CAST(spans AS DOUBLE), CAST(least(p, n) AS DOUBLE), CAST(thin AS DOUBLE), balance, CAST(u AS DOUBLE), CAST(rare AS DOUBLE), CAST(few AS DOUBLE), CAST(splits AS DOUBLE)]) AS measure FROM m""",
)
def a21(spark, root):
    annotated, wanted = pilot(spark, root)
    gaps = quality.id_differences(wanted, annotated, "question_id")
    return review.coverage_rules(annotated, review.fact_type_coverage(audited(spark, root)), gaps)


# ------------------------------------------------------------------------------ checks


@query(
    "v03_references_both_ways",
    """SELECT 'order_customer_left' AS check_name, count(*) = 0 AS passed, count(*) AS detail FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
    UNION ALL SELECT 'order_customer_right', count(*) = 0, count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def v03(spark, root):
    orders = views.table(spark, root, "orders").select(F.col("o_custkey").alias("k"))
    return quality.references(orders, views.table(spark, root, "customer").select(F.col("c_custkey").alias("k")), ["k"], "order_customer")


@query(
    "v12_field_equality",
    """WITH r AS (SELECT doc_id, CAST(length(text) AS VARCHAR) AS n_chars, CASE WHEN lang = 'es' THEN 'ES' ELSE lang END AS lang FROM documents)
    SELECT d.doc_id, 'n_chars' AS field, CAST(d.n_chars AS VARCHAR) AS left_value, r.n_chars AS right_value FROM documents d JOIN r USING (doc_id) WHERE CAST(d.n_chars AS VARCHAR) IS DISTINCT FROM r.n_chars
    UNION ALL SELECT d.doc_id, 'lang', d.lang, r.lang FROM documents d JOIN r USING (doc_id) WHERE d.lang IS DISTINCT FROM r.lang""",
)
def v12(spark, root):
    docs = views.documents(spark, root)
    again = docs.select("doc_id", F.length("text").alias("n_chars"), F.when(F.col("lang") == "es", "ES").otherwise(F.col("lang")).alias("lang"))
    return quality.field_differences(docs, again, ["doc_id"], ["n_chars", "lang"])


# Faults planted by the last digit of a question's number, in the tables that V24 compares.
QUEUE_FIELDS = ["split", "auto_status", "annotation_priority"]
QUEUE_CHECKS = [
    "missing_in_queue", "missing_in_review", "repeated_in_queue", "repeated_in_review", *(f"{f}_differs" for f in QUEUE_FIELDS), "initial_batch_is_phase_1",
]
LOCK_CHECKS = [
    *(f"missing_in_{t}" for t in ("packet", "notes", "locks", "labels")), *(f"repeated_in_{t}" for t in ("packet", "notes", "locks", "labels")),
    "y_differs", "publish_use_differs", "labels_locked", "lock_reason_given",
]


def spoiled_queue(queue: DataFrame) -> DataFrame:
    digit = F.substring("question_id", -1, 1)
    changed = queue.withColumns(
        {
            "split": F.when(digit == "3", "x").otherwise(F.col("split")),
            "is_initial_batch": F.col("is_initial_batch") != (digit == "4"),
            "queue_rank": F.col("queue_rank") + F.when(digit == "5", 1_000_000).otherwise(0),
            "question_id": F.when(digit == "6", F.concat(F.lit("x"), "question_id")).otherwise(F.col("question_id")),
        }
    )
    times = F.when(digit == "1", 0).when(digit == "2", 2).otherwise(1)
    return changed.withColumn("_n", F.explode(F.array_repeat(F.lit(0), times))).drop("_n")


def lock_tables(spark, root) -> dict[str, DataFrame]:
    """Packet, notes, locks and labels of the packet's rows, with planted faults."""
    c, digit = F.col, F.col("question_id") % 10
    rows = packet(spark, root).join(notes(spark, root, ("train", "dev", "test")), "row_id", "left")
    locked = durable(review.lock_decisions(rows).select("row_id", "question_id", "y", "labels_locked", "publish_use", "lock_reason"))
    labels = wide_scores(spark, root).select("row_id", "question_id", "y").join(locked.select("row_id"), "row_id", "left_semi")
    times = F.when(digit == 1, 0).when(digit == 2, 2).otherwise(1)
    locks = locked.withColumn("_n", F.explode(F.array_repeat(F.lit(0), times))).select(
        "row_id", F.when(digit == 3, "other").otherwise(c("publish_use")).alias("publish_use"), (c("labels_locked") & (digit != 4)).alias("labels_locked"),
        F.when(digit == 5, "short").otherwise(c("lock_reason")).alias("lock_reason"))
    return {
        "packet": locked.select("row_id", "y"), "notes": locked.filter(digit != 8).select("row_id", "publish_use"), "locks": locks,
        "labels": labels.filter(digit != 7).select("row_id", F.when(digit == 6, 1 - c("y")).otherwise(c("y")).alias("y")),
    }


def counted_sql(counts: dict[str, str], names: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS check_name, ({c}) = 0 AS passed, CAST(({c}) AS BIGINT) AS detail FROM (SELECT 1)" for n in names
        for c in [f"SELECT {counts[n]} FROM {source}" if n in counts else "0"])


def of_digit(*digits: int) -> str:
    return f"count(*) FILTER (digit IN ({', '.join(map(str, digits))}))"


V24_SQL = f"""
SELECT * FROM (WITH {REVIEW}, q AS (SELECT *, CAST(right(question_id, 1) AS INTEGER) AS digit FROM queued),
  sq AS (SELECT queue_rank + CASE WHEN digit = 5 THEN 1000000 ELSE 0 END AS queue_rank FROM q, range(2) AS r(k) WHERE digit <> 1 AND (k = 0 OR digit = 2))
  {counted_sql({"missing_in_queue": of_digit(1, 6), "missing_in_review": of_digit(6), "repeated_in_queue": of_digit(2), "split_differs": of_digit(3), "initial_batch_is_phase_1": of_digit(4)}, QUEUE_CHECKS, "q")}
  UNION ALL SELECT 'ranks_unique', count(*) = 0, count(*) FROM (SELECT queue_rank FROM sq GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'ranks_contiguous', max(queue_rank) - min(queue_rank) + 1 = count(DISTINCT queue_rank), CAST(max(queue_rank) - min(queue_rank) + 1 - count(DISTINCT queue_rank) AS BIGINT) FROM sq)
UNION ALL SELECT concat('lock_', check_name), passed, detail FROM (WITH {PACKET}, {NOTES.replace(" WHERE split = 'test'", "")},
  l AS (SELECT row_id, question_id % 10 AS digit, {case(review.LOCK_REASON, 'Locked after assistant full review.')} AS reason FROM packet LEFT JOIN notes USING (row_id))
  {counted_sql({"missing_in_notes": of_digit(8), "missing_in_locks": of_digit(1), "missing_in_labels": of_digit(7), "repeated_in_locks": of_digit(2), "y_differs": of_digit(6), "publish_use_differs": of_digit(3), "labels_locked": of_digit(4), "lock_reason_given": "count(*) FILTER (digit <> 1 AND (digit = 5 OR length(reason) < 40))"}, LOCK_CHECKS, "l")})
"""


@query("v24_tables_agree", V24_SQL)
def v24(spark, root):
    """Review and queue by question, packet, notes, locks and labels by row: each group of tables in one aggregation."""
    c = F.col
    table = durable(review_of(questions(spark, root), noted(spark, root)).select("question_id", "prompt_id", *QUEUE_FIELDS))
    queue = durable(spoiled_queue(review.annotation_queue(table)))
    found = quality.disagreements(
        {"review": table, "queue": queue}, "question_id", QUEUE_FIELDS,
        {"queue": {"initial_batch_is_phase_1": c("is_initial_batch") == (c("queue_phase") == "phase_1_heldout_high")}})
    ranks = queue.groupBy("queue_rank").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count_if(c("n") > 1).alias("ranks_unique"), (F.max("queue_rank") - F.min("queue_rank") + 1 - F.count(F.lit(1))).alias("ranks_contiguous"))
    ranked = ranks.unpivot([], ranks.columns, "check_name", "detail").select("check_name", (c("detail") == 0).alias("passed"), "detail")
    locks = quality.disagreements(
        lock_tables(spark, root), "row_id", ["y", "publish_use"],
        {"locks": {"labels_locked": c("labels_locked"), "lock_reason_given": F.length("lock_reason") >= 40}})
    locked = quality.problem_checks(locks, LOCK_CHECKS).withColumn("check_name", F.concat(F.lit("lock_"), "check_name"))
    return review.all_checks([quality.problem_checks(found, QUEUE_CHECKS), ranked, locked])
