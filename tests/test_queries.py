"""Registered queries against the check engine on the same tables.

By default one or two queries per family run; LEDGERPROOF_ALL=1 runs all of them.
"""

import os

import oracle
import pytest

from ledgerproof.plans.registry import ORACLE, QUERIES

ROOT = os.environ.get("LEDGERPROOF_DATA", "/root/testdata/sf0.01")
SAMPLE = (
    "s03_text_cell_scan s05_strict_json_lines_scan s09_json_lines_sink p01_normalize_lines w01_exact_duplicate_flag "
    "a03_monthly_net a07_product_month_net a12_table_profile v07_reconciliation w05_consecutive_months w07_ordinal_ids_and_split "
    "g03_country_comparison_month g05_top3_products_month g06_product_revenue_share g11_prompt_table t01_normalize_text "
    "t02_extract_numbers t08_nth_occurrence t18_redact_paths t19_forbidden_lines w10_token_offsets j03_interval_overlap "
    "a17_span_features n01_step_distribution e05_average_precision e08_split_safe_evaluation a18_score_summaries a24_error_family_statistics "
    "k01_fact_level_review k02_ranked_list_evaluation t13_table_cell_offsets r05_confirmation_packet r09_policy_flags u04_key_set_relations "
    "a31_identity_errors a21_missing_and_extra_ids a21_thin_question_types v01_required_fields"
).split()
NAMES = list(QUERIES) if os.environ.get("LEDGERPROOF_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(ROOT):
        pytest.skip("test tables are not here")
    return oracle.connect(ROOT)


@pytest.mark.parametrize("name", NAMES)
def test_matches_check_sql(spark, con, name):
    assert oracle.compare(spark, ROOT, QUERIES[name], ORACLE[name], con) is None


def test_every_query_has_check_sql():
    assert set(QUERIES) == set(ORACLE)
