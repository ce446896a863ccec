"""Plan shapes that must hold whatever the data size."""

import re

import pytest

from ledgerproof.plans import views
from ledgerproof.plans.registry import QUERIES

ROOT = "/root/testdata/sf0.001"
NO_PAIRS = ("a07_product_month_net", "j03_interval_overlap", "e08_split_safe_evaluation", "a23_confusion_transitions", "v07_reconciliation", "a21_balance_and_warnings")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_PAIRS)
def test_no_cross_joins(spark, name):
    plan = plan_of(QUERIES[name](spark, ROOT))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(views.monthly_net(spark, ROOT))
    assert "l_comment" not in plan and "l_extendedprice" not in plan and "o_totalprice" not in plan


def test_no_python_in_the_hot_path(spark):
    for name in ("k02_ranked_list_evaluation", "t13_table_cell_offsets", "a17_span_features"):
        plan = plan_of(QUERIES[name](spark, ROOT))
        assert "Python" not in plan


@pytest.mark.parametrize("name", ["k03_cell_level_signals", "t13_table_cell_offsets", "g01_top_country_month", "u02_first_kept_by_subset"])
def test_the_five_table_join_runs_once(spark, monkeypatch, name):
    calls = []
    build = views.retail_raw
    monkeypatch.setattr(views, "retail_raw", lambda *a: calls.append(a) or build(*a))
    plan = plan_of(QUERIES[name](spark, ROOT))
    assert len(calls) == 1 and "lineitem" not in plan


def test_documents_are_cut_once(spark, monkeypatch):
    from ledgerproof.plans import spans

    calls = []
    build = spans.cut
    monkeypatch.setattr(spans, "cut", lambda *a: calls.append(a) or build(*a))
    plan = plan_of(QUERIES["a17_span_features"](spark, ROOT))
    assert len(calls) == 1 and "documents.parquet" not in plan


def test_the_token_table_is_read_twice_at_most(spark):
    plan = plan_of(QUERIES["w10_token_offsets"](spark, ROOT)).split("== Initial Plan ==")[-1]
    assert plan.count("FileScan") <= 2 and len(re.findall(r"Exchange (hash|range)partitioning", plan)) <= 5
    plan = plan_of(QUERIES["a17_span_features"](spark, ROOT)).split("== Initial Plan ==")[-1]
    assert len([line for line in plan.splitlines() if "FileScan" in line and "token_text" in line]) <= 2


def test_stages_are_removed(spark):
    import os

    from ledgerproof import session

    root = session.shared_dir(spark)
    session.durable(spark.range(3))
    own = os.path.join(root, spark.sparkContext.applicationId)
    assert os.listdir(own)
    session.clear_stages(spark)
    assert not os.path.exists(own)


def test_a_quota_with_too_few_candidates_stops_the_job(spark):
    from ledgerproof.operators import gold

    rows = spark.createDataFrame([("1", 1), ("1", 2), ("2", 1)], "year_month string, pair_ord int")
    assert gold.round_robin(rows, "year_month", "pair_ord", 3).count() == 3
    assert sorted(tuple(r) for r in gold.round_robin(rows, "year_month", "pair_ord").select("year_month", "pair_ord", "select_ord").collect()) == [("1", 1, 1), ("1", 2, 3), ("2", 1, 2)]
    with pytest.raises(Exception, match="fewer than 4"):
        gold.round_robin(rows, "year_month", "pair_ord", 4).collect()


@pytest.mark.parametrize(
    "low, high, want",
    [("2020-01-01", "2020-03-31", ("2020-01", "2020-03", "")), ("2019-12-05", "2020-02-28", ("2020-01", "2020-01", "2020-02")), ("2020-01-31", "2020-02-29", ("2020-02", "2020-02", ""))],
)
def test_complete_months_come_from_the_data(spark, tmp_path, low, high, want):
    import duckdb

    spark.sql(f"SELECT explode(array(timestamp'{low}', timestamp'{high}')) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    ends = views.bounds(spark, str(tmp_path))
    assert (ends.first, ends.last, ends.partial) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert con.execute(f"WITH {views.BOUNDS} SELECT first_month, last_month, partial_month FROM bounds").fetchone() == want
