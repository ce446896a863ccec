"""The retail step of the question table: each line is joined, cleaned and ranked once."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerproof.operators import gold, normalize, ordering, rollups
from ledgerproof.plans import gold as plans
from ledgerproof.plans import views
from ledgerproof.session import one_job

ROOT = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("bits", [64, 1 << 27])
def test_later_copies_are_the_flagged_lines(spark, bits):
    rng = random.Random(bits)
    rows = [(i, rng.choice("abc"), rng.choice([None, 1, 2, 3, 4, 5])) for i in range(60)] + [(100 + i, "hot", 7) for i in range(50)]
    df = spark.createDataFrame(rows, "row_id bigint, s string, n int")
    flagged = normalize.flag_exact_duplicates(df, ["s", "n"], bits=bits).filter("is_exact_duplicate").select("row_id")
    assert rows_of(normalize.later_copies(df, ["s", "n"], bits=bits)) == rows_of(flagged) and flagged.count() > 49


def test_contenders_lose_no_leader(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.choice([None, *map(float, range(-9, 10 + 300 * (g == "many")))])) for g in ("many", "ties") for i in range(400)]
    rows += [("few", i, float(i)) for i in range(3)] + [(None, i, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    order = [F.col("v").desc(), F.col("i")]
    left = ordering.contenders(df, 8, ["g"], "v")
    assert rows_of(ordering.top_n(left, 8, ["g"], order)) == rows_of(ordering.top_n(df, 8, ["g"], order))
    assert left.filter("g = 'many'").count() < 200


def test_invoices_are_counted_as_in_the_summaries(spark):
    rows = [("2020-01", "A", "1", "5"), ("2020-01", "B", "1", "-2"), ("2020-01", None, "2", "3"), ("2020-01", "A", "1", "4"),
            ("2020-02", "A", "1", "1"), ("2020-02", "A", None, "9"), ("2020-02", "A", "3", None), (None, "A", "4", "8")]
    lines = spark.createDataFrame([(m, c, n, r and Decimal(r)) for m, c, n, r in rows], "year_month string, country string, invoice_no string, revenue decimal(18,4)")
    lines = lines.withColumns({"customer_id": F.lit(1), "quantity": F.lit(1)})
    invoices = rollups.invoice_totals(lines, ["year_month", "country"])
    for keys, unique in ((["year_month", "country"], True), (["year_month"], False)):
        got = rollups.invoice_summary(invoices, keys, unique)
        assert rows_of(got) == rows_of(rollups.net_summary(lines, keys).select(*got.columns))


def test_net_lines_are_the_net_subset(spark):
    columns = ["year_month", "country", "stock_code", "description", "invoice_no", "customer_id", "quantity", "revenue", "is_non_merchandise"]
    assert rows_of(views.net_lines(spark, ROOT).select(*columns)) == rows_of(views.net(spark, ROOT).select(*columns))


def test_all_products_are_ranked_once(spark, monkeypatch):
    ranked, build = [], gold.top_n
    monkeypatch.setattr(gold, "top_n", lambda df, *a: ranked.append(df) or build(df, *a))
    products = spark.range(500).select(
        F.lit("1995-03").alias("year_month"), F.col("id").cast("string").alias("stock_code"), F.lit("d").alias("description"),
        *[(F.col("id") * 7 % 500).cast("decimal(28,4)").alias(c) for c in ("net_revenue", "gross_positive_revenue", "cancellation_revenue")])
    plans.question_table(views.bounds(spark, ROOT), views.country_month_net(spark, ROOT), products, views.monthly_net(spark, ROOT))
    sizes = sorted(df.count() for df in ranked if "stock_code" in df.columns)
    assert sizes[-2] <= gold.EVIDENCE_ROWS and sizes[-1] < 100


def test_lists_rank_all_products_once_by_each_metric(spark, monkeypatch):
    from ledgerproof.plans import checking

    ranked, build = [], ordering.top_n
    for module in (gold, checking):
        monkeypatch.setattr(module, "top_n", lambda df, *a: ranked.append(df) or build(df, *a))
    months = views.monthly_net(spark, ROOT).count()
    checking.list_answers(spark, ROOT, "gross_positive_revenue")
    total = views.product_amounts(spark, ROOT).count()
    assert len(ranked) >= 3 and all(df.count() < total / 2 for df in ranked) and total > 20 * months


def test_firsts_of_invoices_are_the_distinct_lines_and_open_each_month_once(spark):
    rng = random.Random(11)
    pick = lambda *values: rng.choice([None, *values])
    rows = [(rng.randrange(6), rng.random() < 0.5, pick("2020-01", "2020-02"), pick("A", "B"), pick(1, 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "o_orderkey bigint, is_returned boolean, year_month string, country string, quantity int")
    kept = normalize.firsts_of_invoices(df, ["o_orderkey", "is_returned"], ["quantity"])
    assert rows_of(kept.select(*df.columns)) == rows_of(df.distinct()) and kept.count() < 300
    for flag, keys in (("opens_month", []), ("opens_country", ["country"])):
        invoices = df.select("o_orderkey", "is_returned", "year_month", *keys).distinct()
        assert rows_of(kept.filter(flag).select(*invoices.columns)) == rows_of(invoices)


def odd_tables(spark, root):
    """Copies of lines, a product listed twice under two names, two charges of one name and price, an order of two customers."""
    day = F.to_timestamp(F.lit("2020-01-15"))
    tables = {
        "nation": spark.createDataFrame([(1, "A"), (2, "B")], "n_nationkey int, n_name string"),
        "customer": spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "c_custkey bigint, c_nationkey int"),
        "part": spark.createDataFrame(
            [(1, "x y", 5, 2.0), (1, "z", 5, 2.0), (2, "p", 3, 1.5), (3, "p", 3, 1.5), (4, "q", 4, 7.0), (5, "r", 1, 7.0), (6, "s", 2, 7.0), (7, None, 5, 7.0), (8, "t", 5, None)],
            "p_partkey bigint, p_name string, p_size int, p_retailprice double"),
        "orders": spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3), (3, 3)], "o_orderkey bigint, o_custkey bigint").withColumn("o_orderdate", F.when(F.col("o_orderkey") < 3, day)),
        "lineitem": spark.createDataFrame(
            [(o, p, 1, i % 3, float(q), r) for o in (1, 2, 3, 9) for p in range(1, 10) for q, r in ((1, "N"), (1, "R"), (1, None), (2, "N")) for i in range(2)],
            "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}.parquet")
    return str(root)


def test_numbered_lines_are_the_net_lines_on_odd_tables(spark, tmp_path):
    root = odd_tables(spark, tmp_path)
    with one_job():
        countries, products, months, names = views.summaries(spark, root)
        lines = views.net_lines(spark, root)
        for got, rows, keys, people in (
            (countries, lines, ["year_month", "country"], True),
            (months, lines, ["year_month"], True),
            (products.join(names, "product").drop("product", "is_non_merchandise"), normalize.merchandise(lines), ["year_month", "stock_code", "description"], False),
        ):
            due = rollups.net_summary(rows, keys, people).select(*got.columns)
            assert rows_of(got) == rows_of(due) and got.count() > 0


def test_lines_are_shuffled_by_product_and_order_only(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(views, "durable", lambda df: stored.append(df) or df)
    views.numbered_lines(spark, ROOT)
    plan = stored[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Union" not in plan  # that of the products' names
