import re

import pytest
from pyspark.sql import functions as F

from ledgerproof.functions import numbers, tables, text
from ledgerproof.operators import checking

TEXTS = [
    "", "  plain ", " \tWide  space\x1c", "a aa aaa aaaa", "Straße\nGRÜN\r\nnext last\n", "x😀y😀z aa😀", "1,234.50 and -7 in 2011-04",
    "GBP 145,6145.80 of £3", "one\n\ntwo", "\n", "no numbers",
]


def one(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_strip_and_collapse_follow_unicode(spark):
    assert one(spark, TEXTS, text.strip) == [t.strip() for t in TEXTS]
    assert one(spark, TEXTS, text.collapse_space) == [re.sub(r"\s+", " ", t.strip()) for t in TEXTS]


def test_lines(spark):
    assert one(spark, TEXTS, text.split_lines) == [t.splitlines() for t in TEXTS]


@pytest.mark.parametrize("needle", ["a", "aa", "😀", "next", ".", "\\E", "zz"])
def test_nth_occurrence(spark, needle):
    def brute(t, n):
        at = -len(needle)
        for _ in range(n):
            at = t.find(needle, at + len(needle) if at >= 0 else 0)
            if at < 0:
                return None
        return at

    for n in (1, 2, 3):
        got = one(spark, TEXTS, lambda c: text.nth_occurrence(c, F.lit(needle), F.lit(n)))
        assert got == [brute(t, n) for t in TEXTS]


def test_numbers(spark):
    def brute(t):
        return [float(m.replace(",", "")) for m in re.findall(r"[-+]?\d[\d,]*(?:\.\d+)?", t)]

    assert one(spark, TEXTS, numbers.extract_numbers) == [brute(t) for t in TEXTS]
    assert one(spark, TEXTS, numbers.has_broken_grouping) == [bool(re.search(r"\b\d{1,3},\d{4,}(?:\.\d+)?\b", t)) for t in TEXTS]
    assert one(spark, ["GBP 1,234.50", "n/a", "-3%", "£0.5 x 2"], numbers.parse_amount) == [1234.5, None, -3.0, 0.5]


def test_claim_line_and_excerpt(spark):
    body = "first line\nsecond claim here\nthird"
    df = spark.createDataFrame([(body, "claim", 18, 23), (body, "third", -1, -1), (body, "absent", 0, 0)], "t string, s string, a int, b int")
    lines = [r[0] for r in df.select(text.claim_line(F.col("t"), F.col("s"), F.col("a"), F.col("b"))).collect()]
    assert lines == ["second claim here", "third", "absent"]
    shown = df.limit(1).select(text.excerpt(F.col("t"), F.col("a"), F.col("b"), 8)).first()[0]
    assert shown == "... second [[claim]] here th..."


def test_table_parse_reports_issues(spark):
    body = "Intro\n| rank | stock_code | product_name | net_revenue_gbp |\n| --- | :-: | --- | --- |\n| 1 | a1 | Red  mug | GBP 1,200.50 |\n| x | b2 | Tin | n/a |\n| 3 | c |\nend"
    parsed = one(spark, [body, "nothing"], tables.parse_table)
    assert parsed[0]["headers"] == list(tables.HEADERS)
    assert [(r["rank"], r["stock_code"], r["product_name"], r["net_revenue_gbp"]) for r in parsed[0]["rows"]] == [
        (1, "A1", "RED MUG", 1200.5), (None, "B2", "TIN", None)]
    assert parsed[0]["issues"] == ["row 2 rank is not an integer", "row 2 amount is not parseable", "row 3 has 2 columns"]
    assert parsed[1]["issues"] == ["no markdown table rows found"]


def test_direction_wrong_phrase_wins(spark):
    said = ["France generated more net revenue", "Spain had more, France generated more", "both sold"]
    got = one(spark, said, lambda c: checking.direction_stated(F.lit("France"), F.lit("Spain"), c))
    assert got == [True, False, False]


def test_twelve_significant_digits(spark):
    values = [1234567.123456789, 1e-13, 123456789012345.0, 0.0, 1.0, 100.0, -2.5, 1e12, 999999999999.5, 9.99999999999949e-5, 1e-5, 1 / 3, 2e300, -1e-7, None]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(numbers.twelve_digits(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in rows] == [None if v is None else f"{v:.12g}" for v in values]
    for odd in (float("nan"), float("inf"), float("-inf")):
        with pytest.raises(Exception, match="not a finite number"):
            spark.createDataFrame([(odd,)], "x double").select(numbers.twelve_digits(F.col("x"))).collect()


@pytest.mark.parametrize("values, want", [([4e-7, 4e-7, 7e-7], 1e-6), ([1.4e-6] * 4 + [2.4e-6], 2e-6), ([-1.5e-6] * 2, -2e-6), ([], None), ([1e12, 1e12 + 1], 1e12 + 0.5)])
def test_means_are_rounded_once(spark, values, want):
    assert spark.createDataFrame([(v,) for v in values], "x double").agg(numbers.exact_mean(F.col("x"))).first()[0] == want
