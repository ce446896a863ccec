"""URL filters against a brute-force version and the check SQL."""

import random
import re

import oracle
import pytest

from ledgerproof.llm import url_rules

RULE = "host string, path string, verdict string"


def parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute(url, rules, default="allow"):
    host, path = parts(url)
    fits = []
    for h, p, v in rules:
        h, p = h and re.sub("[A-Z]", lambda m: m[0].lower(), h), p or ""
        if h is not None and v is not None and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), h + p, v))
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def made(rng):
    label = lambda: rng.choice(["a", "b", "ab", "com", "net", "www", "é", "A", "", "a-b", "x/y"[:1]])
    host = lambda n: ".".join(label() for _ in range(rng.randrange(1, n)))
    path = lambda n: "".join(rng.choice(["/", "a", "b", "/en/", "é", "/a/b", ".", " "]) for _ in range(rng.randrange(n)))
    rules = [(host(4), path(5), rng.choice(["allow", "block"])) for _ in range(120)]
    rules += [("a", "/" * k, rng.choice(["allow", "block"])) for k in range(1, 9)] + [("", "/", "block"), (None, "/", "block"), ("com", None, "allow"), ("b", "/", None), ("net", "/a", "block"), ("net", "/a", "allow")]
    urls = [rng.choice(["http", "", "https"]) + "://" + host(6) + path(7) + rng.choice(["", "?q=://a", "#x", "?a/b"]) for _ in range(900)]
    urls += [None, "", "com/", "http:/a", "a://", "x\ny://a.com/\nz", "http://A.B.CoM/En/", "http://com", "http://com?x", "http://ÀA.com/", "http://a.com:80/", "http://" + "a." * 3000 + "com/" + "en/" * 3000]
    return rules, urls + ["http://a.b.com/en/hot"] * 400


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rules, urls = made(random.Random(seed))
    ids = [None if k % 50 == 7 else k for k in range(len(urls))]
    pages = spark.createDataFrame([(i, u, "mine", "mine") for i, u in zip(ids, urls)], "page_id long, url string, host string, tail string").repartition(5)
    got = url_rules.judged(pages, spark.createDataFrame(rules, RULE).repartition(3))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(((i, *brute(u, rules)) for i, u in zip(ids, urls)), key=order)


def test_intervals_that_cross_slices(spark):
    rules = [("com", "/" + "a" * k, "block") for k in range(12)] + [("x.com", "/", "allow"), ("zz", "/", "allow")]
    pages = spark.createDataFrame([(k, f"http://{'xy'[k % 2]}.com/" + "a" * (k % 11) + str(k)) for k in range(3000)], "page_id long, url string")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judged(pages, spark.createDataFrame(rules, RULE)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == {r["page_id"]: brute(r["url"], rules) for r in pages.collect()}


def test_no_rows_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "block")], RULE)
    assert url_rules.judged(pages.filter("page_id > 1"), rules).collect() == []
    assert [tuple(r) for r in url_rules.judged(pages, rules.filter("host = ''"), default="block").collect()] == [(1, "a.com", "/x", None, "block")]


def test_no_python_and_two_columns_read(spark):
    df = url_rules.op12_url_filters(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_check_sql(spark):
    assert oracle.compare(spark, "/root/testdata/sf0.01", url_rules.op12_url_filters, url_rules.OP12_SQL) is None
