"""URL filters by a sort-merge range join, in DataFrame operations alone.

The key of a rule is its host with the labels in reverse order, each ending in a dot, then its
path: `com.example./en/`. A url has one such key for its host and for each parent domain, and a
rule fits when its key is a prefix of the one that stands for its host. So a rule is an
interval of keys, and intervals nest or are apart. Rules' ends and urls' keys are sorted
together and swept: the running number of open intervals is the height of the stack of active
rules, and the last interval that was opened at this height is its top, the innermost rule.

Sorting is by range over many tasks. An interval that is open where a slice begins is opened
again there: at most the depth of nesting for each slice. A key that many urls share is cut by
a hash. Before the sweep urls are reduced to what rules can see, as many labels and characters
as the deepest and longest rule has, and repeated ones are one row; afterwards urls look their
answer up by a join. Spark broadcasts the answers where their stored size is below its limit; else
adaptive execution can split the join.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerproof.llm.common import fresh, table
from ledgerproof.session import durable

#: The rules of the query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: The verdict where no rule fits.
DEFAULT = "allow"
#: Above every byte of a text.
_AFTER = bytearray(b"\xff")
_OPEN, _ASK, _SHUT = 0, 1, 2


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("."), path).cast("binary")


def prepared(rules: DataFrame) -> DataFrame:
    """The rules that can be used, one for each host and path: key, rule (length, host_length, text, verdict), labels, points.

    Hosts are lower-cased; a missing path is empty and fits every path; rules without a host or
    verdict are left out, and those whose path can't fit since it doesn't begin with a slash.
    Of rules for the same host and path a block wins.
    """
    usable = rules.select(lowered(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host is not null and verdict is not null and (path = '' or startswith(path, '/'))")
    usable = usable.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels, text = F.split("host", r"\."), F.concat("host", "path")
    return usable.select(
        _key(F.reverse(labels), F.col("path")).alias("key"), F.size(labels).alias("labels"), F.length("path").alias("points"),
        F.struct(F.length(text).alias("length"), F.length("host").alias("host_length"), text.alias("text"), "verdict").alias("rule"),
    )


def _seen(url: Column, labels: int, points: int) -> tuple[Column, Column]:
    """What rules can see of a url: its last labels and the first characters of its path."""
    return F.substring_index(host_of(url), ".", -labels), F.substring(path_of(url), 1, points)


def innermost(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of `asked` (key, with columns of its own) and the innermost rule whose key is a prefix, or null.

    rules are those of `prepared`.
    """
    own = [c for c in asked.columns if c != "key"]
    nothing = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in own]
    empty = F.lit(None).cast(rules.schema["rule"].dataType)
    event = lambda key, kind, rule: [key.alias("key"), F.lit(kind).alias("kind"), rule.alias("rule")]
    events = (
        asked.select(*event(F.col("key"), _ASK, empty), *own)
        .unionByName(rules.select(*event(F.col("key"), _OPEN, F.col("rule")), *nothing))
        .unionByName(rules.select(*event(F.concat("key", F.lit(_AFTER)), _SHUT, F.col("rule")), *nothing))
    )
    # The slices are sampled, so their numbers are stored: all readers see the same ones.
    cut = F.xxhash64(*own) if own else F.lit(0)
    events = durable(events.repartitionByRange("key", "kind", cut).withColumn("slice", F.spark_partition_id()))
    opened, shut = (events.filter(F.col("kind") == k) for k in (_OPEN, _SHUT))
    still = opened.join(shut.select("rule", F.col("slice").alias("last")), "rule").filter("last > slice")
    still = still.withColumn("slice", F.explode(F.sequence(F.col("slice") + 1, "last")))
    swept = W.partitionBy("slice").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    at_height = W.partitionBy("slice", "height").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    change = F.when(F.col("kind") == _OPEN, 1).when(F.col("kind") == _SHUT, -1).otherwise(0)
    return (
        events.unionByName(still.select(*events.columns))
        .withColumn("height", F.sum(change).over(swept))
        .withColumn("top", F.last(F.when(F.col("kind") == _OPEN, F.col("rule")), ignorenulls=True).over(at_height))
        .filter(F.col("kind") == _ASK)
        .select("key", *own, F.when(F.col("height") > 0, F.col("top")).alias("rule"))
    )


def judged(pages: DataFrame, rules: DataFrame, keep: Sequence[str] = ("page_id",), url: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per row of pages: the columns `keep`, host, path, rule, verdict.

    rules has host, path and verdict (allow or block). A rule fits its host and all subdomains
    where the url's path starts with the rule's. The longest (host and path together) wins,
    of two as long the one with the longer host; where none fits rule is null and the verdict
    `default`. A missing url, or one without `://`, has an empty host and path. Repeated rows,
    missing ids and very long urls are rows like others; other columns are not read.
    """
    usable = durable(prepared(rules))
    depth, points = usable.agg(F.max("labels"), F.max("points")).first()
    if depth is None:
        return pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    tail, head = fresh(pages, "tail", "head")
    seen = dict(zip((tail, head), _seen(F.col(url), depth, points)))
    parts = F.reverse(F.split("tail", r"\."))
    asked = (
        pages.select(*(c.alias(n) for c, n in zip(seen.values(), ("tail", "head")))).distinct()
        .withColumn("n", F.explode(F.sequence(F.lit(1), F.size(parts))))
        .select(_key(F.slice(parts, F.lit(1), F.col("n")), F.col("head")).alias("key"), "tail", "head")
    )
    found = innermost(asked, usable).filter("rule is not null").groupBy("tail", "head").agg(F.max("rule").alias("best"))
    # Stored, so that its size is known before pages are shuffled: a small table goes to the pages instead.
    found = durable(found.toDF(tail, head, "best"))
    judged = pages.select(*keep, url).select(*(F.col(c) for c in dict.fromkeys((*keep, url))), *(c.alias(n) for n, c in seen.items()))
    return judged.join(found, [tail, head], "left").select(
        *keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
        F.col("best.text").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP12_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fits USING (page_id)
"""
