"""Data-quality checks. Each yields rows (check_name, passed, detail)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECK_SCHEMA = "check_name string, passed boolean, detail bigint"


def _row(counted: DataFrame, name: str) -> DataFrame:
    """One check row from a one-row count of violations."""
    bad = F.coalesce(F.col("bad"), F.lit(0)).cast("bigint")
    return counted.select(F.lit(name).alias("check_name"), (bad == 0).alias("passed"), bad.alias("detail"))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per named condition; detail counts the rows that break it (one pass)."""
    counted = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return counted.unpivot([], list(checks), "check_name", "detail").select(
        "check_name", (F.col("detail") == 0).alias("passed"), "detail"
    )


def required_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing columns fail; present ones must hold no NULL."""
    present = [c for c in columns if c in df.columns]
    checks = violations(df, {f"required_{c}": F.col(c).isNotNull() for c in present})
    absent = [(f"required_{c}", False, -1) for c in columns if c not in df.columns]
    if not absent:
        return checks
    return checks.unionByName(df.sparkSession.createDataFrame(absent, CHECK_SCHEMA))


def unique_key(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    repeated = df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    return _row(repeated.agg(F.count("*").alias("bad")), name)


def references(left: DataFrame, right: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Keys of either side that have no partner."""
    a, b = left.select(*key).distinct(), right.select(*key).distinct()
    lost = a.join(b, list(key), "left_anti").agg(F.count("*").alias("bad"))
    extra = b.join(a, list(key), "left_anti").agg(F.count("*").alias("bad"))
    return _row(lost, f"{name}_left").unionByName(_row(extra, f"{name}_right"))


def domain(column: str, allowed: Sequence[str]) -> Column:
    return F.col(column).isin(*allowed)


def finite_between(column: str, low: float, high: float) -> Column:
    c = F.col(column).cast("double")
    return ~F.isnan(c) & c.between(low, high)


def identity(left: Column, right: Column, tolerance: float) -> Column:
    return F.abs(left - right) <= tolerance


def relative_identity(left: Column, right: Column, absolute: float = 1e-8, relative: float = 1e-5) -> Column:
    return F.abs(left - right) <= absolute + relative * F.abs(right)


def one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """Several one-row aggregates side by side, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def reconcile(base: DataFrame, base_sum: str, parts: dict[str, tuple[DataFrame, str]], tolerance: float) -> DataFrame:
    """Does each grain add up to the line total?"""
    def total(frame: DataFrame, column: str, name: str) -> DataFrame:
        return frame.agg(F.sum(column).cast("decimal(38,4)").alias(name))

    wide = one_row([total(base, base_sum, "_total"), *[total(f, c, n) for n, (f, c) in parts.items()]])
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("check_name"),
                F.coalesce(F.abs(F.col(n) - F.col("_total")) <= tolerance, F.lit(False)).alias("passed"),
            )
            for n in parts
        ]
    )
    return wide.select(F.inline(rows))


def expected_counts(df: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """Counts per category against a table (key, expected); a missing category fails."""
    actual = df.groupBy(key).agg(F.count("*").alias("actual"))
    return actual.join(expected, key, "full").select(
        key,
        F.coalesce("actual", F.lit(0)).alias("actual"),
        F.coalesce("expected", F.lit(0)).alias("expected"),
        (F.coalesce("actual", F.lit(0)) == F.coalesce("expected", F.lit(0))).alias("passed"),
    )


def field_differences(left: DataFrame, right: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(key..., field, left_value, right_value) for every unequal field of matching keys."""
    a = left.select(*key, *[F.col(f).cast("string").alias(f"l_{f}") for f in fields])
    b = right.select(*key, *[F.col(f).cast("string").alias(f"r_{f}") for f in fields])
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("field"),
                    F.col(f"l_{f}").alias("left_value"),
                    F.col(f"r_{f}").alias("right_value"),
                )
                for f in fields
            ]
        )
    )
    return (
        a.join(b, list(key))
        .select(*key, pairs.alias("d"))
        .select(*key, "d.*")
        .filter(~F.col("left_value").eqNullSafe(F.col("right_value")))
    )


def disagreements(
    tables: Mapping[str, DataFrame], key: str, fields: Sequence[str], rules: Mapping[str, Mapping[str, Column]] | None = None
) -> DataFrame:
    """(key, problem) for tables that should tell the same about the same keys, in one aggregation.

    Each table is one branch of a union: its key, those of `fields` that it has, and whether the
    row breaks one of the table's own rules. Rows of a key then meet once. Problems are
    missing_in_<table>, repeated_in_<table>, <field>_differs (between tables or rows that have the
    field; a missing value is a value), and the names of the rules.
    """
    rules = {name: dict((rules or {}).get(name, {})) for name in tables}
    named = [r for each in rules.values() for r in each]
    branches = [
        t.select(
            F.col(key), F.lit(name).alias("_source"),
            *[(F.struct(F.col(f).cast("string").alias("v")) if f in t.columns else F.lit(None).cast("struct<v:string>")).alias(f"_f_{f}") for f in fields],
            *[(F.coalesce(~rules[name][r], F.lit(True)) if r in rules[name] else F.lit(False)).alias(f"_r_{r}") for r in named],
        )
        for name, t in tables.items()
    ]
    met = reduce(DataFrame.unionByName, branches).groupBy(key).agg(
        *[F.count_if(F.col("_source") == n).alias(f"_n_{n}") for n in tables],
        *[(~F.min(f"_f_{f}").eqNullSafe(F.max(f"_f_{f}"))).alias(f"_f_{f}") for f in fields],
        *[F.bool_or(f"_r_{r}").alias(f"_r_{r}") for r in named],
    )
    found = [F.when(F.col(f"_n_{n}") == 0, f"missing_in_{n}") for n in tables] + [F.when(F.col(f"_n_{n}") > 1, f"repeated_in_{n}") for n in tables]
    found += [F.when(F.col(f"_f_{f}"), f"{f}_differs") for f in fields] + [F.when(F.col(f"_r_{r}"), r) for r in named]
    return met.select(key, F.explode(F.array_compact(F.array(*found))).alias("problem"))


def problem_checks(problems: DataFrame, names: Sequence[str]) -> DataFrame:
    """One check row per named problem; detail counts the keys that have it."""
    counted = problems.agg(*[F.count_if(F.col("problem") == n).alias(n) for n in names])
    return counted.unpivot([], list(names), "check_name", "detail").select("check_name", (F.col("detail") == 0).alias("passed"), "detail")


def id_differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, gap): ids that are missing from `actual`, and extra ones, by one signed count per id."""
    sides = expected.select(key).distinct().withColumn("_side", F.lit(1)).unionByName(actual.select(key).distinct().withColumn("_side", F.lit(-1)))
    signed = sides.groupBy(key).agg(F.sum("_side").alias("_side")).filter("_side <> 0")
    return signed.select(key, F.when(F.col("_side") > 0, "missing").otherwise("extra").alias("gap"))


def roll_up(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count("*").alias("num_checks"),
        F.count_if(~F.col("passed")).alias("num_failures"),
    ).withColumn("all_passed", F.col("num_failures") == 0)


def gate(checks: DataFrame, stage: str) -> DataFrame:
    """The checks, but the job fails when one of them failed."""
    message = F.concat(F.lit(f"{stage}: failed check "), F.col("check_name"))
    return checks.filter(F.when(F.col("passed"), F.lit(True)).otherwise(F.raise_error(message).cast(T.BooleanType())))
