"""Number parsing, tolerance tests and number formatting as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number shapes a claim may contain.
NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?"
AMOUNT = r"-?\d+(?:\.\d+)?"
BROKEN_GROUPING = r"\b\d{1,3},\d{4,}(?:\.\d+)?\b"
CURRENCY_MARKS = "GBP|gbp|£"


def extract_numbers(text: Column) -> Column:
    """All numbers of a text, thousands separators removed."""
    found = F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))


def parse_amount(value: Column) -> Column:
    """First number of a cell once currency, thousands and percent signs are gone."""
    bare = F.regexp_replace(value, f"{CURRENCY_MARKS}|[,%]", "")
    return F.regexp_extract(bare, f"({AMOUNT})", 1).try_cast("double")


def has_broken_grouping(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(BROKEN_GROUPING)), F.lit(False))


def within(value: Column, target: Column, tolerance: float) -> Column:
    """Signed closeness; NULL on either side does not match."""
    return F.coalesce(F.abs(value - target) <= tolerance, F.lit(False))


def magnitude_match(numbers: Column, gold: Column, limit: Column) -> Column:
    """Does any number equal the gold value within a limit, ignoring sign?"""
    return F.coalesce(F.exists(numbers, lambda x: F.abs(F.abs(x) - F.abs(gold)) <= limit), F.lit(False))


def tolerance_limit(gold: Column, absolute: Column, relative_percent: Column, points: Column) -> Column:
    """Percentage points win; else the larger of absolute and relative limit."""
    return F.coalesce(
        points,
        F.greatest(F.coalesce(absolute, F.lit(1.0)), F.abs(gold) * F.coalesce(relative_percent, F.lit(0.5)) / 100),
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields 0 on an empty denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def money(c: Column) -> Column:
    return F.round(c, 2).cast("double")


def _shown(c: Column, pattern: str) -> Column:
    """A double by a pattern. What decides about a digit is its exact binary value, and a tie goes
    to the even digit; format_string rounds the shortest decimal form instead."""
    return F.call_function("format_number", c.cast("double"), F.lit(pattern))


def currency(c: Column) -> Column:
    return F.concat(F.lit("GBP "), _shown(c, "#,##0.00"))


def percent(c: Column) -> Column:
    return F.concat(fixed2(c), F.lit("%"))


def fixed2(c: Column) -> Column:
    return _shown(c, "0.00")


def any_fixed2(c: Column, grouped: bool = False) -> Column:
    """`fixed2` of any double, as C writes it: every digit of a large one, and nan or inf by name. It holds lambdas,
    which amounts of money do without."""
    c = c.cast("double")
    size, pattern = F.abs(c), "#,##0.00" if grouped else "0.00"
    digits = _all_digits(size)
    if grouped:
        digits = F.regexp_replace(digits, r"(?<=\d)(?=(\d{3})+$)", ",")
    huge = F.concat(F.when(c < 0, "-").otherwise(""), digits, F.lit(".00"))
    return _named(c, F.when(size >= 2.0**63, huge).otherwise(_exactly_shown(c, pattern)))


def _named(c: Column, finite: Column) -> Column:
    return F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(finite)


def _exactly_shown(c: Column, pattern: str) -> Column:
    """Large numbers go by as whole ones, or as decimals of two places: of a double the digits of its shortest form
    decide, which from 2**45 up may end before the places that are shown, and its ties go up."""
    whole = c.try_cast("bigint")
    rest = c - whole.cast("double")
    # A rest has so few bits that its hundredfold is exact.
    cents = (whole.cast("decimal(20,0)") * 100 + F.rint(rest * 100).cast("decimal(4,0)")) / F.lit(100).cast("decimal(3,0)")
    large = (F.abs(c) >= 2.0**39) & (F.abs(c) < 2.0**63)
    return F.when(large & (rest == 0), F.call_function("format_number", whole, F.lit(pattern))).when(
        large, F.call_function("format_number", cents.cast("decimal(38,2)"), F.lit(pattern))).otherwise(_shown(c, pattern))


def _all_digits(size: Column) -> Column:
    """The digits of a double from 2**63 up: a whole number times a power of two, in limbs of nine digits, the lowest first."""
    base = F.lit(10**9).cast("bigint")

    def div(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    def times(limbs: Column, factor: Column) -> Column:
        none = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("bigint").alias("carry"))

        def step(acc: Column, limb: Column) -> Column:
            made = limb * factor + acc["carry"]
            return F.struct(F.concat(acc["done"], F.array(made % base)).alias("done"), div(made, base).alias("carry"))

        return F.aggregate(limbs, none, step, lambda acc: F.concat(acc["done"], F.array(acc["carry"])))

    # Two bits more than a double has, so that a logarithm rounded to the next whole number does no harm.
    power = (F.floor(F.log2(size)) - 54).cast("int")
    whole = (size / F.pow(F.lit(2.0), power)).try_cast("bigint")
    factors = F.concat(
        F.array_repeat(F.lit(2**29).cast("bigint"), div(power, F.lit(29)).cast("int")), F.array(F.pow(F.lit(2.0), power % 29).cast("bigint")))
    limbs = F.aggregate(factors, F.array(whole % base, div(whole, base)), times)
    return F.regexp_replace(F.array_join(F.transform(F.reverse(limbs), lambda limb: F.lpad(limb.cast("string"), 9, "0")), ""), "^0+", "")


def twelve_digits(c: Column, named: bool = False) -> Column:
    """Twelve significant digits without trailing zeros, in scientific form below 0.0001
    and from a million million up. A value that isn't finite stops the job, or is `named` as C names it."""
    c = c.cast("double")
    odd = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    stop = F.lit(None) if named else F.raise_error(F.lit("not a finite number"))
    pattern, tiny = "0.00000000000E0", F.abs(c) < 2.2250738585072014e-308
    whole = c.try_cast("bigint")
    large = (F.abs(c) >= 2.0**39) & (F.abs(c) < 2.0**63) & (whole.cast("double") == c)
    # Below the least normal double: whole multiples of 4.94e-324, whose shortest forms have fewer digits.
    steps = (c * 2.0**537 * 2.0**537).try_cast("decimal(16,0)") * F.expr("4.940656458412465441766BD")
    text = (
        F.when(large, F.call_function("format_number", whole, F.lit(pattern)))
        .when(tiny, F.call_function("format_number", steps, F.lit(pattern)))
        .otherwise(_shown(F.when(odd, stop.cast("double")).otherwise(c), pattern))
    )
    power = F.regexp_extract(text, "E(.*)$", 1).cast("int") - F.when(tiny, 324).otherwise(0)
    mantissa = F.regexp_extract(text, "^([^E]*)", 1)
    plain = F.when(power.between(-4, 11), text.cast("decimal(38,16)").cast("string")).otherwise(mantissa)
    bare = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    exponent = F.concat(F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    told = F.when(c.isNotNull(), F.when(power.between(-4, 11), bare).otherwise(F.concat(bare, exponent)))
    # A zero keeps its sign.
    told = F.when(c == 0, _shown(c, "0")).otherwise(told)
    return _named(c, told) if named else told


def half_away(c: Column, digits: int) -> Column:
    """A double times a power of ten, to the nearest whole number, and back: the rounding of C and of SQL engines."""
    return F.round(c * 10.0**digits, 0) / 10.0**digits


def exact_mean(c: Column, digits: int = 6) -> Column:
    """Aggregate: the mean, rounded once, half away from zero. Values are summed as decimals
    of eighteen places, so it is the same whatever order tasks finish in."""
    return F.round(F.try_divide(F.sum(c.cast("decimal(38,18)")), F.count(c).cast("decimal(20,0)")), digits).cast("double")


def exact_mean_of_units(c: Column, scale: int, digits: int = 6) -> Column:
    """Aggregate: `exact_mean` of whole numbers that count units of 10**-scale. They are summed as longs, and the
    mean is rounded once in whole numbers; a sum too large for that stops the job. Missing ones are counted,
    not those that are there: partial counts of zero take little room in a shuffle."""
    total, count = F.sum(c.cast("bigint")), F.count(F.lit(1)) - F.count_if(c.isNull())
    shift = 10 ** abs(digits - scale)
    top, below = (F.abs(total) * (2 * shift), count) if digits >= scale else (F.abs(total) * 2, count * shift)
    size = F.call_function("div", top + below, below * 2)
    return F.when(count > 0, (F.signum(total) * size.cast("double")) / 10.0**digits)


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)
