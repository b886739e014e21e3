"""Small scalar rules used by plans and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tiered(value: Column, tiers, default) -> Column:
    """First ``result`` whose bound lies below ``value``; ``tiers`` go from high to low."""
    tiers = [(bound, result) for bound, result in tiers]
    chain = reduce(
        lambda acc, tier: acc.when(value > F.lit(tier[0]), F.lit(tier[1])),
        tiers[1:],
        F.when(value > F.lit(tiers[0][0]), F.lit(tiers[0][1])),
    )
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def ceil_div(value: Column, by) -> Column:
    """Whole-number division rounded up, for values and divisors above zero."""
    by = by if isinstance(by, Column) else F.lit(by)
    return div(value + by - F.lit(1), by)


def div(value: Column, by) -> Column:
    """Whole-number division of non-negative integers."""
    by = by if isinstance(by, Column) else F.lit(by)
    return F.call_function("div", value.cast("bigint"), by.cast("bigint"))


def one_decimal(value: Column) -> Column:
    """``x.x`` rounded to even on the exact binary value, without grouping commas."""
    return F.call_function("format_number", value.cast("double"), F.lit("0.0"))


def human_rows(count: Column) -> Column:
    return (
        F.when(count < 1_000, count.cast("string"))
        .when(count < 1_000_000, F.concat(one_decimal(count / 1_000), F.lit("K")))
        .when(count < 1_000_000_000, F.concat(one_decimal(count / 1_000_000), F.lit("M")))
        .otherwise(F.concat(one_decimal(count / 1_000_000_000), F.lit("B")))
    )


def human_seconds(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.concat(one_decimal(seconds), F.lit("s")))
        .when(seconds < 3_600, F.concat(one_decimal(seconds / 60), F.lit("m")))
        .otherwise(F.concat(one_decimal(seconds / 3_600), F.lit("h")))
    )


def micros_sql(column: str, spark_type: str) -> str:
    """SQL text for :func:`micros`; ``column`` is itself SQL text."""
    if spark_type == "date":
        return f"unix_date({column}) * 86400000000L"
    if spark_type == "timestamp":
        return f"unix_micros({column})"
    since = f"({column} - TIMESTAMP_NTZ'1970-01-01')"
    return (
        f"((extract(DAY FROM {since}) * 24L + extract(HOUR FROM {since})) * 60L"
        f" + extract(MINUTE FROM {since})) * 60000000L"
        f" + cast(extract(SECOND FROM {since}) * 1000000 AS bigint)"
    )


def micros(column: str, spark_type: str) -> Column:
    """Microseconds since 1970 of a date or timestamp, whatever the session zone is."""
    return F.expr(micros_sql(column, spark_type))
