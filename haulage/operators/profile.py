"""Column and table profiles: one aggregate pass per table, whatever its width."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.functions.rows import literal, quoted
from haulage.functions.scale import ceil_div, micros_sql
from haulage.plans.methods import benefit_label, supports_cursors
from haulage.policy import Policy
from haulage.session import written

# Spark types that can carry a range, under their database names.
RANGEABLE = {
    "smallint": "smallint",
    "int": "integer",
    "bigint": "bigint",
    "float": "real",
    "double": "double precision",
    "date": "date",
    "timestamp": "timestamptz",
    "timestamp_ntz": "timestamp",
}
WHOLE_TYPES = ("smallint", "integer", "bigint", "serial", "bigserial")
SEQUENCE_TYPES = ("integer", "bigint", "serial", "bigserial")
TIME_TYPES = ("date", "timestamp", "timestamptz")
# End of fixed values.


def _among(column: str, names) -> str:
    return f"{column} IN ({', '.join(repr(n) for n in names)})"


def database_type(spark_type: str) -> str | None:
    if spark_type.startswith("decimal"):
        return "numeric"
    return RANGEABLE.get(spark_type)


def rangeable_columns(df: DataFrame) -> list[tuple[int, str, str]]:
    """(ordinal, name, Spark type) of the columns a range can be built on."""
    return [
        (i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes, 1) if database_type(dtype)
    ]


def profile_columns(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """MIN, MAX, null count and row count of every rangeable column in one pass.

    ``min_key``/``max_key`` are whole numbers (values, or microseconds for dates and
    times); ``min_real``/``max_real`` serve the fractional types.
    """
    found = [c for c in rangeable_columns(df) if columns is None or c[1] in columns]
    if not found:
        raise ValueError(f"{table} has no column of a rangeable type")
    return profile_from_extremes(df.selectExpr(*extremes(found)), found, table)


def extremes(found: list[tuple[int, str, str]], quote: str = "`") -> list[str]:
    """Aggregates of one profile row, as SQL that databases understand as well."""
    out = ["count(*) AS row_total"]
    for ordinal, name, _ in found:
        column = quoted(name, quote)
        out += [
            f"min({column}) AS lo_{ordinal}", f"max({column}) AS hi_{ordinal}",
            f"count({column}) AS n_{ordinal}",
        ]
    return out


def profile_from_extremes(
    one_row: DataFrame, found: list[tuple[int, str, str]], table: str
) -> DataFrame:
    """Turn the wide row of :func:`extremes` into one row per column."""
    entries = []
    for ordinal, name, dtype in found:
        kind, low, high = database_type(dtype), f"lo_{ordinal}", f"hi_{ordinal}"
        keys, reals = ["NULL", "NULL"], ["NULL", "NULL"]
        if kind in WHOLE_TYPES:
            keys = [low, high]
        elif kind in TIME_TYPES:
            keys = [micros_sql(low, dtype), micros_sql(high, dtype)]
        else:
            reals = [f"{low} + 0.0D", f"{high} + 0.0D"]  # adding zero turns -0.0 into 0.0
        values = [str(ordinal), literal(name), f"'{kind}'"]
        values += [f"cast({k} AS bigint)" for k in keys] + [f"cast({r} AS double)" for r in reals]
        entries.append(", ".join([*values, f"row_total - n_{ordinal}", "row_total"]))
    names = "ordinal, column_name, data_type, min_key, max_key, min_real, max_real, null_count, total_count"
    stacked = f"stack({len(entries)}, {', '.join(entries)}) AS ({names})"
    return one_row.selectExpr(stacked).selectExpr(f"{literal(table)} AS table_name", "*")


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Column profiles of several tables, one row per column."""
    parts = [profile_columns(df, name) for name, df in tables.items() if rangeable_columns(df)]
    return reduce(DataFrame.unionByName, parts)


def with_density(profile: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Rows per possible key; above one half a whole-number column counts as a sequence."""
    # Decimal, because a span of two 64-bit keys may need 65 bits.
    span = "cast(cast(max_key AS decimal(20,0)) - cast(min_key AS decimal(20,0)) + 1 AS double)"
    density = f"CASE WHEN {_among('data_type', WHOLE_TYPES)} THEN cast(total_count AS double) / {span} END"
    return profile.selectExpr("*", f"{density} AS density").selectExpr(
        "*", f"coalesce(density > {policy.dense_above}, false) AS is_sequential"
    )


def suitable_columns(profile: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Columns with values and not too many NULLs, measured against the table itself."""
    return profile.where(
        "coalesce(min_key, min_real) IS NOT NULL "
        f"AND null_count <= total_count * {policy.max_null_share}D"
    )


def range_priority() -> Column:
    """1 for sequences, 2 for dates and times, 3 for anything else."""
    return F.expr(
        f"CASE WHEN is_sequential AND {_among('data_type', SEQUENCE_TYPES)} THEN 1 "
        f"WHEN {_among('data_type', TIME_TYPES)} THEN 2 ELSE 3 END"
    )


def best_range_column(profile: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The best suitable column of each table (map-side combinable, no window)."""
    if "density" not in profile.columns:
        profile = with_density(profile, policy)
    ranked = suitable_columns(profile, policy).withColumn("priority", range_priority())
    whole_row = ", ".join(c for c in ranked.columns if c != "table_name")
    best = F.expr(f"min_by(struct({whole_row}), struct(priority, ordinal)) AS best")
    return ranked.groupBy("table_name").agg(best).select("table_name", "best.*")


def partition_column(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Numeric key column of a table if it has one, else its first numeric column.

    ``columns(table_schema, table_name, column_name, data_type, ordinal_position)``,
    ``keys(table_schema, table_name, column_name, key_position)``.
    """
    numeric = columns.where(
        F.col("data_type").isin("integer", "bigint", "serial", "bigserial", "numeric")
    )
    on = ["table_schema", "table_name", "column_name"]
    first_key = keys.groupBy(*on).agg(F.min("key_position").alias("key_position"))
    candidate = F.struct("column_name", "data_type", F.col("key_position").isNotNull().alias("is_key"))
    rank = F.struct(
        F.col("key_position").isNull(),
        F.coalesce("key_position", "ordinal_position"),
        "ordinal_position",
        "column_name",
    )
    return (
        numeric.join(first_key, on, "left")
        .groupBy("table_schema", "table_name")
        .agg(F.min_by(candidate, rank).alias("best"))
        .select("table_schema", "table_name", "best.*")
    )


def size_estimate(tables: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Size from ``relation_bytes`` where known, else from the row count; memory need.

    ``tables(table_name, row_count[, relation_bytes])``.
    """
    guessed = F.col("row_count") * policy.bytes_per_row
    if "relation_bytes" in tables.columns:
        guessed = F.coalesce(F.nullif(F.col("relation_bytes"), F.lit(0)), guessed)
    size_mb = guessed / F.lit(1024.0) / F.lit(1024.0)
    return tables.withColumn("estimated_size_mb", size_mb).withColumn(
        "memory_requirements_mb",
        F.least(F.col("estimated_size_mb") * F.lit(0.1), F.lit(float(policy.memory_cap_mb))),
    )


def table_profile(
    profile: DataFrame,
    primary_keys: DataFrame,
    partitioned: DataFrame,
    db_type: str,
    policy: Policy = Policy(),
) -> DataFrame:
    """One row per table with everything the method choice looks at.

    ``profile`` is the column profile; the two key tables carry a ``table_name`` column.
    """
    profile = written(profile, "profile")  # a row per column, so the tables are read once
    rows = profile.groupBy("table_name").agg(F.max("total_count").alias("row_count"))
    best = best_range_column(profile, policy).select(
        "table_name",
        F.concat("column_name", F.lit(" ("), "data_type", F.lit(")")).alias("range_column_info"),
    )

    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select("table_name").distinct().withColumn(name, F.lit(True))

    joined = (
        size_estimate(rows, policy)
        .join(best, "table_name", "left")
        .join(flag(primary_keys, "_pk"), "table_name", "left")
        .join(flag(partitioned, "_part"), "table_name", "left")
    )
    is_partitioned = F.coalesce("_part", F.lit(False)) & F.lit(db_type.lower() == "greenplum")
    return joined.select(
        "table_name",
        "row_count",
        "estimated_size_mb",
        F.col("range_column_info").isNotNull().alias("has_suitable_range_column"),
        "range_column_info",
        F.coalesce("_pk", F.lit(False)).alias("has_primary_key"),
        is_partitioned.alias("is_partitioned"),
        F.lit(db_type).alias("db_type"),
        supports_cursors(F.lit(db_type)).alias("supports_cursors"),
        ceil_div(F.col("row_count"), policy.target_chunk_rows).alias("offset_chunk_count"),
        benefit_label(F.col("row_count")).alias("estimated_offset_penalty"),
        "memory_requirements_mb",
    )
