"""Does the data fit its declared types? One pass per table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.functions.text import redact_text, truncate_text
from haulage.functions.types import storage_type


def _per_column(one_row: DataFrame, names: list[str], fields: dict[str, str]) -> DataFrame:
    """Turn a single wide row into one row per column."""
    entries = [
        F.struct(
            F.lit(name).alias("column_name"),
            *[F.col(f"{prefix}{i}").alias(field) for field, prefix in fields.items()],
        )
        for i, name in enumerate(names)
    ]
    return one_row.select(F.explode(F.array(*entries)).alias("c")).select("c.*")


def cast_audit(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Per declared column: values that do not fit the type, NULLs, all rows."""
    names, aggregates = list(schema), [F.count(F.lit(1)).alias("_rows")]
    for i, name in enumerate(names):
        column = F.col(f"`{name}`")
        misfit = column.isNotNull() & column.try_cast(storage_type(schema[name])).isNull()
        aggregates += [F.count_if(misfit).alias(f"_bad{i}"), F.count(column).alias(f"_n{i}")]
    counted = df.agg(*aggregates)
    counted = counted.withColumns(
        {f"_null{i}": F.col("_rows") - F.col(f"_n{i}") for i in range(len(names))}
        | {f"_all{i}": F.col("_rows") for i in range(len(names))}
        | {f"_type{i}": F.lit(schema[name]) for i, name in enumerate(names)}
    )
    fields = {"target_type": "_type", "misfits": "_bad", "null_count": "_null", "total_rows": "_all"}
    return _per_column(counted, names, fields)


def fitting_schema(df: DataFrame, schema: dict[str, str]) -> dict[str, str]:
    """The declared schema with text for exactly those columns whose data does not fit.

    Decided over the whole table, so that all chunks get the same schema.
    """
    audit = cast_audit(df, schema).where(F.col("misfits") > 0).collect()  # a row per column
    bad = {row["column_name"] for row in audit}
    return {name: "string" if name in bad else dtype for name, dtype in schema.items()}


def string_fallback(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Cast to the declared types, keeping misfit columns as text."""
    chosen = fitting_schema(df, schema)
    return df.select(
        *[F.col(f"`{n}`").cast(storage_type(t)).alias(n) for n, t in chosen.items()]
    )


def validate_nullable(df: DataFrame, table: str, schema: dict[str, str] | None = None) -> DataFrame:
    """One verdict per table: rows, NULLs and misfits over all columns. NULLs are allowed;
    a table without rows passes. Without ``schema`` each column is held against itself."""
    schema = dict(df.dtypes) if schema is None else schema
    columns = {n: F.col(f"`{n}`") for n in schema}
    same = {n for n, t in df.dtypes if schema.get(n) == t}
    checks = [
        F.count_if(c.isNotNull() & c.try_cast(storage_type(schema[n])).isNull()).alias(f"_bad{i}")
        for i, (n, c) in enumerate(columns.items())
        if n not in same
    ]
    bad = [F.col(f"_bad{i}") for i, n in enumerate(columns) if n not in same]
    filled = [F.count(c).alias(f"_n{i}") for i, c in enumerate(columns.values())]
    counted = df.agg(F.count(F.lit(1)).alias("rows_checked"), *filled, *checks)
    nulls = F.lit(0).cast("bigint")
    for i in range(len(columns)):
        nulls = nulls + F.col("rows_checked") - F.col(f"_n{i}")
    misfits = F.lit(0).cast("bigint")
    for column in bad:
        misfits = misfits + column
    verdict = counted.select(
        F.lit(table).alias("table_name"),
        "rows_checked",
        nulls.alias("null_values"),
        misfits.alias("misfits"),
    )
    passed = F.col("misfits") == 0
    message = F.concat(
        F.when(passed, "Validation passed: ").otherwise("Validation failed: "),
        F.col("rows_checked").cast("string"),
        F.lit(" rows validated"),
    )
    return verdict.withColumn("passed", passed).withColumn("message", message)


def truncate_columns(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """Cap texts and say for each row whether any was cut."""
    cut = F.lit(False)
    for name in columns:
        cut = cut | F.coalesce(F.length(name) > limit, F.lit(False))
    return df.withColumns(
        {name: truncate_text(F.col(name), limit) for name in columns} | {"was_truncated": cut}
    )


def redact_columns(df: DataFrame, columns: list[str], strict: bool = False) -> DataFrame:
    return df.withColumns({name: redact_text(F.col(name), strict) for name in columns})
