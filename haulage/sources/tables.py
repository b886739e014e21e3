"""Reading tables: whole, by range, by page, by stride, by query or by filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.functions.types import storage_type
from haulage.operators.positions import page


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_table(df: DataFrame, schema: dict[str, str] | None = None) -> DataFrame:
    """All rows, cast to the declared types; columns not declared are left out."""
    if schema is None:
        return df
    return df.select(
        *[F.col(f"`{name}`").cast(storage_type(dtype)).alias(name) for name, dtype in schema.items()]
    )


def scan_range(df: DataFrame, column: str, lo, hi, hi_inclusive: bool = False) -> DataFrame:
    """Rows with ``lo <= column < hi`` (or ``<= hi``). The bounds are cast to the column's
    type, not the other way round, so that Parquet and JDBC can use the filter."""
    dtype = dict(df.dtypes)[column]
    c, low, high = F.col(f"`{column}`"), F.lit(lo).cast(dtype), F.lit(hi).cast(dtype)
    return df.where((c >= low) & ((c <= high) if hi_inclusive else (c < high)))


def scan_page(df: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """Rows ``offset .. offset + size`` in a stable order: equal keys never change pages.

    For many pages use :func:`haulage.sinks.export.export_paged`, which sorts once for
    all of them.
    """
    return page(df, order, offset, size)


def equal_width(column: Column, lower: int, upper: int, parts: int) -> Column:
    """Part of an equal-width split of ``lower`` to ``upper``; outer parts are open, NULLs go to
    part 0."""
    if lower >= upper:
        return F.lit(0)
    part = F.width_bucket(column, F.lit(lower), F.lit(upper), F.lit(parts)) - 1
    inside = F.greatest(F.lit(0), F.least(F.lit(parts - 1), part))
    return F.when(column.isNull(), 0).otherwise(inside).cast("int")  # least and greatest skip NULLs


def scan_query(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """A SELECT over named DataFrames, e.g. ``scan_query(s, "... FROM {t}", t=df)``."""
    return spark.sql(query, **tables)


def scan_where(df: DataFrame, where_clause: str | None) -> DataFrame:
    """Rows that match a configured SQL condition; no condition keeps all rows."""
    return df if not where_clause else df.where(where_clause)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Exact counts of many tables in one job; Parquet counts read no column data."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def table_info(counts: DataFrame, columns: DataFrame, chunk_rows: int = 1_000_000) -> DataFrame:
    """Row and column count, size guess and chunk estimate per table.

    ``counts(table_name, row_count)``, ``columns(table_name, column_name)``.
    """
    widths = columns.groupBy("table_name").agg(F.count(F.lit(1)).alias("column_count"))
    rows, width = F.col("row_count"), F.coalesce("column_count", F.lit(0))
    partitioned = rows > chunk_rows
    size_mb = F.greatest(F.lit(1.0), rows * width * 10 / F.lit(1024.0 * 1024.0))
    chunks = F.ceil(rows / F.lit(chunk_rows)).cast("bigint")
    return counts.join(widths, "table_name", "left").select(
        "table_name",
        "row_count",
        width.alias("column_count"),
        partitioned.alias("will_be_partitioned"),
        F.when(partitioned, chunks).otherwise(1).cast("bigint").alias("estimated_chunks"),
        F.lit(chunk_rows).alias("chunk_size"),
        F.round(size_mb, 2).alias("estimated_size_mb"),
    )
