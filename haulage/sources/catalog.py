"""Catalog questions as joins over catalog DataFrames.

The inputs have the columns of ``information_schema`` (or ``pg_catalog``), whether they
come from a database through JDBC, from Spark's own catalog or from Parquet schemas.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.functions.rows import quoted
from haulage.operators.profile import database_type
from haulage.sources.jdbc import SYSTEM_SCHEMAS

_SAME = ["table_schema", "table_name"]


def is_user_schema(schema: Column, db_type: str = "postgresql") -> Column:
    if db_type.lower() == "vertica":
        return ~schema.isin(SYSTEM_SCHEMAS["vertica"])
    own = schema.startswith("pg_") | schema.startswith("gp_")
    return ~(schema.isin(SYSTEM_SCHEMAS["postgresql"]) | own)


def full_name() -> Column:
    return F.concat_ws(".", "table_schema", "table_name")


def catalog_tables(tables: DataFrame, db_type: str = "postgresql") -> DataFrame:
    """Base tables outside the system schemas, sorted."""
    user = is_user_schema(F.col("table_schema"), db_type) & (F.col("table_type") == "BASE TABLE")
    return (
        tables.where(user)
        .select(*_SAME, full_name().alias("full_name"))
        .orderBy("table_schema", "table_name")
    )


def catalog_schemas(
    tables: DataFrame, db_type: str = "postgresql", schemas: DataFrame | None = None
) -> DataFrame:
    """User schemas with their base tables: number, first, last, and the sorted list of names.

    ``schemas(table_schema)`` adds schemas that have no table. The list holds the names of
    one schema, as a page that shows it does.
    """
    found = (
        catalog_tables(tables, db_type)
        .groupBy("table_schema")
        .agg(
            F.count(F.lit(1)).alias("table_count"),
            F.min("table_name").alias("first_table"),
            F.max("table_name").alias("last_table"),
            F.sort_array(F.collect_list("table_name")).alias("table_names"),
        )
    )
    if schemas is None:
        return found
    named = schemas.where(is_user_schema(F.col("table_schema"), db_type)).select("table_schema").distinct()
    return named.join(found, "table_schema", "full_outer").withColumns(
        {
            "table_count": F.coalesce("table_count", F.lit(0)),
            "table_names": F.coalesce("table_names", F.array().cast("array<string>")),
        }
    )


# --- Spark's own catalog, in the columns of the functions above --------------------------


def spark_schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.name,) for d in spark.catalog.listDatabases()], "table_schema string")


def spark_tables(spark: SparkSession) -> DataFrame:
    """Tables and views of all schemas of the current catalog, temporary views aside."""
    rows = [
        (d.name, t.name, "VIEW" if t.tableType == "VIEW" else "BASE TABLE")
        for d in spark.catalog.listDatabases()
        for t in spark.catalog.listTables(d.name)
        if not t.isTemporary
    ]
    return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")


def spark_columns(spark: SparkSession, wanted: list[tuple[str, str]]) -> DataFrame:
    """Columns of some tables ``(schema, name)`` under database type names, with ``is_partition``."""
    rows = []
    for schema, table in wanted:
        for place, c in enumerate(spark.catalog.listColumns(f"{quoted(schema)}.{quoted(table)}"), 1):
            kind = database_type(c.dataType) or _other_type(c.dataType)
            rows.append((schema, table, c.name, kind, None, "YES" if c.nullable else "NO", place, c.isPartition))
    return spark.createDataFrame(
        rows,
        "table_schema string, table_name string, column_name string, data_type string, "
        "character_maximum_length int, is_nullable string, ordinal_position int, is_partition boolean",
    )


def spark_partitions(spark: SparkSession, wanted: list[tuple[str, str]]) -> DataFrame:
    """Partitions of some tables: ``table_schema, table_name, partition``; none for a table that
    has no partition columns. The rows come from Spark, table by table."""
    divided = [
        (s, t) for s, t in wanted
        if any(c.isPartition for c in spark.catalog.listColumns(f"{quoted(s)}.{quoted(t)}"))
    ]
    out = spark.createDataFrame([], "table_schema string, table_name string, partition string")
    for s, t in divided:
        listed = spark.sql(f"SHOW PARTITIONS {quoted(s)}.{quoted(t)}")
        out = out.unionByName(listed.select(F.lit(s).alias("table_schema"), F.lit(t).alias("table_name"), "partition"))
    return out


def spark_sizes(spark: SparkSession, wanted: list[tuple[str, str]]) -> DataFrame:
    """Analyzed size and rows of some tables: ``table_schema, table_name, relation_bytes,
    row_count``; null where ANALYZE TABLE was never run."""
    rows = []
    for s, t in wanted:
        described = spark.sql(f"DESCRIBE EXTENDED {quoted(s)}.{quoted(t)}").where("col_name = 'Statistics'").first()
        text = described["data_type"] if described else ""
        size, count = re.search(r"(\d+) bytes", text), re.search(r"(\d+) rows", text)
        rows.append((s, t, int(size[1]) if size else None, int(count[1]) if count else None))
    return spark.createDataFrame(
        rows, "table_schema string, table_name string, relation_bytes bigint, row_count bigint"
    )


def _lower_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({f"_{name}": F.lower(name) for name in _SAME})


def catalog_columns(columns: DataFrame, wanted: DataFrame) -> DataFrame:
    """Columns of the wanted tables by ordinal; names match whatever their case.

    ``wanted(table_schema, table_name)`` may name a table more than once.
    """
    keys = _lower_keys(wanted).select("_table_schema", "_table_name")
    # Not broadcast by hand: the list of wanted tables can be as long as the catalog.
    return (
        _lower_keys(columns)
        .join(keys, ["_table_schema", "_table_name"], "left_semi")
        .select(
            *_SAME, "column_name", "data_type", "character_maximum_length", "is_nullable",
            "ordinal_position",
        )
    )


def existing_tables(wanted: DataFrame, tables: DataFrame) -> DataFrame:
    """Wanted tables that exist in the catalog (any case)."""
    keys = _lower_keys(tables).select("_table_schema", "_table_name")
    joined = _lower_keys(wanted).join(keys, ["_table_schema", "_table_name"], "left_semi")
    return joined.select(*_SAME)


def columns_from_attributes(
    classes: DataFrame, namespaces: DataFrame, attributes: DataFrame
) -> DataFrame:
    """Column catalog from ``pg_class``, ``pg_namespace`` and ``pg_attribute``: live user
    columns with their declared length and whether they may be NULL."""
    live = attributes.where((F.col("attnum") > 0) & ~F.col("attisdropped"))
    named = classes.join(namespaces, classes["relnamespace"] == namespaces["oid"]).select(
        classes["oid"].alias("attrelid"),
        F.col("nspname").alias("table_schema"),
        F.col("relname").alias("table_name"),
    )
    return live.join(named, "attrelid").select(
        *_SAME,
        F.col("attname").alias("column_name"),
        F.col("format_type").alias("data_type"),
        F.when(F.col("atttypmod") > 4, F.col("atttypmod") - 4).alias("character_maximum_length"),
        F.when(F.col("attnotnull"), "NO").otherwise("YES").alias("is_nullable"),
        F.col("attnum").alias("ordinal_position"),
    )


def catalog_keys(constraints: DataFrame, key_columns: DataFrame) -> DataFrame:
    """Columns of primary and unique keys with their place in the key."""
    keyed = constraints.where(F.col("constraint_type").isin("PRIMARY KEY", "UNIQUE"))
    return keyed.join(
        key_columns.select("constraint_schema", "constraint_name", "column_name", "key_position"),
        ["constraint_schema", "constraint_name"],
    ).select(*_SAME, "constraint_name", "constraint_type", "column_name", "key_position")


def tables_with_primary_key(tables: DataFrame, constraints: DataFrame) -> DataFrame:
    primary = constraints.where(F.col("constraint_type") == "PRIMARY KEY")
    return tables.join(primary.select(*_SAME), _SAME, "left_semi")


def partitioned_tables(tables: DataFrame, partitions: DataFrame) -> DataFrame:
    """Tables listed in a catalog of partitions (``table_schema``, ``table_name``)."""
    return tables.join(partitions.select(*_SAME), _SAME, "left_semi")


def columns_of(spark: SparkSession, schema_name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A column catalog from DataFrame schemas, under database type names."""
    rows = [
        (schema_name, table, name, database_type(dtype) or _other_type(dtype), None,
         "YES", ordinal)
        for table, df in tables.items()
        for ordinal, (name, dtype) in enumerate(df.dtypes, 1)
    ]
    return spark.createDataFrame(
        rows,
        "table_schema string, table_name string, column_name string, data_type string, "
        "character_maximum_length int, is_nullable string, ordinal_position int",
    )


def _other_type(dtype: str) -> str:
    if dtype.startswith("array"):
        return "array"
    return {"string": "text", "binary": "bytea"}.get(dtype, dtype)
