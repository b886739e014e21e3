"""Reading from a database through Spark's JDBC source.

Spark owns the connections: one per task, so the number of partitions is the number of
connections. The driver jar must be on the class path.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from haulage.functions.rows import quoted
from haulage.operators.profile import extremes, profile_from_extremes, rangeable_columns
from haulage.plans.ranges import RangePlan

# URL form, default port and default database per dialect.
URLS = {
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "greenplum": "jdbc:postgresql://{host}:{port}/{database}",
    "vertica": "jdbc:vertica://{host}:{port}/{database}",
}
DEFAULT_PORTS = {"postgresql": 5432, "greenplum": 5432, "vertica": 5433}
DEFAULT_DATABASES = {"postgresql": "postgres", "greenplum": "postgres", "vertica": "defaultdb"}
FETCH_SIZES = {"small": 25_000, "medium": 50_000, "large": 100_000}
# End of fixed values.


@dataclass(frozen=True)
class Database:
    """One set of connection options, used everywhere."""

    db_type: str
    host: str
    username: str
    password: str = field(repr=False, default="")
    port: int | None = None
    database: str | None = None
    session_init: str | None = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.db_type.lower() not in URLS:
            raise ValueError(f"unsupported database type: {self.db_type}")

    @property
    def url(self) -> str:
        kind = self.db_type.lower()
        return URLS[kind].format(
            host=self.host,
            port=self.port or DEFAULT_PORTS[kind],
            database=self.database or DEFAULT_DATABASES[kind],
        )

    def options(self) -> dict[str, str]:
        opts = {"url": self.url, "user": self.username, "password": self.password}
        if self.session_init:
            opts["sessionInitStatement"] = self.session_init
        return {**opts, **{k: str(v) for k, v in self.extra.items()}}


def _reader(spark: SparkSession, db: Database, options: dict):
    return spark.read.format("jdbc").options(**db.options(), **options)


def fetch_size(row_count: int | None) -> int:
    """Rows per round trip: more for larger tables."""
    if row_count is None or row_count < 1_000_000:
        return FETCH_SIZES["small"]
    return FETCH_SIZES["medium"] if row_count < 10_000_000 else FETCH_SIZES["large"]


def read_table(spark: SparkSession, db: Database, table: str, rows: int | None = None) -> DataFrame:
    """One task; filters and column choice are pushed down by Spark."""
    return _reader(spark, db, {"dbtable": table, "fetchsize": fetch_size(rows)}).load()


def read_query(spark: SparkSession, db: Database, query: str) -> DataFrame:
    return _reader(spark, db, {"query": query, "fetchsize": FETCH_SIZES["medium"]}).load()


def profile_query(df: DataFrame, table: str) -> str:
    """The profile's aggregates as a query for the database."""
    return f"SELECT {', '.join(extremes(rangeable_columns(df), quote=chr(34)))} FROM {table}"


def read_profile(spark: SparkSession, db: Database, table: str) -> DataFrame:
    """Column profile computed by the database: one row comes back, not the columns.

    The types come from the table's schema, which Spark asks for without reading rows.
    """
    df = read_table(spark, db, table)
    found = rangeable_columns(df)
    if not found:
        raise ValueError(f"{table} has no column of a rangeable type")
    one_row = read_query(spark, db, profile_query(df, table))
    return profile_from_extremes(one_row, found, "source")


def read_count(spark: SparkSession, db: Database, table: str) -> DataFrame:
    return read_query(spark, db, f"SELECT count(*) AS row_count FROM {table}")


def stride_options(column: str, lower, upper, partitions: int) -> dict[str, str]:
    return {
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def read_strides(
    spark: SparkSession, db: Database, table: str, column: str, lower, upper, partitions: int
) -> DataFrame:
    """Equal strides over a column; NULLs come with the first stride."""
    options = {"dbtable": table, **stride_options(column, lower, upper, partitions)}
    return _reader(spark, db, options).load()


def read_plan(spark: SparkSession, db: Database, table: str, plan: RangePlan) -> DataFrame:
    """One task per planned chunk. The chunks are separate reads, so rows written in
    between can differ: compare the counts afterwards."""
    properties = {k: v for k, v in db.options().items() if k != "url"}
    properties["fetchsize"] = str(fetch_size(plan.rows))
    return spark.read.jdbc(db.url, table, predicates=plan.sql_predicates(), properties=properties)


def chunk_counts_query(table: str, plan: RangePlan) -> str:
    """Rows of each planned chunk, counted by the database."""
    cases = " ".join(f"WHEN {p} THEN {i}" for i, p in enumerate(plan.sql_predicates()))
    return (
        f"SELECT chunk_id, count(*) AS row_count FROM (SELECT CASE {cases} END AS chunk_id FROM {table}) c "
        "GROUP BY chunk_id"
    )


def bounds_query(table: str, column: str, predicate: str) -> str:
    """Extremes of a column among the rows of a chunk."""
    name = quoted(column, '"')
    return (
        f"SELECT min({name}) AS low, max({name}) AS high, count({name}) AS filled FROM {table} WHERE {predicate}"
    )


def read_unit(spark: SparkSession, db: Database, table: str, predicate: str, rows: int | None = None) -> DataFrame:
    """The rows of one condition, read by one task over one connection."""
    return read_table(spark, db, f"(SELECT * FROM {table} WHERE {predicate}) unit", rows)


# Catalog queries, passed on to the database. System schemas.
SYSTEM_SCHEMAS = {
    "postgresql": ["information_schema", "pg_catalog", "pg_toast_temp_1", "pg_temp_1"],
    "vertica": ["v_catalog", "v_monitor", "v_internal"],
}


def catalog_query(db_type: str, what: str) -> str:
    """SELECT for ``tables``, ``columns``, ``constraints`` or ``key_columns``."""
    vertica = db_type.lower() == "vertica"
    schema = "v_catalog" if vertica else "information_schema"
    named = "schema_name AS table_schema" if vertica else "table_schema"
    kind = "'BASE TABLE' AS table_type" if vertica else "table_type"
    constraints, keys = "information_schema.table_constraints", "information_schema.key_column_usage"
    if vertica:
        constraints = (
            "(SELECT table_schema AS constraint_schema, constraint_name, table_schema, table_name, "
            "CASE constraint_type WHEN 'p' THEN 'PRIMARY KEY' WHEN 'u' THEN 'UNIQUE' ELSE constraint_type END "
            "AS constraint_type FROM v_catalog.table_constraints JOIN v_catalog.tables USING (table_id)) c"
        )
        keys = (
            "(SELECT table_schema AS constraint_schema, constraint_name, table_schema, table_name, column_name, "
            "ordinal_position FROM v_catalog.constraint_columns) k"
        )
    queries = {
        "tables": f"SELECT {named}, table_name, {kind} FROM {schema}.tables",
        "columns": f"SELECT {named}, table_name, column_name, data_type, "
        f"character_maximum_length, is_nullable, ordinal_position FROM {schema}.columns",
        "constraints": "SELECT constraint_schema, constraint_name, table_schema, table_name, "
        f"constraint_type FROM {constraints}",
        "key_columns": "SELECT constraint_schema, constraint_name, table_schema, table_name, "
        f"column_name, ordinal_position AS key_position FROM {keys}",
    }
    return queries[what]
