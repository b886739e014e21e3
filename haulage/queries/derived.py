"""Inputs that the test tables do not have as such, derived from them row by row.

Each comes as a DataFrame and as the SQL that yields the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from haulage.operators.ledger import EVENT_SCHEMA
from haulage.policy import Policy
from haulage.sources.tables import load

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# The thresholds, divided by 500 to fit tables of some ten thousand rows.
SMALL = Policy().scaled(500)


def cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


# --- a source with very many tables: one per order -----------------------------------

INVENTORY_SQL = """
inventory AS (
  SELECT 'sales.order_' || o_orderkey AS table_name,
    CAST(round(o_totalprice) AS BIGINT) * CASE o_orderpriority
      WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 20 WHEN '3-MEDIUM' THEN 200
      WHEN '4-NOT SPECIFIED' THEN 1500 ELSE 4000 END AS row_count,
    o_orderstatus <> 'P' AS has_suitable_range_column,
    CASE WHEN o_totalprice < 150000 THEN 'vertica'
      WHEN o_totalprice < 350000 THEN 'postgresql' ELSE 'greenplum' END AS db_type,
    'job_' || o_custkey AS job_id
  FROM orders)"""


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").selectExpr(
        "concat('sales.order_', o_orderkey) AS table_name",
        """cast(round(o_totalprice) AS bigint) * CASE o_orderpriority
             WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 20 WHEN '3-MEDIUM' THEN 200
             WHEN '4-NOT SPECIFIED' THEN 1500 ELSE 4000 END AS row_count""",
        "o_orderstatus <> 'P' AS has_suitable_range_column",
        """CASE WHEN o_totalprice < 150000 THEN 'vertica' WHEN o_totalprice < 350000
             THEN 'postgresql' ELSE 'greenplum' END AS db_type""",
        "concat('job_', o_custkey) AS job_id",
    )


# --- a database catalog --------------------------------------------------------------

CATALOG_TABLES_SQL = """
catalog_tables AS (
  SELECT CASE WHEN n_nationkey = 0 THEN 'pg_toast' WHEN n_nationkey = 1 THEN 'gp_toolkit'
      WHEN n_nationkey = 2 THEN 'information_schema'
      ELSE replace(lower(n_name), ' ', '_') END AS table_schema,
    replace(lower(c_name), '#', '_') AS table_name,
    CASE WHEN c_acctbal < 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def catalog_tables(spark: SparkSession, sf: str) -> DataFrame:
    nation = load(spark, sf, "nation")
    joined = load(spark, sf, "customer").join(nation, F.expr("c_nationkey = n_nationkey"))
    return joined.selectExpr(
        """CASE n_nationkey WHEN 0 THEN 'pg_toast' WHEN 1 THEN 'gp_toolkit'
             WHEN 2 THEN 'information_schema' ELSE replace(lower(n_name), ' ', '_') END
             AS table_schema""",
        "replace(lower(c_name), '#', '_') AS table_name",
        "CASE WHEN c_acctbal < 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type",
    )


# Type names as catalogs spell them, picked by quantity (1 to 50).
SPELLED_TYPES = [
    "smallint", "INTEGER", "bigint", "serial", "bigserial", "real", "double precision", "FLOAT8",
    "numeric(10,2)", "decimal", "money", "boolean", "bool", "date", "time without time zone",
    "timestamp", "timestamp without time zone", "timestamp with time zone",
    "timestamp(6) with time zone", "timestamptz", "interval", "interval day to second(3)",
    "character varying(255)", "varchar(64)", "char(1)", "text", "name", "bytea", "json", "jsonb",
    "inet", "cidr", "macaddr", "uuid", "integer[]", "ARRAY", "point", "polygon", "int4range",
    "tstzrange", "gp_segment_id", "tinyint", "auto_increment", "long varchar(9000)",
    "long varbinary", "varbinary(80)", "xml", "int", "int2", "made_up_type",
]

COLUMNS_SQL = (
    """
catalog_columns AS (
  SELECT CASE WHEN l_tax < 0.04 THEN 'Sales' ELSE 'SALES' END AS table_schema,
    'Order_' || l_orderkey AS table_name,
    'c' || l_linenumber || '_' || l_partkey AS column_name,
    ([%s])[CAST(l_quantity AS INTEGER)] AS data_type,
    CAST(l_quantity AS INTEGER) * 4 AS character_maximum_length,
    CASE WHEN l_linestatus = 'F' THEN 'NO' ELSE 'YES' END AS is_nullable,
    l_linenumber AS ordinal_position,
    CASE l_returnflag WHEN 'R' THEN 'vertica' WHEN 'A' THEN 'postgresql' ELSE 'greenplum' END
      AS dialect
  FROM lineitem)"""
    % ", ".join(f"'{t}'" for t in SPELLED_TYPES)
)


def catalog_columns(spark: SparkSession, sf: str) -> DataFrame:
    names = ", ".join(f"'{t}'" for t in SPELLED_TYPES)
    return load(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_tax < 0.04D THEN 'Sales' ELSE 'SALES' END AS table_schema",
        "concat('Order_', l_orderkey) AS table_name",
        "concat('c', l_linenumber, '_', l_partkey) AS column_name",
        f"element_at(array({names}), cast(l_quantity AS int)) AS data_type",
        "cast(l_quantity AS int) * 4 AS character_maximum_length",
        "CASE WHEN l_linestatus = 'F' THEN 'NO' ELSE 'YES' END AS is_nullable",
        "l_linenumber AS ordinal_position",
        """CASE l_returnflag WHEN 'R' THEN 'vertica' WHEN 'A' THEN 'postgresql'
             ELSE 'greenplum' END AS dialect""",
    )


KEYS_SQL = """
key_constraints AS (
  SELECT 'Sales' AS constraint_schema, 'key_' || o_orderkey AS constraint_name,
    'Sales' AS table_schema, 'Order_' || o_orderkey AS table_name,
    CASE o_orderstatus WHEN 'F' THEN 'PRIMARY KEY' WHEN 'O' THEN 'UNIQUE'
      ELSE 'FOREIGN KEY' END AS constraint_type
  FROM orders),
key_columns AS (
  SELECT 'Sales' AS constraint_schema,
    CASE WHEN l_discount >= 0.05 THEN 'key_' ELSE 'check_' END || l_orderkey AS constraint_name,
    'c' || l_linenumber || '_' || l_partkey AS column_name, l_linenumber AS key_position
  FROM lineitem)"""


def key_constraints(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").selectExpr(
        "'Sales' AS constraint_schema",
        "concat('key_', o_orderkey) AS constraint_name",
        "'Sales' AS table_schema",
        "concat('Order_', o_orderkey) AS table_name",
        """CASE o_orderstatus WHEN 'F' THEN 'PRIMARY KEY' WHEN 'O' THEN 'UNIQUE'
             ELSE 'FOREIGN KEY' END AS constraint_type""",
    )


def key_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of constraints: those of discounted lines are of keys."""
    return load(spark, sf, "lineitem").selectExpr(
        "'Sales' AS constraint_schema",
        "concat(CASE WHEN l_discount >= 0.05D THEN 'key_' ELSE 'check_' END, l_orderkey) AS constraint_name",
        "concat('c', l_linenumber, '_', l_partkey) AS column_name",
        "l_linenumber AS key_position",
    )


# --- the event stream as a job ledger, a chunk feed and a log -------------------------

FEED_SQL = """
feed AS (
  SELECT event_id AS seq, ts, epoch_us(ts) AS at_us, user_id, event_type,
    'job_' || user_id AS job_id, CAST(regexp_extract(props, '\\d+') AS INTEGER) AS k,
    'public.t_' || (CAST(regexp_extract(props, '\\d+') AS INTEGER) // 25) AS table_name,
    CAST(round(value * 100) AS BIGINT) AS amount,
    row_number() OVER (ORDER BY ts, event_id) AS ord
  FROM events)"""


def shape_feed(events: DataFrame) -> DataFrame:
    """Columns of the feed, for a batch or a stream of events."""
    k = r"cast(regexp_extract(props, r'\d+', 0) AS int)"
    return events.selectExpr(
        "event_id AS seq", "ts", "event_type", "concat('job_', user_id) AS job_id", f"{k} AS k",
        f"concat('public.t_', {k} div 25) AS table_name",
        "cast(round(value * 100) AS bigint) AS amount",
    )


def feed(spark: SparkSession, sf: str) -> DataFrame:
    return shape_feed(load(spark, sf, "events"))


def _ledger_events(feed: DataFrame, op: str, table: str, fields: dict[str, str]) -> DataFrame:
    """Event log rows from a feed; the fields not named stay NULL."""
    struct = StructType.fromDDL(EVENT_SCHEMA)["fields"].dataType
    values = ", ".join(
        f"cast({fields.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}"
        for f in struct.fields
    )
    return feed.selectExpr(
        "seq", "ts", f"{op} AS op", "job_id", f"{table} AS table_name", f"struct({values}) AS fields"
    )


def as_job_events(feed: DataFrame) -> DataFrame:
    """signup starts a job, view and click update it, purchase completes, error fails it."""
    op = """CASE event_type WHEN 'signup' THEN 'job_start' WHEN 'purchase' THEN 'job_complete'
      WHEN 'error' THEN 'job_fail' ELSE 'job_update' END"""
    fields = {
        "status": "if(event_type = 'signup', 'running', NULL)",
        "overall_status": "if(event_type = 'signup', 'running', NULL)",
        "db_username": "if(event_type = 'signup', concat('user_', k), NULL)",
        "start_time": "if(event_type = 'signup', ts, NULL)",
        "tables_total": "if(event_type = 'signup', k, NULL)",
        "rows_processed": "if(event_type = 'view', amount, NULL)",
        "progress_percent": "if(event_type = 'view', k, NULL)",
        "throughput_rows_per_sec": "if(event_type = 'click', amount, NULL)",
        "tables_completed": "if(event_type = 'click', k div 10, NULL)",
        "error_message": "if(event_type = 'error', concat('failed at ', k), NULL)",
    }
    return _ledger_events(feed, op, "cast(NULL AS string)", fields)


def as_table_events(feed: DataFrame) -> DataFrame:
    """The same for tables; a view reports rows, a click the chunks being processed."""
    op = """CASE event_type WHEN 'signup' THEN 'table_start' WHEN 'purchase' THEN 'table_complete'
      WHEN 'error' THEN 'table_fail' ELSE 'table_update' END"""
    fields = {
        "status": "if(event_type IN ('signup', 'click'), 'processing', NULL)",
        "start_time": "if(event_type = 'signup', ts, NULL)",
        "row_count": "if(event_type = 'signup', amount * 3, NULL)",
        "rows_processed": "if(event_type IN ('view', 'purchase'), amount, NULL)",
        "chunk_count": "if(event_type = 'click', k + 1, NULL)",
        "file_size_mb": "if(event_type = 'purchase', k / 4, NULL)",
        "error_message": "if(event_type = 'error', concat('connection lost at ', k), NULL)",
    }
    return _ledger_events(feed, op, "table_name", fields)


TABLE_STATE_SQL = (
    FEED_SQL
    + """,
started AS (
  SELECT job_id, table_name, max(ord) AS s FROM feed WHERE event_type = 'signup' GROUP BY ALL),
live AS (
  SELECT f.* FROM feed f JOIN started st
    ON f.job_id = st.job_id AND f.table_name = st.table_name AND f.ord >= st.s),
table_state AS (
  SELECT job_id, table_name,
    arg_max(CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
      ELSE 'processing' END, ord) FILTER (WHERE event_type <> 'view') AS status,
    arg_max(amount * 3, ord) FILTER (WHERE event_type = 'signup') AS row_count,
    coalesce(arg_max(amount, ord) FILTER (WHERE event_type IN ('view', 'purchase')), 0)
      AS rows_processed,
    coalesce(arg_max(k + 1, ord) FILTER (WHERE event_type = 'click'), 1) AS chunk_count,
    coalesce(arg_max(k / 4, ord) FILTER (WHERE event_type = 'purchase'), 0.0) AS file_size_mb,
    max(at_us) FILTER (WHERE event_type = 'signup') AS started_at,
    max(at_us) FILTER (WHERE event_type IN ('purchase', 'error')) AS ended_at,
    arg_max('connection lost at ' || k, ord) FILTER (WHERE event_type = 'error')
      AS error_message
  FROM live GROUP BY ALL)"""
)


LOG_SQL = (
    FEED_SQL
    + """,
log_lines AS (
  SELECT seq AS line_no,
    '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' ||
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END ||
    '] [JOB:' || job_id || ']' ||
    CASE WHEN event_type = 'signup' THEN '' ELSE ' [TABLE:' || table_name || '] [PROGRESS:' ||
      k || '.0%] [CHUNKS:' || k || '/100] [METHOD:range_chunking]' END ||
    ' [CONN:1/16] [MEM:' || amount || '.5MB] ' ||
    CASE event_type WHEN 'error' THEN 'Chunk ' || k || ' failed: connection timeout'
      WHEN 'signup' THEN 'Memory is getting low'
      WHEN 'purchase' THEN 'Table export completed successfully'
      WHEN 'view' THEN 'Processing chunk ' || k ELSE 'lazy dataframe read_database' END AS value
  FROM feed)"""
)


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    line = """concat('[', substring(cast(ts AS string), 1, 19), '] [',
      CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END,
      '] [JOB:', job_id, ']',
      CASE WHEN event_type = 'signup' THEN '' ELSE concat(' [TABLE:', table_name, '] [PROGRESS:', k,
        '.0%] [CHUNKS:', k, '/100] [METHOD:range_chunking]') END,
      ' [CONN:1/16] [MEM:', amount, '.5MB] ',
      CASE event_type WHEN 'error' THEN concat('Chunk ', k, ' failed: connection timeout')
        WHEN 'signup' THEN 'Memory is getting low'
        WHEN 'purchase' THEN 'Table export completed successfully'
        WHEN 'view' THEN concat('Processing chunk ', k) ELSE 'lazy dataframe read_database' END)"""
    return feed(spark, sf).selectExpr("seq AS line_no", f"{line} AS value")


def with_ctes(*ctes: str) -> str:
    """``WITH`` clause of several named SQL inputs."""
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
