"""Types, casts and text cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.functions import text, types
from haulage.operators import audit
from haulage.queries.derived import COLUMNS_SQL, cents, catalog_columns, with_ctes
from haulage.queries.registry import query
from haulage.sources.tables import load


def _type_rows() -> str:
    return ", ".join(
        f"('{dialect}', '{name}', '{spark_name}')"
        for dialect in ("postgresql", "greenplum", "vertica")
        for name, spark_name in types.type_names(dialect).items()
    )


@query("map_types", with_ctes(COLUMNS_SQL, f"""
known(dialect, name, engine_type) AS (VALUES {_type_rows()}),
spelled AS (SELECT DISTINCT dialect, data_type, trim(regexp_replace(regexp_replace(
  lower(data_type), '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g')) AS base FROM catalog_columns),
mapped AS (
  SELECT s.dialect, s.data_type, s.base,
    arg_max(k.engine_type, length(k.name)) AS engine_type
  FROM spelled s LEFT JOIN known k ON k.dialect = s.dialect
    AND (s.base = k.name OR starts_with(s.base, k.name || ' '))
  GROUP BY ALL)""") + """
SELECT dialect, data_type,
  CASE WHEN base LIKE '%[]' OR base LIKE 'array%' THEN 'string'
    ELSE coalesce(engine_type, 'string') END AS engine_type,
  count(*) AS columns
FROM catalog_columns JOIN mapped USING (dialect, data_type) GROUP BY ALL""")
def map_types(spark: SparkSession, sf: str) -> DataFrame:
    dialect = F.col("dialect")
    mapped = F.when(dialect == "vertica", types.spark_type(F.col("data_type"), "vertica"))
    mapped = mapped.when(dialect == "greenplum", types.spark_type(F.col("data_type"), "greenplum"))
    mapped = mapped.otherwise(types.spark_type(F.col("data_type")))
    spelled = catalog_columns(spark, sf).groupBy("dialect", "data_type")
    return spelled.agg(F.count(F.lit(1)).alias("columns")).withColumn("engine_type", mapped)


@query("enforce_schema", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  CAST(l_quantity AS BIGINT) AS l_quantity, CAST(l_suppkey AS VARCHAR) AS l_suppkey,
  CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate, l_returnflag
FROM lineitem""")
def enforce_schema(spark: SparkSession, sf: str) -> DataFrame:
    from haulage.sources.tables import scan_table

    declared = {
        "l_orderkey": "bigint", "l_linenumber": "bigint", "l_quantity": "bigint",
        "l_suppkey": "string", "l_shipdate": "date", "l_returnflag": "string",
    }
    typed = scan_table(load(spark, sf, "lineitem"), declared)
    return typed.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


# What a catalog might claim about these columns; some of it does not hold.
CLAIMED = {
    "p_partkey": "bigint", "p_name": "double", "p_brand": "int", "p_type": "string", "p_size": "bigint",
    "p_retailprice": "double",
}


@query("cast_audit", """
SELECT column_name, target_type, CAST(misfits AS BIGINT) AS misfits,
  CAST(null_count AS BIGINT) AS null_count, total_rows
FROM (VALUES ('p_brand', 'int'), ('p_size', 'bigint'), ('p_name', 'double'),
  ('p_type', 'string'), ('p_partkey', 'bigint'), ('p_retailprice', 'double')) t(column_name, target_type)
JOIN (
  SELECT 'p_brand' AS column_name, count(*) FILTER (WHERE p_brand IS NOT NULL AND try_cast(p_brand AS INTEGER) IS NULL) AS misfits,
    count(*) - count(p_brand) AS null_count, count(*) AS total_rows FROM part
  UNION ALL SELECT 'p_size', count(*) FILTER (WHERE p_size IS NOT NULL AND try_cast(p_size AS BIGINT) IS NULL),
    count(*) - count(p_size), count(*) FROM part
  UNION ALL SELECT 'p_name', count(*) FILTER (WHERE p_name IS NOT NULL AND try_cast(p_name AS DOUBLE) IS NULL),
    count(*) - count(p_name), count(*) FROM part
  UNION ALL SELECT 'p_partkey', 0, count(*) - count(p_partkey), count(*) FROM part
  UNION ALL SELECT 'p_retailprice', 0, count(*) - count(p_retailprice), count(*) FROM part
  UNION ALL SELECT 'p_type', 0, count(*) - count(p_type), count(*) FROM part)
USING (column_name)""")
def cast_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.cast_audit(load(spark, sf, "part"), CLAIMED)


@query("string_fallback", """
SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, props, event_type,
  CAST(round(value * 100) AS BIGINT) AS value_cents FROM events""")
def string_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """`props` is claimed to be a number and is not, so it alone stays text."""
    claimed = {
        "event_id": "bigint", "user_id": "string", "props": "double", "event_type": "date",
        "value": "double",
    }
    kept = audit.string_fallback(load(spark, sf, "events"), claimed)
    return kept.withColumn("value_cents", cents("value")).drop("value")


@query("mixed_to_numeric", """
SELECT 'part' AS source, p_partkey AS id,
  try_cast(regexp_extract(p_brand, '-?\\d+(\\.\\d+)?') AS DOUBLE) AS number FROM part
UNION ALL
SELECT 'events', event_id, try_cast(regexp_extract(props, '-?\\d+(\\.\\d+)?') AS DOUBLE) FROM events
UNION ALL
SELECT 'documents', doc_id, try_cast(regexp_extract(text, '-?\\d+(\\.\\d+)?') AS DOUBLE)
FROM documents""")
def mixed_to_numeric(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("part", "p_partkey", "p_brand"), ("events", "event_id", "props"),
             ("documents", "doc_id", "text")]
    frames = [
        load(spark, sf, name).select(
            F.lit(name).alias("source"), F.col(key).alias("id"),
            text.mixed_to_numeric(F.col(column)).alias("number"),
        )
        for name, key, column in parts
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("truncate_text", """
SELECT doc_id, md5(substring(text, 1, 5000)) AS digest,
  length(substring(text, 1, 5000)) AS kept_chars, length(text) > 5000 AS was_truncated
FROM documents""")
def truncate_text(spark: SparkSession, sf: str) -> DataFrame:
    capped = audit.truncate_columns(load(spark, sf, "documents"), ["text"], 5000)
    return capped.select(
        "doc_id", F.md5("text").alias("digest"),
        F.length("text").cast("bigint").alias("kept_chars"), "was_truncated",
    )


# What counts as a secret, and what takes its place.
_REDACTED = """regexp_replace(regexp_replace(regexp_replace({c},
    'gAAAAA[A-Za-z0-9_\\-=]+', '***ENCRYPTED_PASSWORD***', 'gi'),
    '(password|pwd|pass|secret|token|api_key|access_key)\\s*[:=]\\s*[^\\s,]+',
    '\\1=***REDACTED***', 'gi'),
    '://([^:]+):([^@]+)@', '://\\1:***REDACTED***@', 'gi')"""


@query("redact_text", f"""
SELECT 'documents' AS source, doc_id AS id, CAST(0 AS BIGINT) AS turn,
  md5({_REDACTED.format(c="text")}) AS digest, text <> {_REDACTED.format(c="text")} AS changed
FROM documents
UNION ALL
SELECT 'conversations', conv_id, turn, md5({_REDACTED.format(c="text")}),
  text <> {_REDACTED.format(c="text")} FROM conversations
UNION ALL
SELECT 'links', page_id, 0, md5({_REDACTED.format(c="link")}), link <> {_REDACTED.format(c="link")}
FROM (SELECT page_id, replace(url, '://', '://user:pw' || page_id || '@') || ' token: gAAAAAB'
  || page_id AS link FROM pages)""")
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    def redacted(df: DataFrame, source: str, key: str, turn, column: str = "text") -> DataFrame:
        clean = text.redact_text(F.col(column))
        return df.select(
            F.lit(source).alias("source"), F.col(key).alias("id"), turn.alias("turn"),
            F.md5(clean).alias("digest"), (F.col(column) != clean).alias("changed"),
        )

    none = F.lit(0).cast("bigint")
    link = F.concat(
        F.replace("url", F.lit("://"), F.concat(F.lit("://user:pw"), "page_id", F.lit("@"))),
        F.lit(" token: gAAAAAB"), "page_id",
    )
    pages = load(spark, sf, "pages").select("page_id", link.alias("link"))
    documents = redacted(load(spark, sf, "documents"), "documents", "doc_id", none)
    talks = redacted(load(spark, sf, "conversations"), "conversations", "conv_id", F.col("turn"))
    return documents.unionByName(talks).unionByName(
        redacted(pages, "links", "page_id", none, "link")
    )


@query("redact_text_strict", """
SELECT c_custkey, '{"user":"u' || c_custkey || '","password":"***REDACTED***","url":' ||
  '"postgresql://u:***REDACTED***@' || lower(c_mktsegment) || '"} api_key: "***REDACTED***", token=***REDACTED***'
  AS line
FROM customer""")
def redact_text_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Keeps JSON keys, separators and quotes."""
    line = F.concat(
        F.lit('{"user":"u'), "c_custkey", F.lit('","password":"'), F.col("c_name"),
        F.lit('","url":"postgresql://u:'), F.replace("c_name", F.lit("#"), F.lit("")), F.lit("@"),
        F.lower("c_mktsegment"), F.lit('"} api_key: "'), F.col("c_name"), F.lit('", token='),
        F.col("c_name"),
    )
    return load(spark, sf, "customer").select(
        "c_custkey", text.redact_text(line, strict=True).alias("line")
    )


@query("redact_config", """
SELECT c_custkey, 'postgresql' AS db_type, lower(c_mktsegment) AS db_host,
  c_name AS db_username, '***ENCRYPTED***' AS db_password, 'orders' AS second_table FROM customer""")
def redact_config(spark: SparkSession, sf: str) -> DataFrame:
    config = F.to_json(
        F.struct(
            F.lit("postgresql").alias("db_type"), F.lower("c_mktsegment").alias("db_host"),
            F.col("c_name").alias("db_username"),
            F.concat(F.lit('p"w,}'), F.col("c_name")).alias("db_password"),
            F.array(F.lit("users"), F.lit("orders")).alias("tables"),
        )
    )
    safe = load(spark, sf, "customer").select(
        "c_custkey", text.redact_config(config).alias("config")
    )
    wanted = ["db_type", "db_host", "db_username", "db_password"]
    return safe.select(
        "c_custkey",
        *[F.get_json_object("config", f"$.{name}").alias(name) for name in wanted],
        F.get_json_object("config", "$.tables[1]").alias("second_table"),
    )


@query("override_hints", with_ctes(COLUMNS_SQL, """
spelled AS (SELECT *, trim(regexp_replace(regexp_replace(lower(data_type), '\\([^)]*\\)', ' ', 'g'),
  '\\s+', ' ', 'g')) AS base FROM catalog_columns)""") + """
SELECT data_type,
  CASE WHEN base IN ('json', 'jsonb', 'xml', 'inet', 'cidr', 'macaddr', 'uuid', 'point', 'line',
      'polygon', 'circle', 'path', 'box', 'interval', 'tsrange', 'daterange') THEN 'string_fallback'
    WHEN base IN ('numeric', 'decimal', 'money') THEN 'float64_fallback' ELSE 'none' END AS hint,
  base IN ('text', 'varchar', 'char', 'json', 'jsonb', 'uuid') AS problematic, count(*) AS columns
FROM spelled GROUP BY ALL""")
def override_hints(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("data_type")
    return (
        catalog_columns(spark, sf)
        .groupBy("data_type", types.override_hint(kind).alias("hint"),
                 types.is_problematic(kind).alias("problematic"))
        .agg(F.count(F.lit(1)).alias("columns"))
    )


@query("validate_nullable", """
SELECT 'part' AS table_name, count(*) AS rows_checked,
  CAST(count(*) * 6 - count(p_partkey) - count(p_name) - count(p_brand) - count(p_type) - count(p_size)
    - count(p_retailprice) AS BIGINT) AS null_values,
  CAST(count(*) FILTER (WHERE p_brand IS NOT NULL AND try_cast(p_brand AS INTEGER) IS NULL) AS BIGINT) AS misfits,
  count(*) FILTER (WHERE p_brand IS NOT NULL AND try_cast(p_brand AS INTEGER) IS NULL) = 0 AS passed,
  'Validation failed: ' || count(*) || ' rows validated' AS message FROM part
UNION ALL
SELECT 'events', count(*), CAST(count(*) * 6 - count(event_id) - count(ts) - count(user_id)
  - count(event_type) - count(value) - count(props) AS BIGINT), 0, true,
  'Validation passed: ' || count(*) || ' rows validated' FROM events""")
def validate_nullable(spark: SparkSession, sf: str) -> DataFrame:
    claimed = {**CLAIMED, "p_size": "int", "p_name": "string"}
    part = audit.validate_nullable(load(spark, sf, "part"), "part", claimed)
    return part.unionByName(audit.validate_nullable(load(spark, sf, "events"), "events"))
