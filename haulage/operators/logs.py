"""Questions about worker logs, whose lines look like
``[time] [LEVEL] [JOB:..] [TABLE:..] [PROGRESS:..%] .. message``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The tags of a line, the content filters and the severity words.
LINE_HEAD = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] \[([A-Z]+)\] ?"
TAGS = {
    "job_id": "JOB", "tables": "TABLES", "job_progress": "JOB-PROGRESS", "table_name": "TABLE",
    "progress": "PROGRESS", "rows": "ROWS", "eta": "ETA", "chunks": "CHUNKS", "method": "METHOD",
    "connections": "CONN", "circuit": "CIRCUIT", "memory": "MEM",
}
CONTENT_FILTERS = {
    "chunk": r"chunk|partition|split|part_\d+|chunks_|processing chunk",
    "processing": r"processing|export|write|read|starting|completed|finished",
    "export": r"export|parquet|file|save|table.*rows|successfully exported",
    "error": r"error|exception|failed|traceback|critical|warning",
    "polars": r"polars|dataframe|lazy|read_database|write_parquet",
}
SEVERITY = (
    ("error", r"ERROR|CRITICAL|Failed|Exception"),
    ("warning", r"WARNING|Warning"),
    ("info", r"SUCCESS|completed|successfully|finished"),
)
# End of fixed values.


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a sort key that follows the files: (file, block, place in the task)."""
    return spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"),
        ).alias("line_no"),
    )


def parse_logs(lines: DataFrame, value: str = "value") -> DataFrame:
    """Time, level, tags and message of each line; absent parts are NULL."""
    def part(pattern: str) -> str:
        return f"nullif(regexp_extract({value}, r'{pattern}', 1), '')"

    tags = {name: part(rf"\[{tag}:([^\]]*)\]") for name, tag in TAGS.items()}
    rest = LINE_HEAD + r"(?:\[[A-Z-]+:[^\]]*\] ?)*"
    return lines.selectExpr(
        "*",
        f"try_cast({part(LINE_HEAD)} AS timestamp_ntz) AS logged_at",
        f"nullif(regexp_extract({value}, r'{LINE_HEAD}', 2), '') AS level",
        *[f"{text} AS {name}" for name, text in tags.items()],
        f"try_cast(rtrim('%', {tags['progress']}) AS double) AS progress_percent",
        f"regexp_replace({value}, r'{rest}', '') AS message",
    )


def tail_logs(
    lines: DataFrame, count: int = 100, job_id: str | None = None,
    value: str = "value", order: str = "line_no",
) -> DataFrame:
    """The last lines, optionally of one job: a top-k over the line number."""
    chosen = lines if job_id is None else lines.where(F.contains(F.col(value), F.lit(job_id)))
    return chosen.orderBy(F.desc(order)).limit(count)


def tail_totals(lines: DataFrame, count: int, job_id: str | None, value: str = "value") -> DataFrame:
    """All lines, matching lines and lines shown."""
    match = F.lit(True) if job_id is None else F.contains(F.col(value), F.lit(job_id))
    return lines.agg(
        F.count(F.lit(1)).alias("total_lines"), F.count_if(match).alias("matching_lines")
    ).withColumn("showing", F.least(F.col("matching_lines"), F.lit(count)))


def content_matches(line: Column, category: str) -> Column:
    return line.rlike("(?i)" + CONTENT_FILTERS[category])


def filter_logs(lines: DataFrame, category: str, value: str = "value") -> DataFrame:
    return lines.where(content_matches(F.col(value), category))


def categorized_logs(lines: DataFrame, value: str = "value") -> DataFrame:
    """``category`` and line for every category that a line falls into, in one pass."""
    hits = [F.when(content_matches(F.col(value), name), name) for name in CONTENT_FILTERS]
    found = F.array_compact(F.array(*hits))
    return lines.select(F.explode(found).alias("category"), *lines.columns)


def log_severity(line: Column) -> Column:
    chain = F
    for name, pattern in SEVERITY:
        chain = chain.when(line.rlike("(?i)" + pattern), name)
    return chain.otherwise("none")
