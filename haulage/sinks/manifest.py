"""What an export consists of: files, chunks, row counts, and the manifest that says so.

``_export_metadata`` holds one JSON row; ``_export_files`` one Parquet row per file, so
the file list never passes through the driver. Both names start with an underscore,
which keeps them out of reads of the export itself.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.session import child_names, path_exists, write_text

METADATA, FILES = "_export_metadata", "_export_files"
CHUNK = "chunk_id"

METADATA_SCHEMA = (
    "table_name string, total_rows bigint, export_timestamp string, status string, "
    "job_id string, method string, partitioned boolean, chunk_count int, chunk_size bigint, "
    "file_count bigint, total_bytes bigint, schema_json string, plan_json string, "
    "final_path string, organized_timestamp string"
)
FILES_SCHEMA = "file_path string, file_name string, file_size bigint, chunk_id int, row_count bigint"


def part_name(chunk_id):
    """Documented 1-based name of a chunk."""
    return F.format_string("part_%04d", chunk_id + 1)


def chunk_folders(spark: SparkSession, path: str, chunks: list[int]) -> list[str]:
    """Folders of those chunks that have one; the export's folder is listed once."""
    present = set(child_names(spark, path))
    return [f"{path}/{CHUNK}={c}" for c in chunks if f"{CHUNK}={c}" in present]


def scan_files(
    spark: SparkSession, path: str, schema: T.StructType, chunked: bool, folders: list[str] | None = None
) -> DataFrame:
    """Rows per data file, from the Parquet footers (no column is read).

    The path decides the chunk, so a file that lies in the wrong place is seen as such.
    ``folders`` restricts the listing to some chunks.
    """
    if chunked:
        schema = T.StructType([*schema.fields, T.StructField(CHUNK, T.IntegerType())])
    chunk = F.col(CHUNK) if chunked else F.lit(0)
    reader = spark.read.schema(schema).option("basePath", path)
    files = reader.parquet(*([path] if folders is None else folders)).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"),
        chunk.cast("int").alias("chunk_id"),
    )
    return (
        files.groupBy("file_path", "file_size", "chunk_id")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select("file_path", F.element_at(F.split("file_path", "/"), -1).alias("file_name"),
                "file_size", "chunk_id", "row_count")
    )


def write_manifest(
    spark: SparkSession,
    path: str,
    table: str,
    schema: T.StructType,
    *,
    method: str,
    chunked: bool,
    planned_chunks: int = 1,
    chunk_size: int | None = None,
    plan: dict | None = None,
    job_id: str | None = None,
    expected_rows: int | None = None,
) -> dict:
    """List the files of an export and seal it; the metadata row is written last.

    Returns the metadata. Totals are one row; the file list stays distributed. An export
    with another number of rows than ``expected_rows`` is not sealed. Files are listed by
    their place below ``path``, so the list stays right when the export is moved.
    """
    place = F.element_at(F.split("file_path", "/"), -2)
    listed = scan_files(spark, path, schema, chunked).withColumn(
        "file_path", F.concat_ws("/", place, "file_name") if chunked else F.col("file_name")
    )
    listed.write.parquet(f"{path}/{FILES}")
    totals = (
        read_files(spark, path)
        .agg(
            F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
            F.count(F.lit(1)).alias("file_count"),
            F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes"),
        )
        .first()
    )
    if expected_rows is not None and totals["total_rows"] != expected_rows:
        raise ValueError(f"{table}: {totals['total_rows']} rows written, {expected_rows} expected")
    metadata = {
        "table_name": table,
        "total_rows": totals["total_rows"],
        "export_timestamp": datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S"),
        "status": "complete",
        "job_id": job_id,
        "method": method,
        "partitioned": chunked,
        "chunk_count": planned_chunks,
        "chunk_size": chunk_size,
        "file_count": totals["file_count"],
        "total_bytes": totals["total_bytes"],
        "schema_json": schema.json(),
        "plan_json": json.dumps(plan) if plan else None,
        "final_path": None,
        "organized_timestamp": None,
    }
    save_metadata(spark, path, metadata)
    return metadata


def save_metadata(spark: SparkSession, path: str, metadata: dict) -> None:
    write_text(spark, f"{path}/{METADATA}/metadata.json", json.dumps(metadata))


def read_metadata(spark: SparkSession, *paths: str) -> DataFrame:
    """Metadata rows of exports, with the export's path."""
    rows = spark.read.schema(METADATA_SCHEMA).json([f"{p}/{METADATA}" for p in paths])
    path = F.regexp_replace(F.col("_metadata.file_path"), f"/{METADATA}/[^/]*$", "")
    return rows.withColumn("path", path)


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """The listed files, with the paths that they have where the export lies now."""
    rows = spark.read.schema(FILES_SCHEMA).parquet(*[f"{p}/{FILES}" for p in paths])
    root = F.regexp_replace(F.col("_metadata.file_path"), f"/{FILES}/[^/]*$", "")
    return rows.withColumn("file_path", F.concat_ws("/", root, "file_path"))


def load_metadata(spark: SparkSession, path: str) -> dict | None:
    """The single metadata row of one export, or None when it was never sealed."""
    if not path_exists(spark, f"{path}/{METADATA}/metadata.json"):
        return None
    return read_metadata(spark, path).first().asDict()


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """A sealed export with its stored schema. Chunked exports keep ``chunk_id``."""
    metadata = load_metadata(spark, path)
    if metadata is None:
        raise ValueError(f"no complete export at {path}")
    schema = T.StructType.fromJson(json.loads(metadata["schema_json"]))
    if metadata["partitioned"]:
        schema = schema.add(CHUNK, T.IntegerType())
    return spark.read.schema(schema).parquet(path)


def list_data_files(spark: SparkSession, path: str, folders: list[str] | None = None) -> DataFrame:
    """Data files as they lie on disk (path, size), whether readable or not; of some chunks'
    ``folders`` only, if they are given."""
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load([path] if folders is None else folders)
    )
    in_chunk = F.regexp_extract("path", rf"/{CHUNK}=(\d+)/", 1)
    return listing.where(~F.col("path").contains(f"/{FILES}/")).select(
        F.col("path").alias("file_path"),
        F.col("length").alias("file_size"),
        F.when(in_chunk == "", 0).otherwise(in_chunk.try_cast("int")).alias("chunk_id"),
    )


def export_details(files: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Per table: files, chunks, rows and size; taken from the files where the table has
    no metadata row. ``files(table_name, chunk_id, file_size)``."""
    mb = F.lit(1024.0 * 1024.0)
    found = files.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.countDistinct("chunk_id").alias("chunks_found"),
        F.sum("file_size").alias("total_size_bytes"),
    )
    sized = found.withColumn("total_size_mb", F.round(F.col("total_size_bytes") / mb, 2))
    if metadata is None:
        stated = sized.withColumns({"chunk_count": F.lit(None).cast("bigint"),
                                    "partitioned": F.lit(None).cast("boolean")})
    else:
        stated = sized.join(
            metadata.select("table_name", F.col("chunk_count").cast("bigint").alias("chunk_count"),
                            "partitioned"),
            "table_name", "left",
        )
    return stated.select(
        "table_name",
        "file_count",
        F.coalesce("chunk_count", "chunks_found").alias("chunk_count"),
        F.coalesce("partitioned", F.col("chunks_found") > 1).alias("partitioned"),
        "total_size_bytes",
        "total_size_mb",
        F.when(F.col("chunk_count").isNull(), "inferred_from_files")
        .otherwise("manifest").alias("metadata_source"),
    )
