"""A training corpus in five stages, each written as Parquet and read by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from haulage.session import new_dir, remove, scratch, shuffles_removed, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.toxicity(docs.select(*COLUMNS), labels)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    Rows with an identifier of their own keep it; the others, among them all rows without
    one, are named after a hash of identifier and text, and rows that agree in both become
    one row before the search. So exactly one row of each group is the kept one.
    """
    docs = docs.select(*COLUMNS)
    own = F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(1 << 61))
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    shared = written(ids.where("n > 1 OR doc_id IS NULL").select("doc_id"), "shared-ids")
    if not shared.limit(1).count():
        named = docs.withColumn("name", F.col("doc_id"))
    else:
        same = docs["doc_id"].eqNullSafe(shared["doc_id"])
        hashed = docs.join(shared, same, "left_semi").withColumn("name", -own - 1)
        # Copies are combined before they are shuffled.
        once = hashed.groupBy("name").agg(F.first(F.struct(*COLUMNS)).alias("r")).select("r.*", "name")
        rest = docs.join(shared, same, "left_anti").withColumn("name", F.col("doc_id"))
        named = written(rest.unionByName(once), "named")
    found = near_dedup.near_duplicates(named.select(F.col("name").alias("doc_id"), "text"), size=5)
    dropped = found.where("NOT kept").select(F.col("doc_id").alias("name"))
    return named.join(dropped, "name", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs.select(*COLUMNS), items).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    mixed = mixing.mix(docs.select(*COLUMNS)).where("repeats > 0")
    copies = F.sequence(F.lit(1).cast("long"), F.col("repeats"))
    return mixed.withColumn("_copy", F.explode(copies)).select(*COLUMNS)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their place in it."""
    return sharding.shard(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

# Models, sketches and label propagation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage's result is written to the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_dir(spark, f"stage-{name}")
        with scratch(spark):  # what the stage has written on its way goes
            result = stage(spark, docs, sf_dir)
            with shuffles_removed(spark):
                result.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
