"""Helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulage.session import written

# The blanks that separate words: space, tab, line feed, vertical tab, form feed, return.
BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def whole(text: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def row_key(key: str, text: str) -> list[Column]:
    """``_k``, ``_c``: tells rows apart by identifier and content, also where the identifier
    is null or given twice. Rows that agree in both are copies of one row and share results."""
    content = F.xxhash64(F.lit(7), whole(text))
    return [F.coalesce(F.col(key).cast("long"), F.xxhash64(whole(text))).alias("_k"), content.alias("_c")]


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Smaller Arrow batches, so that a batch of long texts stays some tens of MB; a size that
    the session was given on purpose is kept."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def ranks(
    df: DataFrame, group: list[str], bucket: list[str], order: list[str], name: str
) -> DataFrame:
    """``df`` plus a 0-based, gapless rank per ``group`` in the order (bucket, order).

    No window covers a group: rows are numbered within a bucket, and bucket sizes summed up
    give the offsets. With about as many buckets as rows in a bucket both stay small.
    """
    counts = df.groupBy(*group, *bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy(*bucket).rowsBetween(W.unboundedPreceding, -1)
    keys = [*group, *bucket]
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = W.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("_r", F.row_number().over(inside).cast("long") - 1)
    return (
        numbered.join(offsets, keys)
        .withColumn(name, F.col("_o") + F.col("_r"))
        .drop("_o", "_r")
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every end of ``edges(a, b)``; the component is its smallest id.

    Each round links every vertex to the smallest root among its neighbours and then jumps
    to the root's root, so the number of rounds follows the logarithm of the longest path.
    Minima are combined before each shuffle, and each round is written to the shared folder.
    """
    both = edges.selectExpr("a AS id", "b AS other").unionByName(
        edges.selectExpr("b AS id", "a AS other")
    )
    both = written(both.distinct(), "edges")
    labels = written(
        both.groupBy("id").agg(F.min("other").alias("m")).selectExpr("id", "least(id, m) AS root"),
        "labels",
    )
    for _ in range(rounds):
        roots = labels.selectExpr("id AS other", "root AS seen")
        near = both.join(roots, "other").groupBy("id").agg(F.min("seen").alias("m"))
        # The smallest root seen by a vertex is also offered to the vertex's own root.
        offered = near.join(labels, "id").selectExpr("root AS id", "m")
        best = (
            near.unionByName(offered)
            .unionByName(labels.selectExpr("id", "root AS m"))
            .groupBy("id").agg(F.min("m").alias("low"))
        )
        jump = best.selectExpr("id AS low", "low AS lower")
        following = written(
            best.join(jump, "low")
            .join(labels, "id")
            .selectExpr("id", "least(low, lower) AS root", "root <> least(low, lower) AS moved"),
            "labels",
        )
        labels = following.select("id", "root")
        if not following.where("moved").limit(1).count():
            return labels.withColumnRenamed("root", "component")
    raise RuntimeError("components did not settle")


def position(names: list[str], name: str) -> int:
    """Where a column is: by its exact name, else in any case."""
    if name in names:
        return names.index(name)
    folded = [n.lower() for n in names]
    if name.lower() in folded:
        return folded.index(name.lower())
    raise ValueError(f"no column {name} among {names}")


def exact(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the columns ``wanted`` (new name = name in ``df``). A column is found by its exact
    name, else in any case, so further columns, also twins in another case, are not in the way."""
    return _numbered(df).select(
        *[F.col(f"c{position(df.columns, old)}").alias(new) for new, old in wanted.items()]
    )


def _numbered(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def inside(names: list[str], name: str) -> Column:
    """The column ``name`` of a row that :func:`packed` made of columns ``names``."""
    return F.col("row").getField(f"c{position(names, name)}")


def packed(df: DataFrame, **wanted: str) -> DataFrame:
    """All columns as one, ``row``, and those ``wanted`` beside it as in :func:`exact`: inner
    names of an operator then cannot meet names of the caller."""
    whole_row = _numbered(df).select(F.struct("*").alias("row"))
    return whole_row.select("row", *[inside(df.columns, old).alias(new) for new, old in wanted.items()])


def unpacked(df: DataFrame, names: list[str], **results: Column) -> DataFrame:
    """The caller's columns back out of ``row``, and ``results`` after them. A column of the
    caller that has a result's name, in any case, gives way to it."""
    gone = {n.lower() for n in results}
    kept = [F.col("row").getField(f"c{i}").alias(n) for i, n in enumerate(names) if n.lower() not in gone]
    return df.select(*kept, *[c.alias(n) for n, c in results.items()])
