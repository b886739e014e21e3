"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulage.llm.common import exact, packed, ranks, unpacked, whole, word_count
from haulage.operators.positions import placed
from haulage.session import written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
_BLOCK = 100_000  # copies of a row that one task numbers at a time
_DIGITS = 3  # hex digits that one level of the search for the cut looks at


def fill(sources: DataFrame, epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources(_source, size, weight)`` plus ``target``: shares of all sizes by weight.

    A source whose share exceeds ``epochs`` times its size is clamped there, and what it
    leaves is shared among the others by weight, until no share exceeds its cap. The clamped
    set only grows, so each round is one small aggregate and the loop ends.
    """
    sources = sources.withColumn("_cap", F.col("size") * epochs)
    total = sources.agg(F.sum("size").alias("n")).first()["n"] or 0
    level, clamped = 0.0, -1
    while True:
        full = F.col("_cap") <= F.col("weight") * F.lit(level)
        row = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weights"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if row["n"] == clamped or not row["weights"]:
            break
        clamped, level = row["n"], (total - row["held"]) / row["weights"]
    share = F.col("weight") * F.lit(level)
    return sources.withColumn(
        "target", F.when(F.col("_cap") <= share, F.col("_cap").cast("double")).otherwise(share)
    ).drop("_cap")


def _cuts(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``_cut`` per source: documents whose seeded number is at most that give one more
    repetition, so that the sum comes as near the target as whole documents allow.

    The cut is searched by the digits of the number: sums per digit group of the bucket that
    the budget ends in, twice, then a window over the few documents that are left.
    """
    state = sources.select(
        "_source", F.lit("").alias("_prefix"), F.lit(0).cast("long").alias("_base"), "_budget"
    )
    for level in range(2):
        digits = F.substring("_u", level * _DIGITS + 1, _DIGITS)
        inside = rows.join(state, rows["_source"].eqNullSafe(state["_source"])).drop(
            rows["_source"]
        )
        sums = (
            inside.where(F.col("_u").startswith(F.col("_prefix")))
            .groupBy("_source", "_prefix", "_base", "_budget", digits.alias("_d"))
            .agg(F.sum("size").alias("_s"))
        )
        running = W.partitionBy("_source").orderBy("_d").rowsBetween(W.unboundedPreceding, 0)
        upto = F.col("_base") + F.sum("_s").over(running)
        state = written(
            sums.withColumn("_upto", upto)
            .where(F.col("_upto") > F.col("_budget"))
            .groupBy("_source")
            .agg(F.min_by(F.struct("_prefix", "_d", "_upto", "_s", "_budget"), "_d").alias("x"))
            .select(
                "_source",
                F.concat("x._prefix", "x._d").alias("_prefix"),
                (F.col("x._upto") - F.col("x._s")).alias("_base"),
                F.col("x._budget").alias("_budget"),
            ),
            "mix-level",
        )
    inside = rows.join(state, rows["_source"].eqNullSafe(state["_source"])).drop(rows["_source"])
    order = W.partitionBy("_source").orderBy("_u").rowsBetween(W.unboundedPreceding, -1)
    earlier = F.col("_base") + F.coalesce(F.sum("size").over(order), F.lit(0))
    fits = F.col("_earlier") + F.col("size") / 2 <= F.col("_budget")
    return (
        inside.where(F.col("_u").startswith(F.col("_prefix")))
        .withColumn("_earlier", earlier)
        .groupBy("_source", "_prefix")
        # Where nothing of the bucket fits, the cut is just below it.
        .agg(F.max(F.when(fits, F.col("_u"))).alias("_last"))
        .select("_source", F.coalesce("_last", "_prefix").alias("_cut"))
    )


def _copies(counted: DataFrame) -> DataFrame:
    """``_source, _first, _u, size``: a number of its own for each of the equal rows. The first
    keeps the number of the row. Blocks of copies are spread over tasks before they are made."""
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(1).cast("long"), "_n", F.lit(_BLOCK))))
    last = F.least(F.col("_block") + _BLOCK - 1, F.col("_n"))
    copies = blocks.repartition("_u", "_block").withColumn("_copy", F.explode(F.sequence("_block", last)))
    own = F.md5(F.concat_ws("|", "_u", "_copy"))
    return copies.select(
        "_source", F.col("_u").alias("_first"), F.when(F.col("_copy") == 1, F.col("_u")).otherwise(own).alias("_u"), "size"
    )


def mix(
    docs: DataFrame, weights=WEIGHTS, epochs: int = MAX_EPOCHS, seed: str = SEED,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """``docs`` plus ``mix_size``, ``source_size``, ``target`` and ``repeats`` (0 to ``epochs``).

    Sources are weighted in turn by code point, null last. Each document gives the whole
    repetitions of its source; the fraction is drawn in the order of a seeded hash of
    identifier and text, so reruns agree. Rows that agree in both are numbered and each copy
    is drawn by itself; which of the equal rows it is does not matter. Null and empty texts
    have size 0. The tables of sources and of repeated rows are written, so that the planner
    knows their size and decides whether they are small enough to be broadcast; identifiers
    and sizes alone are searched. An empty table gives an empty result; columns named like a
    result are replaced.
    """
    number = F.md5(
        F.concat_ws("|", F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit("")), F.md5(whole("text")))
    )
    sized = [F.col("source").cast("string").alias("_source"), number.alias("_u"), word_count("text").alias("size")]
    counted = written(
        exact(docs, key=key, text=text, source=source).select(*sized)
        .groupBy("_source", "_u", "size").agg(F.count(F.lit(1)).alias("_n")),
        "mix-rows",
    )
    again = counted.where("_n > 1")
    rows, repeated = counted.select("_source", "_u", "size"), bool(again.limit(1).count())
    if repeated:
        copies = written(_copies(again), "mix-copies")
        rows = rows.join(again.select("_source", "_u"), ["_u"], "left_anti").unionByName(copies.drop("_first"))
        rows = written(rows, "mix-numbers")
    sums = written(rows.groupBy("_source").agg(F.sum("size").alias("size")), "mix-sources")
    turn = placed(sums.withColumn("_null", F.col("_source").isNull()), ["_null", "_source"], "_turn")
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("_turn") % len(weights) + 1).cast("int")
    )
    sources = written(turn.select("_source", "size", weight.alias("weight")), "mix-weights")
    whole_part = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    filled = written(
        fill(sources, epochs)
        .withColumn("_whole", whole_part.cast("long"))
        .withColumn("_budget", F.col("target") - F.col("_whole") * F.col("size")),
        "mix-targets",
    )
    cuts = _cuts(rows, filled.where("size > 0"))
    plan = written(
        filled.join(cuts, filled["_source"].eqNullSafe(cuts["_source"]), "left").select(
            filled["_source"].alias("_s"), F.col("size").alias("_total"), "target", "_whole", "_cut"
        ),
        "mix-plan",
    )
    of_source = F.col("_source").eqNullSafe(F.col("_s"))
    whole_rows = packed(docs, key=key, text=text, source=source).select("row", *sized)
    drawn = whole_rows.withColumn("_part", F.spark_partition_id()).join(plan, of_source)
    one = F.coalesce((F.col("_u") <= F.col("_cut")).cast("long"), F.lit(0))
    if repeated:
        drawn = _drawn_copies(drawn, copies.join(plan, of_source), one)
    else:
        drawn = drawn.withColumn("_one", one)
    return unpacked(
        drawn, docs.columns, mix_size=F.col("size"), source_size=F.col("_total"), target=F.col("target"),
        repeats=F.col("_whole") + F.col("_one"),
    )


def _drawn_copies(drawn: DataFrame, copies: DataFrame, one: Column) -> DataFrame:
    """``drawn`` plus ``_one``: of equal rows as many are drawn as of their numbered copies.

    Where some but not all are, rows are numbered by the partition that they were read from
    and within it, so that no task meets all copies of a row.
    """
    groups = written(
        copies.groupBy("_source", "_first").agg(F.sum(one).alias("_k"), F.count(F.lit(1)).alias("_all"))
        .select(F.col("_source").alias("_gs"), F.col("_first").alias("_gu"), "_k", "_all"),
        "mix-groups",
    )
    same = F.col("_source").eqNullSafe(F.col("_gs")) & (F.col("_u") == F.col("_gu"))
    joined = drawn.join(groups, same, "left")
    some = F.coalesce((F.col("_k") > 0) & (F.col("_k") < F.col("_all")), F.lit(False))
    settled = joined.where(~some).withColumn("_one", F.when(F.col("_all").isNull(), one).otherwise((F.col("_k") > 0).cast("long")))
    keyed = joined.where(some).withColumn("_key", F.coalesce("_source", F.lit("")))
    keyed = keyed.withColumn("_null", F.col("_source").isNull())
    counted = ranks(keyed, ["_key", "_null", "_u"], ["_part"], ["_u"], "_place")
    return settled.unionByName(
        counted.withColumn("_one", (F.col("_place") < F.col("_k")).cast("long")).select(*settled.columns)
    )
