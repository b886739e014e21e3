"""Balanced label propagation: linked documents move towards the shard of their neighbours.

Documents with equal text are linked. What moves is a piece, an eighth of the rows of one text
that began in one shard, so the state is at most eight rows per text and shard however many
rows hold the text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulage.llm.common import exact, packed, ranks, unpacked, whole
from haulage.session import written

SHARDS = 16
ROUNDS = 6
_PIECES = 8  # of a text's rows in a shard
_FULL = 0.95  # of its quota: a shard that asks for no more, since hardly any piece fits
_CLASSES, _PARTS = 16, 16  # classes of texts by their number of rows, and parts of a class


def _loads(pieces: DataFrame) -> DataFrame:
    """``(_shard, _class, _held)`` for every class: rows of that class and of larger texts."""
    held = pieces.groupBy("_shard", "_class").agg(F.sum("_n").alias("_n"))
    every = held.select("_shard", "_n", F.explode(F.sequence("_class", F.lit(_CLASSES - 1))).alias("_class"))
    return every.groupBy("_shard", "_class").agg(F.sum("_n").alias("_held"))


def _propagate(pieces: DataFrame, quota: int, rounds: int) -> DataFrame:
    """``pieces(_g1, _g2, _start, _n, _class, _shard)`` after label propagation under the quota.

    In each round a piece asks for the shard that holds most rows of its text, ties by a
    hash of the text. A shard admits larger texts first, then by a hash, while their rows fit
    into what texts as large leave of its quota; smaller texts that no longer fit lose
    their place in the end. Requests and loads are sums per shard and priority, tables of
    fixed size. A text that outgrows a shard goes on to the next fullest with room.
    """
    group = ["_g1", "_g2"]
    for turn in range(rounds):
        loads = written(_loads(pieces), "shard-loads")
        full = loads.where(F.col("_held") >= quota * _FULL).select(F.col("_shard").alias("_to"), "_class")
        votes = pieces.groupBy(*group, "_class", F.col("_shard").alias("_to")).agg(F.sum("_n").alias("_v"))
        open_votes = votes.join(F.broadcast(full), ["_to", "_class"], "left_anti")  # a fixed size
        liking = F.struct("_v", F.xxhash64(*group, "_to"), "_to")
        wish = open_votes.groupBy(*group).agg(F.max(liking).alias("_w")).select(
            *group, F.col("_w._v").alias("_v"), F.col("_w._to").alias("_to")
        )
        own = votes.select(*group, F.col("_to").alias("_shard"), F.col("_v").alias("_own"))
        part = F.pmod(F.xxhash64(*group, "_start", F.lit(turn)), F.lit(_PARTS)).cast("int")
        asking = written(
            pieces.join(own, [*group, "_shard"]).join(wish, group)
            .where("_shard <> _to AND _v >= _own")
            .select(*group, "_start", "_class", "_to", part.alias("_part"), "_n"),
            "shard-wishes",
        )
        sums = asking.groupBy("_to", "_class", "_part").agg(F.sum("_n").alias("_s"))
        running = W.partitionBy("_to").orderBy("_class", "_part").rowsBetween(W.unboundedPreceding, 0)
        admitted = (
            sums.withColumn("_upto", F.sum("_s").over(running))
            .join(loads.withColumnRenamed("_shard", "_to"), ["_to", "_class"], "left")
            .where(F.col("_upto") + F.coalesce("_held", F.lit(0)) <= quota)
            .select("_to", "_class", "_part")
        )
        moves = asking.join(F.broadcast(admitted), ["_to", "_class", "_part"])  # a fixed size
        pieces = written(
            pieces.join(moves.select(*group, "_start", "_to"), [*group, "_start"], "left").select(
                *group, "_start", "_n", "_class", F.coalesce("_to", "_shard").alias("_shard")
            ),
            "shard-pieces",
        )
    return pieces


def shard(
    docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` plus ``shard`` and ``slot``; counts of shards differ by one row at most.

    Linked rows keep the shard that propagation gave them as far as its target count goes,
    larger texts first; rows beyond it and rows without links fill what is missing, rows of
    one text one after the other. Null and empty texts count
    as the same empty text. Rows equal in identifier and text are interchangeable. Rows without
    an identifier get a number first, and their table is written with it, so that many of one
    text are no hot key and a task that runs again finds the same numbers. An empty table
    gives an empty one; columns of ``docs`` named like a result give way to it.
    """
    same = ["_k", "_u", "_g1", "_g2"]
    named = exact(docs, key=key, text=text)
    whole_rows = packed(docs, key=key, text=text)
    own = [
        F.col("key").cast("long").alias("_k"),
        F.xxhash64(whole("text")).alias("_g1"),
        F.xxhash64(F.lit(11), whole("text")).alias("_g2"),
    ]
    nameless = not named.where("key IS NULL").isEmpty()
    none = F.lit(0).cast("long").alias("_u")
    thin, whole_rows = named.select(*own, none), whole_rows.select("row", *own, none)
    if nameless:
        numbered = written(
            whole_rows.where("_k IS NULL").withColumn("_u", F.monotonically_increasing_id() + 1), "shard-nameless"
        )
        thin = thin.where("_k IS NOT NULL").unionByName(numbered.drop("row"))
        whole_rows = whole_rows.where("_k IS NOT NULL").unionByName(numbered)
    group = ["_g1", "_g2"]
    thin = thin.withColumn("_h", F.xxhash64(F.coalesce("_k", -F.col("_u")), "_g1")).withColumn(
        "_start", F.pmod("_h", F.lit(shards * _PIECES)).cast("int")
    )
    # Rows equal in identifier and text have one hash and so stay together.
    states = thin.groupBy(*group, "_start").agg(F.count(F.lit(1)).alias("_n"))
    linked = written(
        states.join(
            states.groupBy(*group).agg(F.sum("_n").alias("_all")).where("_all > 1"), group
        )
        .withColumn("_shard", F.pmod("_start", F.lit(shards)))
        # Class 0 holds the largest texts.
        .withColumn("_class", (_CLASSES - 1) - F.least(F.lit(_CLASSES - 1), F.floor(F.log2("_all")).cast("int"))),
        "shard-pieces",
    )
    rows = named.count()
    quota = rows // shards
    placed = _propagate(linked.drop("_all"), quota, rounds)
    sizes = linked.select(*group, "_start", "_all")
    state = placed.join(sizes, [*group, "_start"])

    buckets = max(1, math.isqrt(rows // shards))
    tagged = (
        thin.join(state, [*group, "_start"], "left")
        .withColumn("_salt", F.pmod("_h", F.floor(F.coalesce("_all", F.lit(0)) / (buckets + 1)) + 1))
        .withColumn("_b", F.pmod("_g1", F.lit(buckets)))
        .withColumn("_loose", F.col("_shard").isNull())
    )
    order = ["_g1", "_g2", "_h", "_k", "_u"]
    target = F.lit(quota) + (F.col("_shard") < rows % shards).cast("long")
    settled = ranks(tagged.where("NOT _loose"), ["_shard"], ["_class", "_b", "_salt"], order, "_rank")
    settled = written(
        settled.withColumn("_over", F.col("_rank") >= target).select(
            "_k", "_u", *group, "_h", "_all", "_shard", "_rank", "_over"
        ),
        "shard-settled",
    )
    keep = settled.where("NOT _over")
    # What each shard lacks, as intervals over the ranks of the loose rows: `shards` rows.
    counts = {r["_shard"]: r["n"] for r in keep.groupBy("_shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    upto, chosen, first = 0, F.lit(shards - 1), F.lit(0)
    bounds = []
    for s in range(shards):
        lack = quota + (s < rows % shards) - counts.get(s, 0)
        bounds.append((s, upto, upto + lack, counts.get(s, 0)))
        upto += lack
    for s, low, high, used in reversed(bounds):
        here = F.col("_rank") < high
        chosen = F.when(here, F.lit(s)).otherwise(chosen)
        first = F.when(here, F.lit(used - low)).otherwise(first)
    wide = max(1, math.isqrt(rows))
    loose = (
        tagged.where("_loose").select(*same, "_h", "_all")
        .unionByName(settled.where("_over").select(*same, "_h", "_all"))
        .withColumn("_one", F.lit(0))
        # Rows of one text follow each other here as well.
        .withColumn("_b", F.pmod("_g1", F.lit(wide)))
        .withColumn("_salt", F.pmod("_h", F.floor(F.coalesce("_all", F.lit(0)) / (wide + 1)) + 1))
    )
    loose = ranks(loose, ["_one"], ["_b", "_salt"], order, "_rank").select(
        *same, chosen.alias("shard"), (F.col("_rank") + first).alias("slot")
    )
    dealt = keep.select(*same, F.col("_shard").alias("shard"), F.col("_rank").alias("slot"))
    # The rows themselves: copies are numbered on both sides, so each takes a place of its own.
    places = _numbered(dealt.unionByName(loose), same, ["shard", "slot"])
    full = _numbered(whole_rows, same, same)
    match = (
        full["_k"].eqNullSafe(places["_k"]) & (full["_u"] == places["_u"]) & (full["_g1"] == places["_g1"])
        & (full["_g2"] == places["_g2"]) & (full["_nth"] == places["_nth"])
    )
    return unpacked(
        full.join(places, match).select("row", "shard", "slot"), docs.columns,
        shard=F.col("shard"), slot=F.col("slot"),
    )


def _numbered(df: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*same).orderBy(*order)))
