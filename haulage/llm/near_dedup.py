"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

The sketch throws the hashes of a document's shingles into bins, round after round, each
round with hashes of its own; a bin keeps its smallest value, earlier rounds first. Random
rounds are followed by one round per bin, so every coordinate fills (Dahlgaard, Knudsen and
Thorup 2017). Two sets agree in a coordinate with probability equal to their similarity,
concentrated as for independent hashes, at a cost of a few hashes per shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm import fingerprints as fp
from haulage.llm.common import bounded_batches, components, exact
from haulage.session import written

BANDS, ROWS = 48, 6  # misses a pair of similarity 0.8 with probability 5e-7
COORDINATES = BANDS * ROWS
BITS = 2048  # one bit of as many coordinates; passes over a pair of similarity 0.8 once in 3e6
DEVIATIONS = 5
SYNTHETIC = 1 << 62  # vertices of rows without an identifier lie above it


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's word ``size``-grams; A to Z are lower-cased. A
    shorter text is one shingle as a whole, a text without words has none."""
    words, first = fp.word_hashes(data, offsets, lower=True)
    every = fp.grams(words, size, fp.multipliers(size, 3))
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        if 0 < high - low < size:
            own = fp.multipliers(size, 100 + high - low)  # never equal to a full shingle
            out.append(fp.grams(words[low:high], high - low, own))
            continue
        found = np.sort(every[low : max(low, high - size + 1)])
        fresh = np.ones(len(found), bool)
        fresh[1:] = found[1:] != found[:-1]
        out.append(found[fresh])
    return out


def sketches(sets: list[np.ndarray], count: int = COORDINATES) -> np.ndarray:
    """One row of ``count`` coordinates per set; sets must not be empty."""
    salts = fp.multipliers(2 * count, 17)
    out = np.full((len(sets), count), np.iinfo(np.uint64).max, np.uint64)
    if not sets:
        return out
    low = np.uint64((1 << 48) - 1)
    left = np.arange(len(sets))
    lengths = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(left, lengths)
    for turn in range(2 * count):
        hashed = fp.mix(values ^ salts[turn])
        ranked = (np.uint64(turn) << np.uint64(48)) | (hashed & low)
        if turn < count:
            bins = ((hashed >> np.uint64(48)).astype(np.int64) * count) >> 16
        else:
            bins = np.full(len(values), turn - count)
        np.minimum.at(out.reshape(-1), owner * count + bins, ranked)
        # Values of later rounds are larger, so a document whose bins are full is done.
        if turn % 4 == 3 or turn >= count or turn < 2:
            open_ = (out[left] == np.iinfo(np.uint64).max).any(axis=1)
            if not open_.all():
                left = left[open_]
                if not len(left):
                    break
                stay = np.isin(owner, left)
                values, owner = values[stay], owner[stay]
    return out


def bands(sketch: np.ndarray, bands_: int = BANDS, rows: int = ROWS) -> np.ndarray:
    factors = fp.multipliers(rows, 23)
    parts = sketch.reshape(len(sketch), bands_, rows)
    total = np.zeros(parts.shape[:2], np.uint64)
    for i in range(rows):
        total += fp.mix(parts[:, :, i]) * factors[i]
    return fp.mix(total ^ (np.arange(bands_, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def bit_rows(sketch: np.ndarray) -> np.ndarray:
    """One bit of every coordinate, 64 in a word."""
    return np.packbits(fp.mix(sketch) & np.uint64(1) == 1, axis=1).view(np.uint64)


def far_bits(percent: int, bits: int = BITS) -> int:
    """More differing bits than this mean a similarity below ``percent`` %."""
    odds = (1 - percent / 100) / 2
    return math.ceil(bits * odds + DEVIATIONS * math.sqrt(bits * odds * (1 - odds)))


def _identities(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set, 0 for an empty one."""
    out = np.zeros((len(sets), 2), np.uint64)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        a, b = fp.multipliers(2, 31)
        flat = np.concatenate([sets[i] for i in some])
        starts = np.cumsum([0, *(len(sets[i]) for i in some[:-1])])
        out[some, 0] = fp.mix(np.add.reduceat(fp.mix(flat ^ a), starts))
        out[some, 1] = fp.mix(np.add.reduceat(fp.mix(flat * b), starts))
    return out


def _vertices(ids: list, keys: np.ndarray) -> list[int]:
    return [i if i is not None else SYNTHETIC + (int(k) >> 3) for i, k in zip(ids, keys[:, 0])]


def _signing(size: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            every = batch.column(0).to_pylist()
            for low, high, data, offsets in fp.parts(batch.column(1)):
                ids, sets = every[low:high], shingle_sets(data, offsets, size)
                some = [i for i, s in enumerate(sets) if len(s)]
                table = np.zeros((len(sets), BANDS), np.uint64)
                if some:
                    table[some] = bands(sketches([sets[i] for i in some]))
                keys = _identities(sets)
                places = np.arange(len(sets) + 1, dtype=np.int32) * BANDS
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(_vertices(ids, keys), pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(fp.signed(keys[:, 0].copy())),
                        pa.array(fp.signed(keys[:, 1].copy())),
                        pa.ListArray.from_arrays(pa.array(places), pa.array(fp.signed(table.reshape(-1)))),
                    ],
                    ["_id", "_v", "_n", "_s1", "_s2", "_bands"],
                )

    return run


def _setting(size: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            every = batch.column(0).to_pylist()
            for low, high, data, offsets in fp.parts(batch.column(1)):
                sets = shingle_sets(data, offsets, size)
                places = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                vertices = _vertices(every[low:high], _identities(sets))
                bits = np.zeros((len(sets), BITS // 64), np.uint64)
                some = [i for i, s in enumerate(sets) if len(s)]
                if some:
                    bits[some] = bit_rows(sketches([sets[i] for i in some], BITS))
                rows = np.arange(len(sets) + 1, dtype=np.int32) * (BITS // 64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(vertices, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(places), pa.array(fp.signed(flat))),
                        pa.ListArray.from_arrays(pa.array(rows), pa.array(fp.signed(bits.reshape(-1)))),
                    ],
                    ["_v", "_set", "_bits"],
                )

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole sets are similar enough."""
    first, second = sets.select("_v", "_set").toDF("a", "_x"), sets.select("_v", "_set").toDF("b", "_y")
    joined = pairs.join(first, "a").join(second, "b")
    both = F.size(F.array_intersect("_x", "_y"))
    union = F.size("_x") + F.size("_y") - both
    return joined.where(both * 100 >= union * percent).select("a", "b")


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``.

    Documents are linked when their shingle sets have at least ``percent`` % in common, and
    a component is what links reach. Rows with the same set form a class with one vertex, so
    copies never meet each other in a bucket. Rows that share an identifier are one document.
    A row without an identifier is linked like others but gives no name to its component and
    is never the kept one. Rows without words are linked with nothing.

    In a bucket, every member is first compared with the one that has most company in all its
    buckets. What this leaves in different components is then paired across components, but
    for pairs whose longer sketches differ too much, and compared in full. So no candidate
    is lost, and a group of similar texts costs about as many comparisons as it has members.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    thin = exact(docs, key=key, text=text).select(
        F.col("key").cast("long").alias("_id"), F.col("text").cast("string").alias("_t")
    )
    signed = written(
        thin.mapInArrow(
            _signing(size), "_id long, _v long, _n long, _s1 long, _s2 long, _bands array<long>"
        ),
        "near-signatures",
    )
    members = signed.select("_id", "_v", "_n", "_s1", "_s2")
    # One vertex per distinct set: the smallest of its rows.
    classes = written(
        members.where("_n > 0").groupBy("_s1", "_s2").agg(F.min("_v").alias("_v"), F.first("_n").alias("_n")),
        "near-classes",
    )
    stars = members.where("_n > 0").select("_s1", "_s2", F.col("_v").alias("a")).join(
        classes.select("_s1", "_s2", F.col("_v").alias("b")), ["_s1", "_s2"]
    ).where("a <> b").select("a", "b").distinct()
    entries = signed.join(
        classes.select("_s1", "_s2", "_v"), ["_s1", "_s2", "_v"], "left_semi"
    ).select("_v", "_n", F.explode("_bands").alias("_h"))
    shared = entries.groupBy("_h").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
    shared = written(entries.join(shared, "_h"), "near-shared")
    # The text that others were copied from shares more buckets with more texts than any copy.
    hubs = shared.groupBy("_v").agg(F.sum("_m").alias("_score"))
    leads = (
        shared.join(hubs, "_v").groupBy("_h")
        .agg(F.max(F.struct("_score", (-F.col("_v")).alias("_o"), "_n")).alias("_lead"))
        .select("_h", (-F.col("_lead._o")).alias("_lead"), F.col("_lead._n").alias("_ln"))
    )
    buckets = written(shared.drop("_m").join(leads, "_h"), "near-buckets")
    # Sets that differ too much in size cannot be similar enough.
    near = "100 * least({0}, {1}) >= " + str(percent) + " * greatest({0}, {1})"
    first = written(
        buckets.where("_v <> _lead").where(near.format("_n", "_ln"))
        .select(F.least("_lead", "_v").alias("a"), F.greatest("_lead", "_v").alias("b")).distinct(),
        "near-pairs",
    )
    candidates = written(buckets.select("_v").distinct(), "near-candidates")
    sets = written(
        thin.join(candidates, thin["_id"] == candidates["_v"], "left_semi")
        .unionByName(thin.where("_id IS NULL"))
        .mapInArrow(_setting(size), "_v long, _set array<long>, _bits array<long>"),
        "near-sets",
    )
    links = written(_verified(first, sets, percent), "near-links")
    roots = components(links)
    placed = buckets.join(roots.withColumnRenamed("id", "_v"), "_v", "left").select(
        "_h", "_v", "_n", F.coalesce("component", "_v").alias("_c")
    )
    mixed = placed.groupBy("_h").agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi")).where("_lo < _hi")
    # Bits of longer sketches pass over most pairs that are not similar enough, and the first
    # bucket that two sets share is the only one to name them.
    traits = sets.select("_v", "_bits").join(
        signed.select("_v", "_bands", "_s1", "_s2").join(
            classes.select("_s1", "_s2", "_v"), ["_s1", "_s2", "_v"], "left_semi"
        ).select("_v", "_bands"), "_v",
    ).dropDuplicates(["_v"])
    open_ = written(placed.join(mixed.select("_h"), "_h", "left_semi").join(traits, "_v"), "near-open")
    open_ = open_.select("_h", "_v", "_n", "_c", "_bits", "_bands")
    left = open_.toDF("_h", "a", "_na", "_ca", "_xa", "_ya")
    right = open_.toDF("_h", "b", "_nb", "_cb", "_xb", "_yb")
    apart = " + ".join(f"bit_count(_xa[{i}] ^ _xb[{i}])" for i in range(BITS // 64))
    rest = (
        left.join(
            right,
            (left["_h"] == right["_h"]) & F.expr("a < b AND _ca <> _cb")
            & F.expr(near.format("_na", "_nb")) & F.expr(f"{apart} <= {far_bits(percent)}")
            & (F.get(F.array_intersect("_ya", "_yb"), F.lit(0)) == left["_h"]),
        )
        .select("a", "b").distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    rest = written(rest, "near-rest")
    links = links.unionByName(_verified(rest, sets, percent))
    final = components(links.unionByName(stars))
    named = F.coalesce("component", "_v")
    return (
        members.join(final.withColumnRenamed("id", "_v"), "_v", "left")
        .withColumn("component_id", F.when(named < SYNTHETIC, named))
        .select(
            F.col("_id").alias("doc_id"),
            F.col("_n").alias("n_shingles"),
            "component_id",
            F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"),
        )
    )
