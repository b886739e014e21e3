"""Passages that occur twice: seeds at winnowed anchors, extended to whole windows.

Every window of words has one anchor, the smallest hash among its word k-grams, the last one
in a tie. Equal windows have equal anchors, so texts that share a window meet at an anchor.
All windows of an anchor occurrence together reach some words to both sides: its extent.
Occurrences with the same extent repeat in all their windows; where extents differ, which is
at the ends of a repeat, single windows are compared. Runs of repeated windows are the
maximal repeats. Occurrences are counted, never paired, so a passage that very many
documents share costs a row per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.llm import fingerprints as fp
from haulage.llm.common import bounded_batches, exact, inside, packed, row_key, unpacked
from haulage.session import written

WINDOW = 35
SEED = 8  # words of an anchor


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class Extents:
    """Anchors of some texts: hash, document, first window (in its document), number of windows
    and hash of all their words, one entry per occurrence of an anchor."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, seed: int):
        hashes, first = fp.word_hashes(data, offsets)
        empty = np.empty(0, np.int64)
        self.anchor = self.span = np.empty(0, np.uint64)
        self.document = self.start = self.count = empty
        n = len(hashes) - window + 1
        if n < 1:
            return
        low = fp.grams(hashes, seed, fp.multipliers(seed, 5))
        place = np.arange(len(low))
        reach, wanted = 1, window - seed + 1
        while reach < wanted:  # the minimum over twice as many k-grams each time
            step = min(reach, wanted - reach)
            later = low[step:] <= low[:-step]
            place = np.where(later, place[step:], place[:-step])
            low = np.where(later, low[step:], low[:-step])
            reach += step
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        begin = np.flatnonzero(owner[:n] == owner[window - 1 :])  # windows within one document
        if not len(begin):
            return
        place, owner = place[begin], owner[begin]
        turn = np.ones(len(begin), bool)
        turn[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(turn)
        self.count = np.diff(np.append(at, len(begin)))
        self.anchor, self.document = low[begin[at]], owner[at]
        self.span = fp.Runs(hashes).of(begin[at], begin[at] + self.count + window - 1)
        self.start = begin[at] - first[self.document]


def _seeding(window: int, seed: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for _, _, data, offsets in fp.parts(batch.column(0)):
                found = Extents(data, offsets, window, seed)
                once, times = np.unique(found.anchor, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp.signed(once)), pa.array(times.astype(np.int64))], ["_a", "_n"]
                )

    return run


def _extending(window: int, seed: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ks, cs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for low, _, data, offsets in fp.parts(batch.column(2)):
                found = Extents(data, offsets, window, seed)
                if not len(found.anchor):
                    continue
                # Occurrences of one extent in one text stand in one row.
                order = np.lexsort((found.span, found.anchor, found.document))
                a, s, d = found.anchor[order], found.span[order], found.document[order]
                fresh = np.ones(len(a), bool)
                fresh[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1]) | (d[1:] != d[:-1])
                head = np.flatnonzero(fresh)
                places = np.append(head, len(a)).astype(np.int32)
                starts = found.start[order].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ks[low + d[head]]), pa.array(cs[low + d[head]]),
                        pa.array(fp.signed(a[head])), pa.array(fp.signed(s[head])),
                        pa.ListArray.from_arrays(pa.array(places), pa.array(starts)),
                        pa.array(found.count[order][head].astype(np.int32)),
                    ],
                    ["_k", "_c", "_a", "_s", "_starts", "_count"],
                )

    return run


def _windowing(window: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            spots = batch.column(3).to_pylist()
            ks, cs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for low, high, data, offsets in fp.parts(batch.column(2)):
                hashes, first = fp.word_hashes(data, offsets)
                rows = [
                    (spot["a"], ks[i], cs[i], first[i - low], spot["s"], spot["n"])
                    for i in range(low, high)
                    for spot in spots[i]
                ]
                if not rows:
                    continue
                a, k, c, base, start, count = map(np.array, zip(*rows))
                inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                begin = np.repeat(start, count) + inside
                at = begin + np.repeat(base, count)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(a, count)), pa.array(fp.signed(fp.Runs(hashes).of(at, at + window))),
                        pa.array(np.repeat(k, count)), pa.array(np.repeat(c, count)),
                        pa.array(begin.astype(np.int32)),
                    ],
                    ["_a", "_w", "_k", "_c", "_s"],
                )

    return run


def _removing(window: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, starts, counts = (
                batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("_t", "_starts", "_counts")
            )
            totals, removed, kept, spans = [], [], [], []
            for text, begins, sizes in zip(texts, starts, counts):
                words = split_words(text)
                change = np.zeros(len(words) + 1, np.int64)
                for begin, size in zip(begins or (), sizes or ()):
                    begin = np.array(begin)
                    np.add.at(change, begin, 1)
                    np.add.at(change, begin + size + window - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
                begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                totals.append(len(words))
                removed.append(int(gone.sum()))
                spans.append([{"begin": int(x), "end": int(y)} for x, y in zip(begin, end)])
                rest = words if not len(begin) else [words[i] for i in np.flatnonzero(~gone)]
                kept.append(b" ".join(rest).decode("utf-8", "surrogatepass"))
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("row")),
                    pa.array(totals, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(kept, pa.string()), pa.array(spans, span),
                ],
                ["row", "n_words", "n_removed", "kept_text", "repeats"],
            )

    return run


def repeated_extents(docs: DataFrame, window: int, seed: int, key: str, text: str) -> DataFrame:
    """``(_k, _c, _starts, _count)``: starts of ``_count`` consecutive repeated windows."""
    rows = exact(docs, key=key, text=text).select(
        *row_key("key", "text"), F.col("text").cast("string").alias("_t")
    )
    repeated = (
        rows.select("_t").mapInArrow(_seeding(window, seed), "_a long, _n long")
        .groupBy("_a").agg(F.sum("_n").alias("_n")).where("_n > 1").select("_a")
    )
    extents = rows.mapInArrow(
        _extending(window, seed), "_k long, _c long, _a long, _s long, _starts array<int>, _count int"
    )
    met = written(extents.join(repeated, "_a"), "repeat-extents")
    kinds = written(
        met.groupBy("_a", "_s").agg(
            F.sum(F.size("_starts")).alias("_n"), F.min(F.struct("_k", "_c")).alias("_one")
        ),
        "repeat-kinds",
    )
    several = kinds.groupBy("_a").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_a")
    # One occurrence stands for its kind where windows of several kinds are compared.
    asked = written(
        kinds.join(several, "_a").select("_a", "_s", "_one._k", "_one._c", F.lit(True).alias("_asked")),
        "repeat-asked",
    )
    alike = met.join(kinds.where("_n > 1").select("_a", "_s"), ["_a", "_s"], "left_semi").select(
        "_k", "_c", "_starts", "_count"
    )
    spots = (
        met.join(asked, ["_a", "_s", "_k", "_c"], "left_semi")
        .groupBy("_k", "_c")
        .agg(F.collect_set(F.struct(F.col("_a").alias("a"), F.col("_starts")[0].alias("s"), F.col("_count").alias("n"))).alias("_spots"))
    )
    single = written(
        rows.join(spots, ["_k", "_c"]).select("_k", "_c", "_t", "_spots")
        .mapInArrow(_windowing(window), "_a long, _w long, _k long, _c long, _s int"),
        "repeat-windows",
    )
    twice = single.groupBy("_a", "_w").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_a", "_w")
    found = single.join(twice, ["_a", "_w"], "left_semi").select(
        "_k", "_c", F.array("_s").alias("_starts"), F.lit(1).alias("_count")
    )
    return alike.unionByName(found)


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, seed: int = SEED, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` plus ``n_words``, ``n_removed``, ``kept_text`` and ``repeats`` (word ranges).

    Removed is each word of a window of ``window`` words that also starts elsewhere, in the
    same document or another; windows are judged on the input. Kept words are joined by one
    blank. Null, empty and short texts keep what words they have. A row that occurs twice is
    two documents, so its windows repeat. An empty table gives an empty one. Columns of ``docs``
    named like a result give way to it, all others stay.
    """
    bounded_batches(docs.sparkSession)
    covered = written(
        repeated_extents(docs, window, seed, key, text)
        .groupBy("_k", "_c")
        .agg(F.collect_list("_starts").alias("_starts"), F.collect_list("_count").alias("_counts")),
        "repeat-cover",
    )
    rows = packed(docs, key=key, text=text).select("row", *row_key("key", "text"))
    found = rows.join(covered, ["_k", "_c"], "left").select(
        "row", inside(docs.columns, text).cast("string").alias("_t"), "_starts", "_counts"
    )
    span = T.StructType().add("begin", "long").add("end", "long")
    schema = T.StructType([found.schema["row"]]).add("n_words", "long").add("n_removed", "long")
    schema = schema.add("kept_text", "string").add("repeats", T.ArrayType(span))
    results = ("n_words", "n_removed", "kept_text", "repeats")
    return unpacked(
        found.mapInArrow(_removing(window), schema), docs.columns, **{n: F.col(n) for n in results}
    )
