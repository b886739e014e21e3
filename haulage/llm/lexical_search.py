"""The best documents for each item of a query set, by their terms.

Documents are reduced to the terms that items ask for, the most frequent ones first, and put
into trees: documents that begin alike share a path. Every subtree knows the largest number
of occurrences of each of its terms and the least length factor of its documents, which bound
the score that any of them can reach. Each item is searched depth-first, the most promising
branch first, and a branch whose bound is below the item's worst kept score is left out. A
document that could still tie is looked at, so results are exact.

A tree holds a bounded number of documents as they come; every task keeps the best of its own
trees for each item, and Spark ranks what tasks have kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulage.llm.common import exact
from haulage.session import written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# The same on UTF-8 after lower-casing: digits, letters and all bytes of other characters.
_TERM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
BEST = 10
BLOCK_TERMS = 1 << 18  # terms of items that are searched for in one pass, or one item's
TREE_ROWS = 4096  # documents of a tree
TREE_ENTRIES = 1 << 20  # and their terms, unless one document has more
TASK_ROWS, MOST_TASKS = 2 * TREE_ROWS, 20_000  # documents of a search task, unless there are more tasks
LEAF_ROWS = 64  # subtrees of up to so many documents are scored one by one
_SALTS = 64


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct ``item_id, term``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = F.translate(F.col("text").cast("string"), upper, lower)
    return (
        exact(items, item_id=item, text=text)
        .select("item_id", F.explode(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("term"))
        .distinct()
    )


def _restricting(known):
    """Number of terms, and the asked terms with their occurrences, of each document."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        number = known.value
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                lengths, terms, times = [], [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    found = _TERM_BYTES.findall(text.lower()) if text else []
                    counts = Counter(map(number.get, found))
                    counts.pop(None, None)
                    lengths.append(len(found))
                    terms.append(list(counts))
                    times.append(list(counts.values()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(lengths, pa.int64()),
                        pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "terms", "times"],
                )

    return run


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def parts(times: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """What a unit of weight adds; grows with the occurrences and shrinks with the factor."""
    return (1_000_000_000 * times) // (1000 * times + 8 * factor)


class Tree:
    """Documents in the order of their term vectors, and the subtrees that they form."""

    def __init__(self, factor: np.ndarray, starts: np.ndarray, terms: np.ndarray, times: np.ndarray):
        """Document ``d`` has the entries from ``starts[d]`` to ``starts[d + 1]``, by term."""
        keys = terms.astype(">u4").tobytes()
        place = sorted(range(len(factor)), key=lambda d: keys[4 * starts[d] : 4 * starts[d + 1]])
        self.docs = np.array(place, np.int64)
        sizes = np.diff(starts)[self.docs]
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        entry = np.repeat(starts[self.docs] - self.begin[:-1], sizes) + np.arange(self.begin[-1])
        self.terms, self.times = terms[entry], times[entry]
        self.factor = factor[self.docs]
        self.owner = np.repeat(np.arange(len(self.docs)), sizes)
        self.children: list[list[int]] = []
        self.bounds: list[tuple[np.ndarray, np.ndarray, int]] = []  # terms, most occurrences, least factor
        self.leaves: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # entries by term
        self.root = self._grow(len(self.docs))

    def _branches(self, low: int, high: int) -> list[int]:
        """Where, after the terms that all documents of a range begin with, the next one changes."""
        first = self.terms[self.begin[low] : self.begin[low + 1]]
        last = self.terms[self.begin[high - 1] : self.begin[high]]
        shared = min(len(first), len(last))
        differ = np.flatnonzero(first[:shared] != last[:shared])
        depth = int(differ[0]) if len(differ) else shared
        at = self.begin[low:high] + depth
        inside = at < self.begin[low + 1 : high + 1]
        following = np.where(inside, self.terms[np.minimum(at, len(self.terms) - 1)], -1)
        cuts = np.flatnonzero(following[1:] != following[:-1]) + 1 + low
        # Neighbouring branches that are small together are scored together.
        kept, begin = [], low
        for cut, after in zip(cuts, [*cuts[1:], high]):
            if after - begin > LEAF_ROWS:
                kept.append(int(cut))
                begin = cut
        return kept

    def _grow(self, rows: int) -> int:
        """Numbers subtrees from the root on, then gathers their maxima from the leaves on."""
        todo, ranges = [(0, rows, -1)], []
        while todo:
            low, high, parent = todo.pop()
            me = len(ranges)
            ranges.append((low, high))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(me)
            if high - low > LEAF_ROWS:
                cuts = self._branches(low, high)
                edges = [low, *cuts, high]
                if cuts:  # else all are alike
                    todo.extend((a, b, me) for a, b in zip(edges, edges[1:]))
        self.bounds = [None] * len(ranges)
        for me in range(len(ranges) - 1, -1, -1):
            low, high = ranges[me]
            if self.children[me]:
                below = [self.bounds[c] for c in self.children[me]]
                terms, times = (np.concatenate(x) for x in list(zip(*below))[:2])
                order = np.argsort(terms, kind="stable")
                least = min(b[2] for b in below)
            else:
                inside = slice(self.begin[low], self.begin[high])
                terms, times = self.terms[inside], self.times[inside]
                order = np.argsort(terms, kind="stable")
                least = int(self.factor[low:high].min())
                self.leaves[me] = (terms[order], times[order], self.owner[inside][order])
            terms, times = terms[order], times[order]
            starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else []
            most = np.maximum.reduceat(times, starts) if len(terms) else times
            self.bounds[me] = (terms[starts] if len(terms) else terms, most, least)
        return 0

    def bound(self, node: int, asked: np.ndarray, weights: np.ndarray) -> int:
        """No document of the subtree scores more."""
        terms, most, least = self.bounds[node]
        if not len(terms):
            return 0
        at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
        hit = terms[at] == asked
        return int((weights[hit] * parts(most[at[hit]], least)).sum())

    def scores(self, leaf: int, asked: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a leaf that hold a term of the item, and their scores."""
        terms, times, owner = self.leaves[leaf]
        low, high = np.searchsorted(terms, asked), np.searchsorted(terms, asked, "right")
        sizes = high - low
        entry = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        held = owner[entry]
        docs, which = np.unique(held, return_inverse=True)
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, which, np.repeat(weights, sizes) * parts(times[entry], self.factor[held]))
        return self.docs[docs], out

    def search(self, asked: np.ndarray, weights: np.ndarray, best: Best, ids: list) -> int:
        """Offers to ``best`` what may belong to it; returns how many documents were scored."""
        scored = 0
        todo = [(self.bound(self.root, asked, weights), self.root)]
        while todo:
            most, node = todo.pop()
            if most < max(best.least(), 1):
                continue
            if node in self.leaves:
                docs, found = self.scores(node, asked, weights)
                scored += len(docs)
                for at in np.flatnonzero(found >= max(best.least(), 1)):
                    best.offer(int(found[at]), ids[docs[at]])
            else:
                below = sorted((self.bound(c, asked, weights), c) for c in self.children[node])
                todo.extend(below)  # the most promising is taken first
        return scored


class Best:
    """The highest scores of an item; of equal ones those of the smallest identifiers, null last."""

    def __init__(self, size: int):
        self.size, self.rows = size, []

    def least(self) -> int:
        """What a document must reach to come in question."""
        return self.rows[-1][0] if len(self.rows) == self.size else 0

    def offer(self, score: int, key) -> None:
        self.rows.append((score, key))
        self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
        del self.rows[self.size :]


def _searching(known, size: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        rank, weights, asked, total, docs = known.value
        best = [Best(size) for _ in asked]

        def search(ids: list, n: np.ndarray, starts: np.ndarray, terms: np.ndarray, times: np.ndarray) -> None:
            factor = 10 + (90 * n * docs) // total
            # Entries of a document by rank; keys of whole documents keep them apart.
            ranks = rank[terms]
            order = np.lexsort((ranks, np.repeat(np.arange(len(ids)), np.diff(starts))))
            tree = Tree(factor, starts, ranks[order], times[order])
            for item, found in zip(asked, best):
                tree.search(item, weights[item], found, ids)

        for batch in batches:
            low = 0
            offsets = batch.column(2).offsets.to_numpy().astype(np.int64)
            offsets -= offsets[0]
            terms, times = (batch.column(i).flatten().to_numpy() for i in (2, 3))
            while low < batch.num_rows:
                high = int(np.searchsorted(offsets, offsets[low] + TREE_ENTRIES, "right")) - 1
                high = max(low + 1, min(high, low + TREE_ROWS, batch.num_rows))
                inside = slice(offsets[low], offsets[high])
                search(
                    batch.column(0).slice(low, high - low).to_pylist(),
                    batch.column(1).slice(low, high - low).to_numpy(),
                    offsets[low : high + 1] - offsets[low],
                    terms[inside],
                    times[inside],
                )
                low = high
            key_type = batch.schema.field("doc_id").type
        rows = [(i, key, score) for i, found in enumerate(best) for score, key in found.rows]
        if rows:
            items, keys, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int32()), pa.array(keys, key_type), pa.array(scores, pa.int64())],
                ["item", "doc_id", "score"],
            )

    return run


def _block(docs: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """``item_id, doc_id, score`` of what tasks have kept for the items of one block."""
    spark = docs.sparkSession
    rows = pairs.collect()  # about BLOCK_TERMS
    terms = sorted({r["term"] for r in rows})
    number = {t.encode(): i for i, t in enumerate(terms)}
    key_type = docs.schema["doc_id"].dataType.simpleString()
    vectors = written(
        docs.mapInArrow(
            _restricting(spark.sparkContext.broadcast(number)),
            f"doc_id {key_type}, n long, terms array<int>, times array<long>",
        ).where("n > 0"),
        "search-vectors",
    )
    counted = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total")).first()
    holding = np.zeros(len(terms), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
        holding[r["t"]] = r["df"]  # at most a row per term of the block
    order = np.lexsort((np.arange(len(terms)), -holding))
    rank = np.empty(len(terms), np.int64)
    rank[order] = np.arange(len(terms))
    weights = np.array([weight(counted["docs"], int(n)) for n in holding[order]], np.int64)
    position = {t: int(rank[i]) for i, t in enumerate(terms)}
    asked: dict = {}
    for r in rows:
        asked.setdefault(r["item_id"], []).append(position[r["term"]])
    keys = sorted(asked, key=lambda k: (k is None, k if k is not None else 0))
    known = spark.sparkContext.broadcast(
        (rank, weights, [np.sort(np.array(asked[k], np.int64)) for k in keys], counted["total"], counted["docs"])
    )
    # Documents without an asked term have no score. Vectors are small for the work they make, so
    # files of them are dealt out to more tasks.
    tasks = max(1, min(counted["docs"] // TASK_ROWS, MOST_TASKS))
    found = vectors.where("size(terms) > 0").repartition(tasks).mapInArrow(
        _searching(known, size), f"item int, doc_id {key_type}, score long"
    )
    schema = f"item int, item_id {pairs.schema['item_id'].dataType.simpleString()}"
    names = spark.createDataFrame(list(enumerate(keys)), schema)
    return found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, best: int = BEST, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``best`` documents of each item with a score above 0.

    Rows of one item identifier are one item with the terms of all, null among them. Each row
    of ``docs`` is a document, also where identifiers are equal or null; equal scores stand
    in the order of identifiers, null last. Null and empty texts hold no term. Items without a
    term that a document holds, and empty tables, give no rows.

    Items are searched in blocks of about ``block_terms`` terms (an item with more is a block
    by itself or shares one with others by chance), each in one pass over all documents.
    """
    pairs = written(item_terms(items, item, item_text), "search-items")
    count = pairs.count()
    whole = exact(docs, doc_id=key, text=text).select("doc_id", F.col("text").cast("string"))
    blocks = max(1, math.ceil(count / block_terms))
    number = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = None
    for block in range(blocks):
        some = _block(whole, pairs.where(number == block), best)
        found = some if found is None else found.unionByName(some)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # Tasks keep a few rows each; no item's rows meet in one task before most are gone.
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)))
    first = W.partitionBy("item_id", "salt").orderBy(*order)
    few = salted.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= best)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")
