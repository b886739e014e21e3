"""Toxicity by two Kneser-Ney models of the characters of words.

One model is fitted to toxic and one to ordinary texts. Both discount the number of documents
that hold a run of five characters, back off to continuation counts of shorter runs in their
own class, and from there to continuation counts that both share and that are gathered from
all documents. A word's log-likelihoods under the two are compared; differences within a
margin are the noise of rare words and count as none, and so do words that the ordinary model
finds likelier: evidence is one-sided. Their sum over a text is divided by its
length, and a logistic curve fitted to texts that the models have not seen turns that into a
probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.llm import fingerprints as fp
from haulage.llm.common import bounded_batches, exact, packed, unpacked
from haulage.session import written

ORDER = 5
DISCOUNT = 3.0  # documents; what three documents hold is left to the backoff
SHARED_DISCOUNT = 0.75
MARGIN, MOST = 2.0, 12.0  # log-likelihood differences of a word that count, and their bound
FIT_ROWS = 24_000  # labelled rows that the two models are fitted to, at most
CURVE_ROWS = 8_000  # labelled rows that the curve is fitted to, at most
MAX_GRAMS = 4_000_000  # entries of the model, so that it can be broadcast; checked
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")
_BEGIN, _END = "\x02", "\x03"
_CACHE = 200_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _codes(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with margins, the places that a model predicts, their words."""
    joined = "".join(f"{_BEGIN * (order - 1)}{w}{_END}" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + order for w in words], np.int64)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    places = np.arange(len(codes))
    predicted = places - starts[owner] >= order - 1
    return codes, places[predicted], owner[predicted]


def _hash(codes: np.ndarray, places: np.ndarray, size: int, back: int = 0) -> np.ndarray:
    """Hash of the ``size`` characters that end ``back`` before each place."""
    factors = fp.multipliers(size, 40 + size)
    total = np.full(len(places), size, np.uint64)
    for i in range(size):
        total += codes[places - back - (size - 1 - i)] * factors[i]
    return fp.mix(total)


def _text_codes(grams: list[str]) -> np.ndarray:
    flat = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.astype(np.uint64)


class Table:
    """Numbers by hash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 where the key is unknown, and whether it is known."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.values[at], 0.0), known


def summed(keys: np.ndarray, values: np.ndarray) -> Table:
    once, inverse = np.unique(keys, return_inverse=True)
    return Table(once, np.bincount(inverse, weights=values, minlength=len(once)))


class Level:
    """Discounted counts of one order of one model: share of a run, and what is left for others."""

    def __init__(self, runs: np.ndarray, contexts: np.ndarray, counts: np.ndarray):
        some = counts > 0
        runs, contexts, counts = runs[some], contexts[some], counts[some].astype(float)
        self.counts = Table(runs, counts)
        self.totals = summed(contexts, counts)
        self.left = summed(contexts, np.minimum(counts, DISCOUNT))

    def share(self, runs: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        count, _ = self.counts.get(runs)
        total, known = self.totals.get(contexts)
        return np.where(known, np.maximum(count - DISCOUNT, 0) / np.where(known, total, 1), 0.0)

    def rest(self, contexts: np.ndarray) -> np.ndarray:
        left, known = self.left.get(contexts)
        total, _ = self.totals.get(contexts)
        return np.where(known, left / np.where(known, total, 1), 1.0)


@dataclass
class Model:
    """Log-likelihood ratios of the runs that a class has seen, and of what backs off."""

    full: Table  # five characters -> ratio
    leave5: Table  # four characters of context -> ratio of what is left for others
    short: Table  # four characters -> ratio of the shorter models
    leave4: Table  # three characters of context -> ratio of what is left for others
    slope: tuple[float, float, float] = (0.0, 0.0, 0.0)  # of the curve: constant, mean, sum/sqrt(n)
    usual: float = 0.0  # mean ratio per word of ordinary texts, which the curve takes off
    longest: float = float("inf")  # words; the curve is not carried on beyond the texts it was fitted to

    def plain(self) -> list:
        """Arrays only, so that it can be broadcast without this package."""
        tables = (self.full, self.leave5, self.short, self.leave4)
        return [[(t.keys, t.values) for t in tables], self.slope, self.usual, self.longest]

    @classmethod
    def of(cls, plain: list) -> Model:
        return cls(*[Table(keys, values) for keys, values in plain[0]], *plain[1:])

    def ratios(self, words: list[str]) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each word, as far as it is clear."""
        if not words:
            return np.empty(0)
        codes, places, owner = _codes(words, ORDER)
        value, known = self.full.get(_hash(codes, places, 5))
        if not known.all():
            miss = places[~known]
            four, seen = self.short.get(_hash(codes, miss, 4))
            four = np.where(seen, four, self.leave4.get(_hash(codes, miss, 3, 1))[0])
            value[~known] = self.leave5.get(_hash(codes, miss, 4, 1))[0] + four
        total = np.bincount(owner, weights=value, minlength=len(words))
        # Toxic texts are ordinary but for a few expressions, so nothing speaks against them.
        return np.where(total > MARGIN, np.minimum(total, MOST), 0.0)

    def scorer(self):
        """Mean ratio per word, and words, of a batch of texts; remembers words it has seen."""
        seen: dict[str, float] = {}

        def score(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
            split = [words_of(t) for t in texts]
            new = list({w for words in split for w in words} - seen.keys())
            if len(seen) + len(new) > _CACHE:
                seen.clear()
                new = list({w for words in split for w in words})
            for lo in range(0, len(new), 20_000):
                part = new[lo : lo + 20_000]
                seen.update(zip(part, self.ratios(part).tolist()))
            counts = np.array([len(w) for w in split], np.int64)
            sums = np.array([sum(map(seen.__getitem__, w)) for w in split])
            return sums / np.maximum(counts, 1), counts

        return score

    def probability(self, mean: np.ndarray, counts: np.ndarray) -> np.ndarray:
        a, b, c = self.slope
        mean = mean - self.usual
        z = a + b * mean + c * mean * np.sqrt(np.minimum(counts, self.longest))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _counting(batches) -> Iterator:
    """Runs of five characters, by class, each with the words and documents that hold it."""
    import pyarrow as pa

    for batch in batches:
        totals: dict[str, list[int]] = {}
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update(set(words_of(text)))
        for toxic in (0, 1):
            for word, n in counts[toxic].items():
                marked = f"{_BEGIN * (ORDER - 1)}{word}{_END}"
                for i in range(len(word) + 1):
                    totals.setdefault(marked[i : i + ORDER], [0, 0])[toxic] += n
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(totals), pa.string()),
                pa.array([n[0] for n in totals.values()], pa.int64()),
                pa.array([n[1] for n in totals.values()], pa.int64()),
            ],
            ["g", "ordinary", "toxic"],
        )


def _sharing(batches) -> Iterator:
    """Distinct runs of four characters of all texts; a task passes over words and runs that it
    has met before, as far as it remembers them."""
    import pyarrow as pa

    words: set[str] = set()
    runs = np.empty(0, np.uint64)
    for batch in batches:
        found = {w for text in batch.column(0).to_pylist() for w in words_of(text)} - words
        words = words | found if len(words) < _CACHE else found
        codes, places, _ = _codes(list(found), ORDER)
        keys, first = np.unique(_hash(codes, places, 4), return_index=True)
        new = ~np.isin(keys, runs)
        runs = np.union1d(runs, keys) if len(runs) < 4 * _CACHE else keys
        at = places[first[new]]
        flat = np.stack([codes[at - 3 + i] for i in range(4)], 1).astype("<u4")
        text = flat.tobytes().decode("utf-32-le", "surrogatepass")
        yield pa.RecordBatch.from_arrays(
            [pa.array([text[i : i + 4] for i in range(0, len(text), 4)], pa.string())], ["g"]
        )


def _shared_levels(docs: DataFrame, text: str, wanted: DataFrame) -> dict[int, list]:
    """Continuation counts of runs of three, two and one characters over all documents, for
    the runs and contexts that the models ask for."""
    runs = docs.select(text).mapInArrow(_sharing, "g string").distinct()
    out, longer = {}, written(runs, "toxic-runs")
    for size in (3, 2, 1):
        types = longer.groupBy(F.substring("g", 2, size).alias("g")).agg(F.count(F.lit(1)).alias("n"))
        types = written(types, "toxic-continuations")
        context = F.substring("g", 1, size - 1)
        totals = types.groupBy(context.alias("h")).agg(
            F.sum("n").alias("total"), F.sum(F.least(F.lit(SHARED_DISCOUNT), "n")).alias("left")
        )
        ask = wanted.select(F.substring("g", ORDER - size + 1, size).alias("g")).distinct()
        found = (
            ask.join(types, "g", "left").withColumn("h", context).join(totals, "h", "left")
            .select("g", F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0)), F.coalesce("left", F.lit(0.0)))
        )
        out[size] = found.collect()  # at most as many rows as the model
        longer = types
    return out


def _build(rows: list, shared: dict[int, list]) -> Model:
    grams = [r[0] for r in rows]
    counts = np.array([[r[1], r[2]] for r in rows], float).reshape(-1, 2)
    codes = _text_codes(grams)
    ends = np.arange(len(grams)) * ORDER + ORDER - 1
    five, context4 = _hash(codes, ends, 5), _hash(codes, ends, 4, 1)
    four, context3 = _hash(codes, ends, 4), _hash(codes, ends, 3, 1)
    once, first = np.unique(four, return_index=True)
    # Probability of the last character after two, by the counts that both classes share.
    chance: dict[str, float] = {}
    for size in (1, 2, 3):
        for gram, n, total, left in shared[size]:
            lower = chance.get(gram[1:], 1e-6) if size > 1 else 1e-5
            chance[gram] = (max(n - SHARED_DISCOUNT, 0) + left * lower) / total if total else lower
    base = np.array([chance.get(grams[i][2:], 1e-6) for i in first])
    base = np.maximum(base, 1e-9)
    likelihood5, likelihood4, rest5, rest4 = [], [], [], []
    asked4, where4 = np.unique(context4, return_index=True)
    asked3, _ = np.unique(context3, return_index=True)
    for c in (0, 1):
        seen = counts[:, c] > 0
        continued = summed(four[seen], np.ones(seen.sum()))
        lower = Level(continued.keys, context3[first][np.searchsorted(once, continued.keys)], continued.values)
        upper = Level(five, context4, counts[:, c])
        p4 = lower.share(once, context3[first]) + lower.rest(context3[first]) * base
        p5 = upper.share(five, context4) + upper.rest(context4) * p4[np.searchsorted(once, four)]
        likelihood4.append(np.log(p4))
        likelihood5.append(np.log(np.maximum(p5, 1e-300)))
        rest5.append(np.log(np.maximum(upper.rest(asked4), 1e-9)))
        rest4.append(np.log(np.maximum(lower.rest(asked3), 1e-9)))
    return Model(
        Table(five, likelihood5[1] - likelihood5[0]), Table(asked4, rest5[1] - rest5[0]),
        Table(once, likelihood4[1] - likelihood4[0]), Table(asked3, rest4[1] - rest4[0]),
    )


def _curve(mean: np.ndarray, counts: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.stack([np.ones(len(mean)), mean, mean * np.sqrt(counts)], 1)
    scale = np.maximum(x.std(0), 1e-9)
    scale[0] = 1
    x, w = x / scale, np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - label) + 1e-2 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w / scale)


def _measuring(model):
    def run(batches) -> Iterator:
        import pyarrow as pa

        score = Model.of(model.value).scorer()
        for batch in batches:
            mean, counts = score(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(mean), pa.array(counts), batch.column(1)], ["mean", "n", "toxic"]
            )

    return run


def _scoring(model):
    def run(batches) -> Iterator:
        import pyarrow as pa

        known = Model.of(model.value)
        score = known.scorer()
        for batch in batches:
            at = batch.schema.get_field_index("_t")
            found = known.probability(*score(batch.column(at).to_pylist()))
            rows = batch.column(batch.schema.get_field_index("row"))
            yield pa.RecordBatch.from_arrays([rows, pa.array(found)], ["row", "score"])

    return run


def learnable(key: str = "doc_id") -> Column:
    """Rows whose labels may be learnt from; the others are held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(3)) != 1


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    label: str = "toxic", fit_rows: int = FIT_ROWS, curve_rows: int = CURVE_ROWS,
) -> Model:
    """Fits to labelled rows that are not held out: at most about ``fit_rows`` for the models and
    ``curve_rows`` others for the curve, chosen by a hash of the identifier. A fifth of the
    rows goes to the curve. Shared counts cover all rows of ``docs``. Rows without a label
    or identifier teach nothing; several labels of one document count as the highest. Texts
    with more than `MAX_GRAMS` distinct runs are refused.
    """
    docs, labels = exact(docs, key=key, text=text), exact(labels, key=key, label=label)
    key, text = "key", "text"
    marked = (
        labels.where(F.col("label").isNotNull() & F.col(key).isNotNull()).where(learnable(key))
        .groupBy(F.col(key).cast("long").alias("_id")).agg(F.max((F.col("label") > 0).cast("int")).alias("_y"))
    )
    hashed = F.xxhash64(F.lit(3), "_id")
    marked = marked.withColumn("_curve", F.pmod(hashed, F.lit(5)) == 0).withColumn(
        "_u", F.pmod(F.shiftright(hashed, 8), F.lit(1 << 30)) / float(1 << 30)
    )
    marked = written(marked, "toxic-labels")
    sizes = {r["_curve"]: r["n"] for r in marked.groupBy("_curve").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {False: fit_rows / max(sizes.get(False, 0), 1), True: curve_rows / max(sizes.get(True, 0), 1)}
    chosen = marked.where(
        F.col("_u") < F.when(F.col("_curve"), share[True]).otherwise(share[False])
    )
    # At most `fit_rows + curve_rows` small rows, give or take the hash.
    taught = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("_t")).join(
        F.broadcast(chosen), "_id"
    ).dropDuplicates(["_t", "_y", "_curve"])  # copies teach nothing new
    grams = written(
        taught.where("NOT _curve").select("_t", "_y")
        .mapInArrow(_counting, "g string, ordinary long, toxic long")
        .groupBy("g").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")),
        "toxic-grams",
    )
    size = grams.count()
    if size > MAX_GRAMS:
        raise ValueError(
            f"{size} distinct runs in the labelled texts, a model holds {MAX_GRAMS} at most; choose fewer fit_rows"
        )
    shared = _shared_levels(docs, text, grams)
    model = _build(grams.collect(), shared)  # at most MAX_GRAMS rows
    known = docs.sparkSession.sparkContext.broadcast(model.plain())
    curve = (
        taught.where("_curve").select("_t", "_y")
        .mapInArrow(_measuring(known), "mean double, n long, toxic int").collect()
    )
    values = np.array([[r[0], r[1], r[2]] for r in curve], float).reshape(-1, 3)
    values = values[np.lexsort(values.T)]  # the same sums in every run
    if len(values):
        clean = values[values[:, 2] == 0]
        # Noise of clean words adds up with the length; without it, only an excess counts.
        model.usual = float((clean[:, 0] * clean[:, 1]).sum() / max(clean[:, 1].sum(), 1))
        model.longest = float(values[:, 1].max())
        model.slope = _curve(values[:, 0] - model.usual, values[:, 1], values[:, 2])
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` plus ``score`` from 0 to 1. Null and empty texts get the score of no evidence. A
    column of ``docs`` named ``score`` in any case gives way to it, all others stay."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(model.plain())
    rows = packed(docs, text=text).select("row", F.col("text").cast("string").alias("_t"))
    schema = rows.select("row").schema.add("score", "double")
    return unpacked(rows.mapInArrow(_scoring(known), schema), docs.columns, score=F.col("score"))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return score(docs, fit(docs, labels, **options), options.get("text", "text"))
