"""The two Kneser-Ney models against plain dictionaries of counts."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from haulage.llm import toxicity as tx
from pyspark.sql import functions as F

BEGIN, END = "\x02", "\x03"


def marked(word):
    return BEGIN * 4 + word + END


def runs(word, size):
    """Runs of ``size`` characters that end at a place which a model predicts."""
    text = marked(word)
    return [text[i - size + 1 : i + 1] for i in range(4, len(text))]


class Plain:
    """Likelihoods from dictionaries: no hashes, no tables, one run at a time."""

    def __init__(self, taught, everything):
        """``taught``: (text, toxic) rows of the models; ``everything``: all texts."""
        five = [Counter(), Counter()]
        for text, toxic in taught:
            for word in set(tx.words_of(text)):
                five[toxic].update(runs(word, 5))
        self.five = five
        self.four = [Counter(g[1:] for g in counts) for counts in five]  # distinct runs that end so
        self.known = set(five[0]) | set(five[1])
        # Continuations that both classes share, from the distinct runs of all texts.
        longer = {g for text in everything for word in tx.words_of(text) for g in runs(word, 4)}
        self.shared = {}
        for size in (3, 2, 1):
            self.shared[size] = Counter(g[1:] for g in longer)
            longer = set(self.shared[size])

    def chance(self, gram):
        if not gram:
            return 1e-5
        counts = self.shared[len(gram)]
        same = [n for g, n in counts.items() if g[:-1] == gram[:-1]]
        lower = self.chance(gram[1:])
        if not same:
            return lower
        left = sum(min(n, tx.SHARED_DISCOUNT) for n in same)
        return (max(counts[gram] - tx.SHARED_DISCOUNT, 0) + left * lower) / sum(same)

    @staticmethod
    def level(counts, gram, lower):
        """Discounted share plus what is left for the lower order."""
        share, rest = Plain.split(counts, gram)
        return share + rest * lower

    @staticmethod
    def split(counts, gram):
        same = [n for g, n in counts.items() if g[:-1] == gram[:-1]]
        if not same:
            return 0.0, 1.0
        left = sum(min(n, tx.DISCOUNT) for n in same) / sum(same)
        return max(counts[gram] - tx.DISCOUNT, 0) / sum(same), left

    def ratio(self, word):
        """Toxic minus ordinary log-likelihood of a word, before the margin."""
        total = 0.0
        for gram in runs(word, 5):
            logs = []
            for c in (0, 1):
                base = max(self.chance(gram[2:]), 1e-9)
                four = self.level(self.four[c], gram[1:], base)
                logs.append(math.log(self.level(self.five[c], gram, four)))
            total += logs[1] - logs[0]
        return total


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(11)
    pool = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    bad = ["zorgbad", "badzor", "vexbad"]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        words = [rng.choice(pool) for _ in range(12)] + ([rng.choice(bad)] * 2 if toxic else [])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.fit(docs, marks, fit_rows=10**6, curve_rows=10**6)
    # The rows that the models learn from: learnable ones, a fifth aside for the curve.
    mine = docs.where(tx.learnable()).where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(5)) != 0)
    chosen = {r["doc_id"] for r in mine.select("doc_id").collect()}
    taught = sorted({(t, y) for (i, t), (_, y) in zip(rows, labels) if i in chosen})
    return model, Plain(taught, [t for _, t in rows]), pool + bad


def test_words_that_were_seen(fitted):
    model, plain, words = fitted
    seen = [w for w in words if set(runs(w, 5)) <= plain.known]
    assert len(seen) > 40 and "zorgbad" in seen
    expected = [plain.ratio(w) for w in seen]
    clear = [min(r, tx.MOST) if r > tx.MARGIN else 0.0 for r in expected]
    assert model.ratios(seen) == pytest.approx(clear, abs=1e-6)
    assert sum(r > 0 for r in clear) >= 3 and any(r < -0.5 for r in expected)


def test_runs_one_by_one(fitted):
    """Ratios of single runs, also those that speak for ordinary texts and that no word sums up."""
    model, plain, _ = fitted
    grams = sorted(plain.known)
    codes = tx._text_codes(grams)
    ends = np.arange(len(grams)) * 5 + 4
    got, known = model.full.get(tx._hash(codes, ends, 5))
    assert known.all()
    for gram, value in zip(grams, got):
        logs = []
        for c in (0, 1):
            four = plain.level(plain.four[c], gram[1:], max(plain.chance(gram[2:]), 1e-9))
            logs.append(math.log(plain.level(plain.five[c], gram, four)))
        assert value == pytest.approx(logs[1] - logs[0], abs=1e-6), gram


def test_probabilities_sum_to_one(fitted):
    """After a context, the shares of all runs and what is left make one."""
    _, plain, _ = fitted
    for c in (0, 1):
        sums = defaultdict(float)
        for gram in plain.five[c]:
            sums[gram[:-1]] += plain.split(plain.five[c], gram)[0]
        for context, share in sums.items():
            rest = plain.split(plain.five[c], context + "?")[1]
            assert share + rest == pytest.approx(1)
