"""Language of a text by unigram models of word pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. Each language has a probability for each
piece; a word's likelihood is the sum over all ways to cut it into pieces, found by the forward
algorithm, and a text's is the product over its words. The probabilities are learnt by
expectation steps (forward and backward) over the counts of all distinct words of a language.

Words are runs of letters in lower case, with the vocabulary's mark for a blank in front. A run
of more than 64 letters is cut after every 64. A letter that is no piece is the product of its
UTF-8 bytes, for which the vocabulary has pieces too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import exact
from haulage.session import written

MARK = "▁"
UNKNOWN = "und"
ROUNDS = 2  # expectation steps
PRIOR = 5_000.0  # pieces that each language is lent from the mean of all languages
MAX_LANGUAGES = 128  # so that the model can be broadcast; checked
_WORD = re.compile(r"[^\W\d_]{1,64}")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FLUSH = 300_000  # distinct words that a counting task holds
_CACHE = 400_000  # words whose likelihoods a scoring task remembers
_CELLS = 1 << 20  # numbers in one lattice
_ROWS = 512  # texts that are split into words at a time


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces by id, without control pieces, of a vocabulary that falls back to bytes."""
    import public_tokenizers
    import sentencepiece

    path = path or public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i))]


class Pieces:
    """Pieces that lower-case words can hold, by length and hash, and one piece per byte."""

    def __init__(self, names: list[str]):
        one_byte = re.compile("<0x([0-9A-F]{2})>")
        inside = re.compile(f"{MARK}?(?:[^\\W\\d_])*")
        of_bytes = {int(m[1], 16): n for n in names if (m := one_byte.fullmatch(n))}
        if len(of_bytes) != 256:
            raise ValueError("the vocabulary has no piece for some bytes")
        kept = [n for n in names if n and inside.fullmatch(n) and n == n.lower()]
        self.names = kept + [of_bytes[b] for b in range(256)]
        self.first_byte = len(kept)
        self.tables = {}
        for size in sorted({len(n) for n in kept}):
            ids = np.array([i for i, n in enumerate(kept) if len(n) == size])
            flat = np.frombuffer("".join(kept[i] for i in ids).encode("utf-32-le"), np.uint32)
            keys = np.zeros(len(ids), np.uint64)
            for place in range(size):
                keys = keys * _BASE + flat[place::size].astype(np.uint64)
            order = np.argsort(keys)
            self.tables[size] = (keys[order], ids[order])

    def __len__(self) -> int:
        return len(self.names)


class Lattice:
    """All segmentations of some words: one arc for each piece at each place."""

    def __init__(self, pieces: Pieces, words: list[str]):
        text = "".join(MARK + w for w in words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.length = np.array([len(w) + 1 for w in words], np.int64)
        first = np.cumsum(self.length) - self.length
        owner = np.repeat(np.arange(len(words)), self.length)
        left = np.repeat(first + self.length, self.length) - np.arange(len(codes))
        at, keys, found = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
        single = np.zeros(len(codes), bool)
        for size in range(1, max(pieces.tables) + 1):
            fits = left[at] >= size
            at, keys = at[fits], keys[fits] * _BASE + codes[at[fits] + size - 1]
            if size not in pieces.tables:
                continue
            known, ids = pieces.tables[size]
            near = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[near] == keys
            found.append((at[hit], np.full(hit.sum(), size), ids[near[hit]]))
            if size == 1:
                single[at[hit]] = True
        # Letters that are no piece: numbers beyond the pieces, one for each such letter.
        missing = np.flatnonzero(~single)
        letters, which = np.unique(codes[missing], return_inverse=True)
        found.append((missing, np.ones(len(missing), np.int64), len(pieces) + which))
        bytes_of = [chr(int(c)).encode("utf-8", "surrogatepass") for c in letters]
        self.spelt_by = np.repeat(np.arange(len(letters)), [len(b) for b in bytes_of])
        self.spelt = pieces.first_byte + np.frombuffer(b"".join(bytes_of), np.uint8).astype(np.int64)
        at, size, self.piece = (np.concatenate(x) for x in zip(*found))
        self.owner, self.begin = owner[at], at - first[owner[at]]
        self.end = self.begin + size
        self.pieces, self.letters = len(pieces), len(letters)

    def weights(self, model: np.ndarray) -> np.ndarray:
        """``model`` (a log-probability per piece and language) with rows for spelt letters."""
        spelt = np.zeros((self.letters, model.shape[1]))
        np.add.at(spelt, self.spelt_by, model[self.spelt])
        return np.concatenate([model, spelt])

    def sums(self, weight: np.ndarray, back: bool = False) -> np.ndarray:
        """Log of the summed weights of all ways from a word's begin to each place, or from
        there to its end; ``weight`` has a row per arc. Axes: place, word, column of weight."""
        source, target = (self.end, self.begin) if back else (self.begin, self.end)
        order = np.lexsort((self.owner, target))
        bounds = np.searchsorted(target[order], np.arange(self.length.max() + 2))
        out = np.full((self.length.max() + 1, len(self.length), weight.shape[1]), -np.inf)
        out[self.length if back else 0, np.arange(len(self.length))] = 0.0
        places = range(self.length.max() + 1)
        for place in reversed(places) if back else places:
            arcs = order[bounds[place] : bounds[place + 1]]
            if not len(arcs):
                continue
            word = self.owner[arcs]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            ways = out[source[arcs], word] + weight[arcs]
            out[place, word[starts]] = np.logaddexp.reduceat(ways, starts, axis=0)
        return out


def blocks(words: list[str], columns: int) -> Iterator[np.ndarray]:
    """Places of ``words`` in blocks of like lengths whose lattices are of bounded size."""
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    low = 0
    while low < len(order):
        high = min(len(order), low + max(1, _CELLS // (int(lengths[order[low]]) * columns)))
        high = min(high, low + max(1, _CELLS // (int(lengths[order[high - 1]]) * columns)))
        yield order[low:high]
        low = high


def likelihoods(pieces: Pieces, model: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-likelihood of each word in each language."""
    out = np.empty((len(words), model.shape[1]))
    for block in blocks(words, model.shape[1]):
        lattice = Lattice(pieces, [words[i] for i in block])
        ways = lattice.sums(lattice.weights(model)[lattice.piece])
        out[block] = ways[lattice.length, np.arange(len(block))]
    return out


def expected(pieces: Pieces, model: np.ndarray, words: list[str], language: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each language uses each piece, over all segmentations of its words."""
    out = np.zeros(model.shape)
    for block in blocks(words, 2):
        lattice = Lattice(pieces, [words[i] for i in block])
        spoken = language[block][lattice.owner]
        weight = lattice.weights(model)[lattice.piece, spoken][:, None]
        ahead, behind = lattice.sums(weight), lattice.sums(weight, back=True)
        total = ahead[lattice.length, np.arange(len(block)), 0]
        share = ahead[lattice.begin, lattice.owner, 0] + weight[:, 0] + behind[lattice.end, lattice.owner, 0]
        share = np.exp(share - total[lattice.owner]) * times[block][lattice.owner]
        cells = (len(pieces) + lattice.letters, model.shape[1])
        used = np.bincount(
            lattice.piece * cells[1] + spoken, weights=share, minlength=cells[0] * cells[1]
        ).reshape(cells)
        out += used[: len(pieces)]
        np.add.at(out, lattice.spelt, used[len(pieces) :][lattice.spelt_by])
    return out


def _counting(batches) -> Iterator:
    """Words of each language with their number; partial counts, which Spark adds up."""
    import pyarrow as pa

    def out():
        rows = [(word, lang, n) for lang, found in counts.items() for word, n in found.items()]
        for low in range(0, len(rows), 50_000):
            words, langs, times = zip(*rows[low : low + 50_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(langs, pa.string()), pa.array(times, pa.int64())],
                ["word", "lang", "n"],
            )

    counts: dict[str, Counter] = {}
    for batch in batches:
        for low in range(0, batch.num_rows, _ROWS):
            part = batch.slice(low, _ROWS)
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > _FLUSH:
                yield from out()
                counts = {}
    yield from out()


def _expecting(known):
    def run(batches) -> Iterator:
        import pyarrow as pa

        names, langs, model = known.value
        pieces, total = Pieces(names), np.zeros(model.shape)
        number = {lang: i for i, lang in enumerate(langs)}
        for batch in batches:
            words = batch.column(0).to_pylist()
            language = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            total += expected(pieces, model, words, language, batch.column(2).to_numpy().astype(float))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(total.ravel()[used], pa.float64())], ["cell", "n"]
        )

    return run


def _smoothed(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities: each language is lent some pieces from the mean of all."""
    mean = counts.sum(1) + 1.0
    lent = counts + PRIOR * (mean / mean.sum())[:, None]
    return np.log(lent) - np.log(lent.sum(0))


def learnable(key: str = "doc_id") -> Column:
    """Rows that may be learnt from: crc32 of the identifier as text is not 2 modulo 4. A null
    identifier counts as an empty text and is learnt from."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(4)) != 2


def fit(
    docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang",
    rounds: int = ROUNDS,
) -> tuple[list[str], list[str], np.ndarray]:
    """``(pieces, languages, log-probabilities)`` learnt from all learnable rows with a language.

    Every word of these rows counts. Words are added up by Spark, and each round is one pass
    over the distinct words; the driver sees one number per piece and language. More than
    `MAX_LANGUAGES` languages are refused. Languages without a word are not learnt.
    """
    spark = docs.sparkSession
    names = vocabulary(path)
    rows = exact(docs, key=key, text=text, lang=lang).where(F.col("lang").isNotNull() & learnable("key"))
    words = written(
        rows.select(F.col("text").cast("string"), F.col("lang").cast("string"))
        .mapInArrow(_counting, "word string, lang string, n long")
        .groupBy("word", "lang").agg(F.sum("n").alias("n")),
        "language-words",
    )
    found = words.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()
    langs = sorted(r["lang"] for r in found)
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    size = len(Pieces(names))
    model = np.full((size, len(langs)), -np.log(size))
    for _ in range(rounds if langs else 0):
        known = spark.sparkContext.broadcast((names, langs, model))
        used = (
            words.mapInArrow(_expecting(known), "cell long, n double")
            .groupBy("cell").agg(F.sum("n").alias("n"))
        ).toArrow()  # at most pieces times languages
        counts = np.zeros(model.size)
        counts[used.column("cell").to_numpy()] = used.column("n").to_numpy()
        model = _smoothed(counts.reshape(model.shape))
    return names, langs, model


def _scoring(known):
    def run(batches) -> Iterator:
        import pyarrow as pa

        names, langs, model = known.value
        pieces = Pieces(names)
        seen: dict[str, int] = {}
        table = np.empty((0, len(langs)))
        for batch in batches:
            for low in range(0, batch.num_rows, _ROWS):
                part = batch.slice(low, _ROWS)
                # What `_WORD` takes besides letters are numbers of other kinds; they don't count.
                split = [
                    [w for w in words_of(t) if w.isalpha() or any(map(str.isalpha, w))]
                    for t in part.column(1).to_pylist()
                ]
                if len(seen) > _CACHE:
                    seen, table = {}, table[:0]
                new = list({w for words in split for w in words} - seen.keys())
                if new and langs:
                    seen.update(zip(new, range(len(seen), len(seen) + len(new))))
                    table = np.concatenate([table, likelihoods(pieces, model, new)])
                preds, scores = [], []
                for words in split:
                    if not words or not langs:
                        preds.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    total = table[[seen[w] for w in words]].sum(0)
                    best = int(total.argmax())  # the first of equals, in order of names
                    preds.append(langs[best])
                    scores.append(round(float(1 / np.exp(total - total[best]).sum()), 6))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    return run


def predict(docs: DataFrame, model: tuple, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` per row; the score is the language's share of the text's
    likelihood if all languages are as likely beforehand.

    Null texts, texts without a letter, and all texts if nothing was learnt, get `und` and 0.
    Equal likelihoods go to the language that comes first by name. Repeated rows give repeated
    results; texts of any length are read whole; an empty table gives an empty result.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    rows = exact(docs, key=key, text=text)
    field = rows.schema["key"].dataType.simpleString()
    return rows.select("key", F.col("text").cast("string")).mapInArrow(
        _scoring(known), f"doc_id {field}, lang_pred string, score double"
    )


def language_id(docs: DataFrame, **options) -> DataFrame:
    """Learns from the learnable rows of ``docs`` and predicts all of them."""
    named = {k: options[k] for k in ("key", "text") if k in options}
    return predict(docs, fit(docs, **options), **named)
