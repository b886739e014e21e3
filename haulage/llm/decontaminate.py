"""Test items in documents, with errors: pieces by the pigeonhole, then bit-parallel distance.

An item with an error budget of k edits is split into k + 1 pieces. Any passage within the
budget holds one of them unchanged, so documents are scanned once for all pieces, and only
around a hit is the edit distance computed (Myers 1999).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.llm.common import exact, packed, unpacked, whole

CHARS_PER_ERROR = 15  # one edit is allowed per so many characters of an item
MIN_CHARS = 24  # shorter items must be held word by word, without an edit
BLOCK_CHARS = 1 << 20  # items that one scan looks for, so what is broadcast stays bounded
# ASCII punctuation counts as a blank.
_BLANKED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def plain(text: str | None) -> str:
    """Lower case, words separated and surrounded by one blank."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANKED).split()
    return f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of about the same length with their places."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(item):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def distance(mask: dict[str, int], length: int, text: str) -> int:
    """Fewest edits that turn the item into a substring of ``text``."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score, best = full, 0, length, length
    for ch in text:
        same = mask.get(ch, 0)
        across = ((((same & plus) + plus) ^ plus) | same) & full
        up = (minus | ~(across | plus)) & full
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            best = min(best, score)
        up, down = (up << 1) & full, (down << 1) & full
        diagonal = same | minus
        plus = (down | ~(diagonal | up)) & full
        minus = up & diagonal
    return best


class Finder:
    """All items of a block."""

    def __init__(self, items: list[tuple[int | None, str]], chars_per_error: int, min_chars: int):
        import ahocorasick

        self.items, at = [], {}
        for identifier, text in items:
            budget = len(text) // chars_per_error if len(text) - 2 >= min_chars else 0
            for place, piece in pieces(text, budget):
                at.setdefault(piece, []).append((len(self.items), place))
            self.items.append((identifier, len(text), budget, masks(text)))
        self.machine = ahocorasick.Automaton()
        for piece, where in at.items():
            self.machine.add_word(piece, (len(piece), where))
        self.machine.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int]]:
        """``(item, distance)`` for the items within their budget."""
        starts: dict[int, set[int]] = {}
        for end, (length, where) in self.machine.iter(text):
            for item, place in where:
                starts.setdefault(item, set()).add(end + 1 - length - place)
        found = []
        for item, begins in starts.items():
            identifier, length, budget, mask = self.items[item]
            best, low, high = length, None, None
            for begin in [*sorted(begins), None]:
                if low is not None and (begin is None or begin > high + 2 * budget):
                    region = text[max(0, low - budget) : high + length + budget]
                    best = min(best, distance(mask, length, region))
                    low = None
                if begin is not None:
                    low, high = (begin if low is None else low), begin
            if best <= budget:
                found.append((identifier, best))
        return found


def _finding(block, chars_per_error: int, min_chars: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        finder = Finder(block.value, chars_per_error, min_chars)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int64())]))
        for batch in batches:
            at, known = (batch.schema.get_field_index(n) for n in ("text", "hits"))
            hits = [
                [*(old or ()), *({"item_id": i, "distance": d} for i, d in finder.find(plain(text)))]
                for text, old in zip(batch.column(at).to_pylist(), batch.column(known).to_pylist())
            ]
            yield batch.set_column(known, "hits", pa.array(hits, kind))

    return run


def find_items(
    docs: DataFrame, items: DataFrame, chars_per_error: int = CHARS_PER_ERROR,
    min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS,
    text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``docs`` plus ``hits``: ``item_id`` and ``distance`` of each item that the text holds.

    Letters are compared in lower case, ASCII punctuation and blanks as one blank, and an
    item must begin and end with whole words but for its edits. Items of fewer than
    ``min_chars`` characters must be held as they are, whole words in a row. Items are looked
    for in blocks of bounded size, one scan of the documents for each, and no row moves. Null
    and empty texts hold nothing; null items and those without a word are held by nothing;
    items given twice are reported twice. Texts are read whole, repeated rows are judged alike;
    a column named ``hits`` is replaced.
    """
    spark = docs.sparkSession
    known = exact(items, i=item_key, t=item_text).select(F.col("i").cast("long"), whole("t").alias("t"))
    total = known.agg(F.sum(F.char_length("t")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-2 * total // block_chars)) if total > block_chars else 1
    hit = T.ArrayType(T.StructType().add("item_id", "long").add("distance", "long"))
    found = packed(docs, text=text).select("row", F.col("text").cast("string"), F.lit(None).cast(hit).alias("hits"))
    for b in range(blocks):
        mine = F.pmod(F.xxhash64("t"), F.lit(blocks)) == b
        rows = [(r["i"], plain(r["t"])) for r in known.where(mine).collect()]  # one block
        rows = [(i, t) for i, t in rows if t.strip()]
        if rows:
            block = spark.sparkContext.broadcast(rows)
            found = found.mapInArrow(_finding(block, chars_per_error, min_chars), found.schema)
    return unpacked(found, docs.columns, hits=F.coalesce("hits", F.array().cast(hit)))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    return find_items(docs, items, **options).where(F.size("hits") == 0).drop("hits")
