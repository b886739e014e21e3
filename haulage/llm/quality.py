"""Quality rules: a table of thresholds compiled into one projection.

Every metric is a built-in expression over the text, so the whole filter is a single pass
over the scan without a shuffle and without user functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import BLANKS, packed, unpacked, whole

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is it that for was on are with as at be this have from or by an not "
    "der die das und von zu den dem ist mit sich des auf nicht ein eine im es für an "
    "le la les de des et un une du en que qui dans pour est par sur pas au avec "
    "el los las y del se con por para una lo no al su como más"
).split()
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Keep a document while ``low <= metric <= high``; a missing bound does not bind."""

    name: str
    metric: str  # SQL over the columns of `measured`
    low: float | None = None
    high: float | None = None

    def verdict(self) -> str:
        bounds = [f"({self.metric}) >= {self.low}"] if self.low is not None else []
        bounds += [f"({self.metric}) <= {self.high}"] if self.high is not None else []
        return " AND ".join(bounds) or "true"


# The two base rules come first; the rest is the verdict on what passes them.
BASE_RULES = (
    Rule("enough_words", "n_words", low=20),
    Rule("repeated_words", "100 * n_repeat_words - 30 * n_words", high=0),
)
RULES = (
    Rule("mean_word_length", "word_chars / greatest(n_words, 1)", low=2, high=18),
    Rule("symbols_per_word", "n_symbols / greatest(n_words, 1)", high=0.3),
    Rule("stop_words", "n_stop_words / greatest(n_words, 1)", low=0.02),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", high=0.5),
)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the metrics. Null and empty texts have no words and zero everywhere.

    Repeated windows are first only counted as distinct hashes; positions are sorted in the
    few documents where that shows a repeat. Window hashes are compared within one document.
    """
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    has_word = F.lit("[^\\x20\\x09-\\x0D]")
    counted = (
        packed(docs, text=text).select("row", whole("text").alias("_t"))
        .withColumn("_words", F.array_remove(F.split("_t", BLANKS + "+"), ""))
        .withColumn("_lines", F.filter(F.split("_t", "\n"), lambda line: F.rlike(line, has_word)))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn(
            "_hashes",
            F.expr(
                f"CASE WHEN n_words < {WINDOW} THEN array() ELSE transform(sequence(1, cast(n_words"
                f" AS int) - {WINDOW - 1}), i -> xxhash64(slice(_words, i, {WINDOW}))) END"
            ),
        )
        .withColumn(
            "_sorted",
            F.expr(
                "CASE WHEN size(array_distinct(_hashes)) < size(_hashes) THEN"
                " sort_array(transform(_hashes, (h, i) -> struct(h AS h, i AS i))) END"
            ),
        )
        .withColumn(
            "_places",
            F.expr(
                "sort_array(transform(filter(_sorted, (x, k) -> get(_sorted, k - 1).h = x.h"
                " OR get(_sorted, k + 1).h = x.h), x -> x.i))"
            ),
        )
        .withColumns(
            {
                "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
                "n_symbols": F.regexp_count("_t", F.lit(SYMBOLS)).cast("long"),
                "n_lines": F.size("_lines").cast("long"),
                "n_dup_lines": (
                    F.size("_lines") - F.size(F.array_distinct("_lines"))
                ).cast("long"),
                "n_repeat_words": F.expr(
                    "CASE WHEN _places IS NULL THEN 0L ELSE aggregate(_places,"
                    f" struct(0L AS n, -{WINDOW} AS last), (a, p) -> struct(a.n + least({WINDOW},"
                    " p - a.last) AS n, p AS last), a -> a.n) END"
                ),
                "n_stop_words": F.expr(
                    f"cast(size(filter(_words, w -> lower(w) IN ({stop}))) AS long)"
                ),
            }
        )
    )
    metrics = (
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words"
    )
    return unpacked(counted, docs.columns, **{m: F.col(m) for m in metrics})


def verdict(rules) -> Column:
    return F.expr(" AND ".join(f"({rule.verdict()})" for rule in rules) or "true")


def judge(docs: DataFrame, rules=RULES, base=BASE_RULES, text: str = "text") -> DataFrame:
    """``docs`` plus metrics, ``base_failed``, ``failed`` (names of broken rules) and ``kept``.

    Repeated rows are judged one by one alike. Columns of ``docs`` that carry a metric's or a
    result's name, in any case, are replaced; all others stay. An empty table gives an empty one.
    """
    broken = F.array_compact(
        F.array(*[F.when(~verdict([r]), F.lit(r.name)) for r in (*base, *rules)])
    )
    return measured(docs, text).drop("base_failed", "failed", "kept").withColumns(
        {
            "base_failed": ~verdict(base),
            "failed": broken,
            "kept": verdict([*base, *rules]),
        }
    )
