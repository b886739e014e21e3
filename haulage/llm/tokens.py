"""Token counts without ids: count the pieces of a pre-token once, then sum by document.

The vocabulary holds no piece with a blank mark after another character and no piece with a
line feed, so merges never cross such a place. A text therefore falls into pre-tokens, a run
of blanks with the characters after it, and its count is the sum of theirs plus one for each
line feed. A vocabulary for which this doesn't hold is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import bounded_batches, exact, row_key, whole
from haulage.session import written

MARK = "▁"  # what the vocabulary writes for a blank
COMMON = 1 << 18  # pre-tokens that are broadcast, at most
COMMON_CHARS = 32  # of this length at most, so the broadcast is bounded by 2^18 short strings
SALTS = 16  # tasks that one pre-token may be gathered in
SAMPLE_ROWS = 32_000  # rows that the common pre-tokens are looked for in; no result depends on it


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_model(path: str):
    """The tokenizer, checked once for the two properties that pre-tokens rest on."""
    import re

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for piece in (model.id_to_piece(i) for i in range(model.get_piece_size())):
        if re.search(f"[^{MARK}]{MARK}", piece) or "\n" in piece:
            raise ValueError(f"piece {piece!r} crosses pre-tokens")
    if len(model.encode("  \n ")) != 3:
        raise ValueError("the vocabulary changes blanks")
    return model


def count_pieces(path: str):
    """A function for mapInArrow: counts each distinct ``_p`` of a batch once, and once more
    only where its rows continue in the next batch of the sorted partition."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        model = load_model(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index("_p"))
            coded = column.dictionary_encode()
            # A line feed in front keeps the tokenizer from adding a blank of its own.
            texts = ["\n" + p for p in coded.dictionary.to_pylist()]
            sizes = [len(ids) - 2 for ids in model.encode(texts, num_threads=1)]
            counted = pa.array(sizes, pa.int64()).take(coded.indices)
            rest = [n for n in batch.schema.names if n != "_p"]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in rest]
            yield pa.RecordBatch.from_arrays([*columns, counted], [*rest, "_pieces"])

    return run


def pre_tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per pre-token occurrence, and one with a null ``_p`` per document that carries
    its bytes and line feeds."""
    blanks = F.concat(F.lit(" "), F.replace(F.col("_t"), F.lit(MARK), F.lit(" ")))
    parts = F.regexp_extract_all(blanks, F.lit("[ ]*[^ \\n]+|[ ]+"), F.lit(0))
    head = F.array(F.lit(None).cast("string"))
    return (
        docs.select(*row_key(key, text), F.col(key).cast("long").alias("_id"), whole(text).alias("_t"))
        .withColumn("_feeds", F.char_length("_t") - F.char_length(F.replace("_t", F.lit("\n"), F.lit(""))))
        .withColumn("_bytes", F.octet_length("_t").cast("long"))
        .select(
            "_k", "_c", "_id", "_feeds", "_bytes",
            F.explode(F.when(F.col("_t") == "", head).otherwise(F.concat(head, parts))).alias("_p"),
        )
    )


def common_pre_tokens(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``(_p, _n)`` for frequent short pre-tokens: at most `COMMON` rows, whatever the data."""
    rows = docs.count()
    share = F.lit(min(1.0, SAMPLE_ROWS / max(rows, 1)) * 2**31)
    sample = docs.where(F.pmod(F.xxhash64(whole(text)), F.lit(2**31)) <= share)
    top = (
        pre_tokens(sample, key, text)
        .where((F.col("_p") != "") & (F.char_length("_p") <= COMMON_CHARS))
        .groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1").orderBy(F.desc("_n"), "_p").limit(COMMON)
    )
    one = top.select("_p", F.col("_p").alias("_q"))
    counted = one.mapInArrow(count_pieces(path), "_q string, _pieces long")
    return written(counted.selectExpr("_q AS _p", "_pieces AS _n"), "common-pre-tokens")


def token_counts(
    docs: DataFrame, path: str | None = None, limit: int = 4096, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row; null and empty texts have no tokens.

    Occurrences of frequent pre-tokens are summed where the document is read, by a join with
    a broadcast table of bounded size. The others are gathered by pre-token, each dealt over
    a few tasks in case it is frequent nevertheless (a long one, or one that the sample
    misses), so that a task counts it once, and their counts go back to the documents.
    An empty table gives an empty result; texts of any length are read whole.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or model_path()
    docs, key, text = exact(docs, key=key, text=text), "key", "text"
    keys = ["_k", "_c"]
    common = F.broadcast(common_pre_tokens(docs, key, text, path))
    parts = pre_tokens(docs, key, text)
    known = (
        parts.join(common, "_p", "left")
        .groupBy(*keys)
        .agg(
            F.max("_id").alias("_id"),
            F.max("_bytes").alias("_bytes"),
            F.count(F.when(F.col("_p").isNull(), 1)).alias("_copies"),
            F.sum(F.when(F.col("_p").isNull(), F.col("_feeds")).otherwise(F.coalesce("_n", F.lit(0)))).alias("_sum"),
        )
    )
    rare = (
        parts.where("_p IS NOT NULL").select(*keys, "_p").join(common, "_p", "left_anti")
        .repartition("_p", F.pmod(F.xxhash64("_k"), F.lit(SALTS))).sortWithinPartitions("_p")
        .mapInArrow(count_pieces(path), "_k long, _c long, _pieces long")
        .groupBy(*keys).agg(F.sum("_pieces").alias("_rare"))
    )
    total = (F.col("_sum") + F.coalesce("_rare", F.lit(0))) / F.col("_copies")
    per = known.join(rare, keys, "left").withColumn("_total", total.cast("long"))
    # Copies of a row were summed together; each gets its share back.
    return per.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(
        F.col("_id").alias("doc_id"),
        F.col("_bytes").alias("n_bytes"),
        F.col("_total").alias("n_tokens"),
        (F.col("_total") > limit).alias("over_limit"),
    )
