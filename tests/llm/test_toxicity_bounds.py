"""Very long clean texts, and more runs than a model holds."""

import random

import pytest
from haulage.llm import toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    return docs, spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")


def test_long_clean_texts(spark, tables):
    docs, labels = tables
    clean = docs.join(labels.where("toxic = 0"), "doc_id").where(~toxicity.learnable())
    texts = [r["text"].split() for r in clean.orderBy("doc_id").collect() if r["text"]]
    rng, rows = random.Random(1), []
    for i in range(4):
        words = []
        while len(words) < 100_000:
            words += rng.choice(texts)
        rows.append((i, " ".join(words[:100_000])))
    long = spark.createDataFrame(rows, "doc_id long, text string")
    scores = [r["score"] for r in toxicity.score(long, toxicity.fit(docs, labels)).collect()]
    assert len(scores) == 4 and max(scores) < 0.7


def test_too_many_runs_are_refused(tables, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_GRAMS", 1000)
    with pytest.raises(ValueError, match="fewer fit_rows"):
        toxicity.fit(*tables)
