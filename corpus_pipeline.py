"""A corpus pipeline of five stages, from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept. All
but the last return the columns of documents. Stages are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketframe.llm import bpe, decontamination, pii, setjoin, toxicity
from marketframe.llm.common import discard, settle, settled, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, scores below 0.5."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8), the smallest doc_id."""
    return setjoin.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and terms that disclose it replaced by marks."""
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the text decoded from them."""
    return bpe.encode(docs, decoded_col="text")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("personal data", hide_personal),
    ("bpe", encode),
]

#: SQL can't express the classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage leaves but its result is deleted as soon as that is written."""
    docs, first = table(spark, sf_dir, "documents"), settled()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, name.replace(" ", "-"))
            discard(spark, first)
    return docs
