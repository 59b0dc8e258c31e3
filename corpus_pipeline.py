"""The corpus pipeline: classify, filter, deduplicate, mix and encode documents.

``STAGES`` lists the stages in order. A stage takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, which is written as Parquet and read again as the next stage's ``docs``. ``sf_dir``
is where the labels are.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tripkit.llm import bpe, mixing, quality, simhash, toxicity
from tripkit.operators.layout import ensure_checkpoint_dir
from tripkit.sources import read_table, read_trips


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return quality.keep_quality(docs, model, threshold=0.3)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model, threshold=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: what op10 links, and what else is similar."""
    return simhash.drop_near_duplicates(docs, print_words=(3, simhash.SHINGLE_WORDS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each time a document is drawn, in shuffled order."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix, which decode to its text: ``(doc_id, ids, decoded)``."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    # Smaller blocks than usual: executors that ran the other stages have less memory to spare.
    encoded = bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, block_chars=bpe.BLOCK_CHARS // 8)
    return bpe.decode(encoded, vocabulary)


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

# Learned models and tokenizers are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes to the checkpoint folder."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = read_trips(spark, path)
    return STAGES[-1][1](spark, docs, sf_dir)
