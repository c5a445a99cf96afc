"""The corpus pipeline: quality rules, SimHash near-dedup, secret scans, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next one's docs.
Null texts are dropped by the first stage, as they fail its rules; where a stage meets them, it takes them as its operator says.
Repeated rows are judged alike until near-dedup keeps one. Empty tables go through all stages. Other columns of documents stay up
to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rostrum.llm import mixing, packing, quality, secrets, simhash
from rostrum.llm.common import checkpoint_dir
from rostrum.sources.files import remove


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the quality rules go. The target multinomial comes from the labelled rows that are among docs."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose five-word shingles are similar by 0.8 or more, one stays."""
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; every row stays."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's rate and its own draw say."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a training sequence."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Near copies and token ids are beyond SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written to the shared folder and read again. What a stage has read goes when its
    result is written, so one copy of the corpus is left, which the last stage's rows come from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            result.write.parquet(f"{folder}/{k}")
            result = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")  # nothing reads it any more
        docs = result
    return docs
