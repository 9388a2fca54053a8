"""From raw documents to packed training sequences: five stages, each an operator of siltstone.llm.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of `documents`; the last returns pieces
of sequences with their ids. run() writes every stage to the shared folder and reads it back for the next one.

There is no SQL for the whole: neighbour voting, packing and the Markov models have none (tests/llm/test_pipeline.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontaminate, jaccard, packing, quality, queries, secrets
from siltstone.llm.common import Scratch
from siltstone.session import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours vote for quality (score 0.5 or more); labels of held-out ids are not used."""
    return quality.keep(docs, queries.quality_model(docs, spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link with a Jaccard similarity of 0.8 or more."""
    return jaccard.representatives(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), n=10)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids."""
    return packing.pack(docs, queries.tokenizer_path(), end_id=1, window=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        scratch.keep(docs)
    return docs
