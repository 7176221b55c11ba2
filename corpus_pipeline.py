"""From raw documents to tokens: quality rules, near duplicates, repeated passages, mixing, byte-level BPE."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import bpe, jaccard_join, mixing, quality, suffix_dedup
from tablewright.llm.common import cut, remove, shared_dir, table
from tablewright.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail by themselves or stand on a rejected host."""
    return quality.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a similarity of 0.8 on shingles of five words."""
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every string of 400 bytes that stands anywhere else out of the texts; n_chars follows."""
    out = suffix_dedup.remove_repeats(docs, outputs=("text",))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out blocks of words until the sources have their target weights; n_chars follows."""
    out = mixing.mixed_documents(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return bpe.encode_documents(docs, vocabulary(), carry=("doc_id", "source"), cached=100_000)  # workers of other stages hold memory too


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mixing", source_mixing),
    ("byte pairs", byte_pairs),
]

#: Permutations and prefix doubling have no short form in SQL; the tests compare the stages with brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder as Parquet and read again by the next; what they wrote is removed in the end.

    Null and empty texts have no words and go in the first stage, as quality rules say; a null source is a source of its own. Repeated
    rows are near duplicates of one another. Further columns travel along up to the last stage. An empty table gives an empty result.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    out = cut(STAGES[-1][1](spark, docs, sf_dir))
    remove(spark, folder)
    return out
