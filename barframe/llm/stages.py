"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and gives back documents with the columns of ``docs``.

Rows that a stage cannot judge (no id, no text) are kept. All but the last stage keep extra columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe.llm import leaks, mixing, neardup, quality, tokens
from barframe.llm.common import free_name, prepare, remainder, table

#: Near copies go from this similarity on (percent); op7 alone has a contract of its own, ``neardup.PERCENT``.
NEAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the compression classifier rejects. It learns from the labelled rows of its own input."""
    prepare(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    name = free_name(docs, "quality_score")
    return quality.with_score(docs, model, column=name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one with the smallest id."""
    prepare(spark)
    return neardup.without_duplicates(docs, percent=NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark."""
    prepare(spark)
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents as the target weights ask; the sizes are those of what the earlier stages kept."""
    prepare(spark)
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files; the rows are the documents as read back from them."""
    prepare(spark)
    return tokens.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
