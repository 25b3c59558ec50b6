"""The corpus pipeline: documents in, token files out, one operator a stage.

Each stage works on all that its predecessor kept and takes effect on it. Between stages the documents
are written as Parquet in the shared folder, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barframe.llm import stages
from barframe.llm.common import prepare
from barframe.session import settle

STAGES = [
    ("quality classifier", stages.quality_stage),
    ("near-duplicates", stages.near_duplicate_stage),
    ("benchmark decontamination", stages.decontamination_stage),
    ("mixing to target weights", stages.mixing_stage),
    ("token files", stages.token_stage),
]
#: The classifier is fitted, which SQL can't express; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def through(number: int) -> DataFrame:
        """The rows of stage ``number``. A stage's input is deleted as soon as its output is written."""
        if number < 0:
            return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
        docs = settle(spark, lambda: through(number - 1), f"stage-{number - 1}") if number else through(-1)
        return STAGES[number][1](spark, docs, sf_dir)

    return settle(spark, lambda: through(len(STAGES) - 1), "stages")
