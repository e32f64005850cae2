"""Corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, packing.

Each stage takes what the one before kept, as a table with the columns of ``documents``, and its
decisions take effect: rejected documents, repeated lines, further documents of a class and
contaminated documents go; the last stage packs what is left. A stage's own written steps are deleted
once the next stage begins, when its result has been written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from railflow import staging
from railflow.llm import decontaminate, lines, ngrams, packing, quality, vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_steps: list[str] = []  # what the stage before has written for itself


def _own_steps(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        staging.drop(spark, _steps)
        with staging.collecting(_steps):
            return stage(spark, docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
    return run_stage


@_own_steps
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_own_steps
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each class of equal or nearly equal lines stays."""
    return lines.without_repeated_lines(docs)


@_own_steps
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return ngrams.without_near_duplicates(docs)


@_own_steps
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_own_steps
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left, one row per piece."""
    return packing.pack(docs, vocabulary.word_bpe())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("pack", pack),
]

#: The learned rules and the packing are not expressible in SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{staging.stage_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{at}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
