"""Written stages: cut lineage through parquet in the folder the cluster shares.

A stage survives the loss of executors, and its file size gives Catalyst real statistics, so
a small stage is broadcast and a large one is not, without a hint.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_MADE: ContextVar[list[str] | None] = ContextVar("railflow_stages", default=None)


def stage_dir(spark: SparkSession) -> str:
    """Folder for stages: ``spark.checkpoint.dir``, else the session's own checkpoint folder or
    ``railflow.stage.dir``; a plain local session falls back to its warehouse folder."""
    base = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getCheckpointDir()
        or spark.conf.get("railflow.stage.dir", None)
    )
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir or railflow.stage.dir to a folder every executor can reach")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.stages"
    return f"{base.rstrip('/')}/railflow/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once and return a reader of the written rows; ``by`` puts the rows of each value in a folder of their own."""
    path = f"{stage_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete the given stages."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


@contextmanager
def collecting(into: list[str]) -> Iterator[list[str]]:
    """Note the paths of the stages made inside in ``into``, for ``drop`` once their result is written."""
    token = _MADE.set(into)
    try:
        yield into
    finally:
        _MADE.reset(token)


@contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """Delete the stages made inside at the end; write or collect the result inside."""
    made: list[str] = []
    with collecting(made):
        try:
            yield
        finally:
            drop(spark, made)


def drop_stages(spark: SparkSession) -> None:
    """Delete the stages of this application; results that still read them become unusable."""
    drop(spark, [stage_dir(spark)])
