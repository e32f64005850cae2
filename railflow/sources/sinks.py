"""Sinks. Output stays partitioned: nothing is forced into a single file. Overwriting is safe against failed jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from railflow.functions.time import time_text
from railflow.functions.vectors import vector_text


def _write(df: DataFrame, path: str, mode: str, save: Callable[[DataFrameWriter, str], None], by: str | None = None) -> None:
    """Write with ``save``. ``mode="overwrite"`` writes beside the old result and moves the new one in its place when it is whole:
    a job that fails leaves the old result as it was, and a query may read the path that it replaces."""
    writer = df.write.partitionBy(by) if by else df.write
    if mode != "overwrite":
        return save(writer.mode(mode), path)
    spark = df.sparkSession
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tag = uuid.uuid4().hex
    folder, _, name = path.rstrip("/").rpartition("/")
    new, old = (f"{folder}/_{name}-{kind}-{tag}" if folder else f"_{name}-{kind}-{tag}" for kind in ("new", "old"))
    try:
        save(writer.mode("errorifexists"), new)
        replaced = files.exists(at(path))
        if replaced and not files.rename(at(path), at(old)):
            raise OSError(f"cannot move {path}")
        if not files.rename(at(new), at(path)):
            if replaced:
                files.rename(at(old), at(path))
            raise OSError(f"cannot move the new result to {path}")
        files.delete(at(old), True)
    finally:
        files.delete(at(new), True)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet; ``mode="overwrite"`` replaces an older result."""
    _write(df, path, mode, lambda w, p: w.parquet(p))


def write_text(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One ``(a,b,...)`` record per row."""
    kinds = dict(df.dtypes)
    cells = [time_text(F.col(c)) if kinds[c].startswith("timestamp") else F.col(c).cast("string") for c in df.columns]
    shown = [F.coalesce(c, F.lit("null")) for c in cells]
    _write(df.select(F.concat(F.lit("("), F.concat_ws(",", *shown), F.lit(")")).alias("value")), path, mode, lambda w, p: w.text(p))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header in every part."""
    _write(df, path, mode, lambda w, p: w.option("header", True).csv(p))


def write_by_slot(df: DataFrame, path: str, mode: str = "errorifexists", column: str = "st") -> None:
    """One folder per start slot, of a few files: rows are rebalanced by slot first, and a slot with very many rows is split
    into files of the advisory partition size."""
    _write(df.hint("rebalance", column), path, mode, lambda w, p: w.parquet(p), column)


def sample_text(samples: DataFrame, kinds: Sequence[str], tail: Sequence[str]) -> DataFrame:
    """Dense samples as ``os:v#v#...:target:...`` lines.

    Counts print as whole numbers, group shares with 5 decimals.
    """

    def shown(kind: str) -> Column:
        if kind.startswith("group") or kind == "crowd":
            return vector_text(F.transform(kind, lambda v: F.format_string("%.5f", v)))
        return vector_text(F.transform(kind, lambda v: v.cast("bigint")))

    vectors = F.concat_ws("#", *[shown(k) for k in kinds])
    rest = [F.col(c).cast("string") for c in tail]
    return samples.select(F.concat_ws(":", F.col("os").cast("string"), vectors, *rest).alias("value"))
