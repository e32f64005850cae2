"""Joins and numbering that stay balanced when one key holds a large share of the rows.

``hot_keys`` finds the few keys worth splitting. With none, a salted join is the plain one; with some, their
rows are salted. Which keys are split never changes a result, only how the work is spread. Ordered passes
within keys are in ``railflow.scan``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railflow.staging import stage

MIN_ROWS = 5_000_000  # keys below this fit a task comfortably; conf railflow.skew.minRows


def _conf(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(f"railflow.skew.{name}", str(default)))


def hot_keys(df: DataFrame, *keys: str, fraction: float = 1.0) -> list[int]:
    """Hashes of the keys with more than ``minRows * fraction`` rows: there are at most rows / that many."""
    found = (
        df.groupBy(F.xxhash64(*keys).alias("_k"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > _conf(df.sparkSession, "minRows", MIN_ROWS) * fraction)
    )
    return sorted(r["_k"] for r in found.select("_k").collect())


def is_hot(hot: Sequence[int], *keys: str) -> Column:
    return F.xxhash64(*keys).isin(list(hot))


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    hot: Sequence[int],
    how: str = "inner",
) -> DataFrame:
    """Equi join that spreads the rows of hot keys of ``big`` over many tasks.

    ``how`` may be inner, left, left_semi or left_anti; ``hot`` comes from ``hot_keys(big, *on)``.
    """
    on = list(on)
    if not hot:
        return big.join(small, on, how)
    salts = max(8, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")
    left = big.withColumn("_salt", F.when(is_hot(hot, *on), spread).otherwise(F.lit(0)))
    copies = F.when(is_hot(hot, *on), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = small.withColumn("_salt", F.explode(copies))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def global_index(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: the 0-based position of each row in the total order, without a one-task sort.

    Rows are range partitioned and sorted, written once, then shifted by the sizes of the
    earlier partitions (one row per partition).
    """
    placed = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "index",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    return (
        placed.join(F.broadcast(shifts), "_part")  # one row per shuffle partition
        .withColumn(name, F.col("_pos") + F.col("_shift"))
        .drop("_part", "_pos", "_shift")
    )
