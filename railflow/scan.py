"""Segmented scans: ordered passes within keys, spread over range partitions.

Rows are range partitioned by (key, order), so a key with very many rows, at one time even, covers several
partitions and a small one shares its partition with others. Each partition is passed on its own; one summary row a
partition says what it hands on to the next, and a pass over these summaries (as many as partitions) gives
what each partition takes over. There is one path for all keys, and it does not depend on how many rows a key has.

A partition's rows beyond its first key begin with that key's first row, so only the rows of its first key (``lo``) can
continue an earlier partition, and only those of its last key (``hi``) can be continued. Null keys are one key,
and null times come first, as in a window. Rows equal in key and order keep the order of their input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railflow.staging import stage

SORTED = ("_part", "_tie")  # columns that a scan adds and drops


class _Ranges:
    """``df`` in range partitions by (key, order), written, with the first and last key of each."""

    def __init__(self, df: DataFrame, key: str, order: Sequence[str]):
        self.key, self.order = key, [*order, "_tie"]
        placed = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(key, *self.order)
        self.rows = stage(placed.withColumn("_part", F.spark_partition_id()), "ranges")
        self.own = F.struct(F.col(key).alias("k"))  # in a struct a null key counts, and is the least
        self.ends = self.summary()
        self.window = Window.partitionBy("_part", key).orderBy(*self.order)

    def summary(self, *more: Column) -> DataFrame:
        """One row per partition: its first and last key, and more aggregates of all its rows."""
        return self.rows.groupBy("_part").agg(F.min(self.own).alias("_lo"), F.max(self.own).alias("_hi"), *more)

    def of_end(self, end: str) -> DataFrame:
        """The rows of each partition's first (``_lo``) or last (``_hi``) key."""
        ends = F.broadcast(self.ends.select("_part", F.col(f"{end}.k").alias("_k")))  # one row per partition
        return self.rows.join(ends, "_part").filter(F.col(self.key).eqNullSafe(F.col("_k"))).drop("_k")

    def take_over(self, handed: DataFrame, rows: DataFrame, following: bool = False) -> DataFrame:
        """``rows`` with ``_carry``: the ``_handed`` of the partition before (or behind), for the rows of the key that both share.
        ``handed`` is a summary with that column."""
        near, own = ("_lo", "_hi") if following else ("_hi", "_lo")
        step = F.lead if following else F.lag
        told = step(F.struct(F.col(f"{near}.k").alias("k"), "_handed")).over(Window.orderBy("_part"))  # one row per partition
        shared = handed.withColumn("_told", told).filter(F.col("_told.k").eqNullSafe(F.col(f"{own}.k")) & F.col("_told").isNotNull())
        table = F.broadcast(shared.select(F.col("_part").alias("_p"), F.col(f"{own}.k").alias("_k"), F.col("_told._handed").alias("_carry")))
        return rows.join(table, (F.col("_part") == F.col("_p")) & F.col(self.key).eqNullSafe(F.col("_k")), "left").drop("_p", "_k")


def neighbour(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str], name: str, following: bool = False) -> DataFrame:
    """Add ``name``: a struct of ``cols`` from the previous (or following) row of the same key."""
    ranges = _Ranges(df, key, order)
    payload, at = F.struct(*cols), F.struct(ranges.own.alias("k"), *ranges.order)
    edge = F.min_by(payload, at) if following else F.max_by(payload, at)  # the partition's first or last row
    handed = ranges.summary(edge.alias("_handed"))
    within = ranges.rows.withColumn(name, (F.lead if following else F.lag)(payload).over(ranges.window))
    whole = ranges.take_over(handed, within, following)
    return whole.withColumn(name, F.coalesce(name, "_carry")).drop("_carry", *SORTED)


def running_sum(df: DataFrame, key: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over this row and the earlier rows of its key."""
    ranges = _Ranges(df.withColumn("_v", value), key, order)
    sums = ranges.of_end("_hi").groupBy("_part").agg(F.sum("_v").alias("_s"))
    so_far = Window.partitionBy("_hi").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)  # partitions of one key
    handed = sums.join(ranges.ends, "_part").select("_part", "_lo", "_hi", F.sum("_s").over(so_far).alias("_handed"))
    within = ranges.rows.withColumn(name, F.sum("_v").over(ranges.window.rowsBetween(Window.unboundedPreceding, 0)))
    whole = ranges.take_over(handed, within)
    return whole.withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).drop("_carry", "_v", *SORTED)


def preceding(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str], k: int, name: str) -> DataFrame:
    """Add ``name``: an array of structs of ``cols`` from the up to ``k`` rows before this one of the same key, oldest first."""
    ranges = _Ranges(df, key, order)
    payload = F.struct(*cols)
    last = Window.partitionBy("_part").orderBy(*[F.desc(c) for c in ranges.order])
    tail = ranges.of_end("_hi").withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= k)
    tails = tail.groupBy("_part").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("n"), payload.alias("x")))), lambda e: e["x"]).alias("_t"))
    so_far = Window.partitionBy("_hi").orderBy("_part").rowsBetween(1 - k, 0)  # k partitions hold k rows of the key
    joined = F.flatten(F.collect_list("_t").over(so_far))
    handed = tails.join(ranges.ends, "_part").select("_part", "_lo", "_hi", _last(joined, k).alias("_handed"))
    within = ranges.rows.withColumn(name, F.collect_list(payload).over(ranges.window.rowsBetween(-k, -1)))
    whole = ranges.take_over(handed, within)
    more = F.when(F.col("_carry").isNull(), F.col(name)).otherwise(_last(F.concat("_carry", name), k))
    return whole.withColumn(name, more).drop("_carry", *SORTED)


def _last(array: Column, k: int) -> Column:
    size = F.size(array)
    return F.when(size <= k, array).otherwise(F.slice(array, F.greatest(size - (k - 1), F.lit(1)), F.lit(k)))
