"""Distributions over travellers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railflow.functions.time import day_of


def _distribution(per_key: DataFrame, key: str) -> DataFrame:
    """Share of rows per value of ``key``.

    The window sees one row per distinct value: at most one per day of the data, one rank per station, or, for
    trip counts, under sqrt(2 x trips) values.
    """
    counts = per_key.groupBy(key).agg(F.sum("cnt").alias("cnt"))
    return counts.withColumn("share", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(F.lit(1)))).orderBy(key)


def trips_dist(trips: DataFrame) -> DataFrame:
    """Number of trips to share of travellers."""
    per_id = trips.groupBy("id").agg(F.count(F.lit(1)).alias("n_trips"))
    return _distribution(per_id.withColumn("cnt", F.lit(1).cast("bigint")), "n_trips")


def active_days_dist(trips: DataFrame, day_key: str = "month") -> DataFrame:
    """Number of days with an entry to share of travellers."""
    per_id = trips.groupBy("id").agg(F.countDistinct(day_of(F.col("ot"), day_key)).alias("n_days"))
    return _distribution(per_id.withColumn("cnt", F.lit(1).cast("bigint")), "n_days")


def station_ranks(trips: DataFrame) -> DataFrame:
    """Stations of each traveller by visits, origins and destinations together; ties by code.

    ``arrivals`` counts the visits that were destinations.
    """
    visits = trips.select("id", F.explode(F.array(F.struct(F.col("os").alias("station"), F.lit(0).alias("arrival")), F.struct(F.col("ds").alias("station"), F.lit(1).alias("arrival")))).alias("v"))
    cells = visits.groupBy("id", "v.station").agg(
        F.count(F.lit(1)).alias("visits"), F.sum("v.arrival").alias("arrivals")
    )
    # one row per station in each traveller's window
    w = Window.partitionBy("id").orderBy(F.desc("visits"), "station")
    return cells.withColumn("rank", F.row_number().over(w))


def rank_dist(trips: DataFrame) -> DataFrame:
    """Share of trips whose destination is the traveller's r-th most visited station."""
    ranked = station_ranks(trips).filter(F.col("arrivals") > 0)
    return _distribution(ranked.select("rank", F.col("arrivals").alias("cnt")), "rank")
