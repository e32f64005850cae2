"""Origin-destination flows. All group keys are station, hour and day codes, so results are small
and every groupBy combines on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railflow.functions.time import day_of, seconds_between, two_hour_slot
from railflow.functions.vectors import dense


def _cnt() -> Column:
    return F.count(F.lit(1)).alias("cnt")


def od_count(trips: DataFrame) -> DataFrame:
    return trips.groupBy("os", "ds").agg(_cnt())


def od_hour_count(trips: DataFrame) -> DataFrame:
    return trips.groupBy(F.hour("ot").alias("hour"), "os", "ds").agg(_cnt())


def _share(counts: DataFrame, *origin: str, digits: int | None = None) -> DataFrame:
    """Share of each destination within its origin group (at most one row per station in a group)."""
    ratio = F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*origin))
    return counts.withColumn("ratio", ratio if digits is None else F.round(ratio, digits))


def od_share(trips: DataFrame, digits: int = 5) -> DataFrame:
    """Where riders of each origin go, all day."""
    return _share(od_count(trips), "os", digits=digits)


def od_hour_share(trips: DataFrame, digits: int = 5) -> DataFrame:
    return _share(od_hour_count(trips), "hour", "os", digits=digits)


def od_slot_share(trips: DataFrame, day_key: str = "month") -> DataFrame:
    """Destination share per day, two-hour slot and origin, not rounded."""
    counts = trips.groupBy(
        day_of(F.col("ot"), day_key).alias("day"), two_hour_slot(F.col("ot")).alias("slot"), "os", "ds"
    ).agg(_cnt())
    return _share(counts, "day", "slot", "os")


def _hour_vector(trips: DataFrame, time: str) -> DataFrame:
    hours = [
        F.count(F.when(F.hour(time) == h, True)).alias(f"h{h}") for h in range(24)
    ]
    return trips.groupBy("os", "ds").agg(*hours).select("os", "ds", F.array(*[f"h{h}" for h in range(24)]).alias("vec"))


def depart_vec(trips: DataFrame) -> DataFrame:
    """Departures per hour of each OD as a 24-vector."""
    return _hour_vector(trips, "ot")


def arrive_vec(trips: DataFrame) -> DataFrame:
    """Arrivals per hour of each OD as a 24-vector."""
    return _hour_vector(trips, "dt")


def station_mobility(trips: DataFrame) -> DataFrame:
    """Long form: hourly departures to, and arrivals from, every partner of a station.

    A station that only ever departs, or only ever arrives, is left out.
    """
    both = trips.select(
        F.explode(
            F.array(
                F.struct(F.col("os").alias("station"), F.lit("to").alias("side"), F.col("ds").alias("partner"), F.hour("ot").alias("hour")),
                F.struct(F.col("ds").alias("station"), F.lit("from").alias("side"), F.col("os").alias("partner"), F.hour("dt").alias("hour")),
            )
        ).alias("e")
    ).select("e.*")
    cells = both.groupBy("station", "side", "partner", "hour").agg(_cnt())
    w = Window.partitionBy("station")
    return (
        cells.withColumn("_first", F.min("side").over(w))
        .withColumn("_last", F.max("side").over(w))
        .filter(F.col("_first") != F.col("_last"))
        .drop("_first", "_last")
    )


def station_vectors(mobility: DataFrame, n_stations: int) -> DataFrame:
    """Dense form: per station N x 24 departures then N x 24 arrivals."""
    at = (
        F.when(F.col("side") == "to", F.lit(0)).otherwise(F.lit(n_stations * 24))
        + F.col("partner") * 24
        + F.col("hour")
    )
    entries = mobility.groupBy("station").agg(F.collect_list(F.struct(at.alias("station"), F.col("cnt").alias("value"))).alias("e"))
    return entries.select("station", dense(F.col("e"), n_stations * 48, "bigint").alias("vec"))


def od_avg_time(trips: DataFrame) -> DataFrame:
    """Mean travel time in whole seconds, cut off."""
    total = F.sum(seconds_between(F.col("ot"), F.col("dt"))).alias("total")
    return trips.groupBy("os", "ds").agg(total, _cnt()).select("os", "ds", F.expr("total div cnt").alias("sec"))


def od_ordered(trips: DataFrame) -> DataFrame:
    """OD counts by origin, then count, both descending."""
    return od_count(trips).orderBy(F.desc("os"), F.desc("cnt"), F.desc("ds"))


def origin_stats(trips: DataFrame) -> DataFrame:
    """Trips and distinct destinations of each origin."""
    return (
        od_count(trips).groupBy("os").agg(F.sum("cnt").alias("trips"), F.count(F.lit(1)).alias("destinations"))
    )


def top_origin(trips: DataFrame) -> DataFrame:
    """The busiest origin; ties by distinct destinations, then code."""
    return origin_stats(trips).orderBy(F.desc("trips"), F.desc("destinations"), "os").limit(1)


def target_dist(samples: DataFrame) -> DataFrame:
    """Samples per origin and target."""
    return samples.groupBy("os", "target").agg(_cnt()).orderBy("os", "target")
