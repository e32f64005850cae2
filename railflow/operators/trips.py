"""Taps to trips, station coding and trip filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railflow.functions.time import (
    HOLIDAYS,
    ZONE,
    epoch_to_text,
    half_hour_of_month,
    is_holiday,
    is_weekday,
    peak_flags,
    period_of_day,
    quarter_of_day,
    seconds_of_day,
    text_to_epoch,
    time_text,
    trip_day,
    two_hour_slot,
)
from railflow.scan import neighbour, running_sum
from railflow.skew import global_index, hot_keys, salted_join


def pair_taps(taps: DataFrame, tiebreak: str = "tap_id") -> DataFrame:
    """A zero-fare tap followed, for the same card, by a paid tap is a trip.

    A paid tap can never open a trip, so looking one tap ahead equals the pairwise scan.
    """
    seen = neighbour(taps, "id", ["ts", tiebreak], ["ts", "station", "fare"], "exit", following=True)
    return seen.filter((F.col("fare") == 0) & (F.col("exit.fare") > 0)).select(
        "id",
        F.col("ts").alias("ot"),
        F.col("station").alias("os"),
        F.col("fare").alias("o_fare"),
        F.col("exit.ts").alias("dt"),
        F.col("exit.station").alias("ds"),
        F.col("exit.fare").alias("d_fare"),
    )


def station_codes(names: DataFrame, name: str = "name") -> DataFrame:
    """Distinct station names in order, coded from 0."""
    trimmed = names.select(F.trim(name).alias("name")).distinct()
    return global_index(trimmed, ["name"], "station").select("station", "name")


def code_stations(trips: DataFrame, stations: DataFrame) -> DataFrame:
    """Replace ``os_name`` and ``ds_name`` by station codes; rows with unknown names drop out.

    ``unknown_stations`` lists what dropped. The dictionary has no hint: its size decides.
    """
    codes = stations.select("station", "name")
    for end in ("os", "ds"):
        lookup = codes.select(F.col("station").alias(end), F.col("name").alias(f"{end}_name"))
        trips = trips.join(lookup, f"{end}_name").drop(f"{end}_name")
    return trips


def unknown_stations(trips: DataFrame, stations: DataFrame) -> DataFrame:
    """Names used by trips but missing from the dictionary, with the number of uses."""
    used = trips.select(F.explode(F.array("os_name", "ds_name")).alias("name"))
    return used.groupBy("name").agg(F.count(F.lit(1)).alias("uses")).join(stations, "name", "left_anti")


def locate(trips: DataFrame, stations: DataFrame) -> DataFrame:
    """Add the position of both ends."""
    for end, prefix in (("os", "o"), ("ds", "d")):
        lookup = stations.select(
            F.col("station").alias(end), F.col("lon").alias(f"{prefix}_lon"), F.col("lat").alias(f"{prefix}_lat")
        )
        trips = trips.join(lookup, end)
    return trips


def time_parts(trips: DataFrame, holidays: Iterable[int] = HOLIDAYS, day_key: str = "month") -> DataFrame:
    """All calendar fields of a trip."""
    ot, dt = F.col("ot"), F.col("dt")
    morning, evening, normal = peak_flags(ot)
    return trips.select(
        "event_id",
        F.dayofmonth(ot).alias("day"),
        F.hour(ot).alias("hour"),
        period_of_day(ot).alias("period"),
        seconds_of_day(ot).alias("second"),
        F.dayofweek(ot).alias("weekday_no"),
        F.month(ot).alias("month"),
        quarter_of_day(ot).alias("quarter"),
        half_hour_of_month(ot).alias("half_hour"),
        two_hour_slot(ot).alias("slot"),
        is_weekday(ot).cast("int").alias("weekday"),
        is_holiday(ot, holidays).cast("int").alias("holiday"),
        morning.alias("morning_peak"),
        evening.alias("evening_peak"),
        normal.alias("normal_hour"),
        trip_day(ot, dt, day_key).alias("trip_day"),
    )


def clock_fields(trips: DataFrame, zone: str = ZONE) -> DataFrame:
    """Entry time as text, its Unix seconds in ``zone``, and the text those seconds give back."""
    text = time_text(F.col("ot"))
    return trips.select(
        "event_id", text.alias("text"), text_to_epoch(text, zone).alias("epoch"),
        epoch_to_text(text_to_epoch(text, zone), zone).alias("back"),
    )


def within_day(trips: DataFrame, day_key: str = "month") -> DataFrame:
    """Drop trips that enter and leave on different days."""
    return trips.filter(trip_day(F.col("ot"), F.col("dt"), day_key) > 0)


def active_travellers(trips: DataFrame, min_days: int = 5, day_key: str = "month") -> DataFrame:
    """Travellers with more than ``min_days`` distinct trip days; 0, the cross-day code, counts as one."""
    day = trip_day(F.col("ot"), F.col("dt"), day_key)
    return (
        trips.groupBy("id")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct(day).alias("n_days"))
        .filter(F.col("n_days") > min_days)
    )


def frequent_travellers(trips: DataFrame, min_trips: int = 10) -> DataFrame:
    """Trips of travellers with more than ``min_trips`` trips."""
    often = trips.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_trips)
    return salted_join(trips, often.select("id"), ["id"], hot_keys(trips, "id"), "left_semi")


def trip_index(trips: DataFrame, tiebreak: str = "event_id") -> DataFrame:
    """0-based position of each trip in its traveller's history."""
    counted = running_sum(trips, "id", ["ot", tiebreak], F.lit(1).cast("bigint"), "idx")
    return counted.withColumn("idx", F.col("idx") - 1)


def prediction_table(trips: DataFrame, min_trips: int = 10, holidays: Iterable[int] = HOLIDAYS) -> DataFrame:
    """Flat training rows of frequent travellers."""
    ot = F.col("ot")
    return frequent_travellers(trips, min_trips).select(
        "id",
        "ot",
        "dt",
        F.col("os").alias("os_num"),
        F.col("ds").alias("ds_num"),
        F.dayofweek(ot).alias("day_of_week"),
        quarter_of_day(ot).alias("quarter"),
        F.month(ot).alias("mon"),
        is_holiday(ot, holidays).cast("int").alias("holiday"),
    )
