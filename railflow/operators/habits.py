"""Habitual and irregular trips of each traveller.

A traveller's entry and exit seconds of the day are reduced to distinct times with weights, at
most 86,400 rows however many trips there are. The density and the distance to the nearest
denser time then run on that bounded profile in Arrow batches; everything else is Spark SQL on
pair counts. No step pairs up a traveller's trips with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railflow.functions.profile import profile_udf
from railflow.functions.time import seconds_of_day, trip_day
from railflow.operators.trips import active_travellers
from railflow.skew import hot_keys, salted_join

BANDWIDTH = 1800
PAIR = ("id", "os", "ds")


def time_profiles(
    trips: DataFrame, min_days: int = 5, bandwidth: float = BANDWIDTH, day_key: str = "month"
) -> DataFrame:
    """One row per traveller with more than ``min_days`` trip days: trips, days and density profile."""
    day = trip_day(F.col("ot"), F.col("dt"), day_key)
    if day_key == "month":  # days 0..31 fit one bit each, so one pass counts them too
        days, n_days = F.bit_or(F.expr("shiftleft(1L, _day)")), F.bit_count(F.bit_or("_days")).cast("int")
    else:  # dates are counted first, and only the trips of active travellers go on
        active = active_travellers(trips, min_days, day_key).select("id", F.col("n_days").cast("int").alias("_days"))
        trips = trips.join(active, "id")
        days, n_days = F.first("_days"), F.max("_days")
    seconds = F.explode(F.array(seconds_of_day(F.col("ot")), seconds_of_day(F.col("dt"))))
    per_time = (
        trips.select("id", day.alias("_day"), *([] if day_key == "month" else ["_days"]), seconds.alias("t"))
        .groupBy("id", "t")
        .agg(F.count(F.lit(1)).alias("w"), days.alias("_days"))
    )
    # rows are short but each costs a density pass: this is the shuffle of the next step, in partitions that are not merged
    per_time = per_time.repartition(int(trips.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    per_id = per_time.groupBy("id").agg(
        F.expr("sum(w) div 2").alias("n"),
        n_days.alias("n_days"),
        F.sort_array(F.collect_list(F.struct("t", "w"))).alias("times"),
    )
    active = per_id.filter(F.col("n_days") > min_days).select(
        "id", "n", "n_days", F.col("times.t").alias("t"), F.col("times.w").alias("w")
    )
    scored = active.withColumn("_p", profile_udf(bandwidth)("t", "w"))
    zipped = F.arrays_zip("t", "w", F.col("_p.density").alias("density"), F.col("_p.dist").alias("dist"))
    return scored.select("id", "n", "n_days", zipped.alias("profile"))


def profile_rows(profiles: DataFrame) -> DataFrame:
    """One row per traveller and distinct time: weight, density, distance to a denser time."""
    return profiles.select("id", F.inline("profile"))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside the loops of ``body``."""
    return F.transform(F.array(value), body)[0]


def with_centres(profiles: DataFrame, min_z: float = 3.0) -> DataFrame:
    """Add ``centres``: the times whose distance and density deviate by ``min_z`` pooled deviations.

    Weights count repeated times. The mean distance is a whole number, cut off. No spread, no centre.
    """
    def spread(p: Column, m: Column) -> Column:
        far, dense = p["dist"] - m["dist"], p["density"] - m["density"]
        return far * far + dense * dense

    def means(a: Column) -> Column:
        whole = (a["dist"] - F.pmod(a["dist"], a["n"])) / a["n"]
        return F.struct(a["n"].alias("n"), whole.alias("dist"), (a["density"] / a["n"]).alias("density"))

    def chosen(m: Column) -> Column:
        total = F.aggregate("profile", F.lit(0.0), lambda a, p: a + p["w"] * spread(p, m))
        return _bind(total / m["n"], lambda v: F.filter(
            "profile", lambda p: (v > 0) & (F.sqrt(spread(p, m)) / F.sqrt(v) >= min_z)
        ))

    zero = F.struct(
        F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("dist"), F.lit(0.0).alias("density")
    )
    found = F.aggregate(
        "profile",
        zero,
        lambda a, p: F.struct(
            (a["n"] + p["w"]).alias("n"),
            (a["dist"] + p["w"] * p["dist"]).alias("dist"),
            (a["density"] + p["w"] * p["density"]).alias("density"),
        ),
        lambda a: _bind(means(a), chosen),
    )
    return profiles.select("id", "n", "n_days", F.transform(found, lambda p: p["t"]).alias("centres"))


def _nearest_centre(second: Column, radius: int) -> Column:
    """Closest centre strictly within ``radius``; the earlier one wins a tie."""
    near = F.filter("centres", lambda c: F.abs(c - second) < radius)
    return F.array_min(F.transform(near, lambda c: F.struct(F.abs(c - second).alias("d"), c.alias("t"))))["t"]


def label_trips(
    trips: DataFrame, travellers: DataFrame, hot: Sequence[int], radius: int = 5400
) -> DataFrame:
    """Trips of the given travellers with ``label``: the centre both ends belong to, else null."""
    joined = salted_join(trips, travellers, ["id"], hot)
    entry = _nearest_centre(seconds_of_day(F.col("ot")), radius)
    leave = _nearest_centre(seconds_of_day(F.col("dt")), radius)
    return joined.withColumn("_o", entry).withColumn(
        "label", F.when(F.col("_o") == leave, F.col("_o"))
    ).drop("_o")


def cluster_counts(labelled: DataFrame) -> DataFrame:
    """Trips per traveller, pair and label, with the latest of them; at most one row per pair and centre."""
    return labelled.groupBy("id", "os", "ds", "label").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.max(F.struct("ot", "event_id")).alias("last"),
        F.max("n").alias("n"),
        F.max("n_days").alias("n_days"),
        F.max(F.size("centres")).alias("n_centres"),
    )


def _is_cluster_habit(min_trips: int) -> Column:
    often = (F.col("cnt") >= min_trips) | (F.col("cnt") > F.expr("n_days div 2"))
    return F.col("label").isNotNull() & often


def habit_clusters(counts: DataFrame, min_trips: int = 5) -> DataFrame:
    """Pairs repeated often enough inside one time cluster."""
    return counts.filter(_is_cluster_habit(min_trips)).select("id", "label", "os", "ds", "cnt")


def traveller_pairs(counts: DataFrame, min_trips: int = 5) -> DataFrame:
    """One row per traveller and pair, with habit flags and the latest trip.

    A pair dominates when it and its reverse hold more than half of the trips; with equal ends
    the pair is its own reverse and counts twice. Travellers without a centre have no habits.
    """
    pairs = counts.groupBy("id", "os", "ds").agg(
        F.sum("cnt").alias("cnt"),
        F.max("last").alias("last"),
        F.max("n").alias("n"),
        F.max("n_centres").alias("n_centres"),
        F.coalesce(F.max(_is_cluster_habit(min_trips)), F.lit(False)).alias("cluster_habit"),
    )
    both = Window.partitionBy("id", F.least("os", "ds"), F.greatest("os", "ds"))  # two rows at most
    total = F.when(F.col("os") == F.col("ds"), F.col("cnt") * 2).otherwise(F.sum("cnt").over(both))
    dominant = (F.col("n_centres") > 0) & (total > F.expr("n div 2"))
    return pairs.withColumn("dominant", dominant).withColumn("habit", F.col("dominant") | F.col("cluster_habit"))


def hot_pairs(trips: DataFrame, hot: Sequence[int]) -> list[int]:
    """Hot (traveller, pair) keys; there are none without hot travellers."""
    return hot_keys(trips, *PAIR) if hot else []


def last_irregular(pairs: DataFrame) -> DataFrame:
    """The latest trip outside the habits of each traveller; none when every trip is habitual."""
    latest = F.max(F.struct("last", "os", "ds")).alias("m")
    return (
        pairs.filter(~F.col("habit"))
        .groupBy("id")
        .agg(latest)
        .select("id", "m.last.ot", "m.last.event_id", "m.os", F.col("m.ds").alias("target"))
    )


def all_irregular(trips: DataFrame, pairs: DataFrame, hot: Sequence[int]) -> DataFrame:
    """Every trip outside the habits of its (active) traveller."""
    odd = pairs.filter(~F.col("habit")).select("id", "os", "ds")
    return salted_join(trips, odd, PAIR, hot_pairs(trips, hot), "left_semi")


def sampled_irregular(
    trips: DataFrame,
    pairs: DataFrame,
    hot: Sequence[int],
    per_traveller: int = 20,
    min_irregular: int = 50,
    pick: str = "latest",
) -> DataFrame:
    """The latest irregular trips of travellers with more than ``min_irregular`` of them.

    ``pick="legacy"`` takes the earliest ones for travellers that have a habit.
    """
    w = Window.partitionBy("id")  # pairs: at most one row per station pair
    often = (
        pairs.withColumn("any_habit", F.max("habit").over(w))
        .filter(~F.col("habit"))
        .withColumn("n_odd", F.sum("cnt").over(w))
        .filter(F.col("n_odd") > min_irregular)
        .select("id", "os", "ds", "any_habit")
    )
    odd = salted_join(trips, often, PAIR, hot_pairs(trips, hot))
    latest = Window.partitionBy("id").orderBy(F.desc("ot"), F.desc("event_id"))
    # row_number with a small bound is cut to that bound inside every map task before the shuffle
    newest = odd.withColumn("rn", F.row_number().over(latest)).filter(F.col("rn") <= per_traveller)
    if pick == "legacy":
        earliest = Window.partitionBy("id").orderBy("ot", "event_id")
        oldest = odd.withColumn("rn", F.row_number().over(earliest)).filter(F.col("rn") <= per_traveller)
        newest = newest.filter(~F.col("any_habit")).unionByName(oldest.filter("any_habit"))
    elif pick != "latest":
        raise ValueError(f"unknown pick: {pick}")
    return newest.select("id", "ot", "event_id", "os", F.col("ds").alias("target"))


def habit_travellers(
    trips: DataFrame, min_days: int = 5, bandwidth: float = BANDWIDTH, min_z: float = 3.0, day_key: str = "month"
) -> DataFrame:
    """Active travellers with their centres."""
    return with_centres(time_profiles(trips, min_days, bandwidth, day_key), min_z)


def habit_pairs(
    trips: DataFrame,
    hot: Sequence[int] | None = None,
    *,
    min_days: int = 5,
    bandwidth: float = BANDWIDTH,
    min_z: float = 3.0,
    radius: int = 5400,
    min_trips: int = 5,
    day_key: str = "month",
) -> DataFrame:
    """``traveller_pairs`` straight from trips."""
    hot = hot_keys(trips, "id") if hot is None else hot
    travellers = habit_travellers(trips, min_days, bandwidth, min_z, day_key)
    return traveller_pairs(cluster_counts(label_trips(trips, travellers, hot, radius)), min_trips)
