"""Feature cells of samples: group shares of the origin and the traveller's own history.

A sample is a trip to be predicted: ``id, ot, event_id, os, target``. A traveller's history
before the sample is first counted into cells (segment, period, weekday, origin, destination),
so every personal feature reads one small table instead of the trips. Results stay long:
``id, event_id, feature, station, value``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railflow.functions.time import HOLIDAYS, day_of, is_holiday, is_weekday, period_of_day, two_hour_slot
from railflow.functions.vectors import dense
from railflow.scan import preceding
from railflow.skew import global_index, salted_join

KEY = ("id", "event_id")
SAMPLES_PER_TASK = 4_000  # each gives some dozens to hundreds of feature values
CELLS_PER_TASK = 200_000


def history_cells(trips: DataFrame, samples: DataFrame, hot: Sequence[int], per_traveller: int = 1) -> DataFrame:
    """Trips before each sample, counted per (id, seg, period, weekday, os, ds).

    ``seg`` is the 0-based rank of the traveller's first sample that the trips precede, so a
    sample of rank r reads the cells with ``seg <= r``. A trip is counted once, however many
    samples its traveller has.
    """
    order = F.struct("ot", "event_id")
    if per_traveller == 1:
        marks = samples.select("id", order.alias("_mark"))
        placed = salted_join(trips, marks, ["id"], hot).filter(order < F.col("_mark"))
        placed = placed.withColumn("seg", F.lit(0))
    else:
        marks = samples.groupBy("id").agg(F.sort_array(F.collect_list(order)).alias("_marks"))
        placed = salted_join(trips, marks, ["id"], hot)
        placed = placed.withColumn("seg", F.size(F.filter("_marks", lambda m: m <= order)))
        placed = placed.filter(F.col("seg") < F.size("_marks"))
    return placed.groupBy(
        "id", "seg", period_of_day(F.col("ot")).alias("period"), is_weekday(F.col("ot")).alias("weekday"), "os", "ds"
    ).agg(F.count(F.lit(1)).alias("cnt"))


def sample_tasks(samples: DataFrame, cells: DataFrame) -> int:
    """Tasks for steps that make many rows of each sample. Samples and cells pack so well that partitions merged by their
    size would hold any number of them; both should be written stages, whose rows cost little to count."""
    least = samples.sparkSession.sparkContext.defaultParallelism
    return max(least, -(-samples.count() // SAMPLES_PER_TASK), -(-cells.count() // CELLS_PER_TASK))


def _sample_cells(samples: DataFrame, cells: DataFrame, tasks: int | None = None) -> DataFrame:
    """Cells before each sample, next to the sample's own fields; with ``tasks`` in that many partitions by traveller."""
    if tasks:
        samples, cells = samples.repartition(tasks, "id"), cells.repartition(tasks, "id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("ot", "event_id")) - 1
    s = samples.select(
        "id", "event_id", F.col("os").alias("s_os"), period_of_day(F.col("ot")).alias("s_period"), rank.alias("_rank")
    )
    return cells.join(s, "id").filter(F.col("seg") <= F.col("_rank"))


def personal_features(samples: DataFrame, cells: DataFrame, kinds: Iterable[str], tasks: int | None = None) -> DataFrame:
    """Personal counts per station for the wanted feature kinds.

    period: destinations in the same period of the day; origin: destinations from the same
    origin; visits: all ends; td_wd, td_we: period, on weekdays or weekends; tsd_wd, tsd_we:
    same period and origin, on weekdays or weekends.
    """
    same_period, same_os = F.col("period") == F.col("s_period"), F.col("os") == F.col("s_os")
    week = F.col("weekday")
    rules: dict[str, list[tuple[Column, str]]] = {
        "period": [(same_period, "ds")],
        "origin": [(same_os, "ds")],
        "visits": [(F.lit(True), "os"), (F.lit(True), "ds")],
        "td_wd": [(same_period & week, "ds")],
        "td_we": [(same_period & ~week, "ds")],
        "tsd_wd": [(same_period & same_os & week, "ds")],
        "tsd_we": [(same_period & same_os & ~week, "ds")],
    }
    entries = [
        F.when(rule, F.struct(F.lit(kind).alias("feature"), F.col(end).alias("station")))
        for kind in kinds
        for rule, end in rules[kind]
    ]
    return (
        _sample_cells(samples, cells, tasks)
        .select(*KEY, "cnt", F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy(*KEY, "e.feature", "e.station")
        .agg(F.sum("cnt").cast("double").alias("value"))
    )


def history_length(samples: DataFrame, cells: DataFrame, tasks: int | None = None) -> DataFrame:
    """Samples that have a history, with ``idx``, the number of earlier trips."""
    length = _sample_cells(samples, cells, tasks).groupBy(*KEY).agg(F.sum("cnt").alias("idx"))
    return samples.join(length, list(KEY))


def group_day_feature(samples: DataFrame, shares: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """All-day destination shares of the sample's origin, with the samples' columns ``carry``."""
    share = shares.select("os", F.col("ds").alias("station"), F.col("ratio").alias("value"))
    return samples.select(*KEY, *carry, "os").join(share, "os").select(
        *KEY, *carry, F.lit("group_day").alias("feature"), "station", "value"
    )


def group_hour_feature(samples: DataFrame, hour_shares: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Destination shares of the sample's origin in its entry hour, with the samples' columns ``carry``."""
    share = hour_shares.select("hour", "os", F.col("ds").alias("station"), F.col("ratio").alias("value"))
    return samples.select(*KEY, *carry, "os", F.hour("ot").alias("hour")).join(share, ["hour", "os"]).select(
        *KEY, *carry, F.lit("group_hour").alias("feature"), "station", "value"
    )


def crowd_table(slot_shares: DataFrame, lookback: int = 7) -> DataFrame:
    """Summed shares of the ``lookback`` days before each day, per slot, origin and destination.

    Each share is handed on to the days it precedes, so no range join is needed.
    """
    return (
        slot_shares.select("slot", "os", "ds", "ratio", F.explode(F.sequence(F.col("day") + 1, F.col("day") + lookback)).alias("day"))
        .groupBy("day", "slot", "os", "ds")
        .agg(F.round(F.sum("ratio"), 5).alias("value"))
    )


def crowd_feature(samples: DataFrame, crowd: DataFrame, day_key: str = "month") -> DataFrame:
    """Crowd flow from the sample's origin, in its slot, over the days before."""
    keyed = samples.select(*KEY, "os", day_of(F.col("ot"), day_key).alias("day"), two_hour_slot(F.col("ot")).alias("slot"))
    return keyed.join(crowd.withColumnRenamed("ds", "station"), ["day", "slot", "os"]).select(
        *KEY, F.lit("crowd").alias("feature"), "station", "value"
    )


def sample_header(samples: DataFrame, holidays: Iterable[int] = HOLIDAYS) -> DataFrame:
    """Non-vector fields of a sample that has a history."""
    ot = F.col("ot")
    return samples.select(
        *KEY,
        "os",
        "target",
        two_hour_slot(ot).alias("st"),
        "idx",
        is_weekday(ot).cast("int").alias("weekday"),
        is_holiday(ot, holidays).cast("int").alias("holiday"),
    )


def _header(header: DataFrame) -> Column:
    return F.struct(*[c for c in header.columns if c not in KEY]).alias("header")


def headed(samples: DataFrame, header: DataFrame) -> DataFrame:
    """Samples with the other columns of their header in the struct ``header``."""
    return samples.join(header.select(*KEY, _header(header)), list(KEY))


def headed_cells(cells: DataFrame, header: DataFrame, tasks: int) -> DataFrame:
    """The same for cells, of which a sample has many: they stay in their partitions by traveller, where a traveller's few
    headers meet them at once."""
    own = header.repartition(tasks, "id").groupBy("id").agg(F.collect_list(F.struct("event_id", _header(header))).alias("headers"))
    mine = F.filter("headers", lambda h: h["event_id"] == F.col("event_id"))
    return cells.join(own, "id").withColumn("h", F.explode(mine)).select(*cells.columns, "h.header")


def share_vectors(shares: DataFrame, keys: Sequence[str], name: str, n_stations: int, value: str = "ratio") -> DataFrame:
    """One row per origin group with its shares as a vector (the table has at most one row per station pair and group)."""
    entries = F.collect_list(F.struct(F.col("ds").alias("station"), F.col(value).alias("value")))
    return shares.groupBy(*keys).agg(dense(entries, n_stations).alias(name))


def dense_samples(header: DataFrame, cells: DataFrame, kinds: Sequence[str], n_stations: int, tasks: int | None = None) -> DataFrame:
    """Add a vector of ``n_stations`` values per personal feature kind to each sample."""
    grouped = cells.groupBy(*KEY).agg(
        *[F.collect_list(F.when(F.col("feature") == k, F.struct("station", "value"))).alias(k) for k in kinds]
    )
    own = header
    if tasks:  # vectors pack well too
        own, grouped = own.repartition(tasks, *KEY), grouped.repartition(tasks, *KEY)
    joined = own.join(grouped, list(KEY), "left")
    return joined.select(*header.columns, *[dense(F.col(k), n_stations).alias(k) for k in kinds])


def traveller_number(samples: DataFrame) -> DataFrame:
    """Travellers of the samples, numbered from 0 in id order."""
    return global_index(samples.select("id").distinct(), ["id"], "traveller").select("id", "traveller")


def previous_trips(trips: DataFrame, k: int, where: Column, cols: Sequence[str], tiebreak: str = "event_id") -> DataFrame:
    """Trips that satisfy ``where``, with ``prefix``: the ``k`` trips before them, oldest first.

    Trips with fewer than ``k`` predecessors drop out.
    """
    seen = preceding(trips, "id", ["ot", tiebreak], cols, k, "prefix")
    return seen.filter((F.size("prefix") == k) & where)
