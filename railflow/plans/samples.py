"""From trips to feature samples and scored baselines."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railflow.functions.time import HOLIDAYS, day_of, is_weekday, peak_flags, quarter_of_day, two_hour_slot
from railflow.operators import features as feat
from railflow.operators import flows, habits, predict
from railflow.operators.trips import within_day
from railflow.skew import hot_keys
from railflow.staging import stage

PERSONAL = ("period", "origin", "visits")
BASE_KINDS = ("group_day", "group_hour", *PERSONAL)
PERSONAL_EXTENDED = ("td_wd", "td_we", "origin", "tsd_wd", "tsd_we", "visits")
EXTENDED_KINDS = ("crowd", *PERSONAL_EXTENDED)


class SampleSet:
    """Samples with a history (``rows``, with ``idx``) and their history cells, both written stages."""

    def __init__(self, trips: DataFrame, samples: DataFrame, hot: list[int], per_traveller: int = 1):
        self.trips = trips
        drawn = stage(samples, "samples")
        self.cells = stage(feat.history_cells(trips, drawn, hot, per_traveller), "cells")
        self.drawn = drawn

    @cached_property
    def rows(self) -> DataFrame:
        return stage(feat.history_length(self.drawn, self.cells, self.tasks), "rows")

    @cached_property
    def tasks(self) -> int:
        return feat.sample_tasks(self.drawn, self.cells)

    def personal(self, *kinds: str) -> DataFrame:
        return feat.personal_features(self.drawn, self.cells, kinds, self.tasks)


def last_irregular_samples(trips: DataFrame, **habit_options) -> SampleSet:
    """The last irregular trip of each active traveller."""
    hot = hot_keys(trips, "id")
    return SampleSet(trips, habits.last_irregular(habits.habit_pairs(trips, hot, **habit_options)), hot)


def multi_samples(
    trips: DataFrame, per_traveller: int = 20, min_irregular: int = 50, pick: str = "latest", **habit_options
) -> SampleSet:
    """Several irregular trips of travellers that have many."""
    hot = hot_keys(trips, "id")
    pairs = stage(habits.habit_pairs(trips, hot, **habit_options), "pairs")
    drawn = habits.sampled_irregular(trips, pairs, hot, per_traveller, min_irregular, pick)
    return SampleSet(trips, drawn, hot, per_traveller)


def _shares(trips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All-day and hourly shares as stages: their real size decides how samples are joined to them."""
    return stage(flows.od_share(trips), "od_share"), stage(flows.od_hour_share(trips), "od_hour_share")


def base_cells(s: SampleSet, header: DataFrame) -> DataFrame:
    """The five feature kinds of ``BASE_KINDS``, long, behind the columns of ``header`` (of the samples). The headers are joined
    to the samples, or to cells where they lie, so no shuffle holds a row per feature value."""
    share, hour_share = _shares(s.trips)
    samples = feat.headed(s.rows, header)
    day = feat.group_day_feature(samples, share, ["header"])
    hour = feat.group_hour_feature(samples, hour_share, ["header"])
    personal = feat.headed_cells(s.personal(*PERSONAL), header, s.tasks)
    return day.unionByName(hour).unionByName(personal).select(*feat.KEY, "header.*", "feature", "station", "value")


def _numbered_header(s: SampleSet, holidays: Iterable[int], numbered: bool) -> DataFrame:
    header = feat.sample_header(s.rows, holidays)
    return header.join(feat.traveller_number(s.drawn), "id") if numbered else header


def samples_base(s: SampleSet, holidays: Iterable[int] = HOLIDAYS, numbered: bool = False) -> DataFrame:
    """Five-feature samples, one row per non-zero feature value; ``numbered``: with the traveller number."""
    return base_cells(s, _numbered_header(s, holidays, numbered))


def samples_base_dense(s: SampleSet, n_stations: int, holidays: Iterable[int] = HOLIDAYS, numbered: bool = False) -> DataFrame:
    """One row per sample with five vectors; group vectors are joined whole, one per origin."""
    share, hour_share = _shares(s.trips)
    header = _numbered_header(s, holidays, numbered).join(
        s.rows.select(*feat.KEY, F.hour("ot").alias("hour")), list(feat.KEY)
    )
    grouped = (
        header.join(feat.share_vectors(share, ["os"], "group_day", n_stations), "os")
        .join(feat.share_vectors(hour_share, ["hour", "os"], "group_hour", n_stations), ["hour", "os"])
        .drop("hour")
    )
    return feat.dense_samples(grouped, s.personal(*PERSONAL), PERSONAL, n_stations, s.tasks)


def extended_samples(trips: DataFrame, **habit_options) -> tuple[SampleSet, DataFrame]:
    """Samples over within-day trips, and the crowd flow table.

    The crowd flow counts all trips; history and habits leave out cross-day trips.
    """
    day_key = habit_options.get("day_key", "month")
    s = last_irregular_samples(within_day(trips, day_key), **habit_options)
    return s, stage(feat.crowd_table(flows.od_slot_share(trips, day_key)), "crowd")


def _extended_header(s: SampleSet) -> DataFrame:
    return feat.sample_header(s.rows).select(*feat.KEY, "os", "target", "st", "idx")


def samples_ext(trips: DataFrame, **habit_options) -> DataFrame:
    """Extended samples, one row per non-zero feature value."""
    s, crowd = extended_samples(trips, **habit_options)
    cells = feat.crowd_feature(s.rows, crowd, habit_options.get("day_key", "month")).unionByName(s.personal(*PERSONAL_EXTENDED))
    return _extended_header(s).join(cells, list(feat.KEY))


def samples_ext_dense(trips: DataFrame, n_stations: int, **habit_options) -> DataFrame:
    """One row per sample with seven vectors; the crowd vector is zero when no day came before."""
    s, crowd = extended_samples(trips, **habit_options)
    key = ["day", "slot", "os"]
    vectors = feat.share_vectors(crowd, key, "crowd", n_stations, "value")
    date = day_of(F.col("ot"), habit_options.get("day_key", "month"))
    day = s.rows.select(*feat.KEY, date.alias("day"), two_hour_slot(F.col("ot")).alias("slot"))
    zeros = F.array_repeat(F.lit(0.0), n_stations)
    header = (
        _extended_header(s)
        .join(day, list(feat.KEY))
        .join(vectors, key, "left")
        .withColumn("crowd", F.coalesce("crowd", zeros))
        .drop("day", "slot")
    )
    return feat.dense_samples(header, s.personal(*PERSONAL_EXTENDED), PERSONAL_EXTENDED, n_stations, s.tasks)


def _number_last(rows: DataFrame) -> DataFrame:
    return rows.select("id", *[c for c in rows.columns if c not in ("id", "traveller")], "traveller")


def samples_multi(s: SampleSet) -> DataFrame:
    """Multi-sample rows with the traveller number."""
    return _number_last(samples_base(s, numbered=True))


def samples_multi_dense(s: SampleSet, n_stations: int, holidays: Iterable[int] = HOLIDAYS) -> DataFrame:
    """One row per sample with five vectors and the traveller number."""
    return _number_last(samples_base_dense(s, n_stations, holidays, numbered=True))


def markov_ranks(s: SampleSet, n_stations: int) -> DataFrame:
    by_origin = stage(predict.origin_ranks(flows.od_share(s.trips), n_stations), "origin_ranks")
    return predict.markov_ranks(s.rows, s.personal("period"), by_origin, n_stations)


def empirical_ranks(s: SampleSet, n_stations: int) -> DataFrame:
    return predict.target_ranks(s.rows, s.personal("visits"), n_stations)


def text_markov_ranks(samples: DataFrame) -> DataFrame:
    """Markov ranks of dense samples, as ``readers.read_samples`` gives them."""
    vector = predict.markov_vector(F.col("period"), F.col("group_day"))
    return samples.select("os", "target", "st", "idx", predict.vector_rank(vector, F.col("target")).alias("rank"))


def text_empirical_ranks(samples: DataFrame) -> DataFrame:
    """Empirical ranks of dense samples, as ``readers.read_samples`` gives them."""
    return samples.select("os", "target", "st", "idx", predict.vector_rank(F.col("visits"), F.col("target")).alias("rank"))


def sequence_samples(trips: DataFrame, stations: DataFrame, k: int) -> DataFrame:
    """The k trips before every trip from the busiest origin, then that trip, with positions.

    Only codes and times go through the scan; the positions are joined to the trips of the samples alone, one row per
    trip of a prefix, and put back in order.
    """
    top = flows.top_origin(trips).select("os").scalar()
    found = feat.previous_trips(trips.select("id", "event_id", "ot", "os", "ds"), k, F.col("os") == top, ["ot", "os", "ds"])
    own = F.struct(F.lit(k).alias("at"), "ot", "os", "ds")
    steps = F.transform("prefix", lambda p, i: F.struct(i.alias("at"), p["ot"].alias("ot"), p["os"].alias("os"), p["ds"].alias("ds")))
    flat = found.select(*feat.KEY, F.inline(F.concat(steps, F.array(own))))
    for end, prefix in (("os", "o"), ("ds", "d")):
        spots = stations.select(F.col("station").alias(end), F.col("lon").alias(f"{prefix}_lon"), F.col("lat").alias(f"{prefix}_lat"))
        flat = flat.join(spots, end, "left")
    morning, evening, normal = peak_flags(F.col("ot"))
    step = F.struct(
        "at", "o_lon", "o_lat", "d_lon", "d_lat", morning.alias("mp"), evening.alias("ep"), normal.alias("normal"),
        (~is_weekday(F.col("ot"))).cast("int").alias("weekend"),
    )
    last = F.col("at") == k

    def of_last(value: Column | str) -> Column:
        return F.max(F.when(last, value if isinstance(value, Column) else F.col(value)))

    rows = flat.groupBy(*feat.KEY).agg(  # k + 1 rows a sample
        F.sort_array(F.collect_list(F.when(~last, step))).alias("prefix"),
        *[of_last(c).alias(c) for c in ("o_lon", "o_lat", "d_lon", "d_lat")],
        of_last(F.dayofweek("ot")).alias("day_of_week"),
        of_last(quarter_of_day(F.col("ot"))).alias("quarter"),
    )
    kept = F.transform("prefix", lambda p: p.dropFields("at"))
    return rows.select(*feat.KEY, kept.alias("prefix"), "o_lon", "o_lat", "day_of_week", "quarter", "d_lon", "d_lat", F.lit(k).alias("k"))
