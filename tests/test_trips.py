from conftest import at
from pyspark.sql import functions as F

from railflow.functions import time as tm
from railflow.operators import features, flows, trips


def _taps(spark, rows):
    return spark.createDataFrame(rows, "id bigint, tap_id bigint, ts timestamp_ntz, station int, fare double")


def test_pairing_takes_the_last_free_tap_before_a_paid_one(spark):
    taps = _taps(
        spark,
        [
            (1, 1, at(1, 0), 5, 0.0),
            (1, 2, at(1, 60), 6, 0.0),  # two entries in a row
            (1, 3, at(1, 120), 7, 3.0),
            (1, 4, at(1, 180), 8, 2.0),  # paid tap without an entry
            (1, 5, at(1, 240), 9, 0.0),  # entry without an exit
            (2, 6, at(1, 0), 1, 0.0),
            (2, 7, at(1, 60), 2, 0.0),  # zero-fare exit does not pair
        ],
    )
    found = trips.pair_taps(taps).select("id", "os", "ds").collect()
    assert [tuple(r) for r in found] == [(1, 6, 7)]


def test_pairing_of_a_long_history(spark):
    rows = [(1, i, at(1, 700 * i), i, 0.0 if i % 2 == 0 else 1.0) for i in range(40)]
    found = trips.pair_taps(_taps(spark, rows)).select("os", "ds").collect()
    assert sorted(tuple(r) for r in found) == [(i, i + 1) for i in range(0, 40, 2)]


def test_trip_index_and_previous_trips(spark, make_trips):
    rows = [(i, 1, i % 3, 1, at(1, 400 * i), at(1, 400 * i + 60)) for i in range(50)]
    t = make_trips(rows)
    assert {r["event_id"]: r["idx"] for r in trips.trip_index(t).collect()} == {i: i for i in range(50)}
    seen = features.previous_trips(t, 3, F.col("os") == 0, ["event_id"]).collect()
    assert {r["event_id"]: [p["event_id"] for p in r["prefix"]] for r in seen} == {
        i: [i - 3, i - 2, i - 1] for i in range(3, 50, 3)
    }


def test_cross_day_trip_counts_as_day_zero(spark, make_trips):
    rows = [(d, 1, 0, 1, at(d, 3600), at(d, 4000)) for d in range(1, 6)] + [(9, 1, 0, 1, at(6, 86_390), at(7, 100))]
    t = make_trips(rows)
    assert trips.active_travellers(t).collect()[0]["n_days"] == 6
    assert trips.within_day(t).count() == 5
    assert trips.active_travellers(trips.within_day(t)).count() == 0


def test_unknown_station_names_are_listed(spark):
    t = spark.createDataFrame([(1, "a", "b"), (2, "a", "x")], "event_id int, os_name string, ds_name string")
    known = spark.createDataFrame([(0, "a"), (1, "b")], "station int, name string")
    assert trips.code_stations(t, known).count() == 1
    assert [tuple(r) for r in trips.unknown_stations(t, known).collect()] == [("x", 1)]


def test_epoch_is_taken_in_the_given_zone(spark):
    row = spark.range(1).select(
        tm.text_to_epoch(F.lit("2019-06-30 00:59:05")).alias("e"),
        tm.epoch_to_text(F.lit(1561827545)).alias("t"),
        tm.text_to_epoch(F.lit("not a time")).alias("bad"),
    ).first()
    assert tuple(row) == (1561827545, "2019-06-30 00:59:05", None)


def test_shares_add_up(spark, make_trips):
    t = make_trips([(i, 1, i % 2, i % 7, at(1, i), at(1, i + 9)) for i in range(200)])
    sums = flows.od_share(t).groupBy("os").agg(F.sum("ratio").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-4 for r in sums)


def test_station_with_one_role_is_left_out(spark, make_trips):
    t = make_trips([(1, 1, 0, 1, at(1, 0), at(1, 9)), (2, 1, 1, 2, at(1, 0), at(1, 9))])
    long = flows.station_mobility(t)
    assert {r["station"] for r in long.collect()} == {1}
    vec = flows.station_vectors(long, 3).first()["vec"]
    assert len(vec) == 3 * 48 and sum(vec) == 2 and vec[2 * 24] == 1 and vec[3 * 24] == 1
