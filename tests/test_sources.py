"""Sample records of every text layout."""

from datetime import datetime

import pytest
from conftest import at
from pyspark.sql import functions as F

from railflow.operators import trips
from railflow.plans.samples import BASE_KINDS
from railflow.sources import readers, sinks


@pytest.fixture
def text(tmp_path):
    def write(*lines):
        p = tmp_path / f"in{len(list(tmp_path.iterdir()))}.txt"
        p.write_text("\n".join(lines) + "\n", encoding="utf-8")
        return str(p)

    return write


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_stations(spark, text):
    assert _rows(readers.read_stations(spark, text("42,Quay North,1.5,2.75,x,y"))) == [(41, "Quay North", 1.5, 2.75)]
    assert readers.read_stations(spark, text("6,a,1,2"), base=0).first()["station"] == 6
    assert _rows(readers.read_station_tuples(spark, text("(17,Mill Lane)"))) == [(17, "Mill Lane", None, None)]


def test_trips_of_both_cities(spark, text):
    path = text(
        "(c-1,2030-11-02 04:05:06,Quay North,in,2030-11-02 04:31:00,Mill Lane,out)",
        "(c-2,2031-01-09 23:50:01,Mill Lane,1.25,2031-01-10 00:02:03,Mill Lane,4.75)",
        "(c-3,soon,a,in,2030-11-02 04:31:00,b,out)",
    )
    df = readers.read_trips(spark, path)
    assert _rows(df.filter("id = 'c-1'").drop("event_id")) == [
        ("c-1", datetime(2030, 11, 2, 4, 5, 6), "Quay North", datetime(2030, 11, 2, 4, 31, 0), "Mill Lane")
    ]
    assert dict(df.dtypes)["ot"] == "timestamp_ntz"
    assert readers.bad_rows(df, "ot", "dt") == 1


def test_taps_and_raw_taps(spark, text):
    taps = readers.read_taps(spark, text("(c-4,2030-05-06 10:11:12,Hill Top ,tram,6.50)"))
    assert _rows(taps.drop("tap_id")) == [("c-4", datetime(2030, 5, 6, 10, 11, 12), "Hill Top", 6.5)]
    raw = readers.read_raw_taps(spark, text("c-5,2030-05-07,13:14:15,Hill Top,tram,0.50,none", "c-5,2030-05-07,13:20:00,corner,bus,1.50,none"), mode="tram")
    assert _rows(raw.drop("tap_id")) == [("c-5", datetime(2030, 5, 7, 13, 14, 15), "Hill Top", 0.5)]
    subway = readers.read_raw_taps(spark, text(f"c-6,2030-05-08,01:02:03,Ford,{readers.SUBWAY},0,none"))
    assert subway.first()["station"] == "Ford"


def test_paths_traces_and_dictionaries(spark, text):
    path = readers.read_paths(spark, text("4 8 15 # 2 V 0.5000 7.1250"))
    assert _rows(path) == [(4, 15, [4, 8, 15], 2, 7.13)]
    ap = readers.read_ap(spark, text("(dev-a,2030-07-08 09:10:11,Ford,33)", "(dev-b,2030-07-08 09:10:12,Ford)"))
    assert sorted(_rows(ap)) == [("dev-a", datetime(2030, 7, 8, 9, 10, 11), "Ford", 33), ("dev-b", datetime(2030, 7, 8, 9, 10, 12), "Ford", 0)]
    assert _rows(readers.read_idmap(spark, text("(c-7,dev-a,3,5,0.625)"))) == [("c-7", "dev-a", 0.625)]
    assert _rows(readers.read_od_interval(spark, text("(Ford,Hill Top,777)"))) == [("Ford", "Hill Top", 777)]
    assert _rows(readers.read_transfer_stations(spark, text("Ford", "", "Ford"))) == [("Ford",)]
    assert _rows(readers.read_tallies(spark, text("(0,31,9)"))) == [(0, 31.0, 9)]
    known = spark.createDataFrame([(3, "Ford")], "station int, name string")
    assert readers.name_to_code(ap, known).select("station").distinct().first()[0] == 3


def test_dropped_names_come_with_the_coding(spark, text):
    known = spark.createDataFrame([(3, "Ford"), (4, "Hill Top")], "station int, name string")
    rows = readers.read_od_interval(spark, text("(Ford,Hill Top,777)", "(Ford,Moor,1)", "(Moor,Fen,2)", "(,Ford,3)"))
    coded = readers.code_names(rows, known, {"os_name": "os", "ds_name": "ds"})
    assert _rows(coded.rows.select("os", "ds", "sec")) == [(3, 4, 777)] and set(coded.rows.columns) == {"os", "ds", "sec"}
    assert sorted(_rows(coded.dropped)) == [("", 1), ("Fen", 1), ("Moor", 2)]
    assert (coded.counts["n_rows"], coded.counts["n_dropped"]) == (4, 3)
    none = readers.code_names(rows.limit(0), known, {"os_name": "os", "ds_name": "ds"})
    assert none.rows.count() == none.dropped.count() == none.counts["n_rows"] == 0


def test_sample_text_round_trip(spark, tmp_path):
    s = spark.createDataFrame(
        [(4, [0.25, 0.12345], [0.0, 1.0], [2.0, 0.0], [0.0, 3.0], [1.0, 9.0], 1, 8, 17, 1, 0)],
        "os int, group_day array<double>, group_hour array<double>, period array<double>, origin array<double>,"
        " visits array<double>, target int, st int, idx int, weekday int, holiday int",
    )
    tail = ["target", "st", "idx", "weekday", "holiday"]
    line = sinks.sample_text(s, BASE_KINDS, tail)
    assert line.first()[0] == "4:0.25000,0.12345#0.00000,1.00000#2,0#0,3#1,9:1:8:17:1:0"
    line.write.text(str(tmp_path / "s"))
    back = readers.read_samples(spark, str(tmp_path / "s")).first()
    want = s.first()
    assert all(back[c] == want[c] for c in s.columns) and back["traveller"] is None


def test_sinks(spark, tmp_path, make_trips):
    t = make_trips([(1, 1, 0, 1, at(1, 0), at(1, 9)), (2, 1, 0, 1, at(1, 50_000), at(1, 50_009))])
    sinks.write_text(t.select("id", "ot", "os"), str(tmp_path / "text"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "text")).collect())[0] == "(1,2024-01-01 00:00:00,0)"
    sinks.write_csv(t.select("id", "os"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["id", "os"]
    slotted = t.withColumn("st", F.floor(F.hour("ot") / 2).cast("int"))
    sinks.write_by_slot(slotted, str(tmp_path / "slots"))
    assert sorted(p.name for p in (tmp_path / "slots").iterdir() if p.name.startswith("st=")) == ["st=0", "st=6"]
    sinks.write_table(t, str(tmp_path / "table"))
    sinks.write_table(t.limit(1), str(tmp_path / "table"), mode="overwrite")
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1


def test_station_codes_are_dense_and_sorted(spark):
    names = spark.createDataFrame([(f"n{i % 50:02d} ",) for i in range(500)], "name string")
    got = trips.station_codes(names).collect()
    assert sorted((r["station"], r["name"]) for r in got) == [(i, f"n{i:02d}") for i in range(50)]


def test_equal_lines_are_rows_of_their_own(spark, text):
    line = "(7,2030-03-05 06:07:08,a,in,2030-03-05 06:17:08,b,out)"
    at = text(*[line] * 50)
    df = readers.read_trips(spark, at)
    ids = sorted(_rows(df.select("event_id")))
    assert len(ids) == len(set(ids)) == 50 and ids == sorted(_rows(readers.read_trips(spark, at).select("event_id")))
    assert "Exchange" not in df._jdf.queryExecution().toString()


def test_a_failed_overwrite_keeps_the_old_result(spark, tmp_path):
    at = str(tmp_path / "table")
    sinks.write_table(spark.range(5), at)
    broken = spark.range(5).select(F.when(F.col("id") < 9, F.raise_error(F.lit("broken")).cast("bigint")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_table(broken, at, mode="overwrite")
    assert spark.read.parquet(at).count() == 5
    sinks.write_table(spark.read.parquet(at).filter("id < 2"), at, mode="overwrite")  # reads what it replaces
    assert sorted(r[0] for r in spark.read.parquet(at).collect()) == [0, 1]
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_slots_are_few_files_and_busy_slots_are_split(spark, tmp_path):
    rows = spark.range(0, 60_000, 1, 12).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 12).cast("int").alias("st"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    try:
        sinks.write_by_slot(rows, str(tmp_path / "slots"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "slots").iterdir() if p.name.startswith("st=")}
    assert files["st=0"] > 1 and len(files) == 4 and sum(files.values()) < 20  # 12 tasks of 4 slots each would be 48
    assert spark.read.parquet(str(tmp_path / "slots")).count() == 60_000
