"""Segmented scans against plain windows: null keys and times, ties, keys that cover partitions or share one."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from railflow import scan

DAY = datetime(2024, 1, 1)


@pytest.fixture(params=["mixed", "one time", "one key", "all null", "few"])
def rows(spark, request):
    out = []
    for i in range(6 if request.param == "few" else 400):
        key = {"mixed": None if i % 5 == 0 else f"k{(i * i) % 7}", "one time": "a" if i % 3 else f"b{i}", "one key": "a", "all null": None, "few": f"k{i % 2}"}[request.param]
        ts = None if i % 11 == 0 and request.param != "one time" else DAY + timedelta(seconds=0 if request.param == "one time" else 37 * (i % 90), microseconds=500_000 * (i % 2))
        out.append((key, ts, i, i % 5))
    return spark.createDataFrame(out, "key string, ts timestamp_ntz, n int, v int").repartition(7, "n")


@pytest.fixture(autouse=True)
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


ORDER = ["ts", "n"]


def _window():
    return Window.partitionBy("key").orderBy(*ORDER)


def _same(got, want):
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("following", [False, True])
def test_neighbour(rows, following):
    near = (F.lead if following else F.lag)(F.struct("n", "v")).over(_window())
    _same(scan.neighbour(rows, "key", ORDER, ["n", "v"], "near", following), rows.withColumn("near", near))


def test_running_sum(rows):
    total = F.sum("v").over(_window().rowsBetween(Window.unboundedPreceding, 0))
    _same(scan.running_sum(rows, "key", ORDER, F.col("v"), "total"), rows.withColumn("total", total))


@pytest.mark.parametrize("k", [1, 3, 120])
def test_preceding(rows, k):
    before = F.collect_list(F.struct("n")).over(_window().rowsBetween(-k, -1))
    _same(scan.preceding(rows, "key", ORDER, ["n"], k, "before"), rows.withColumn("before", before))


def test_rows_equal_in_key_and_order_are_spread(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("key"), F.lit(DAY).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("bigint").alias("v"))
    ranges = scan._Ranges(rows, "key", ["ts"])
    sizes = sorted(r["count"] for r in ranges.rows.groupBy("_part").count().collect())
    assert len(sizes) == 9 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    total = scan.running_sum(rows, "key", ["ts"], F.col("v"), "total")
    assert total.agg(F.min("total"), F.max("total"), F.countDistinct("total")).first() == (1, 20_000, 20_000)


def test_empty_tables(rows):
    none = rows.limit(0)
    assert scan.neighbour(none, "key", ORDER, ["n"], "near").count() == 0
    assert scan.running_sum(none, "key", ORDER, F.col("v"), "total").count() == 0
    assert scan.preceding(none, "key", ORDER, ["n"], 2, "before").count() == 0
