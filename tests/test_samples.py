from collections import Counter

import pytest
from conftest import at
from pyspark.sql import functions as F

from railflow.operators import features
from railflow.plans import samples as plans

N = 6
IDS = range(40)


@pytest.fixture
def sample_set(spark, make_trips, monkeypatch):
    """40 travellers of 10 trips, the last three of which are samples; two samples a task."""
    monkeypatch.setattr(features, "SAMPLES_PER_TASK", 2)
    trips = [(i * 100 + k, i, (i + k) % N, (i + 2 * k + 1) % N, at(1 + k, 30_000), at(1 + k, 31_000)) for i in IDS for k in range(10)]
    drawn = [(i, ot, e, os, ds) for e, i, os, ds, ot, _ in trips if e % 100 >= 7]
    rows = spark.createDataFrame(drawn, "id bigint, ot timestamp_ntz, event_id bigint, os int, target int")
    return trips, plans.SampleSet(make_trips(trips), rows, [], per_traveller=3)


def _visits(trips):
    return {
        (i, e): Counter(x for e2, i2, os2, ds2, *_ in trips if i2 == i and e2 < e for x in (os2, ds2))
        for e, i, *_ in trips if e % 100 >= 7
    }


def _partitions(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_feature_values_get_tasks_by_samples(spark, sample_set):
    trips, s = sample_set
    assert s.tasks == 60
    assert _partitions(s.personal("visits")) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = plans.samples_multi(s)
    assert rows.columns == ["id", "event_id", "os", "target", "st", "idx", "weekday", "holiday", "feature", "station", "value", "traveller"]
    got = {}
    for r in rows.filter("feature = 'visits'").collect():
        assert (r.idx, r.traveller) == (r.event_id % 100, r.id)
        got.setdefault((r.id, r.event_id), Counter())[r.station] = int(r.value)
    assert got == _visits(trips)


def test_dense_samples_get_tasks_by_samples(spark, sample_set, monkeypatch):
    trips, s = sample_set
    seen, dense = [], features.dense_samples
    monkeypatch.setattr(features, "dense_samples", lambda *a: seen.append(a[-1]) or dense(*a))
    rows = plans.samples_multi_dense(s, N)
    assert seen == [60]
    got = {(r.id, r.event_id): Counter({i: int(v) for i, v in enumerate(r.visits) if v}) for r in rows.collect()}
    assert got == _visits(trips)
    assert rows.columns[0] == "id" and rows.columns[-1] == "traveller"


def test_repeated_samples_meet_every_header(spark):
    header = spark.createDataFrame([(1, 5, 7), (1, 5, 7), (1, 6, 8), (2, None, 9)], "id int, event_id int, os int")
    cells = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (1, 6, "c"), (2, None, "d"), (3, 5, "e")], "id int, event_id int, feature string")
    got = sorted((r.event_id, r.feature, r.header.os) for r in features.headed_cells(cells, header, 3).collect())
    assert got == [(5, "a", 7), (5, "a", 7), (6, "b", 8), (6, "c", 8)]
