import random

import pytest
from pyspark.sql import functions as F

from railflow.operators import predict

N = 12


def test_ranks_match_sorting_the_dense_vector(spark):
    rng = random.Random(3)
    samples, cells, want = [], [], {}
    for e in range(40):
        target = rng.randrange(N)
        vec = [rng.choice([0, 0, 1, 1, 2]) for _ in range(N)]
        samples.append((1, e, target))
        cells += [(1, e, i, float(v)) for i, v in enumerate(vec) if v]
        order = sorted(range(N), key=lambda i: (vec[i], i), reverse=True)
        want[e] = order.index(target) + 1
    s = spark.createDataFrame(samples, "id int, event_id int, target int")
    c = spark.createDataFrame(cells, "id int, event_id int, station int, value double")
    ranks = predict.target_ranks(s, c, N)
    assert {r["event_id"]: r["rank"] for r in ranks.collect()} == want

    curve = predict.accuracy_curve(ranks, N).collect()
    assert [r["hits"] for r in curve] == [sum(w <= k for w in want.values()) for k in range(1, N + 1)]
    assert curve[-1]["accuracy"] == 1.0
    tally = {r["flag"]: r["cnt"] for r in predict.hit_tally(ranks, 3).collect()}
    assert tally.get(1, 0) == sum(w <= 3 for w in want.values()) and sum(tally.values()) == 40


def test_group_shares_step_in_when_the_period_is_empty(spark):
    s = spark.createDataFrame([(1, 1, 7, 3), (1, 2, 7, 3)], "id int, event_id int, os int, target int")
    period = spark.createDataFrame([(1, 1, "period", 3, 2.0)], "id int, event_id int, feature string, station int, value double")
    share = spark.createDataFrame([(7, 5, 0.6), (7, 9, 0.3), (7, 2, 0.1)], "os int, ds int, ratio double")
    by_origin = predict.origin_ranks(share, N)
    order = [r["target"] for r in by_origin.orderBy("rank").collect()]
    assert order == [5, 9, 2, 11, 10, 8, 7, 6, 4, 3, 1, 0]
    got = {r["event_id"]: r["rank"] for r in predict.markov_ranks(s, period, by_origin, N).collect()}
    assert got == {1: 1, 2: 10}


def test_merge_with_a_missing_flag(spark):
    rows = spark.createDataFrame([(1, 5.0, 1), (0, 3.0, 2), (1, 1.0, 2)], "flag int, cnt double, k int")
    assert [tuple(r) for r in predict.merge_tallies(rows).collect()] == [(1, 1.0), (2, 0.25)]
    assert predict.merge_tallies(rows.filter(F.lit(False))).count() == 0


def test_vector_ranks_equal_sorting(spark):
    rng = random.Random(5)
    rows = [(e, rng.randrange(N), [float(rng.choice([0, 0, 1, 1, 2])) for _ in range(N)]) for e in range(60)]
    rows += [(60, 3, [0.0] * N), (61, 11, [1.0] * N)]
    df = spark.createDataFrame(rows, "event_id int, target int, v array<double>")
    got = df.select("event_id", predict.vector_rank(F.col("v"), F.col("target")).alias("rank"), predict.vector_top(F.col("v"), 4).alias("top")).collect()
    for (_, target, v), r in zip(rows, sorted(got), strict=True):
        order = sorted(range(N), key=lambda i, v=v: (v[i], i), reverse=True)
        assert r["rank"] == order.index(target) + 1 and r["top"] == order[:4]
    with pytest.raises(Exception, match="outside"):
        df.select(predict.vector_rank(F.col("v"), F.lit(N))).collect()
    s = spark.createDataFrame([(1, 1, N)], "id int, event_id int, target int")
    c = spark.createDataFrame([(1, 1, 0, 1.0)], "id int, event_id int, station int, value double")
    with pytest.raises(Exception, match="outside"):
        predict.target_ranks(s, c, N).collect()


def test_markov_vector_falls_back_on_the_group(spark):
    df = spark.createDataFrame([([0.0, 0.0], [0.2, 0.8]), ([1.0, 0.0], [0.2, 0.8])], "period array<double>, g array<double>")
    assert [r[0] for r in df.select(predict.markov_vector(F.col("period"), F.col("g"))).collect()] == [[0.2, 0.8], [1.0, 0.0]]
