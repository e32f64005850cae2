import math

import numpy as np
from conftest import at
from pyspark.sql import functions as F

from railflow.functions import profile
from railflow.operators import habits
from railflow.plans import samples as plans


def _brute(t, w, d):
    out = []
    for i in range(len(t)):
        denser = [abs(t[i] - t[j]) for j in range(len(t)) if d[j] > d[i]]
        out.append(min(denser) if denser else t[-1] - t[0])
    return out


def test_profile_matches_brute_force():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 17, 130):
        t = np.sort(rng.choice(86_400, size, replace=False)).astype(np.int64)
        w = rng.integers(1, 4, size)
        d = np.round(profile._density(t, w, 1800), 15)
        slow = [
            sum(wj * math.exp(-((a - b) ** 2) / (2 * 1800**2)) for b, wj in zip(t, w))
            / math.sqrt(2 * math.pi) / w.sum() / 1800
            for a in t
        ]
        assert np.allclose(d, slow, atol=1e-15, rtol=0)
        assert profile._denser_gap(t, d).tolist() == _brute(t, w, d)


def test_density_is_one_algorithm_at_every_size():
    rng = np.random.default_rng(2)
    t = np.sort(rng.choice(86_400, 2500, replace=False)).astype(np.int64)
    w = rng.integers(1, 9, 2500)
    gap = (t[:, None] - t[None, :]) / 1800
    direct = np.exp(-0.5 * gap * gap) @ w / (np.sqrt(2 * np.pi) * w.sum() * 1800)
    assert np.allclose(profile._density(t, w, 1800), direct, atol=1e-17, rtol=0)


def _days(n, second, os, ds, first=0, id=1, ride=600):
    return [(first + d, id, os, ds, at(d, second), at(d, second + ride)) for d in range(1, n + 1)]


def test_no_spread_gives_no_centre_and_no_habit(spark, make_trips):
    t = make_trips(_days(8, 30_000, 1, 2, ride=0))  # all times equal
    assert habits.habit_travellers(t).first()["centres"] == []
    s = plans.last_irregular_samples(t).rows.collect()
    assert [(r["event_id"], r["idx"]) for r in s] == [(8, 7)]


def test_traveller_with_only_habits_has_no_sample(spark, make_trips):
    pairs = spark.createDataFrame(
        [(1, 1, 2, 5, True), (2, 1, 2, 5, True), (2, 3, 4, 1, False)], "id int, os int, ds int, cnt int, habit boolean"
    ).withColumn("last", F.struct(F.lit(at(1, 0)).cast("timestamp_ntz").alias("ot"), F.lit(7).alias("event_id")))
    found = habits.last_irregular(pairs).collect()
    assert [(r["id"], r["os"], r["target"]) for r in found] == [(2, 3, 4)]


def test_pair_with_equal_ends_counts_twice(spark):
    schema = "id int, os int, ds int, label int, cnt bigint, n bigint, n_days int, n_centres int"
    rows = [(1, 4, 4, None, 3, 10, 9, 1), (1, 1, 2, None, 3, 10, 9, 1), (1, 2, 1, None, 2, 10, 9, 1), (1, 5, 6, None, 2, 10, 9, 1)]
    counts = spark.createDataFrame(rows, schema).withColumn("last", F.struct(F.lit(1).alias("ot"), F.lit(1).alias("event_id")))
    flags = {(r["os"], r["ds"]): r["dominant"] for r in habits.traveller_pairs(counts).collect()}
    # 2 * 3 > 5 for the loop; 3 + 2 is not more than 5
    assert flags == {(4, 4): True, (1, 2): False, (2, 1): False, (5, 6): False}


def test_day_keys(spark, make_trips):
    rows = [(i, 1, 0, 1, at(d, 0), at(d, 60)) for i, d in enumerate((1, 2, 3, 32, 33, 34, 35))]
    assert habits.time_profiles(make_trips(rows)).count() == 0  # days of month 1,2,3,1,2,3,4
    assert habits.time_profiles(make_trips(rows), day_key="date").first()["n_days"] == 7


def test_legacy_pick_takes_the_earliest_trips_of_habitual_travellers(spark, make_trips):
    odd = [(100 + d, 1, d % 5, 9, at(d, 50_000), at(d, 50_600)) for d in range(1, 11)]
    t = make_trips(odd)
    pairs = spark.createDataFrame(
        [(1, o, 9, 2, False) for o in range(5)] + [(1, 7, 8, 3, True)], "id bigint, os int, ds int, cnt int, habit boolean"
    )
    latest = habits.sampled_irregular(t, pairs, [], 3, 5).collect()
    assert sorted(r["event_id"] for r in latest) == [108, 109, 110]
    legacy = habits.sampled_irregular(t, pairs, [], 3, 5, pick="legacy").collect()
    assert sorted(r["event_id"] for r in legacy) == [101, 102, 103]
    assert habits.sampled_irregular(t, pairs, [], 3, 10).count() == 0  # not more than 10


def test_fixture_counts_at_a_hundredth(spark):
    """Counts both engines gave for the default parameters."""
    from checks.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    assert QUERIES["centres"](spark, sf).count() == 297
    assert QUERIES["habit_pairs"](spark, sf).count() == 110
    last = QUERIES["last_irregular"](spark, sf).agg(F.count("*"), F.sum("idx")).first()
    assert tuple(last) == (150, 9631)
    assert QUERIES["high_sampling"](spark, sf).count() == 7927
    assert QUERIES["subset_match"](spark, sf).count() == 7555
    assert QUERIES["path_match"](spark, sf).count() == 3702


def test_densities_are_exact_whatever_the_way(spark):
    import numpy as np

    from railflow.functions import profile

    rng = np.random.default_rng(1)
    for n in (1, 40, 2300, 2500, 6000):  # summed directly up to 2351 times, convolved beyond
        t = np.sort(rng.choice(profile.DAY_SECONDS, n, replace=False))
        w = rng.integers(1, 100_000, n)
        direct = np.stack([limb[np.abs(t[:, None] - t[None, :])] @ w.astype(float) for limb in profile._limbs(1800)])
        assert (profile._weighted(t, w, 1800) == direct).all()
        lag = (t[:, None] - t[None, :]) / 1800
        plain = (np.exp(-0.5 * lag * lag) * w).sum(axis=1) / (np.sqrt(2 * np.pi) * w.sum() * 1800)
        assert np.abs(profile._density(t, w, 1800) - plain).max() < 1e-17
    whole = profile._density(np.arange(profile.DAY_SECONDS), np.ones(profile.DAY_SECONDS, int), 1800)
    assert (whole == whole[::-1]).all() and whole.sum() < 1


def test_profiles_by_date_equal_those_by_month_within_a_month(spark, make_trips):
    rows = [(i, i % 4, i % 3, 1, at(1 + i % 21, 600 * (i % 90)), at(1 + i % 21, 600 * (i % 90) + 300)) for i in range(400)]
    month, date = (habits.time_profiles(make_trips(rows), day_key=k).orderBy("id").collect() for k in ("month", "date"))
    assert month == date and month
