"""Every registered query against its oracle SQL, and every salted or sliced path against the plain one."""

import pytest

from checks.compare import ROOT, compare, connect
from checks.oracle import ORACLES
from checks.queries import QUERIES

SF = f"{ROOT}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name) == ""


@pytest.mark.parametrize(
    "name",
    [
        "tap_pairs", "trip_index", "frequent_travellers", "sequence_samples", "all_irregular", "samples_multi",
        "ap_segments", "route_ratio", "personal_routes", "path_shares",
    ],
)
def test_query_with_hot_keys(spark, con, name):
    spark.conf.set("railflow.skew.minRows", "20")
    try:
        assert compare(spark, con, SF, name) == ""
    finally:
        spark.conf.unset("railflow.skew.minRows")
