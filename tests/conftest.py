import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from railflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, partitions=4)
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("railflow.stage.dir", str(tmp_path_factory.mktemp("stages")))
    return session


@pytest.fixture
def hot(spark):
    """Treat every key with more than two rows as hot."""
    spark.conf.set("railflow.skew.minRows", "2")
    yield
    spark.conf.unset("railflow.skew.minRows")


DAY0 = datetime(2024, 1, 1)


def at(day: int, second: int) -> datetime:
    return DAY0 + timedelta(days=day - 1, seconds=second)


TRIP = "event_id bigint, id bigint, os int, ds int, ot timestamp_ntz, dt timestamp_ntz"


@pytest.fixture
def make_trips(spark):
    def make(rows):
        return spark.createDataFrame(rows, TRIP)

    return make
