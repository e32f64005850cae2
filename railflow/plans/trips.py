"""Jobs from taps to trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railflow.operators.trips import pair_taps
from railflow.sources.readers import code_names


def tap_trips(taps: DataFrame, stations: DataFrame) -> DataFrame:
    """Trips between coded stations from taps that name their stations; trips with an unknown name drop out."""
    paired = pair_taps(taps).withColumnRenamed("os", "os_name").withColumnRenamed("ds", "ds_name")
    coded = code_names(paired, stations, {"os_name": "os", "ds_name": "ds"}).rows
    return coded.select(F.monotonically_increasing_id().alias("event_id"), "id", "os", "ds", "ot", "dt")
