"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6378.137


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    north = F.sin((F.radians(lat1) - F.radians(lat2)) / 2)
    east = F.sin((F.radians(lon1) - F.radians(lon2)) / 2)
    chord = F.sqrt(north * north + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * east * east)
    return F.lit(2000.0 * EARTH_RADIUS_KM) * F.asin(F.least(chord, F.lit(1.0)))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scale into 0..1; null when the range is empty."""
    return F.try_divide(value - low, high - low)
