"""Distances between stations and coordinate scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railflow.functions.geo import EARTH_RADIUS_KM, haversine_m, min_max
from railflow.scan import neighbour
from railflow.staging import stage

RADIUS_M = EARTH_RADIUS_KM * 1000.0
BITS = 21  # of an axis on the curve
AXES = ("x", "y", "z")
CELL = ("gx", "gy", "gz")


def gps_extent(stations: DataFrame) -> DataFrame:
    return stations.agg(
        F.min("lon").alias("lon_min"),
        F.max("lon").alias("lon_max"),
        F.min("lat").alias("lat_min"),
        F.max("lat").alias("lat_max"),
    )


def minmax_gps(stations: DataFrame) -> DataFrame:
    """Longitude and latitude scaled to 0..1 over all stations."""
    extent = gps_extent(stations)

    def scaled(axis: str) -> Column:
        low, high = (extent.select(f"{axis}_{side}").scalar() for side in ("min", "max"))
        return min_max(F.col(axis), low, high)

    return stations.select("station", "name", scaled("lon").alias("lon_norm"), scaled("lat").alias("lat_norm"))


def _spread(x: Column) -> Column:
    """The low 21 bits of ``x`` with two zero bits between each."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _curve(shift: Column) -> Column:
    """Place on a space-filling curve of the cube around the globe, moved along its diagonal by ``shift`` quarters."""
    step = 4 * RADIUS_M / (1 << BITS)  # the cube doubled, so that no shift leaves it
    bits = [_spread(F.floor((F.col(c) + RADIUS_M + shift * (RADIUS_M / 2)) / step).cast("bigint")) for c in AXES]
    return bits[0].bitwiseOR(F.shiftleft(bits[1], 1)).bitwiseOR(F.shiftleft(bits[2], 2))


def _within_reach(spots: DataFrame) -> DataFrame:
    """``name`` and ``reach``: a distance within which each spot has another one.

    It is the distance to a neighbour on one of four curves; shifting the curve bounds it by a constant times the distance of the
    nearest spot, wherever the edges of the curve's cells fall. One segmented scan sorts all four curves."""
    curves = spots.select("first", "lat", "lon", *AXES, F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("curve"))
    placed = curves.select("first", "lat", "lon", "curve", _curve(F.col("curve")).alias("place"))
    met = neighbour(placed, "curve", ["place", "first"], ["first", "lat", "lon"], "before").filter("before is not null")
    dist = haversine_m(F.col("lon"), F.col("lat"), F.col("before.lon"), F.col("before.lat"))
    both = met.select(dist.alias("d"), F.explode(F.array("first", "before.first")).alias("name"))
    return both.groupBy("name").agg(F.min("d").alias("reach"))


def nearest_station(stations: DataFrame) -> DataFrame:
    """Nearest other station of each station, without comparing all pairs and without rounds.

    A neighbour on a space-filling curve bounds how far the nearest station can be. A station looks for others in the cells that a ball of that
    radius touches, eight at most, of a cubic grid around the globe (so no meridian or pole is an edge) whose width is the power of two
    from twice the radius on. Stations are in the grids of all widths that occur, a few dozen at most.
    Stations sharing one position are settled first, by name. Ties go to the smaller name.
    """
    points = stations.select("name", "lat", "lon").distinct()
    lat, lon = F.radians("lat"), F.radians("lon")
    places = (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
    spots = stage(
        points.groupBy("lat", "lon")
        .agg(F.count(F.lit(1)).alias("names"), F.min("name").alias("first"))
        .select("*", *[(x * RADIUS_M).alias(c) for x, c in zip(places, AXES, strict=True)]),
        "spots",
    )
    shared = points.join(spots.filter("names > 1").select("lat", "lon", "first"), ["lat", "lon"])
    second = shared.filter("name <> first").groupBy("lat", "lon").agg(F.min("name").alias("second"))
    at_zero = shared.join(second, ["lat", "lon"]).select(
        "name", F.when(F.col("name") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("nearest"),
        F.lit(0.0).alias("dist"),
    )

    reach = _within_reach(spots)
    radius = F.col("reach") * (1 + 1e-9) + 1e-6  # covers the rounding of distances
    asked = stage(
        spots.filter("names = 1")
        .withColumnRenamed("first", "name")
        .join(reach, "name")
        .select("name", "lat", "lon", *AXES, radius.alias("reach"))
        .withColumn("level", F.ceil(F.log2(F.col("reach") * 2)).cast("int")),
        "reaches",
    )
    width = F.pow(F.lit(2.0), F.col("level"))
    sides = [F.array_distinct(F.array(F.floor((F.col(c) - F.col("reach")) / width), F.floor((F.col(c) + F.col("reach")) / width))) for c in AXES]
    cells = asked.select("name", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), "level", *[side.alias(c) for side, c in zip(sides, CELL, strict=True)])
    for c in CELL:
        cells = cells.withColumn(c, F.explode(c))
    levels = [r["level"] for r in asked.select("level").distinct().collect()]  # powers of two between a micrometre and the globe
    there = spots.select(F.col("first").alias("other"), "lat", "lon", *AXES, F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
    there = there.select("other", "lat", "lon", "level", *[F.floor(F.col(x) / width).alias(c) for x, c in zip(AXES, CELL, strict=True)])
    dist = haversine_m(F.col("a_lon"), F.col("a_lat"), F.col("lon"), F.col("lat"))
    met = (
        there.join(cells, ["level", *CELL])
        .filter(F.col("other") != F.col("name"))
        .groupBy("name")  # partial minima are shuffled, not pairs
        .agg(F.min(F.struct(dist.alias("dist"), F.col("other").alias("nearest"))).alias("m"))
    )
    return at_zero.unionByName(met.select("name", "m.nearest", "m.dist"))


def mean_nearest(stations: DataFrame) -> DataFrame:
    """Mean distance to the nearest other station."""
    return nearest_station(stations).agg(F.avg("dist").alias("mean_dist"))
