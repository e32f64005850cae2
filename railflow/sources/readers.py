"""Readers of the text layouts. Fields are cut by position; parentheses around a record are dropped.

Malformed numbers and times become null instead of failing the job; ``bad_rows`` counts them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from railflow.functions.time import parse_time
from railflow.functions.vectors import parse_vector
from railflow.staging import stage

SUBWAY = "地铁"  # fixed value: the transport mode kept from raw taps


def _fields(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """Lines of the files (globs allowed) with ``f``, their fields without the outer parentheses."""
    body = F.regexp_replace(F.trim("value"), r"^\(|\)$", "")
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).select("value", F.split(body, sep, -1).alias("f"))


def _numbered(lines: DataFrame) -> DataFrame:
    """The lines with ``no``, an id of its own for each, also for equal lines: its place in the split and order of the files.

    Nothing is shuffled; the same files read with the same split size get the same ids."""
    return lines.select("f", F.monotonically_increasing_id().alias("no"))


def _at(i: int) -> Column:
    """Field ``i``; a negative one counts from the end."""
    return F.try_element_at("f", F.lit(i + 1 if i >= 0 else i))


def _number(c: Column, kind: str) -> Column:
    return F.trim(c).try_cast(kind)


def read_stations(spark: SparkSession, path: str, base: int = 1) -> DataFrame:
    """``no,name,lat,lon,...``; ``base`` is taken off the number."""
    return _fields(spark, path).select(
        (_number(_at(0), "int") - base).alias("station"),
        _at(1).alias("name"),
        _number(_at(2), "double").alias("lat"),
        _number(_at(3), "double").alias("lon"),
    )


def read_station_tuples(spark: SparkSession, path: str) -> DataFrame:
    """``(code,name)``, without positions."""
    none = F.lit(None).cast("double")
    return _fields(spark, path).select(
        _number(_at(0), "int").alias("station"), _at(1).alias("name"), none.alias("lat"), none.alias("lon")
    )


def read_trips(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(id,entry,origin,tag,exit,destination,tag)`` with station names.

    ``event_id`` tells trips of one second apart, equal lines too.
    """
    return _numbered(_fields(spark, path)).select(
        F.col("no").alias("event_id"),
        _at(0).alias("id"),
        parse_time(_at(1)).alias("ot"),
        F.trim(_at(2)).alias("os_name"),
        parse_time(_at(4)).alias("dt"),
        F.trim(_at(5)).alias("ds_name"),
    )


def read_taps(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(id,time,station,mode,fare)``."""
    return _numbered(_fields(spark, path)).select(
        _at(0).alias("id"),
        F.col("no").alias("tap_id"),
        parse_time(_at(1)).alias("ts"),
        F.trim(_at(2)).alias("station"),
        _number(_at(4), "double").alias("fare"),
    )


def read_raw_taps(spark: SparkSession, path: str | list[str], mode: str = SUBWAY) -> DataFrame:
    """``id,date,time,station,mode,fare,discount`` rows of one mode, by card and time."""
    return (
        _numbered(_fields(spark, path))
        .filter(_at(4) == mode)
        .select(
            _at(0).alias("id"),
            F.col("no").alias("tap_id"),
            parse_time(F.concat_ws(" ", _at(1), _at(2))).alias("ts"),
            F.trim(_at(3)).alias("station"),
            _number(_at(5), "double").alias("fare"),
        )
        .orderBy("id", "ts", "tap_id")
    )


def read_paths(spark: SparkSession, path: str, base: int = 0) -> DataFrame:
    """``s1 s2 ... # transfers V x cost``, station numbers less ``base``, cost to 2 decimals."""
    halves = F.split("value", r"\s*#\s*")
    right = F.split(F.trim(F.get(halves, F.lit(1))), r"\s+")
    st = F.transform(F.split(F.trim(F.get(halves, F.lit(0))), r"\s+"), lambda x: x.try_cast("int") - base)
    return spark.read.text(path).filter(F.contains(F.col("value"), F.lit("#"))).select(
        F.element_at(st, 1).alias("os"),
        F.element_at(st, -1).alias("ds"),
        st.alias("st"),
        F.get(right, F.lit(0)).try_cast("int").alias("transfers"),
        F.round(F.try_element_at(right, F.lit(-1)).try_cast("double"), 2).alias("cost"),
    )


def read_od_interval(spark: SparkSession, path: str) -> DataFrame:
    """``(name,name,seconds)``."""
    return _fields(spark, path).select(
        _at(0).alias("os_name"), _at(1).alias("ds_name"), _number(_at(2), "bigint").alias("sec")
    )


def read_ap(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(device,time,station,stay)``; a missing stay is 0."""
    return _fields(spark, path).select(
        _at(0).alias("ap_id"),
        parse_time(_at(1)).alias("ts"),
        _at(2).alias("station_name"),
        F.when(F.size("f") > 3, _number(_at(3), "int")).otherwise(0).alias("stay"),
    )


def read_idmap(spark: SparkSession, path: str) -> DataFrame:
    """``(card,device,...,score)``."""
    return _fields(spark, path).select(
        _at(0).alias("id"), _at(1).alias("ap_id"), _number(_at(-1), "double").alias("score")
    )


def read_transfer_stations(spark: SparkSession, path: str) -> DataFrame:
    """One station name per line."""
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> ''").distinct()


def read_samples(spark: SparkSession, path: str | list[str], kinds: list[str] | None = None) -> DataFrame:
    """``os:v#v#...:target:slot:index[:weekday:holiday[:traveller]]`` with vectors named ``kinds``."""
    from railflow.plans.samples import BASE_KINDS

    kinds = list(kinds or BASE_KINDS)
    vectors = F.split(_at(1), "#")
    tail = ["target", "st", "idx", "weekday", "holiday", "traveller"]
    return _fields(spark, path, ":").select(
        _number(_at(0), "int").alias("os"),
        *[parse_vector(F.get(vectors, F.lit(i))).alias(k) for i, k in enumerate(kinds)],
        *[_number(_at(i + 2), "int").alias(c) for i, c in enumerate(tail)],
    )


def read_tallies(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(flag,count,k)``."""
    return _fields(spark, path).select(
        _number(_at(0), "int").alias("flag"), _number(_at(1), "double").alias("cnt"), _number(_at(2), "int").alias("k")
    )


def bad_rows(df: DataFrame, *required: str) -> int:
    """Rows with a null in a required column: fields that were missing or did not parse."""
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    return df.filter(missing).count()


@dataclass
class Coded:
    """``rows`` with codes instead of names; ``dropped`` lists the names without a code (``name``, ``uses``); ``counts`` has the
    numbers of all and of dropped rows (``n_rows``, ``n_dropped``), known without a further job."""

    rows: DataFrame
    dropped: DataFrame
    counts: dict[str, int]


def code_names(df: DataFrame, stations: DataFrame, columns: dict[str, str]) -> Coded:
    """Replace station names by codes; ``columns`` maps the columns of names to the columns of codes.

    One pass over ``df`` writes both what can be coded and, in a folder of its own, what cannot."""
    for name, code in columns.items():
        df = df.join(stations.select(F.col("station").alias(code), F.col("name").alias(name)), name, "left")
    unknown = F.lit(False)
    for code in columns.values():
        unknown = unknown | F.col(code).isNull()
    seen = Observation()
    marked = df.withColumn("_unknown", unknown).observe(
        seen, F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("_unknown"), 1)).alias("n_dropped")
    )
    written = stage(marked, "coded", by="_unknown")
    missing = F.array_compact(F.array(*[F.when(F.col(code).isNull(), F.coalesce(F.col(name), F.lit(""))) for name, code in columns.items()]))
    side = written.filter("_unknown").select(F.explode(missing).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("uses"))
    return Coded(written.filter("not _unknown").drop("_unknown", *columns), side, seen.get)


def name_to_code(df: DataFrame, stations: DataFrame, column: str = "station_name", code: str = "station") -> DataFrame:
    """Replace a station name column by its code; unknown names drop out, ``code_names`` lists them."""
    lookup = stations.select(F.col("station").alias(code), F.col("name").alias(column))
    return df.join(lookup, column).drop(column)
