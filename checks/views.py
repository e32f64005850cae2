"""Input views derived from the driver tables (FIXTURES.md), as Spark DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railflow.staging import stage

N = 25  # stations in the derived network
NAMED = "concat('S', lpad(cast({0} as string), 2, '0'))"


SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey station",
        "n_name name",
        "22.5D + 0.02D*(n_nationkey div 5) + 0.001D*((n_nationkey*3)%7) lat",
        "113.8D + 0.02D*(n_nationkey%5) + 0.001D*((n_nationkey*7)%5) lon",
    )


def transfer_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("n_nationkey station").filter("station % 6 = 0")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A station dictionary that grows with the data: one site per customer."""
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as int) station",
        "c_name name",
        "22.4D + 0.00001D*((c_custkey*7919)%40000) lat",
        "113.7D + 0.00001D*((c_custkey*104729)%60000) lon",
    )


def taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id id",
        "event_id tap_id",
        "cast(date_trunc('second', ts) as timestamp_ntz) ts",
        "cast(get_json_object(props,'$.k') as int)%25 station",
        "case when event_type in ('purchase','error') then value else 0D end fare",
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "event_id",
            "user_id id",
            "cast(date_trunc('second', ts) as timestamp_ntz) ts",
            "cast(cast(ts as date) as timestamp_ntz) midnight",
            "cast(get_json_object(props,'$.k') as int) k",
            "cast(event_id%10 as int) r",
            "cast(user_id%25 as int) home",
            "cast((user_id*7+3)%25 as int) work",
            "case cast(user_id%3 as int) when 0 then 8 when 1 then 4 else 0 end share",
        )
        .selectExpr("*", "case when r<share and r%2=0 then 1 when r<share then 2 else 0 end dir")
        # a generator is computed once per row; plain columns would be repeated in every filter using them
        .selectExpr(
            "event_id",
            "id",
            "inline(array(struct("
            "case dir when 1 then home when 2 then work else k%25 end os,"
            "case dir when 1 then work when 2 then home else (k+cast(event_id%23 as int)+1)%25 end ds,"
            "case dir when 1 then timestampadd(SECOND, 8*3600+event_id%1200, midnight)"
            " when 2 then timestampadd(SECOND, 18*3600+event_id%1200, midnight) else ts end ot)))",
        )
        .selectExpr(
            "*", "timestampadd(SECOND, 300+120*(abs(os div 5-ds div 5)+abs(os%5-ds%5))+event_id%60, ot) dt"
        )
    )


def named_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips that name their stations; every 97th names a station outside the dictionary."""
    known = stations(spark, sf_dir)
    named = trips(spark, sf_dir)
    for end in ("os", "ds"):
        name = known.select(F.col("station").alias(end), F.col("name").alias(f"{end}_name"))
        named = named.join(name, end)
    return named.drop("os", "ds").withColumn(
        "os_name", F.when(F.col("event_id") % 97 == 0, F.lit("UNKNOWN")).otherwise(F.col("os_name"))
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-first path per OD, and column-first where it differs."""
    known = table(spark, sf_dir, "nation").selectExpr("n_nationkey ds")
    ends = (
        table(spark, sf_dir, "nation")
        .selectExpr("n_nationkey os", "explode(sequence(0, 24)) ds")
        .filter("os <> ds")
        .join(known, "ds", "left_semi")
        .selectExpr("os", "ds", "os div 5 r1", "os%5 c1", "ds div 5 r2", "ds%5 c2")
    )
    row_first = (
        "concat(transform(sequence(c1,c2), c->int(r1*5+c)), slice(transform(sequence(r1,r2), r->int(r*5+c2)),2,5))"
    )
    column_first = (
        "concat(transform(sequence(r1,r2), r->int(r*5+c1)), slice(transform(sequence(c1,c2), c->int(r2*5+c)),2,5))"
    )
    return (
        ends.selectExpr(
            "os",
            "ds",
            "r1<>r2 and c1<>c2 turns",
            f"explode(if(r1<>r2 and c1<>c2, array(struct(1 path_no, {row_first} st), struct(2 path_no, {column_first} st)),"
            f" array(struct(1 path_no, {row_first} st)))) p",
        )
        .selectExpr("os", "ds", "p.path_no", "p.st", "if(turns,1,0) transfers")
        .withColumn("cost", F.expr("2.0D*(size(st)-1)+3.0D*transfers"))
    )


def od_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        paths(spark, sf_dir).filter("path_no = 1").selectExpr("os", "ds", "cast(120*(size(st)-1) as bigint) sec")
    )


def idmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .selectExpr("user_id id", "concat('ap', user_id) ap_id", "(50+10*(user_id%6))/100D score")
        .distinct()
    )


def ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the stations on one path per trip; path 2 for odd trips where it exists."""
    choice = paths(spark, sf_dir).groupBy("os", "ds").agg(
        F.max(F.when(F.col("path_no") == 1, F.col("st"))).alias("st1"),
        F.max(F.when(F.col("path_no") == 2, F.col("st"))).alias("st2"),
    )
    return (
        trips(spark, sf_dir)
        .join(choice, ["os", "ds"])
        .selectExpr("event_id", "id", "ot", "posexplode(if(st2 is not null and event_id%2=1, st2, st1)) (i, station)")
        .filter("(event_id+i+1)%3<>0")
        .selectExpr(
            "concat('ap', id) ap_id",
            "timestampadd(SECOND, 60+120*i, ot) ts",
            "station",
            "cast(event_id%4*10 as int) stay",
        )
    )


def observed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct station sequences travellers were seen on, with the quickest time as cost."""
    choice = paths(spark, sf_dir).selectExpr("os", "ds", "path_no", "st", "transfers")
    return (
        trips(spark, sf_dir)
        .withColumn("hour", F.hour("ot"))
        .selectExpr("os", "ds", "hour", "timestampdiff(SECOND, ot, dt) sec")
        .groupBy("os", "ds", "hour")
        .agg(F.min("sec").alias("sec"))
        .join(choice, ["os", "ds"])
        .selectExpr("os", "ds", "hour slot", "st", "transfers", "sec/60D + path_no cost")
    )


def stored(view: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The view written once, for jobs that read it several times, spread over the shuffle's partitions."""

    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = view(spark, sf_dir)
        return stage(rows.repartition(*rows.columns), view.__name__)

    return read
