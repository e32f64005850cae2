"""Destination baselines and their accuracy.

A baseline ranks all stations by a feature value, the higher code first among equal values,
zeros included. The target's rank alone decides every k at once, so no vector is built; samples that
come as vectors (from text) are ranked on their vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railflow.operators.features import KEY


def target_ranks(samples: DataFrame, cells: DataFrame, n_stations: int) -> DataFrame:
    """Rank of each sample's target by ``value``; stations without a cell have value 0."""
    kept = cells.filter(F.col("value") > 0).select(*KEY, "station", "value")
    marked = samples.select(*KEY, "target").join(kept, list(KEY), "left")
    w = Window.partitionBy(*KEY)  # at most one row per station
    mine = F.coalesce(F.max(F.when(F.col("station") == F.col("target"), F.col("value"))).over(w), F.lit(0.0))

    def count(rule: Column) -> Column:
        return F.count(F.when(rule, True))

    beats = (F.col("value") > F.col("mine")) | ((F.col("value") == F.col("mine")) & (F.col("station") > F.col("target")))
    per_sample = marked.withColumn("mine", mine).groupBy(*KEY, "target", "mine").agg(
        count(beats).alias("ahead"), count(F.col("station") > F.col("target")).alias("higher")
    )
    outside = F.raise_error(F.lit(f"a target code is outside 0..{n_stations - 1}")).cast("bigint")
    # a target without a value also stands behind the higher codes that have none
    zeros = F.when(F.col("mine") > 0, F.lit(0)).otherwise(F.lit(n_stations - 1) - F.col("target") - F.col("higher"))
    rank = F.when(F.col("target").between(0, n_stations - 1), F.col("ahead") + zeros + 1).otherwise(outside)
    return per_sample.select(*KEY, "target", rank.alias("rank"))


def vector_rank(vector: Column, target: Column) -> Column:
    """Place of the entry ``target`` when a dense vector is ranked, the higher index first among equal values; one pass
    without sorting. A target outside the vector fails."""
    mine = F.get(vector, target)
    beats = F.filter(vector, lambda v, i: (v > mine) | ((v == mine) & (i > target)))
    outside = F.raise_error(F.concat(F.lit("a target code is outside 0.."), (F.size(vector) - 1).cast("string"))).cast("bigint")
    return F.when((target >= 0) & (target < F.size(vector)), F.size(beats).cast("bigint") + 1).otherwise(outside)


def vector_top(vector: Column, k: int) -> Column:
    """Indices of the ``k`` greatest entries of a dense vector, the higher index first among equal values."""
    ranked = F.sort_array(F.transform(vector, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), asc=False)
    return F.transform(F.slice(ranked, 1, k), lambda e: e["i"])


def markov_vector(period: Column, group: Column) -> Column:
    """The vector that the Markov baseline ranks: the traveller's own counts of the period, or the group shares where there are none."""
    return F.when(F.exists(period, lambda v: v != 0), period).otherwise(group)


def top_stations(cells: DataFrame, k: int) -> DataFrame:
    """The k stations with the highest positive values per sample; ties to the higher code."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("value"), F.desc("station"))
    return cells.filter(F.col("value") > 0).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def origin_ranks(shares: DataFrame, n_stations: int) -> DataFrame:
    """Rank of every target by the group share of its origin: one row per station pair."""
    targets = F.explode(F.sequence(F.lit(0), F.lit(n_stations - 1))).alias("target")
    grid = shares.select("os").distinct().select("os", targets)
    listed = grid.join(shares.select("os", F.col("ds").alias("target"), "ratio"), ["os", "target"], "left")
    w = Window.partitionBy("os").orderBy(F.desc(F.coalesce("ratio", F.lit(0.0))), F.desc("target"))
    return listed.select("os", "target", F.row_number().over(w).cast("bigint").alias("rank"))


def markov_ranks(samples: DataFrame, period: DataFrame, by_origin: DataFrame, n_stations: int) -> DataFrame:
    """Ranks by the traveller's own counts of the period; where there are none, by the group shares.

    The group ranking depends on origin and target only, so it is looked up, not spread per sample.
    """
    known = period.select(*KEY).distinct()
    own = target_ranks(samples.join(known, list(KEY), "left_semi"), period, n_stations)
    rest = samples.join(known, list(KEY), "left_anti").join(by_origin, ["os", "target"])
    return own.unionByName(rest.select(*KEY, "target", "rank"))


def hit_tally(ranks: DataFrame, k: int) -> DataFrame:
    """Samples whose target is (1) or is not (0) among the first k."""
    return ranks.groupBy((F.col("rank") <= k).cast("int").alias("flag")).agg(F.count(F.lit(1)).alias("cnt")).select(
        "flag", "cnt", F.lit(k).alias("k")
    )


def tallies(ranks: DataFrame, max_k: int) -> DataFrame:
    """``hit_tally`` of k = 1..max_k in one pass; at most one row per rank is expanded."""
    per_rank = ranks.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_rank.select("rank", "n", F.explode(F.sequence(F.lit(1), F.lit(max_k))).alias("k"))
        .groupBy("k")
        .agg(
            F.sum(F.when(F.col("rank") <= F.col("k"), F.col("n")).otherwise(F.lit(0))).alias("hits"),
            F.sum("n").alias("total"),
        )
    )


def accuracy_curve(ranks: DataFrame, max_k: int) -> DataFrame:
    """Share of hits for every k, to 3 decimals."""
    return tallies(ranks, max_k).withColumn("accuracy", F.round(F.col("hits") / F.col("total"), 3)).orderBy("k")


def merge_tallies(rows: DataFrame) -> DataFrame:
    """Accuracy per k from ``(flag, cnt, k)`` rows; a missing flag counts as zero."""
    hits = F.sum(F.when(F.col("flag") == 1, F.col("cnt")).otherwise(F.lit(0)))
    merged = rows.groupBy("k").agg(hits.alias("hits"), F.sum("cnt").alias("total"))
    return merged.select("k", F.round(F.try_divide(F.col("hits"), F.col("total")), 3).alias("accuracy")).orderBy("k")
