"""Hot keys never change a result, fractional seconds included."""

import pytest
from pyspark.sql import functions as F

from railflow.functions.vectors import dense
from railflow.skew import hot_keys



def test_more_than_a_thousand_hot_keys(spark):
    rows = spark.range(6000).select((F.col("id") % 1500).alias("key"))
    spark.conf.set("railflow.skew.minRows", "2")
    try:
        assert len(hot_keys(rows, "key")) == 1500
    finally:
        spark.conf.unset("railflow.skew.minRows")


def test_dense_vectors_are_linear_and_checked(spark):
    size = 313 * 48
    rows = spark.range(4).select(
        F.transform(F.sequence(F.lit(0), F.lit(size - 1), F.lit(3)), lambda i: F.struct(i.alias("station"), (i * 2.0).alias("value"))).alias("e")
    )
    vec = rows.select(dense(F.col("e"), size).alias("v")).first()["v"]
    assert vec == [2.0 * i if i % 3 == 0 else 0.0 for i in range(size)]
    empty = spark.range(1).select(dense(F.lit(None), 3).alias("v")).first()["v"]
    assert empty == [0.0, 0.0, 0.0]
    with pytest.raises(Exception, match="outside"):
        rows.select(dense(F.col("e"), 5)).collect()
