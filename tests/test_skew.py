"""Joins whose keys are common on the left, against plain joins."""

import pytest
from pyspark.sql import functions as F

from rankloom.operators import skew


@pytest.fixture
def plain_shuffles(spark):
    """Joins by shuffle alone, so that tasks show how rows were dealt."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(before, ("false", "-1", "8")):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, plain_shuffles, how):
    left = spark.range(10_000).select("id", F.when(F.col("id") % 10 > 0, 1).when(F.col("id") % 50 > 0, F.col("id")).alias("k"), F.lit("x").alias("j"))
    right = spark.createDataFrame([(1, "x", "a"), (1, "x", "b"), (1, "y", "c"), (20, "x", "d"), (None, "x", "e")], "k long, j string, v string")
    got = skew.spread_join(left, right, ["k", "j"], how, least=100)
    want = left.join(right, ["k", "j"], how)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == 8 and max(tasks) < 2 * sum(tasks) / len(tasks)


def test_spread_join_refuses_other_joins(spark):
    with pytest.raises(ValueError):
        skew.spread_join(spark.range(1), spark.range(1), ["id"], "full")
