import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import order


@pytest.fixture(params=["1", "5"])
def parts(spark, request):
    """The same with one part for all rows and with several for each group."""
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield int(request.param)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def rows():
    rng = random.Random(2)
    hot = [("hot", rng.choice([0.0, 0.0, 0.0, -1.5, rng.random(), 7.0])) for _ in range(900)]  # one group and one value hold most rows
    return hot + [("one", 3.0), ("null", None), (None, 4.0), (None, 5.0), ("two", -2.0), ("two", 1e300), ("hot", None), ("ties", 1.0), ("ties", 1.0), ("ties", 1.0)]


def test_quantiles(spark, parts):
    data = rows()
    df = spark.createDataFrame(data, "g string, v double").repartition(4)
    wanted = {"low": 0.0, "q1": 0.25, "m": 0.5, "q99": 0.99, "high": 1.0}
    got = {r.g: r for r in order.quantiles(df, "v", wanted, ["g"]).collect()}
    groups = {g for g, v in data if v is not None}
    assert got.keys() == groups
    for g in groups:
        values = [v for x, v in data if x == g and v is not None]
        for name, q in wanted.items():
            assert got[g][name] == pytest.approx(np.quantile(values, q), rel=1e-12)
    (whole,) = order.quantiles(df, "v", {"m": 0.3}).collect()
    assert whole.m == pytest.approx(np.quantile([v for _, v in data if v is not None], 0.3))
    assert order.quantiles(df.limit(0), "v", wanted, ["g"]).count() == 0
    beside = order.with_quantiles(df, "v", {"m": 0.5}, ["g"])
    assert beside.count() == len(data) and beside.where("g = 'null'").first().m is None


def test_ranks_and_sums(spark, parts):
    data = rows()
    df = spark.createDataFrame(data, "g string, v double").repartition(4)
    got = {(r.g, r.v): r["rank"] for r in order.value_ranks(df, "v", ["g"]).collect()}
    for g in {g for g, v in data if v is not None}:
        values = sorted(v for x, v in data if x == g and v is not None)
        for v in set(values):
            places = [i + 1 for i, x in enumerate(values) if x == v]
            assert got[g, v] == sum(places) / len(places)
    steps = spark.createDataFrame([("a", i, i * 10) for i in range(50)] + [("b", 7, 1)], "g string, i int, w int").repartition(3)
    have = {(r.g, r.i): (r.w_before, r.previous, r.following) for r in order.cumulative(steps, ["g"], ["i"], around="i", w="w").collect()}
    assert have == {("a", i): (sum(j * 10 for j in range(i)), i - 1 if i else None, i + 1 if i < 49 else None) for i in range(50)} | {("b", 7): (0, None, None)}
    assert [r.n_before for r in order.cumulative(steps.withColumn("one", F.lit(1)), [], ["g", "i"], n="one").orderBy("g", "i").collect()] == list(range(51))


def test_no_part_holds_a_group(spark):
    """A third of all rows share one group; its distinct values are spread over the parts."""
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("g"), F.rand(1).alias("v"))
        sizes = [r["count"] for r in order._parts(df, ["g"], ["v"]).groupBy("__part").count().collect()]
        assert len(sizes) == 6 and max(sizes) < 900
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
