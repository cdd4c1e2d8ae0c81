import pytest
from pyspark.sql import functions as F

from trackloom.operators import statistics, tables, tracks


def test_correlations_between_rows_and_their_p(spark):
    rows = [("a", 1.0, 2.0, 3.0, 4.0), ("b", 2.0, 4.0, 6.0, 9.0), ("c", 4.0, 3.0, 2.0, 1.0), ("d", 1.0, None, 1.0, 1.0), ("e", None, None, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "name string, w double, x double, y double, z double")
    got = {(r.a, r.b): r for r in statistics.corr_tests(tables.corr_between(df, "name", ["w", "x", "y", "z"])).collect()}
    assert got["a", "b"].n == 4 and got["a", "b"]["corr"] == pytest.approx(11.5 / 133.75**0.5) and got["a", "b"].p == pytest.approx(0.005623, abs=1e-5)
    assert got["a", "c"]["corr"] == pytest.approx(-1.0) and got["a", "c"].p == pytest.approx(0.0, abs=1e-9)
    assert got["a", "e"].n == 2 and got["a", "e"].p is None and len(got) == 10
    assert got["c", "d"].n == 3 and got["a", "d"].n == 3 and got["d", "e"]["corr"] is None  # a row without variance
    ranks = {(r.a, r.b): r["corr"] for r in tables.corr_between(df, "name", ["w", "x", "y", "z"], "spearman").collect()}
    assert ranks["a", "b"] == pytest.approx(1.0) and ranks["b", "c"] == pytest.approx(-1.0)
    assert tables.corr_between(df.limit(0), "name", ["w", "x"]).count() == 0


def test_treatments_with_overrides(spark):
    ids = spark.createDataFrame([("AM001100425CHR2B02293TMETRNOCONNN0WH00",), ("odd",), (None,)], "experiment string")
    known = spark.createDataFrame([("odd", "X"), ("odd", "Y"), ("elsewhere", "Z")], "id string, treatment string")
    assert [r.treatment for r in tables.treatments(ids, "experiment", known).orderBy("experiment").collect()] == [None, "METR", "X"]
    assert tables.treatments(ids, "experiment", known, most=0).where("treatment = 'X'").count() == 1


def test_two_sided_speed_and_order(spark):
    rows = [("e", 1, t, 45.0, float(x), 0.0) for t, x in ((1, 0), (2, 3), (3, 9), (6, 10), (7, 20), (8, 22))]
    df = spark.createDataFrame(rows, "experiment string, parent long, time_index int, dt double, x_pos double, y_pos double").repartition(2)
    got = {r.time_index: r.two_sided_speed for r in tracks.mean_speed_two_sided(df).collect()}
    assert got == {1: None, 2: 9 / 1.5, 3: None, 6: None, 7: 12 / 1.5, 8: None}
    assert {r.time_index: r.two_sided_speed for r in tracks.mean_speed_two_sided(df, 3).collect()}[3] == 7 / 3.0
    more = df.unionByName(df.withColumn("experiment", F.lit("a")))
    assert [(r.experiment, r.time_index) for r in tracks.track_order(more).orderBy("position").collect()] == [(e, t) for e in "ae" for t in (1, 2, 3, 6, 7, 8)]


def test_ranks_of_values_that_are_not_the_same_when_computed_again(spark):
    """Means differ in the last digit from run to run, by the order in which parts arrive."""

    def shaken(batches):
        import random

        for pdf in batches:
            yield pdf.assign(**{c: pdf[c] + random.random() * 1e-9 for c in "wxyz"})

    rows = [(n, *[float((i * 7 + j * 3) % 11) for j in range(4)]) for i, n in enumerate("abc")]
    df = spark.createDataFrame(rows, "name string, w double, x double, y double, z double")
    df = df.mapInPandas(shaken, df.schema)
    assert [r.n for r in tables.corr_between(df, "name", ["w", "x", "y", "z"], "spearman").collect()] == [4, 4, 4]
    assert all(r["corr"] is not None for r in tables.corr_matrix(df, ["w", "x", "y", "z"], ["name"], "spearman").collect())
