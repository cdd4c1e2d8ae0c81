import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import clusters, grouped


def blobs(rng, at, n):
    return [(rng.gauss(x, 0.3), rng.gauss(y, 0.3)) for x, y in at for _ in range(n)]


@pytest.fixture(scope="module")
def groups(spark):
    rng = random.Random(1)
    rows = [("a", *p) for p in blobs(rng, [(0, 0), (9, 0), (0, 9)], 30)] + [("b", *p) for p in blobs(rng, [(50, 50), (50, 59), (70, 50)], 20)] + [("few", 1.0, 1.0), ("few", 2.0, 2.0), ("a", None, 1.0)]
    return spark.createDataFrame(rows, "g string, x double, y double").repartition(3)


def test_kmeans_of_groups_equals_single_fits(groups):
    labelled, models = grouped.kmeans(groups, ["x", "y"], ["g"], 3)
    together = {r.g: r for r in models.collect()}
    assert together.keys() == {"a", "b"} and labelled.count() == groups.count()
    for g in "ab":
        alone = grouped.kmeans(groups.where(F.col("g") == g), ["x", "y"], [], 3)[1].first()
        assert np.allclose(np.array(alone.centres), np.array(together[g].centres)) and alone.cost == pytest.approx(together[g].cost)
        sizes = [r["count"] for r in labelled.where((F.col("g") == g) & F.col("cluster").isNotNull()).groupBy("cluster").count().collect()]
        assert sizes == [30 if g == "a" else 20] * 3
        totals = [sum(c) for c in together[g].centres]
        assert totals == sorted(totals)
    assert labelled.where("g = 'few' or x is null").select("cluster").distinct().collect()[0][0] is None


def test_components_equal_numpy(groups):
    scores, models = grouped.components(groups, ["x", "y"], ["g"], 2)
    for m in models.collect():
        x = np.array([(r.x, r.y) for r in groups.where((F.col("g") == m.g) & F.col("x").isNotNull()).collect()])
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        values, vectors = np.linalg.eigh(z.T @ z / len(z))
        assert np.allclose(m.shares, values[::-1] / values.sum())
        assert np.allclose(np.abs(np.array(m.loadings).T), np.abs(vectors[:, ::-1]), atol=1e-6)
        got = np.array(sorted((r.pc1, r.pc2) for r in scores.where(F.col("g") == m.g).collect()))
        assert np.allclose(got, np.array(sorted(map(tuple, z @ np.array(m.loadings).T))))


def silhouette(points, labels):
    """The definition, row by row."""
    out = []
    for i, p in enumerate(points):
        by = {}
        for j, q in enumerate(points):
            if i != j:
                by.setdefault(labels[j], []).append(math.dist(p, q))
        a = by.pop(labels[i], None)
        b = min(sum(v) / len(v) for v in by.values())
        out.append(0.0 if a is None else (b - sum(a) / len(a)) / max(sum(a) / len(a), b) if max(sum(a) / len(a), b) else 0.0)
    return sum(out) / len(out)


@pytest.mark.parametrize("block", [grouped.BLOCK, 7])
def test_silhouettes_equal_the_definition(spark, block):
    rng = random.Random(3)
    rows = [(g, rng.gauss(c, 1), rng.random(), c, rng.choice([0, 1, 2, 3]), 0) for g in "pq" for c in (0, 4) for _ in range(12)] + [("p", 50.0, 50.0, 7, 1, 0), ("p", 0.5, 0.5, 0, 1, 0), ("p", 0.5, 0.5, 0, 1, 0), ("one", 1.0, 1.0, 0, 0, 0), ("p", None, 1.0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, good int, rand int, same int").repartition(3)
    got = {(r.g, r.labelling): (r.n, r.silhouette) for r in grouped.silhouettes(df, ["x", "y"], ["good", "rand", "same"], ["g"], block).collect()}
    assert got.keys() == {(g, m) for g in "pq" for m in ("good", "rand")}
    for (g, m), (n, s) in got.items():
        mine = [r for r in rows if r[0] == g and r[1] is not None]
        assert n == len(mine) and s == pytest.approx(silhouette([r[1:3] for r in mine], [r[3 if m == "good" else 4] for r in mine]))


def test_sweep_finds_the_blobs(groups):
    got = {(r.g, r.k): r.silhouette for r in clusters.euclidean_sweep(groups, ["x", "y"], range(2, 5), ["g"]).collect()}
    assert {g for g, _ in got} == {"a", "b"}
    assert all(got[g, 3] > 0.85 and got[g, 3] == max(got[g, k] for k in (2, 3, 4)) for g in "ab")


def test_group_cv(spark):
    """Groups stay whole, folds are alike in size, and what can be told apart is."""
    rng = random.Random(5)
    rows = [(f"g{i % 11}", c * 2 + rng.gauss(0, 0.4), rng.random(), 3.0, f"k{c}") for i, c in enumerate(rng.choices([0, 1, 2], [6, 3, 1], k=600))]
    df = spark.createDataFrame(rows, "g string, x double, noise double, still double, c string").withColumn("label", F.substring("c", 2, 1).cast("int")).repartition(3)
    folds = clusters._balanced_folds(df, "g", 4).groupBy("g").agg(F.countDistinct("fold").alias("n"), F.first("fold").alias("fold"), F.count("*").alias("rows")).collect()
    assert all(r.n == 1 for r in folds) and len({r.fold for r in folds}) == 4 and len(folds) == 11
    got = clusters.group_cv(df.withColumn("l", F.col("label")), ["x", "noise", "still"], "l", "g", 4, reg=0.01, steps=30).collect()
    assert len(got) == 4 and sum(r.n for r in got) == 600 and min(r.balanced_accuracy for r in got) > 0.9


def test_all_numbers_of_clusters_together(groups):
    together, _ = grouped.kmeans_sweep(groups, ["x", "y"], ["g"], {"two": 2, "four": 4})
    cells = ["g", "x", "y"]
    for k, label in ((2, "two"), (4, "four")):
        alone = grouped.kmeans(groups, ["x", "y"], ["g"], k)[0]
        assert sorted(map(str, together.select(*cells, label).collect())) == sorted(map(str, alone.select(*cells, F.col("cluster").alias(label)).collect()))
