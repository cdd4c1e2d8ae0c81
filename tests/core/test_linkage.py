import itertools
import math
import random

import pytest

from trackloom.operators import linkage


def one_by_one(points):
    """Ward's algorithm as it is defined: the two clusters whose union adds least to the sum of squares, again and again."""
    clusters = {i: [i] for i in points}
    centre = lambda ids: [sum(points[i][k] for i in ids) / len(ids) for k in range(len(next(iter(points.values()))))]
    out = []
    while len(clusters) > 1:
        def height(pair):
            x, y = (clusters[p] for p in pair)
            return math.sqrt(2 * len(x) * len(y) / (len(x) + len(y)) * sum((a - b) ** 2 for a, b in zip(centre(x), centre(y), strict=True)))

        a, b = min(itertools.combinations(sorted(clusters), 2), key=height)
        h = height((a, b))
        clusters[a] = clusters[a] + clusters.pop(b)
        out.append((a, b, round(h, 8), len(clusters[a])))
    return out


@pytest.mark.parametrize(("n", "most"), [(40, linkage.BLOCK), (40, 7), (2, 1), (1, 8)])
def test_same_merges_as_one_by_one(spark, n, most):
    rng = random.Random(n + most)
    points = {f"c{i:02d}": [rng.gauss(i % 4 * 3, 1), rng.gauss(i % 3, 1), rng.random()] for i in range(n)}
    df = spark.createDataFrame([(k, *v) for k, v in points.items()] + [("none", None, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], "name string, x double, y double, z double").repartition(3)
    merges = linkage.ward(df, ["x", "y", "z"], "name", most).orderBy("step").collect()
    assert [(r.a, r.b, round(r.height, 8), r["size"]) for r in merges] == one_by_one(points)
    assert [r.step for r in merges] == list(range(1, n))


def test_branches_and_equal_rows(spark):
    points = [(i, float(i // 5 * 100), float(i % 5)) for i in range(15)] + [(100 + i, 0.0, 0.0) for i in range(3)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    for most in (linkage.BLOCK, 4):
        merges = linkage.ward(df, ["x", "y"], "id", most).cache()
        got = {r.id: r.branch for r in linkage.branches(merges, df, "id", 3).collect()}
        assert got == {i: i // 5 * 5 for i in range(15)} | {100: 0, 101: 0, 102: 0}
        assert len({r.branch for r in linkage.branches(merges, df, "id", 18).collect()}) == 18
