import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import matching as m
from trackloom.operators import space


def best(edges):
    """(pairs, least total) by trying every matching."""
    edges = sorted({(a, b): d for a, b, d in sorted(edges, key=lambda e: -e[2])}.items())

    def walk(i, used_a, used_b):
        if i == len(edges):
            return (0, 0.0)
        (a, b), d = edges[i]
        out = walk(i + 1, used_a, used_b)
        if a not in used_a and b not in used_b:
            n, t = walk(i + 1, used_a | {a}, used_b | {b})
            out = max(out, (n + 1, t + d), key=lambda x: (x[0], -x[1]))
        return out

    return walk(0, frozenset(), frozenset())


def random_edges(rng, n_a, n_b, share):
    return [(a, f"b{b}", round(rng.random() * 10, 3)) for a, b in itertools.product(range(n_a), range(n_b)) if rng.random() < share]


def numbers(edges):
    a, b, d = zip(*edges, strict=True)
    return np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1], np.array(d)


def test_optimal_equals_every_matching_tried():
    rng = random.Random(4)
    for _ in range(150):
        edges = random_edges(rng, rng.randint(1, 4), rng.randint(1, 4), rng.choice([0.4, 0.7, 1.0])) or [(0, "b0", 1.0)]
        chosen = [edges[i] for i in m.optimal(*numbers(edges))]
        n, total = best(edges)
        assert len(chosen) == n and abs(sum(d for *_, d in chosen) - total) < 1e-9
        assert len({a for a, *_ in chosen}) == len({b for _, b, _ in chosen}) == n


def test_more_pairs_come_before_less_distance():
    edges = [(0, "x", 1.0), (0, "y", 50.0), (1, "x", 50.0)]
    assert sorted(edges[i] for i in m.optimal(*numbers(edges))) == [(0, "y", 50.0), (1, "x", 50.0)]
    assert [edges[i] for i in m.greedy(*numbers(edges))] == [(0, "x", 1.0)]


def test_groups_are_matched_apart(spark):
    rng = random.Random(5)
    groups = {g: random_edges(rng, 4, 4, 0.8) for g in "pqr"}
    groups["q"] += groups["q"][:3]  # repeated edges
    df = spark.createDataFrame([(g, *e) for g, x in groups.items() for e in x], "g string, a long, b string, distance double")
    rows = m.optimal_match(df, ["g"]).collect()
    for g, edges in groups.items():
        mine = [r for r in rows if r.g == g]
        n, total = best(edges)
        assert len(mine) == n and abs(sum(r.distance for r in mine) - total) < 1e-9
    assert m.optimal_match(df.limit(0), ["g"]).count() == 0


def test_auction_over_all_tasks_is_as_good(spark):
    """The same edges with no unit small enough for a task."""
    edges = random_edges(random.Random(6), 3, 3, 0.8) + [(10, "z", 3.0)]
    df = spark.createDataFrame(edges, "a long, b string, distance double").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rows = m.optimal_match(df, [], most_cells=0, epsilon=0.2).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    n, total = best(edges)
    assert len(rows) == n == len({r.a for r in rows}) == len({r.b for r in rows})
    assert total - 1e-9 <= sum(r.distance for r in rows) <= total + 0.2 * 8
    assert {(r.a, r.b, r.distance) for r in rows} <= set(edges)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1_000), (4, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in m.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 1_000: 7} | {100 + i: 100 for i in range(41)}


@pytest.mark.parametrize("most_cells", [m.CELLS, 6, 0])
def test_greedy_in_tasks_and_in_rounds(spark, most_cells):
    rng = random.Random(8)
    rows = [(t, i, round(rng.random() * 60, 2), round(rng.random() * 60, 2)) for t in range(2) for i in range(14)]
    a = spark.createDataFrame(rows, "t int, id long, x_pos double, y_pos double").coalesce(2)
    b = a.withColumns({"id": F.col("id") + 100, "x_pos": F.col("x_pos") + 3})
    got = {(r.t, r.a, r.b) for r in space.greedy_match(a, b, 12.0, ["t"], most_cells=most_cells).collect()}
    want = set()
    for t in range(2):
        mine = [r for r in rows if r[0] == t]
        pairs = sorted((((p[2] - q[2] - 3) ** 2 + (p[3] - q[3]) ** 2) ** 0.5, p[1], q[1] + 100) for p in mine for q in mine)
        used = set()
        for d, i, j in pairs:
            if d <= 12 and not {i, j} & used:
                used |= {i, j}
                want.add((t, i, j))
    assert got == want
