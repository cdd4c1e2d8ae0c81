import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import frames, matching, space

KINDS = ["lattice", "even", "columns", "crowd"]


def places(rng, kind, n):
    columns = rng.integers(0, 12, n) * 20.0
    return {"lattice": np.stack([columns, rng.integers(0, 12, n) * 20.0]), "even": rng.random((2, n)) * 300, "columns": np.stack([columns, rng.random(n) * 300]), "crowd": rng.normal(0, 1, (2, n)) * 10.0 ** rng.integers(-3, 5, n)}[kind]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("few", [0, frames.FEW])
def test_as_all_pairs(kind, few, monkeypatch):
    monkeypatch.setattr(frames, "FEW", few)
    rng = np.random.default_rng(KINDS.index(kind))
    for trial in range(24):
        p, q, reach = places(rng, kind, rng.integers(1, 60)), places(rng, kind, rng.integers(1, 60)), [20.0, 60.0, 100.0, 200.0][trial % 4]
        n, m = p.shape[1], q.shape[1]
        gap = [np.abs(a[:, None] - b) for a, b in zip(q, p, strict=True)]
        d = np.where(gap[0] ** 2 + gap[1] ** 2 <= reach * reach, np.sqrt(gap[0] ** 2 + gap[1] ** 2), np.inf)
        rank = rng.permutation(n)
        at, away = frames.nearest(q, p, rank, reach)
        assert [(r if i >= 0 else -1, x) for i, r, x in zip(at, rank[at], away, strict=True)] == [min((x, r) for x, r in zip(row, rank, strict=True))[::-1] if row.min() < np.inf else (-1, np.inf) for row in d]
        value, own = rng.normal(size=(3, n)), [np.abs(a[:, None] - a) for a in p]
        for cube, near in ((True, (own[0] <= reach) & (own[1] <= reach)), (False, own[0] ** 2 + own[1] ** 2 <= reach * reach)):
            assert np.allclose(frames.sums_around(p, value, reach, cube).astype(float), value @ near.T, atol=1e-11)
        id_q, id_p = rng.integers(0, m, m), rng.integers(0, n, n)
        i, j, x = frames.greedy(q, p, id_q, id_p, reach)
        used, want = (set(), set()), []
        for e in sorted((d[a, b], id_q[a], id_p[b]) for a in range(m) for b in range(n) if d[a, b] < np.inf):
            if e[1] not in used[0] and e[2] not in used[1]:
                used[0].add(e[1])
                used[1].add(e[2])
                want.append(e)
        assert sorted(zip(x, id_q[i], id_p[j], strict=True)) == sorted(want)
        i, j, x = frames.in_order(q, p, np.arange(m), np.arange(n), frames.assigned(q, p, reach))
        edges = np.nonzero(d < np.inf)
        best = d[edges][matching.optimal(*edges, d[edges])] if len(edges[0]) else np.zeros(0)
        assert len(i) == len(set(i)) == len(set(j)) == len(best) and np.array_equal(d[i, j], x) and x.sum() == pytest.approx(best.sum(), rel=1e-9)


def rows(spark, n):
    return spark.range(n).select(F.lit("e").alias("experiment"), (F.col("id") % 3).cast("int").alias("time_index"), F.col("id").alias("parent"), (F.rand(1) * 500).alias("x_pos"), (F.rand(2) * 500).alias("y_pos"), F.rand(3).alias("v_x_pos"), F.rand(4).alias("v_y_pos"))


def test_no_pair_of_a_frame_is_a_row(spark):
    df = rows(spark, 300)
    objects = df.select("experiment", "time_index", F.col("parent").alias("id"), "x_pos", "y_pos")
    by = ["experiment", "time_index"]
    for out in (space.collectivity(df), space.nearest_within(objects, df, 50.0, by, "id", "parent"), space.greedy_match(objects, objects, 50.0, by)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "explode" not in plan
        assert out.count() > 0
    one_side = space.greedy_match(objects, objects.where("time_index > 0"), 50.0, by)  # frames without places on the other side
    assert one_side.where("time_index = 0").count() == 0 and one_side.where("time_index = 1").count() == 100


def test_collectivity_of_odd_rows(spark):
    """Repeated rows of a track, rows without place, without speed and without track, against all pairs."""
    spots = [(1, 0.0, 0.0, 1.0, 0.0), (2, 1.0, 0.0, 0.0, 2.0), (2, 2.0, 0.0, 1.0, 1.0), (3, 5.0, 5.0, 0.0, 0.0), (4, None, 0.0, 1.0, 0.0), (5, 150.0, 150.0, -1.0, 0.0), (6, 1.0, 1.0, None, 1.0), (None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame([("e", 0, *x) for x in spots], "experiment string, time_index int, parent long, x_pos double, y_pos double, v_x_pos double, v_y_pos double")
    got = sorted((r.parent, r.n_neighbours, round(r.collectivity, 9)) for r in space.collectivity(df).collect() if r.parent is not None)
    cosine = lambda a, b: (a[3] * b[3] + a[4] * b[4]) / (np.hypot(a[3], a[4]) * np.hypot(b[3], b[4]))
    ok = [x for x in spots if None not in x]
    want = []
    for a in (x for x in spots if None not in (x[0], x[3])):
        found = [cosine(o, b) for o in ok if o[0] == a[0] for b in ok if b[0] != a[0] and np.hypot(o[3], o[4]) * np.hypot(b[3], b[4]) > 0 and np.hypot(o[1] - b[1], o[2] - b[2]) <= 200]
        want.append((a[0], len(found), round(sum(found) / len(found), 9) if found else 0.0))
    assert got == sorted(want)


def test_tracks_at_one_place_are_assigned_by_id(spark):
    df = spark.createDataFrame([("e", p + 10 * c, float(p * p), float(p % 3)) for c in range(5) for p in range(8)], "experiment string, parent long, x_pos double, y_pos double").repartition(3)
    far = df.withColumns({"x_pos": F.col("x_pos") + 25, "y_pos": F.col("y_pos") - 60})
    assert all(r.a == r.b for r in space.assign_tracks(df, far, 400.0, ["experiment"]).collect())
