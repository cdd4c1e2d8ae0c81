import math
import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import space as s


def nearest(rows):
    """Each row against every other, as the definition has it."""
    out = {}
    for e, t, p, *at, ok in rows:
        others = [math.dist(at, o[3:-1]) for o in rows if None not in at and o[0] == e and o[1] == t and o[2] != p and o[-1] is not None and None not in o[3:-1]]
        out.setdefault((e, t, p, *at), set()).add(round(min(others), 9) if others and ok is not None and None not in at else None)
    return out


def check(spark, rows, axes):
    names = ", ".join(f"{a} double" for a in axes)
    df = spark.createDataFrame(rows, f"experiment string, time_index int, parent long, {names}, speed double").repartition(3)
    got = {}
    for r in s.min_distance(df, axes).collect():
        got.setdefault((r.experiment, r.time_index, r.parent, *[r[a] for a in axes]), set()).add(None if r.min_distance is None else round(r.min_distance, 9))
    assert got == nearest(rows)


@pytest.mark.parametrize("axes", [("x_pos", "y_pos"), ("x_pos", "y_pos", "z_pos")])
def test_min_distance_equals_all_pairs(spark, axes):
    rng = random.Random(len(axes))
    place = lambda spread, at: [round(at + rng.gauss(0, spread), 4) for _ in axes]
    rows = [("even", t, p, *[rng.uniform(-100, 900) for _ in axes], 1.0) for t in range(2) for p in range(120)]
    rows += [("dense", 0, p, *place(1e-3, 5.0), 1.0) for p in range(80)] + [("dense", 0, 1_000 + p, *place(1e5, 0.0), 1.0) for p in range(8)]  # a crowd and far outliers
    rows += [("same", 0, p, *[1.0 for _ in axes], 1.0) for p in range(30)] + [("same", 0, 99, *[2.0 for _ in axes], 1.0)]
    rows += [("line", 0, p, float(p * p), *[0.0 for _ in axes[1:]], 1.0) for p in range(20)]
    rows += [("alone", 0, 1, *[0.0 for _ in axes], 1.0), ("nulls", 0, 1, *[0.0 for _ in axes], None), ("nulls", 0, 2, None, *[0.0 for _ in axes[1:]], 1.0), ("nulls", 0, 3, *[1.0 for _ in axes], 1.0), ("nulls", 0, 4, *[5.0 for _ in axes], 1.0)]
    # one track in several places of a frame, another far away
    rows += [("several", 0, 1, *[float(i) for _ in axes], 1.0) for i in range(6)] + [("several", 0, 2, *[700.0 for _ in axes], 1.0)]
    check(spark, rows, axes)


def test_min_distance_of_nothing(spark):
    df = spark.createDataFrame([], "experiment string, time_index int, parent long, x_pos double, y_pos double, speed double")
    assert s.min_distance(df).count() == 0
    assert s.min_distance(df.unionByName(spark.createDataFrame([("e", 0, 1, 0.0, 0.0, 1.0)], df.schema))).first().min_distance is None


def test_min_distance_plan(spark):
    """A few exchanges in all, however wide a frame is."""
    df = spark.range(500).select(F.lit("e").alias("experiment"), F.lit(0).alias("time_index"), F.col("id").alias("parent"), (F.rand(1) * 1e6).alias("x_pos"), F.rand(2).alias("y_pos"), F.lit(1.0).alias("speed"))
    plan = s.min_distance(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 20 and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_msd_of_long_sparse_and_odd_tracks(spark):
    """Tracks of several blocks, with gaps, repeated frames and missing positions, against all pairs of rows; no pair is a row of a join."""
    rng = random.Random(11)
    rows = [("e", 1, t, float(t % 7), rng.random()) for t in range(1_300) if t % 3]
    rows += [("e", 2, t, rng.random(), None if t % 5 == 0 else rng.random()) for t in [0, 1, 2, 2, 3, 5_000, 5_001, 9_000, 9_002]] + [("e", 3, 4, 1.0, 1.0), ("f", 3, -600, 1.0, 1.0), ("f", 3, -1, 1.0, 3.0), ("f", 3, 0, 2.0, 3.0), ("f", 4, None, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "experiment string, parent long, time_index int, x_pos double, y_pos double").repartition(3)
    tracks = {}
    for e, p, t, x, y in rows:
        if t is not None:
            tracks.setdefault((e, p), []).append((t, x, y))
    for most in (None, 4, 700):
        want = {}
        for key, spots in tracks.items():
            limit = math.ceil((max(t for t, *_ in spots) - min(t for t, *_ in spots)) / 2) if most is None else most
            for a in spots:
                for b in spots:
                    if 0 < b[0] - a[0] <= limit:
                        want.setdefault((*key, b[0] - a[0]), []).append(None if None in (a[2], b[2]) else (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2)
        got = {(r.experiment, r.parent, r.tau): (r.n_pairs, r.msd) for r in s.msd_pairs(df, most).collect()}
        assert got.keys() == want.keys()
        for k, d in want.items():
            known = [x for x in d if x is not None]
            assert got[k][0] == len(d) and (got[k][1] is None if not known else got[k][1] == pytest.approx(sum(known) / len(known), rel=1e-12)), k
    assert s.msd_pairs(df, None)._jdf.queryExecution().optimizedPlan().toString().count("sequence(") == 0  # rows are not copied for each lag
    zone = {(r.experiment, r.zone): r.n_tracks for r in s.msd_by_zone(df, None).where("tau = 1").collect()}
    assert sum(zone.values()) == 3
