"""Hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from trackloom.functions import columns as c
from trackloom.operators import space as s
from trackloom.operators import tracks as t

SCHEMA = "experiment string, parent long, time_index int, dt double, x_pos double, y_pos double"


def track(spark, rows, dt=60.0):
    return spark.createDataFrame([("e", p, i, dt, float(x), float(y)) for p, i, x, y in rows], SCHEMA)


@pytest.fixture(scope="module")
def line(spark):
    return track(spark, [(1, i, 3 * i, 4 * i) for i in range(1, 10)])


def test_straight_line(line):
    rows = t.backward_kinematics(line).orderBy("time_index").collect()
    assert rows[0].speed is None and [r.speed for r in rows[1:]] == [5.0] * 8
    assert rows[1].speed_change is None and [r.speed_change for r in rows[2:]] == [0.0] * 7
    assert {(r.tau, r.msd) for r in s.msd_by_track(line, 10).collect()} == {(k, 25.0 * k * k) for k in range(1, 5)}
    m = t.track_motility(t.backward_kinematics(line)).first()
    assert m.confinement_ratio == pytest.approx(1.0) and m.net_displacement == pytest.approx(40.0)
    taus, squares = [1, 2, 3, 4], [25, 100, 225, 400]
    mt, ms = 2.5, 187.5
    r2 = sum((a - mt) * (b - ms) for a, b in zip(taus, squares, strict=True)) ** 2 / sum((a - mt) ** 2 for a in taus) / sum((b - ms) ** 2 for b in squares)
    fit = s.msd_models(s.msd_by_track(line, 10)).first()
    assert fit.linearity == pytest.approx(r2)
    assert (fit.directed_d, fit.directed_v, fit.power_alpha) == (pytest.approx(0, abs=1e-6), pytest.approx(5.0), pytest.approx(2.0))


def test_gap(spark):
    df = track(spark, [(1, i, i, 0) for i in (1, 2, 4, 5)])
    speeds = {r.time_index: r.speed for r in t.backward_kinematics(df).collect()}
    assert speeds == {1: None, 2: 1.0, 4: None, 5: 1.0}
    assert {(r.tau, r.n_pairs) for r in s.msd_pairs(df, 3).collect()} == {(1, 2), (2, 1), (3, 2)}
    assert {r.time_index for r in t.valid_tracks(df, 4, 1).collect()} == set()
    assert t.densify(df).count() == 5


def test_single_frame(spark):
    df = track(spark, [(1, 3, 5, 5)]).withColumn("label", F.lit("a"))
    assert t.backward_kinematics(df).first().speed is None and t.central_kinematics(df).first().central_speed is None
    assert t.transition_rate(df, "label").first().transition_rate == 0.0
    assert t.ar1(df).first().ar1 is None


def test_angles_are_not_wrapped(spark):
    a, b = math.radians(170), math.radians(-170)
    df = track(spark, [(1, 1, 0, 0), (1, 2, math.cos(a), math.sin(a)), (1, 3, math.cos(a) + math.cos(b), math.sin(a) + math.sin(b))])
    assert t.angles(df).orderBy("time_index").collect()[2].angle_change == pytest.approx(math.radians(-340))


def test_neighbours(spark):
    rows = [(p, i, x + (i - 1) * dx, 0) for p, x, dx in ((1, 0, 1), (2, 199, 1), (3, 400, -1)) for i in (1, 2)]
    df = track(spark, rows)
    near = {(r.parent, r.time_index): r.min_distance for r in s.min_distance(df, having=None).collect()}
    assert [near[p, 1] for p in (1, 2, 3)] == [199.0, 199.0, 201.0]
    assert s.min_distance(track(spark, [(1, 1, 0, 0)]), having=None).first().min_distance is None
    coll = {r.parent: r.collectivity for r in s.collectivity(t.backward_kinematics(df)).collect()}
    assert coll[1] == pytest.approx(1.0) and coll[3] == pytest.approx(-1.0)
    apart = track(spark, [(p, i, x, i) for p, x in ((1, 0), (2, 199), (3, 401)) for i in (1, 2)])
    assert {r.parent: r.collectivity for r in s.collectivity(t.backward_kinematics(apart)).collect()} == {1: 1.0, 2: 1.0, 3: 0.0}


def test_cube_and_radius(spark):
    df = t.backward_kinematics(track(spark, [(1, 1, 0, 0), (1, 2, 1, 0), (2, 1, 150, 150), (2, 2, 151, 150)]))
    assert {r.n_neighbours for r in s.collectivity(df).collect()} == {0}
    assert {r.n_neighbours for r in s.collectivity(df, shape="cube").collect()} == {1}


def test_wave(spark):
    speeds = [1, 1, 5, 6, 5, 1, 1]
    df = spark.createDataFrame([("e", 1, i, float(v)) for i, v in enumerate(speeds, 1)], "experiment string, parent long, time_index int, speed double")
    w = t.speed_wave(df).first()
    assert (w.wave_time, w.wave_peak, w.wave_left, w.wave_right, w.fwhm) == (4.0, 6.0, 2.0, 6.0, 4.0)
    short = t.speed_wave(df.where("time_index < 3")).first()
    assert (short.wave_peak, short.fwhm) == (0.0, 0.0)
    share = t.wave_share(t.speed_wave(df), "experiment").first()
    assert share.n_full == 1 and share.pct_full == 100.0


def test_interpolation(spark):
    values = [None, 1.0, None, 3.0, None]
    df = spark.createDataFrame([("e", 1, i, v) for i, v in enumerate(values)], "experiment string, parent long, time_index int, v double")
    get = lambda d: [r.v for r in d.orderBy("time_index").collect()]
    assert get(t.interpolate(df, ["v"], inside_only=True)) == [None, 1.0, 2.0, 3.0, None]
    assert get(t.interpolate(df, ["v"])) == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_greedy(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0)], "id long, x_pos double, y_pos double")
    b = spark.createDataFrame([(7, 4.0, 0.0), (8, 9.0, 0.0)], "id long, x_pos double, y_pos double")
    assert {(r.a, r.b, r.distance) for r in s.greedy_match(a, b, 20.0, []).collect()} == {(2, 8, 1.0), (1, 7, 4.0)}
    assert s.greedy_match(a, b, 0.5, []).count() == 0


def test_greedy_equals_a_global_pass(spark):
    import random

    rng = random.Random(1)
    a = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(80)]
    b = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(70)]
    schema = "id long, x_pos double, y_pos double"
    got = {(r.a, r.b) for r in s.greedy_match(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 15.0, []).collect()}
    want, used_a, used_b = set(), set(), set()
    for d, i, j in sorted((math.dist(x[1:], y[1:]), x[0], y[0]) for x in a for y in b):
        if d <= 15 and i not in used_a and j not in used_b:
            want.add((i, j))
            used_a.add(i)
            used_b.add(j)
    assert got == want


def test_bins_and_ids(spark):
    df = spark.createDataFrame([(-0.524,), (0.524,), (0.525,), (None,)], "v double")
    assert [r[0] for r in df.select(c.dose_category("v")).collect()] == ["Neg", "Pos", "High", None]
    ids = spark.createDataFrame([("B2",), ("B12",), ("xx",)], "w string")
    assert [r[0] for r in ids.select(c.padded_well("w")).collect()] == ["B02", "B12", "xx"]


def test_partitions_do_not_matter(spark, line):
    counts = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        counts.append(sorted(map(tuple, t.track_kinematics(line).collect())))
    assert counts[0] == counts[1]
