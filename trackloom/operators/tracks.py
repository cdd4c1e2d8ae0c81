"""Tracks: which to keep, their kinematics, waves and summaries.

A track is all rows of one (experiment, parent), in the order of time_index. Every window here is partitioned by that key, so one shuffle
by it serves them all.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.columns import ratio
from trackloom.operators import order

KEY = ("experiment", "parent")
TIME = "time_index"


def over_track(key: Sequence[str] = KEY, time: str = TIME):
    return Window.partitionBy(*key).orderBy(time)


# ---- which tracks and rows stay ----------------------------------------------------------------------------------------------


def valid_tracks(df: DataFrame, min_frames: int = 25, max_gap: int = 5, key: Sequence[str] = KEY) -> DataFrame:
    """Rows of tracks with enough frames whose gaps are all small enough."""
    gaps = df.select(*key, TIME, (F.col(TIME) - F.lag(TIME).over(over_track(key))).alias("gap"))
    good = gaps.groupBy(*key).agg(F.count("*").alias("n"), F.coalesce(F.max("gap"), F.lit(0)).alias("gap")).where((F.col("n") >= min_frames) & (F.col("gap") <= max_gap))
    return df.join(good.select(*key), list(key), "left_semi")


def min_track_length(df: DataFrame, n: int, key: Sequence[str] = KEY, distinct_frames: bool = True) -> DataFrame:
    """Rows of tracks with at least n (distinct) frames."""
    length = F.countDistinct(TIME) if distinct_frames else F.count("*")
    return df.join(df.groupBy(*key).agg(length.alias("n")).where(F.col("n") >= n).select(*key), list(key), "left_semi")


def length_report(df: DataFrame, n: int, key: Sequence[str] = KEY) -> DataFrame:
    """Tracks and rows before, after and deleted by min_track_length."""
    tracks = df.groupBy(*key).agg(F.countDistinct(TIME).alias("frames"), F.count("*").alias("rows"))
    long = F.col("frames") >= n
    return tracks.agg(
        F.count("*").alias("tracks_before"), F.count_if(long).alias("tracks_after"), F.count_if(~long).alias("tracks_deleted"),
        F.sum("rows").alias("rows_before"), F.coalesce(F.sum(F.when(long, F.col("rows"))), F.lit(0)).alias("rows_after"),
    )


def dedup_time(df: DataFrame, tiebreak: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """One row for each track and time: the first by the tiebreak."""
    line = Window.partitionBy(*key, TIME).orderBy(*tiebreak)
    return df.withColumn("__n", F.row_number().over(line)).where("__n = 1").drop("__n")


def drop_report(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """reason, n and share: rows by the first stage whose condition (a value is missing) holds; 'kept' for none."""
    reason = reduce(lambda c, s: c.when(F.coalesce(s[1], F.lit(False)), s[0]), stages[1:], F.when(F.coalesce(stages[0][1], F.lit(False)), stages[0][0])).otherwise("kept")
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def sample_every(df: DataFrame, k: int, key: Sequence[str] = KEY) -> DataFrame:
    """Every k-th track in the order of its key, the first included."""
    ids = order.cumulative(df.select(*key, F.lit(1).alias("__one")).distinct(), [], key, place="__one")
    return df.join(ids.where(F.col("place_before") % k == 0).select(*key), list(key), "left_semi")


def sample_tracks(df: DataFrame, n: int, seed: int = 42, key: Sequence[str] = KEY) -> DataFrame:
    """n tracks chosen by a hash of their key."""
    ids = df.select(*key).distinct().orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)
    return df.join(ids, list(key), "left_semi")


def with_particles(df: DataFrame, particles: DataFrame, keep_unmatched: bool = True) -> DataFrame:
    """Per-frame object ids (frame, id) replaced by the track's id (particle); unmatched keep their own or go."""
    joined = df.join(particles.select("frame", "id", "particle"), ["frame", "id"], "left" if keep_unmatched else "inner")
    return joined.withColumn("id", F.coalesce("particle", "id")).drop("particle")


def drop_constant_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """df without features that have no two different values. One pass over the table."""
    seen = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in features]).first()
    return df.drop(*[c for c in features if not seen[c]])


def feature_coverage(df: DataFrame, features: Sequence[str], max_null: float = 0.02, min_cells: int = 200, key: Sequence[str] = KEY) -> DataFrame:
    """feature, null_share, n_cells and keep, for each feature."""
    stacked = df.select(*key, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])).alias("f")).select(*key, "f.*")
    each = stacked.groupBy("feature").agg(F.avg(F.col("value").isNull().cast("double")).alias("null_share"), F.countDistinct(F.when(F.col("value").isNotNull(), F.struct(*key))).alias("n_cells"))
    return each.withColumn("keep", (F.col("null_share") <= max_null) & (F.col("n_cells") >= min_cells))


def whole_tracks(df: DataFrame, features: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """Rows of tracks in which no feature is ever null."""
    gap = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in features])
    return df.join(df.where(gap).select(*key).distinct(), list(key), "left_anti")


def null_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature and n_null of each feature, from one pass."""
    counts = df.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c).isNull()).alias("n_null")) for c in features]).alias("f"))
    return counts.select(F.inline("f"))


# ---- gaps --------------------------------------------------------------------------------------------------------------------


def densify(df: DataFrame, key: Sequence[str] = KEY, dt_default: float = 45.0) -> DataFrame:
    """A row for every time between a track's first and last; dt is filled forward, backward and by default."""
    grid = df.groupBy(*key).agg(F.min(TIME).alias("a"), F.max(TIME).alias("b")).select(*key, F.explode(F.sequence("a", "b")).alias(TIME))
    full = grid.join(df, [*key, TIME], "left")
    if "dt" not in df.columns:
        return full
    w = over_track(key)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    return full.withColumn("dt", F.coalesce(F.last("dt", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("dt", True).over(ahead), F.lit(dt_default)))


def interpolate(df: DataFrame, features: Sequence[str], key: Sequence[str] = KEY, inside_only: bool = False) -> DataFrame:
    """Nulls filled linearly by row position between the neighbours that have values; outside by the nearest, unless inside_only."""
    w = over_track(key)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    numbered = df.withColumn("__n", F.row_number().over(w))
    out = {}
    for c in features:
        at = F.when(F.col(c).isNotNull(), F.col("__n"))
        n0, n1 = F.last(at, True).over(back), F.first(at, True).over(ahead)
        v0, v1 = F.last(c, True).over(back), F.first(c, True).over(ahead)
        line = F.when(n1 == n0, v0).otherwise(v0 + (v1 - v0) * (F.col("__n") - n0) / F.when(n1 != n0, n1 - n0))
        out[c] = line if inside_only else F.coalesce(line, v0, v1)
    return numbered.withColumns(out).drop("__n")


# ---- kinematics --------------------------------------------------------------------------------------------------------------


def backward_kinematics(df: DataFrame, axes: Sequence[str] = ("x_pos", "y_pos"), max_gap: int | None = 1, per_second: bool = False, key: Sequence[str] = KEY) -> DataFrame:
    """step (from the row before), v_axis, speed, a_axis, acceleration (norm) and speed_change (signed, of the speed) at each row.

    Only between rows whose gap is at most max_gap frames (None: any). Per hour, or per second for tables of the converter.
    """
    w = over_track(key)
    gap = F.col(TIME) - F.lag(TIME).over(w)
    hours = gap * F.col("dt") * (60 if per_second else 1 / 60)
    ok = (gap > 0) if max_gap is None else (gap > 0) & (gap <= max_gap)
    moves = {a: F.col(a) - F.lag(a).over(w) for a in axes}
    first = df.withColumns({"__hours": F.when(ok, hours), **{f"__d_{a}": F.when(ok, m) for a, m in moves.items()}})
    first = first.withColumns({"step": F.sqrt(sum((F.pow(f"__d_{a}", 2) for a in axes), F.lit(0.0))), **{f"v_{a}": F.col(f"__d_{a}") / F.col("__hours") for a in axes}})
    first = first.withColumn("speed", F.col("step") / F.col("__hours"))
    change = lambda c: (F.col(c) - F.lag(c).over(w)) / F.col("__hours")
    second = first.withColumns({"speed_change": change("speed"), **{f"a_{a}": change(f"v_{a}") for a in axes}})
    return second.withColumn("acceleration", F.sqrt(sum((F.pow(f"a_{a}", 2) for a in axes), F.lit(0.0)))).drop("__hours", *[f"__d_{a}" for a in axes])


def central_kinematics(df: DataFrame, axes: Sequence[str] = ("x_pos", "y_pos"), key: Sequence[str] = KEY) -> DataFrame:
    """cv_axis and central_speed between the rows before and after, per second; null at the track's ends. The acceleration is fixed at 0."""
    w = over_track(key)
    seconds = (F.lead(TIME).over(w) - F.lag(TIME).over(w)) * F.col("dt") * 60
    out = df.withColumns({f"cv_{a}": (F.lead(a).over(w) - F.lag(a).over(w)) / seconds for a in axes})
    return out.withColumns({"central_speed": F.sqrt(sum((F.pow(f"cv_{a}", 2) for a in axes), F.lit(0.0))), "central_acceleration": F.lit(0.0)})


def mean_speed_two_sided(df: DataFrame, max_gap: int = 1, axes: Sequence[str] = ("x_pos", "y_pos"), key: Sequence[str] = KEY) -> DataFrame:
    """two_sided_speed: distance from the row before to the row after, per hour between them; null at the ends and where one of the gaps is larger than max_gap."""
    w = over_track(key)
    back, ahead = F.col(TIME) - F.lag(TIME).over(w), F.lead(TIME).over(w) - F.col(TIME)
    hours = (back + ahead) * F.col("dt") / 60
    distance = F.sqrt(sum((F.pow(F.lead(a).over(w) - F.lag(a).over(w), 2) for a in axes), F.lit(0.0)))
    return df.withColumn("two_sided_speed", F.when((back <= max_gap) & (ahead <= max_gap), distance / hours))


def track_order(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """df with position: its place (from 1) when all rows are sorted by key and time. (key, time) must identify rows; no task holds them all."""
    return order.cumulative(df.withColumn("__one", F.lit(1).cast("long")), [], [*key, TIME], place="__one").withColumn("position", F.col("place_before") + 1).drop("__one", "place_before")


def angles(df: DataFrame, axes: Sequence[str] = ("x_pos", "y_pos"), max_gap: int = 1, key: Sequence[str] = KEY) -> DataFrame:
    """angle of each step (three for three axes) and its change from the step before, which is not wrapped."""
    w = over_track(key)
    gap = F.col(TIME) - F.lag(TIME).over(w)
    d = [F.when(gap <= max_gap, F.col(a) - F.lag(a).over(w)) for a in axes]
    if len(axes) == 2:
        out = df.withColumn("angle", F.atan2(d[1], d[0]))
        return out.withColumn("angle_change", F.col("angle") - F.lag("angle").over(w))
    moved = df.withColumns({f"__d{i}": x for i, x in enumerate(d)})
    names = {"angle_xy": ("__d1", "__d0"), "angle_xz": ("__d2", "__d0"), "angle_yz": ("__d2", "__d1")}
    moved = moved.withColumns({n: F.atan2(a, b) for n, (a, b) in names.items()}).drop("__d0", "__d1", "__d2")
    return moved.withColumns({f"{n}_change": F.col(n) - F.lag(n).over(w) for n in names})


def displacement2(df: DataFrame, axes: Sequence[str] = ("x_pos", "y_pos"), key: Sequence[str] = KEY) -> DataFrame:
    """displacement2 (squared distance from the track's first row) and step2 (from the row before)."""
    w = over_track(key)
    first = {a: F.first(a).over(w.rowsBetween(Window.unboundedPreceding, 0)) for a in axes}
    return df.withColumns({"displacement2": sum((F.pow(F.col(a) - first[a], 2) for a in axes), F.lit(0.0)), "step2": sum((F.pow(F.col(a) - F.lag(a).over(w), 2) for a in axes), F.lit(0.0))})


def relative_paths(df: DataFrame, n_tracks: int | None = None, axes: Sequence[str] = ("x_pos", "y_pos"), key: Sequence[str] = KEY) -> DataFrame:
    """Positions relative to the track's first (rel_axis), of the first n tracks of each experiment if given."""
    w = over_track(key).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({f"rel_{a}": F.col(a) - F.first(a).over(w) for a in axes})
    if n_tracks is None:
        return out
    rank = Window.partitionBy(key[0]).orderBy(*key[1:])
    some = df.select(*key).distinct().withColumn("__n", F.row_number().over(rank)).where(F.col("__n") <= n_tracks).select(*key)
    return out.join(some, list(key), "left_semi")


def start_position(df: DataFrame, axis: str = "y_pos", key: Sequence[str] = KEY) -> DataFrame:
    """start_axis: the position at the track's first row, on every row."""
    return df.withColumn(f"start_{axis}", F.first(axis).over(over_track(key).rowsBetween(Window.unboundedPreceding, 0)))


def running_msd1(df: DataFrame, axes: Sequence[str] = ("x_pos", "y_pos"), key: Sequence[str] = KEY) -> DataFrame:
    """msd1: mean squared step so far, over steps of exactly one frame."""
    w = over_track(key)
    step2 = sum((F.pow(F.col(a) - F.lag(a).over(w), 2) for a in axes), F.lit(0.0))
    stepped = df.withColumn("__s", F.when(F.col(TIME) - F.lag(TIME).over(w) == 1, step2))
    return stepped.withColumn("msd1", F.avg("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def lag_matrix(df: DataFrame, column: str, n: int, key: Sequence[str] = KEY) -> DataFrame:
    """lag_1 ... lag_n of a column."""
    return df.withColumns({f"lag_{i}": F.lag(column, i).over(over_track(key)) for i in range(1, n + 1)})


def transition_rate(df: DataFrame, label: str, key: Sequence[str] = KEY) -> DataFrame:
    """n_frames and transition_rate: the share of steps with a change of label, 0 for a single row."""
    w = over_track(key)
    changed = df.select(*key, (F.lag(label).over(w) != F.col(label)).cast("double").alias("c"))
    return changed.groupBy(*key).agg(F.count("*").alias("n_frames"), F.coalesce(F.sum("c") / F.nullif(F.count("*") - 1, F.lit(0)), F.lit(0.0)).alias("transition_rate"))


def ar1(df: DataFrame, axes: Sequence[str] = ("x_pos", "y_pos"), key: Sequence[str] = KEY) -> DataFrame:
    """ar1_axis: lag-1 autocorrelation of a track's increments less their mean, and ar1, their mean. Null for fewer than 3 increments or no variance."""
    w = over_track(key)
    whole = Window.partitionBy(*key)
    d = df.select(*key, TIME, *[(F.col(a) - F.lag(a).over(w)).alias(a) for a in axes])
    centred = d.select(*key, TIME, *[(F.col(a) - F.avg(a).over(whole)).alias(a) for a in axes])
    pairs = centred.select(*key, *axes, *[F.lag(a).over(w).alias(f"b_{a}") for a in axes])
    enough = lambda a: (F.count(a) >= 3) & (F.sum(F.pow(a, 2)) > 1e-12)
    out = pairs.groupBy(*key).agg(*[F.when(enough(a), F.sum(F.col(a) * F.col(f"b_{a}")) / F.sum(F.pow(a, 2))).alias(f"ar1_{a}") for a in axes])
    mean = sum((F.coalesce(f"ar1_{a}", F.lit(0.0)) for a in axes), F.lit(0.0)) / F.nullif(sum((F.col(f"ar1_{a}").isNotNull().cast("int") for a in axes), F.lit(0)), F.lit(0))
    return out.withColumn("ar1", mean)


def speed_wave(df: DataFrame, speed: str = "speed", key: Sequence[str] = KEY) -> DataFrame:
    """The wave of each track's speed, from means of three neighbouring known speeds; times in frames times dt (where there is one).

    The peak is in the first window of largest mean: its largest speed (wave_peak) and when (wave_time). Half of that mean is reached in the
    nearest window before (after) whose mean is at most half: at its last (first) row of at most half, wave_left (wave_right) with the speed there. 0 for
    what is not found, and for tracks of fewer than three speeds. fwhm adds the sides that were found.
    """
    time = F.col(TIME) * F.col("dt") if "dt" in df.columns else F.col(TIME).cast("double")
    w = over_track(key)
    rows = df.where(F.col(speed).isNotNull()).select(*key, TIME, time.alias("t0"), F.col(speed).alias("s0"))
    windows = rows.select("*", *[F.lead(f"{c}0", i).over(w).alias(f"{c}{i}") for i in (1, 2) for c in ("t", "s")], F.row_number().over(w).alias("n")).where(F.col("s2").isNotNull())
    windows = windows.withColumn("m", (F.col("s0") + F.col("s1") + F.col("s2")) / 3)
    whole = Window.partitionBy(*key)
    peaked = windows.withColumn("peak", F.max("m").over(whole))
    peaked = peaked.withColumns({"at": F.min(F.when(F.col("m") == F.col("peak"), F.col("n"))).over(whole), "half": F.col("peak") / 2})
    places = [F.struct(F.col(f"s{i}").alias("s"), F.col(f"t{i}").alias("t")) for i in range(3)]
    first_low = lambda order: F.coalesce(*[F.when(F.col(f"s{i}") <= F.col("half"), places[i]) for i in order])
    top = F.greatest("s0", "s1", "s2")
    highest = F.coalesce(*[F.when(F.col(f"s{i}") == top, places[i]) for i in range(3)])
    low = F.col("m") <= F.col("half")
    found = peaked.groupBy(*key).agg(
        F.max(F.when(F.col("n") == F.col("at"), highest)).alias("p"), F.max_by(first_low((2, 1, 0)), F.when(low & (F.col("n") < F.col("at")), F.col("n"))).alias("l"),
        F.min_by(first_low((0, 1, 2)), F.when(low & (F.col("n") > F.col("at")), F.col("n"))).alias("r"),
    )
    all_ = df.select(*key).distinct().join(found, list(key), "left")
    value = lambda c, name: F.coalesce(F.col(c), F.lit(0.0)).alias(name)
    width = F.coalesce(F.col("p.t") - F.col("l.t"), F.lit(0.0)) + F.coalesce(F.col("r.t") - F.col("p.t"), F.lit(0.0))
    return all_.select(*key, value("p.s", "wave_peak"), value("p.t", "wave_time"), value("l.t", "wave_left"), value("l.s", "wave_left_speed"), value("r.t", "wave_right"), value("r.s", "wave_right_speed"), width.alias("fwhm"))


def wave_filter(waves: DataFrame, kind: str) -> DataFrame:
    """Tracks with any, a whole (double-sided), a left- or a right-sided wave."""
    left, right = F.col("wave_left") > 0, F.col("wave_right") > 0
    return waves.where({"any": left | right, "double": left & right, "left": left & ~right, "right": right & ~left}[kind])


def wave_share(waves: DataFrame, group: str) -> DataFrame:
    """Tracks without, with left, right and whole waves in each group, and their percentages (which sum to 100)."""
    left, right = F.col("wave_left") > 0, F.col("wave_right") > 0
    kinds = {"none": ~left & ~right, "left": left & ~right, "right": right & ~left, "full": left & right}
    return waves.groupBy(group).agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{k}") for k, c in kinds.items()], *[(F.count_if(c) * 100 / F.count("*")).alias(f"pct_{k}") for k, c in kinds.items()])


# ---- summaries ---------------------------------------------------------------------------------------------------------------


def track_summary(df: DataFrame, features: Sequence[str], carried: Sequence[str] = (), slope: bool = False, key: Sequence[str] = KEY) -> DataFrame:
    """n_frames and mean, std (of a sample), min, max, first and last (values in time's order) of each feature; carried: first values of columns."""
    aggs = [F.count("*").alias("n_frames")]
    for c in features:
        at = F.when(F.col(c).isNotNull(), F.col(TIME))
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.min_by(c, at).alias(f"{c}_first"), F.max_by(c, at).alias(f"{c}_last")]
        if slope:
            aggs.append(F.regr_slope(F.col(c), F.col(TIME).cast("double")).alias(f"{c}_slope"))
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(TIME))).alias(c) for c in carried]
    return df.groupBy(*key).agg(*aggs)


def track_motility(kinematics: DataFrame, axes: Sequence[str] = ("x_pos", "y_pos"), key: Sequence[str] = KEY) -> DataFrame:
    """Net and total displacement, confinement ratio, mean curvilinear and straight-line speed, linearity; null where a denominator is zero.

    From rows with step and speed of backward_kinematics. The straight-line speed is per minute, the curvilinear per hour, as in the original.
    """
    ends = [F.max_by(a, TIME) - F.min_by(a, TIME) for a in axes]
    grouped = kinematics.groupBy(*key).agg(
        F.count("*").alias("n_frames"), F.sqrt(sum((F.pow(e, 2) for e in ends), F.lit(0.0))).alias("net_displacement"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("total_displacement"),
        F.avg("speed").alias("mean_curvilinear_speed"), ((F.max(TIME) - F.min(TIME)) * F.min("dt")).alias("minutes"),
    )
    out = grouped.withColumns({"confinement_ratio": ratio("net_displacement", "total_displacement"), "mean_straight_line_speed": ratio("net_displacement", "minutes")})
    return out.withColumn("linearity", ratio("mean_straight_line_speed", "mean_curvilinear_speed")).drop("minutes")


def track_kinematics(df: DataFrame, axes: Sequence[str] = ("x_pos", "y_pos"), features: Sequence[str] = (), key: Sequence[str] = KEY) -> DataFrame:
    """Displacements, duration (seconds), length, speeds (mean = length / duration; max, min, ddof-0 deviation of the steps' speeds), straightness, AR(1), means."""
    w = over_track(key)
    step = df.select("*", F.sqrt(sum((F.pow(F.col(a) - F.lag(a).over(w), 2) for a in axes), F.lit(0.0))).alias("__step"), ((F.col(TIME) - F.lag(TIME).over(w)) * F.col("dt") * 60).alias("__sec"))
    step = step.withColumn("__speed", F.col("__step") / F.col("__sec"))
    moved = {a: F.max_by(a, TIME) - F.min_by(a, TIME) for a in axes}
    grouped = step.groupBy(*key).agg(
        F.count("*").alias("n_frames"), *[m.alias(f"displacement_{a}") for a, m in moved.items()], F.sqrt(sum((F.pow(m, 2) for m in moved.values()), F.lit(0.0))).alias("displacement"),
        ((F.max(TIME) - F.min(TIME)) * F.min("dt") * 60).alias("duration"), F.coalesce(F.sum("__step"), F.lit(0.0)).alias("length"), F.max("__speed").alias("speed_max"), F.min("__speed").alias("speed_min"),
        F.stddev_pop("__speed").alias("speed_std"), F.coalesce(F.sum(F.pow("__step", 2)), F.lit(0.0)).alias("sum_step2"), *[F.avg(f).alias(f"{f}_mean") for f in features],
    )
    out = grouped.withColumns({"speed_mean": ratio("length", "duration"), "straightness": ratio("displacement", "length")}).withColumn("speed_variation", ratio("speed_std", "speed_mean"))
    return out.join(ar1(df, axes, key), list(key))


def track_ranges(long: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Range of each (track, feature) of a long table."""
    return long.groupBy(*key, "feature").agg((F.max("value") - F.min("value")).alias("range"))


def sunplot_extent(df: DataFrame, axes: Sequence[str] = ("x_pos", "y_pos"), key: Sequence[str] = KEY) -> DataFrame:
    """The largest distance from the start on each axis, over all tracks."""
    paths = relative_paths(df, None, axes, key)
    return paths.agg(*[F.max(F.abs(f"rel_{a}")).alias(f"extent_{a}") for a in axes])
