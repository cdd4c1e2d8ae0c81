"""Queries on which tracks stay, kinematics, waves and track summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import tracks as t
from trackloom.plans.registry import query

W = "PARTITION BY experiment, parent ORDER BY time_index"
#: Speeds and steps of the rows of v_tracks, in SQL.
KIN = f"""
k0 AS (SELECT *, time_index - lag(time_index) OVER w AS gap, x_pos - lag(x_pos) OVER w AS dx, y_pos - lag(y_pos) OVER w AS dy FROM v_tracks WINDOW w AS ({W})),
k1 AS (SELECT *, CASE WHEN gap <= 1 THEN dt / 60 * gap END AS h, CASE WHEN gap <= 1 THEN sqrt(dx * dx + dy * dy) END AS step FROM k0),
k2 AS (SELECT *, step / h AS speed, CASE WHEN gap <= 1 THEN dx / h END AS vx, CASE WHEN gap <= 1 THEN dy / h END AS vy FROM k1),
k3 AS (SELECT *, (speed - lag(speed) OVER w) / h AS speed_change, (vx - lag(vx) OVER w) / h AS ax, (vy - lag(vy) OVER w) / h AS ay FROM k2 WINDOW w AS ({W}))"""


@query("v_tracks", sql=f"""
WITH g AS (SELECT experiment, parent, time_index, x_pos, area, time_index - lag(time_index) OVER ({W}) AS gap FROM v_tracks),
k AS (SELECT *, count(*) OVER w AS n, max(gap) OVER w AS widest FROM g WINDOW w AS (PARTITION BY experiment, parent))
SELECT experiment, parent, time_index, x_pos, area FROM k WHERE n >= 95 AND coalesce(widest, 0) <= 2""", doubles="x_pos area")
def valid_tracks(df: DataFrame) -> DataFrame:
    return t.valid_tracks(df, 95, 2).select("experiment", "parent", "time_index", "x_pos", "area")


@query("v_tracks", sql="""
SELECT experiment, parent, time_index, y_pos FROM v_tracks SEMI JOIN (SELECT experiment, parent FROM v_tracks GROUP BY ALL HAVING count(DISTINCT time_index) >= 90) USING (experiment, parent)""", doubles="y_pos")
def min_track_length(df: DataFrame) -> DataFrame:
    return t.min_track_length(df, 90).select("experiment", "parent", "time_index", "y_pos")


@query("v_tracks", sql="""
SELECT count(*) AS tracks_before, count(*) FILTER (WHERE n >= 90) AS tracks_after, count(*) FILTER (WHERE n < 90) AS tracks_deleted,
  CAST(sum(m) AS BIGINT) AS rows_before, CAST(coalesce(sum(m) FILTER (WHERE n >= 90), 0) AS BIGINT) AS rows_after
FROM (SELECT count(DISTINCT time_index) AS n, count(*) AS m FROM v_tracks GROUP BY experiment, parent)""")
def track_length_report(df: DataFrame) -> DataFrame:
    return t.length_report(df, 90)


@query("v_tracks_full", sql="""
SELECT experiment, parent, time_index, l_partkey FROM (SELECT experiment, parent, CAST(time_index // 2 AS INT) AS time_index, l_partkey,
  row_number() OVER (PARTITION BY experiment, parent, time_index // 2 ORDER BY time_index) AS n FROM v_tracks_full) WHERE n = 1""")
def dedup_time(df: DataFrame) -> DataFrame:
    halved = df.withColumn("old", F.col("time_index")).withColumn("time_index", F.expr("cast(time_index div 2 as int)"))
    return t.dedup_time(halved, ["old"]).select("experiment", "parent", "time_index", "l_partkey")


@query("v_tracks", sql=f"""
WITH {KIN} SELECT CASE WHEN speed IS NULL THEN 'speed' WHEN speed_change IS NULL THEN 'acceleration' WHEN area IS NULL THEN 'area' WHEN intensity IS NULL THEN 'other' ELSE 'kept' END AS reason, count(*) AS n FROM k3 GROUP BY 1""")
def drop_report(df: DataFrame) -> DataFrame:
    null = lambda c: F.col(c).isNull()
    return t.drop_report(t.backward_kinematics(df), [("speed", null("speed")), ("acceleration", null("speed_change")), ("area", null("area")), ("other", null("intensity"))])


@query("v_tracks", sql="""
SELECT experiment, parent, count(*) AS n FROM v_tracks SEMI JOIN (SELECT * FROM (SELECT experiment, parent, row_number() OVER (ORDER BY experiment, parent) AS n FROM
  (SELECT DISTINCT experiment, parent FROM v_tracks)) WHERE (n - 1) % 7 = 0) USING (experiment, parent) GROUP BY ALL""")
def sample_every(df: DataFrame) -> DataFrame:
    return t.sample_every(df, 7).groupBy("experiment", "parent").agg(F.count("*").alias("n"))


@query("v_tracks")
def sample_tracks(df: DataFrame) -> DataFrame:
    return t.sample_tracks(df, 50).groupBy("experiment", "parent").agg(F.count("*").alias("n"))


@query("v_tracks", "v_cells", sql="""
SELECT p.frame, coalesce(c.particle, p.id) AS id, count(*) AS n FROM (SELECT time_index AS frame, parent AS id FROM v_tracks) p
LEFT JOIN (SELECT DISTINCT CAST(n_frames AS INT) AS frame, parent AS id, parent + 1000000 AS particle FROM v_cells) c ON p.frame = c.frame AND p.id = c.id GROUP BY 1, 2""")
def attach_particle(df: DataFrame, cells: DataFrame) -> DataFrame:
    frames = df.select(F.col("time_index").alias("frame"), F.col("parent").alias("id"))
    particles = cells.select(F.col("n_frames").cast("int").alias("frame"), F.col("parent").alias("id"), (F.col("parent") + 1_000_000).alias("particle")).distinct()
    return t.with_particles(frames, particles).groupBy("frame", "id").agg(F.count("*").alias("n"))


@query("v_tracks", sql="SELECT experiment, parent, time_index, area FROM v_tracks", doubles="area")
def drop_constant_features(df: DataFrame) -> DataFrame:
    kept = t.drop_constant_features(df.select("experiment", "parent", "time_index", "area", "dt"), ["area", "dt"])
    return kept


@query("v_tracks", sql="""
WITH f AS (SELECT experiment, parent, 'area' AS feature, area AS value FROM v_tracks UNION ALL SELECT experiment, parent, 'intensity', intensity FROM v_tracks UNION ALL SELECT experiment, parent, 'x_pos', x_pos FROM v_tracks),
g AS (SELECT feature, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS null_share, count(DISTINCT CASE WHEN value IS NOT NULL THEN experiment || '/' || parent END) AS n_cells FROM f GROUP BY feature)
SELECT *, null_share <= 0.02 AND n_cells >= 10 AS keep FROM g""", doubles="null_share")
def feature_coverage(df: DataFrame) -> DataFrame:
    return t.feature_coverage(df, ["area", "intensity", "x_pos"], min_cells=10)


@query("v_tracks", sql="""
SELECT experiment, parent, count(*) AS n FROM v_tracks ANTI JOIN (SELECT DISTINCT experiment, parent FROM v_tracks WHERE area IS NULL AND time_index > 60) USING (experiment, parent) GROUP BY ALL""")
def whole_tracks(df: DataFrame) -> DataFrame:
    late = df.withColumn("late", F.when(F.col("time_index") > 60, F.col("area")).otherwise(0.0))
    return t.whole_tracks(late, ["late"]).groupBy("experiment", "parent").agg(F.count("*").alias("n"))


@query("v_tracks", sql="SELECT 'area' AS feature, count(*) - count(area) AS n_null FROM v_tracks UNION ALL SELECT 'intensity', count(*) - count(intensity) FROM v_tracks")
def null_counts(df: DataFrame) -> DataFrame:
    return t.null_counts(df, ["area", "intensity"])


@query("v_tracks", sql="""
WITH g AS (SELECT experiment, parent, CAST(unnest(range(a, b + 1)) AS INT) AS time_index FROM (SELECT experiment, parent, min(time_index) AS a, max(time_index) AS b FROM v_tracks GROUP BY ALL))
SELECT experiment, parent, time_index, 45.0 AS dt, x_pos FROM g LEFT JOIN v_tracks USING (experiment, parent, time_index)""", doubles="dt x_pos")
def densify(df: DataFrame) -> DataFrame:
    return t.densify(df).select("experiment", "parent", "time_index", "dt", "x_pos")


_FILL = f"""
WITH n AS (SELECT experiment, parent, time_index, area, row_number() OVER ({W}) AS n FROM v_tracks),
e AS (SELECT *, last_value(area IGNORE NULLS) OVER b AS v0, first_value(area IGNORE NULLS) OVER a AS v1, last_value(CASE WHEN area IS NOT NULL THEN n END IGNORE NULLS) OVER b AS n0,
  first_value(CASE WHEN area IS NOT NULL THEN n END IGNORE NULLS) OVER a AS n1 FROM n
  WINDOW b AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT *, CASE WHEN n0 = n1 THEN v0 ELSE v0 + (v1 - v0) * (n - n0) / (n1 - n0) END AS line FROM e)"""


@query("v_tracks", sql=_FILL + " SELECT experiment, parent, time_index, coalesce(line, v0, v1) AS area FROM l", doubles="area")
def interpolate(df: DataFrame) -> DataFrame:
    return t.interpolate(df, ["area"]).select("experiment", "parent", "time_index", "area")


@query("v_tracks", sql=_FILL + " SELECT experiment, parent, time_index, line AS area FROM l", doubles="area")
def interpolate_inside(df: DataFrame) -> DataFrame:
    return t.interpolate(df, ["area"], inside_only=True).select("experiment", "parent", "time_index", "area")


@query("v_tracks", sql=f"""
WITH {KIN} SELECT experiment, parent, time_index, step, speed, speed_change, sqrt(ax * ax + ay * ay) AS acceleration FROM k3""", doubles="step speed speed_change acceleration", digits=4)
def backward_kinematics(df: DataFrame) -> DataFrame:
    return t.backward_kinematics(df).select("experiment", "parent", "time_index", "step", "speed", "speed_change", "acceleration")


@query("v_tracks", sql=f"""
SELECT experiment, parent, time_index, sqrt(dx * dx + dy * dy) / (gap * dt * 60) AS speed FROM (SELECT experiment, parent, time_index, dt,
  time_index - lag(time_index) OVER w AS gap, x_pos - lag(x_pos) OVER w AS dx, y_pos - lag(y_pos) OVER w AS dy FROM v_tracks WINDOW w AS ({W}))""", doubles="speed")
def backward_kinematics_seconds(df: DataFrame) -> DataFrame:
    return t.backward_kinematics(df, max_gap=None, per_second=True).select("experiment", "parent", "time_index", "speed")


@query("v_tracks", sql=f"""
SELECT experiment, parent, time_index, dx / s AS cv_x_pos, dy / s AS cv_y_pos, sqrt(dx / s * (dx / s) + dy / s * (dy / s)) AS central_speed, 0.0 AS central_acceleration FROM (SELECT experiment, parent, time_index,
  (lead(time_index) OVER w - lag(time_index) OVER w) * dt * 60 AS s, lead(x_pos) OVER w - lag(x_pos) OVER w AS dx, lead(y_pos) OVER w - lag(y_pos) OVER w AS dy FROM v_tracks WINDOW w AS ({W}))""", doubles="cv_x_pos cv_y_pos central_speed central_acceleration", digits=10)
def central_kinematics(df: DataFrame) -> DataFrame:
    return t.central_kinematics(df).select("experiment", "parent", "time_index", "cv_x_pos", "cv_y_pos", "central_speed", "central_acceleration")


@query("v_tracks", sql=f"""
WITH g AS (SELECT experiment, parent, time_index, dt, time_index - lag(time_index) OVER w AS b, lead(time_index) OVER w - time_index AS a, lead(x_pos) OVER w - lag(x_pos) OVER w AS dx, lead(y_pos) OVER w - lag(y_pos) OVER w AS dy FROM v_tracks WINDOW w AS ({W}))
SELECT experiment, parent, time_index, CASE WHEN a <= 1 AND b <= 1 THEN sqrt(dx * dx + dy * dy) / ((a + b) * dt / 60) END AS two_sided_speed FROM g""", doubles="two_sided_speed")
def mean_speed_two_sided(df: DataFrame) -> DataFrame:
    return t.mean_speed_two_sided(df).select("experiment", "parent", "time_index", "two_sided_speed")


@query("v_tracks", sql="SELECT experiment, parent, time_index, row_number() OVER (ORDER BY experiment, parent, time_index) AS position FROM v_tracks")
def track_order(df: DataFrame) -> DataFrame:
    return t.track_order(df).select("experiment", "parent", "time_index", "position")


@query("v_tracks", sql=f"""
WITH a AS (SELECT experiment, parent, time_index, CASE WHEN time_index - lag(time_index) OVER w <= 1 THEN atan2(y_pos - lag(y_pos) OVER w, x_pos - lag(x_pos) OVER w) END AS angle FROM v_tracks WINDOW w AS ({W}))
SELECT *, angle - lag(angle) OVER ({W}) AS angle_change FROM a""", doubles="angle angle_change")
def angle(df: DataFrame) -> DataFrame:
    return t.angles(df).select("experiment", "parent", "time_index", "angle", "angle_change")


@query("v_tracks", sql=f"""
SELECT experiment, parent, time_index, power(x_pos - first_value(x_pos) OVER w, 2) + power(y_pos - first_value(y_pos) OVER w, 2) AS displacement2,
  power(x_pos - lag(x_pos) OVER w, 2) + power(y_pos - lag(y_pos) OVER w, 2) AS step2 FROM v_tracks WINDOW w AS ({W})""", doubles="displacement2 step2", digits=3)
def displacement2(df: DataFrame) -> DataFrame:
    return t.displacement2(df).select("experiment", "parent", "time_index", "displacement2", "step2")


@query("v_tracks", sql=f"""
SELECT experiment, parent, time_index, avg(s) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS msd1 FROM (SELECT experiment, parent, time_index,
  CASE WHEN time_index - lag(time_index) OVER w = 1 THEN power(x_pos - lag(x_pos) OVER w, 2) + power(y_pos - lag(y_pos) OVER w, 2) END AS s FROM v_tracks WINDOW w AS ({W}))""", doubles="msd1", digits=3)
def running_msd1(df: DataFrame) -> DataFrame:
    return t.running_msd1(df).select("experiment", "parent", "time_index", "msd1")


#: The peak of each track's smoothed speed and where it falls to half, in SQL.
WAVES = f"""
{KIN}, v AS (SELECT experiment, parent, time_index * dt AS t0, speed AS s0, lead(time_index * dt, 1) OVER w AS t1, lead(speed, 1) OVER w AS s1, lead(time_index * dt, 2) OVER w AS t2, lead(speed, 2) OVER w AS s2, row_number() OVER w AS n FROM k3 WHERE speed IS NOT NULL WINDOW w AS ({W})),
m AS (SELECT *, (s0 + s1 + s2) / 3 AS m, max((s0 + s1 + s2) / 3) OVER (PARTITION BY experiment, parent) AS peak FROM v WHERE s2 IS NOT NULL), a AS (SELECT *, min(CASE WHEN m = peak THEN n END) OVER (PARTITION BY experiment, parent) AS at_ FROM m),
p AS (SELECT experiment, parent, greatest(s0, s1, s2) AS s, CASE WHEN s0 >= greatest(s1, s2) THEN t0 WHEN s1 >= s2 THEN t1 ELSE t2 END AS t FROM a WHERE n = at_),
l AS (SELECT experiment, parent, CASE WHEN s2 <= peak / 2 THEN s2 WHEN s1 <= peak / 2 THEN s1 ELSE s0 END AS s, CASE WHEN s2 <= peak / 2 THEN t2 WHEN s1 <= peak / 2 THEN t1 ELSE t0 END AS t FROM a WHERE n < at_ AND m <= peak / 2 QUALIFY row_number() OVER (PARTITION BY experiment, parent ORDER BY n DESC) = 1),
r AS (SELECT experiment, parent, CASE WHEN s0 <= peak / 2 THEN s0 WHEN s1 <= peak / 2 THEN s1 ELSE s2 END AS s, CASE WHEN s0 <= peak / 2 THEN t0 WHEN s1 <= peak / 2 THEN t1 ELSE t2 END AS t FROM a WHERE n > at_ AND m <= peak / 2 QUALIFY row_number() OVER (PARTITION BY experiment, parent ORDER BY n) = 1),
waves AS (SELECT e.experiment, e.parent, coalesce(p.s, 0) AS wave_peak, coalesce(p.t, 0) AS wave_time, coalesce(l.t, 0) AS wave_left, coalesce(l.s, 0) AS wave_left_speed, coalesce(r.t, 0) AS wave_right, coalesce(r.s, 0) AS wave_right_speed, coalesce(p.t - l.t, 0) + coalesce(r.t - p.t, 0) AS fwhm
FROM (SELECT DISTINCT experiment, parent FROM v_tracks) e LEFT JOIN p USING (experiment, parent) LEFT JOIN l USING (experiment, parent) LEFT JOIN r USING (experiment, parent))"""
COLUMNS = "wave_peak wave_time wave_left wave_left_speed wave_right wave_right_speed fwhm"


@query("v_tracks", sql=f"WITH {WAVES} SELECT * FROM waves", doubles=COLUMNS)
def speed_wave(df: DataFrame) -> DataFrame:
    return t.speed_wave(t.backward_kinematics(df))


@query("v_tracks", sql=f"WITH {WAVES} SELECT * FROM waves WHERE wave_left > 0 AND wave_right > 0", doubles=COLUMNS)
def wave_filter(df: DataFrame) -> DataFrame:
    return t.wave_filter(t.speed_wave(t.backward_kinematics(df)), "double")


@query("v_tracks", sql=f"""
WITH {WAVES}, k AS (SELECT experiment, CASE WHEN wave_left > 0 AND wave_right > 0 THEN 'full' WHEN wave_left > 0 THEN 'left' WHEN wave_right > 0 THEN 'right' ELSE 'none' END AS kind FROM waves),
c AS (SELECT experiment, count(*) AS n, count(*) FILTER (WHERE kind = 'none') AS n_none, count(*) FILTER (WHERE kind = 'left') AS n_left, count(*) FILTER (WHERE kind = 'right') AS n_right, count(*) FILTER (WHERE kind = 'full') AS n_full FROM k GROUP BY experiment)
SELECT *, n_none * 100 / n AS pct_none, n_left * 100 / n AS pct_left, n_right * 100 / n AS pct_right, n_full * 100 / n AS pct_full FROM c""", doubles="pct_none pct_left pct_right pct_full")
def wave_share(df: DataFrame) -> DataFrame:
    return t.wave_share(t.speed_wave(t.backward_kinematics(df)), "experiment")


@query("v_states", sql="""
WITH c AS (SELECT parent, CASE WHEN lag(cluster) OVER (PARTITION BY parent ORDER BY time_index) <> cluster THEN 1.0 ELSE 0.0 END AS c FROM v_states)
SELECT parent, count(*) AS n_frames, coalesce(sum(c) / nullif(count(*) - 1, 0), 0) AS transition_rate FROM c GROUP BY parent""", doubles="transition_rate")
def transition_rate(df: DataFrame) -> DataFrame:
    return t.transition_rate(df, "cluster", ["parent"])


_AR1 = f"""
d AS (SELECT experiment, parent, time_index, x_pos - lag(x_pos) OVER w AS x, y_pos - lag(y_pos) OVER w AS y FROM v_tracks WINDOW w AS ({W})),
c AS (SELECT experiment, parent, time_index, x - avg(x) OVER p AS x, y - avg(y) OVER p AS y FROM d WINDOW p AS (PARTITION BY experiment, parent)),
b AS (SELECT *, lag(x) OVER ({W}) AS bx, lag(y) OVER ({W}) AS by_ FROM c),
r AS (SELECT experiment, parent, CASE WHEN count(x) >= 3 AND sum(x * x) > 1e-12 THEN sum(x * bx) / sum(x * x) END AS ar1_x_pos, CASE WHEN count(y) >= 3 AND sum(y * y) > 1e-12 THEN sum(y * by_) / sum(y * y) END AS ar1_y_pos FROM b GROUP BY ALL)"""


@query("v_tracks", sql=f"WITH {_AR1} SELECT *, (ar1_x_pos + ar1_y_pos) / 2 AS ar1 FROM r", doubles="ar1_x_pos ar1_y_pos ar1")
def ar1(df: DataFrame) -> DataFrame:
    return t.ar1(df)


@query("v_tracks", sql=f"SELECT experiment, parent, time_index, y_pos - first_value(y_pos) OVER ({W}) AS rel_y_pos, x_pos - first_value(x_pos) OVER ({W}) AS rel_x_pos FROM v_tracks WHERE parent IN (SELECT p FROM (SELECT experiment AS e, parent AS p, row_number() OVER (PARTITION BY experiment ORDER BY parent) AS n FROM (SELECT DISTINCT experiment, parent FROM v_tracks)) WHERE n <= 20 AND e = experiment)", doubles="rel_x_pos rel_y_pos")
def relative_paths(df: DataFrame) -> DataFrame:
    return t.relative_paths(df, 20).select("experiment", "parent", "time_index", "rel_x_pos", "rel_y_pos")


@query("v_tracks", sql=f"SELECT experiment, parent, time_index, first_value(y_pos) OVER ({W}) AS start_y_pos FROM v_tracks", doubles="start_y_pos")
def start_position(df: DataFrame) -> DataFrame:
    return t.start_position(df).select("experiment", "parent", "time_index", "start_y_pos")


@query("v_tracks", sql=f"SELECT experiment, parent, time_index, lag(area, 1) OVER w AS lag_1, lag(area, 2) OVER w AS lag_2, lag(area, 3) OVER w AS lag_3 FROM v_tracks WINDOW w AS ({W})", doubles="lag_1 lag_2 lag_3")
def lag_matrix(df: DataFrame) -> DataFrame:
    return t.lag_matrix(df, "area", 3).select("experiment", "parent", "time_index", "lag_1", "lag_2", "lag_3")


@query("v_tracks", sql="""
SELECT experiment, parent, count(*) AS n_frames, avg(area) AS area_mean, stddev_samp(area) AS area_std, min(area) AS area_min, max(area) AS area_max,
  arg_min(area, time_index) FILTER (WHERE area IS NOT NULL) AS area_first, arg_max(area, time_index) FILTER (WHERE area IS NOT NULL) AS area_last,
  regr_slope(area, time_index) AS area_slope, arg_min(cha1_category, time_index) AS cha1_category FROM v_tracks GROUP BY ALL""", doubles="area_mean area_std area_min area_max area_first area_last area_slope")
def track_summary(df: DataFrame) -> DataFrame:
    return t.track_summary(df, ["area"], ["cha1_category"], slope=True)


@query("v_tracks", sql=f"""
WITH {KIN}, g AS (SELECT experiment, parent, count(*) AS n_frames, sqrt(power(arg_max(x_pos, time_index) - arg_min(x_pos, time_index), 2) + power(arg_max(y_pos, time_index) - arg_min(y_pos, time_index), 2)) AS net_displacement,
  coalesce(sum(step), 0) AS total_displacement, avg(speed) AS mean_curvilinear_speed, (max(time_index) - min(time_index)) * 45.0 AS minutes FROM k3 GROUP BY experiment, parent),
h AS (SELECT *, net_displacement / nullif(total_displacement, 0) AS confinement_ratio, net_displacement / nullif(minutes, 0) AS mean_straight_line_speed FROM g)
SELECT * EXCLUDE (minutes), mean_straight_line_speed / nullif(mean_curvilinear_speed, 0) AS linearity FROM h""", doubles="net_displacement total_displacement mean_curvilinear_speed confinement_ratio mean_straight_line_speed linearity", digits=4)
def track_motility(df: DataFrame) -> DataFrame:
    return t.track_motility(t.backward_kinematics(df))


@query("v_tracks", sql=f"""
WITH {_AR1}, s AS (SELECT *, sqrt(power(x_pos - lag(x_pos) OVER w, 2) + power(y_pos - lag(y_pos) OVER w, 2)) AS step, (time_index - lag(time_index) OVER w) * 2700.0 AS sec FROM v_tracks WINDOW w AS ({W})),
g AS (SELECT experiment, parent, count(*) AS n_frames, arg_max(x_pos, time_index) - arg_min(x_pos, time_index) AS displacement_x_pos, arg_max(y_pos, time_index) - arg_min(y_pos, time_index) AS displacement_y_pos,
  (max(time_index) - min(time_index)) * 2700.0 AS duration, coalesce(sum(step), 0) AS length, max(step / sec) AS speed_max, min(step / sec) AS speed_min, stddev_pop(step / sec) AS speed_std, coalesce(sum(step * step), 0) AS sum_step2, avg(area) AS area_mean FROM s GROUP BY ALL),
h AS (SELECT *, sqrt(displacement_x_pos * displacement_x_pos + displacement_y_pos * displacement_y_pos) AS displacement, length / nullif(duration, 0) AS speed_mean FROM g)
SELECT h.*, displacement / nullif(length, 0) AS straightness, speed_std / nullif(speed_mean, 0) AS speed_variation, ar1_x_pos, ar1_y_pos, (ar1_x_pos + ar1_y_pos) / 2 AS ar1 FROM h JOIN r USING (experiment, parent)""",
       doubles="displacement_x_pos displacement_y_pos displacement duration length speed_max speed_min speed_std sum_step2 area_mean speed_mean straightness speed_variation ar1_x_pos ar1_y_pos ar1", digits=4)
def track_kinematics(df: DataFrame) -> DataFrame:
    return t.track_kinematics(df, features=["area"])


@query("v_long", sql="SELECT experiment, parent, feature, max(value) - min(value) AS range FROM v_long GROUP BY ALL", doubles="range", digits=8)
def track_ranges(df: DataFrame) -> DataFrame:
    return t.track_ranges(df)


@query("v_tracks", sql=f"""
SELECT max(abs(x)) AS extent_x_pos, max(abs(y)) AS extent_y_pos FROM (SELECT x_pos - first_value(x_pos) OVER ({W}) AS x, y_pos - first_value(y_pos) OVER ({W}) AS y FROM v_tracks)""", doubles="extent_x_pos extent_y_pos")
def sunplot_extent(df: DataFrame) -> DataFrame:
    return t.sunplot_extent(df)
