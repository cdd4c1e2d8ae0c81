"""Queries on neighbours, matching, mean squared displacement, layers and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import space as s
from trackloom.operators import tracks as t
from trackloom.plans.registry import query
from trackloom.plans.track_queries import KIN

K = "experiment, parent"


@query("v_tracks", sql=f"""
WITH {KIN}, m AS MATERIALIZED (SELECT experiment, parent, time_index, CASE WHEN speed IS NOT NULL THEN x_pos END AS x, y_pos AS y FROM k3),
d AS (SELECT a.experiment, a.parent, a.time_index, min(power(a.x - b.x, 2) + power(a.y - b.y, 2)) FILTER (WHERE a.parent <> b.parent) AS d FROM m a JOIN m b ON a.experiment = b.experiment AND a.time_index = b.time_index GROUP BY ALL)
SELECT experiment, parent, time_index, sqrt(d) AS min_distance FROM d""", doubles="min_distance")
def min_distance(df: DataFrame) -> DataFrame:
    return s.min_distance(t.backward_kinematics(df)).select("experiment", "parent", "time_index", "min_distance")


@query("v_tracks", sql=f"""
WITH {KIN}, m AS (SELECT * FROM k3 WHERE vx IS NOT NULL AND vy IS NOT NULL),
p AS (SELECT a.experiment, a.parent, a.time_index, (a.vx * b.vx + a.vy * b.vy) / (sqrt(a.vx * a.vx + a.vy * a.vy) * sqrt(b.vx * b.vx + b.vy * b.vy)) AS c FROM m a JOIN m b
  ON a.experiment = b.experiment AND a.time_index = b.time_index AND a.parent <> b.parent AND power(a.x_pos - b.x_pos, 2) + power(a.y_pos - b.y_pos, 2) <= 40000
  WHERE sqrt(a.vx * a.vx + a.vy * a.vy) * sqrt(b.vx * b.vx + b.vy * b.vy) > 0)
SELECT m.experiment, m.parent, m.time_index, coalesce(avg(c), 0) AS collectivity, count(c) AS n_neighbours FROM m LEFT JOIN p USING (experiment, parent, time_index) GROUP BY ALL""", doubles="collectivity")
def collectivity(df: DataFrame) -> DataFrame:
    return s.collectivity(t.backward_kinematics(df))


@query("v_tracks", sql=f"""
WITH {KIN}, m AS (SELECT * FROM k3 WHERE vx IS NOT NULL AND vy IS NOT NULL),
p AS (SELECT a.experiment, a.parent, a.time_index, (a.vx * b.vx + a.vy * b.vy) / (sqrt(a.vx * a.vx + a.vy * a.vy) * sqrt(b.vx * b.vx + b.vy * b.vy)) AS c FROM m a JOIN m b
  ON a.experiment = b.experiment AND a.time_index = b.time_index AND a.parent <> b.parent AND abs(a.x_pos - b.x_pos) <= 200 AND abs(a.y_pos - b.y_pos) <= 200
  WHERE sqrt(a.vx * a.vx + a.vy * a.vy) * sqrt(b.vx * b.vx + b.vy * b.vy) > 0)
SELECT m.experiment, m.parent, m.time_index, coalesce(avg(c), 0) AS collectivity, count(c) AS n_neighbours FROM m LEFT JOIN p USING (experiment, parent, time_index) GROUP BY ALL""", doubles="collectivity")
def collectivity_cube(df: DataFrame) -> DataFrame:
    return s.collectivity(t.backward_kinematics(df), shape="cube")


#: Pairs of rows of a track up to half its span (rounded up) apart.
_PAIRS = f"""
sp AS (SELECT {K}, max(time_index) - min(time_index) AS span, count(DISTINCT time_index) AS n FROM v_tracks GROUP BY ALL),
c AS (SELECT a.experiment, a.parent, b.time_index - a.time_index AS tau, avg(power(a.x_pos - b.x_pos, 2) + power(a.y_pos - b.y_pos, 2)) AS msd, count(*) AS n_pairs
  FROM v_tracks a JOIN sp USING (experiment, parent) JOIN v_tracks b ON a.experiment = b.experiment AND a.parent = b.parent AND b.time_index > a.time_index AND b.time_index - a.time_index <= ceil(span / 2.0) GROUP BY ALL)"""


@query("v_tracks", sql=f"WITH {_PAIRS} SELECT experiment, parent, tau, msd, n_pairs FROM c", doubles="msd", digits=3)
def msd_pairs(df: DataFrame) -> DataFrame:
    return s.msd_pairs(df, None)


@query("v_tracks", sql=f"""
WITH {_PAIRS}, d AS (SELECT c.* FROM c JOIN sp USING (experiment, parent) WHERE n > 6 AND tau <= ceil(span / 2.0)),
g AS (SELECT {K} FROM d GROUP BY ALL HAVING count(*) >= 3 AND min(tau) = 1)
SELECT experiment, tau, avg(msd) AS msd, count(*) AS n_tracks FROM d SEMI JOIN g USING (experiment, parent) GROUP BY experiment, tau""", doubles="msd", digits=3)
def msd_by_well(df: DataFrame) -> DataFrame:
    return s.msd_by_well(df, None)


@query("v_tracks", sql=f"""
WITH {_PAIRS}, d AS (SELECT c.* FROM c JOIN sp USING (experiment, parent) WHERE tau <= floor(span / 2.0)),
g AS (SELECT {K}, count(*) AS n, min(tau) AS least, regr_r2(msd, tau) AS linearity, sum(tau * msd) / (4 * sum(tau * tau)) AS brownian_d FROM d GROUP BY ALL)
SELECT experiment, parent, linearity, brownian_d FROM g WHERE n >= 3 AND least = 1""", doubles="linearity brownian_d", digits=4)
def msd_models_brownian(df: DataFrame) -> DataFrame:
    return s.msd_models(s.msd_by_track(df, None)).select("experiment", "parent", "linearity", "brownian_d")


@query("v_tracks", sql=f"""
WITH {_PAIRS}, d AS (SELECT experiment, parent, CAST(tau AS DOUBLE) AS t, msd AS m FROM c JOIN sp USING (experiment, parent) WHERE tau <= floor(span / 2.0)),
s AS (SELECT {K}, count(*) AS n, regr_r2(m, t) AS linearity, sum(t * t) AS s2, sum(t * t * t) AS s3, sum(t * t * t * t) AS s4, sum(t * m) AS m1, sum(t * t * m) AS m2, sum(m * m) AS mm,
  regr_slope(CASE WHEN m > 0 THEN ln(m) END, ln(t)) AS power_alpha, exp(regr_intercept(CASE WHEN m > 0 THEN ln(m) END, ln(t))) AS power_d FROM d GROUP BY ALL HAVING count(*) >= 3 AND min(t) = 1),
f AS (SELECT *, m1 / (4 * s2) AS brownian_d, (m1 * s4 - m2 * s3) / (s2 * s4 - s3 * s3) AS p, (m2 * s2 - m1 * s3) / (s2 * s4 - s3 * s3) AS q, greatest(m2 / s4, 1) AS qv, greatest((m1 - s3) / s2, 0) AS pd FROM s),
g AS (SELECT *, CASE WHEN p >= 0 AND q >= 1 THEN p WHEN -2 * qv * m2 + qv * qv * s4 <= -2 * (pd * m1 + m2) + pd * pd * s2 + 2 * pd * s3 + s4 THEN 0 ELSE pd END AS a,
  CASE WHEN p >= 0 AND q >= 1 THEN q WHEN -2 * qv * m2 + qv * qv * s4 <= -2 * (pd * m1 + m2) + pd * pd * s2 + 2 * pd * s3 + s4 THEN qv ELSE 1 END AS b FROM f)
SELECT experiment, parent, n, linearity, brownian_d, n * ln(greatest(mm - 8 * brownian_d * m1 + 16 * brownian_d * brownian_d * s2, 1e-12) / n) + ln(n) AS brownian_bic, a / 4 AS directed_d, sqrt(b) AS directed_v,
  n * ln(greatest(mm - 2 * (a * m1 + b * m2) + a * a * s2 + 2 * a * b * s3 + b * b * s4, 1e-12) / n) + 2 * ln(n) AS directed_bic, power_d, power_alpha FROM g""",
       doubles="linearity brownian_d brownian_bic directed_d directed_v directed_bic power_d power_alpha", digits=3)
def msd_models(df: DataFrame) -> DataFrame:
    return s.msd_models(s.msd_by_track(df, None))


@query("v_tracks")
def msd_pairs_whole(df: DataFrame) -> DataFrame:
    return s.msd_pairs(df, None)


@query("v_tracks")
def msd_by_well_whole(df: DataFrame) -> DataFrame:
    return s.msd_by_well(df, None)


@query("v_tracks")
def msd_by_zone_whole(df: DataFrame) -> DataFrame:
    return s.msd_by_zone(df, None)


@query("v_tracks", sql=f"""
WITH {_PAIRS}, d AS (SELECT c.* FROM c JOIN sp USING (experiment, parent) WHERE tau <= floor(span / 2.0)),
e AS (SELECT {K}, arg_min(y_pos, time_index) AS y0 FROM v_tracks GROUP BY ALL), h AS (SELECT experiment, min(y_pos) AS lo, max(y_pos) AS hi FROM v_tracks GROUP BY experiment),
z AS (SELECT {K}, CAST(least(floor(abs(y0 - (lo + hi) / 2) / ((hi - lo) / 6)), 2) AS INT) + 1 AS zone FROM e JOIN h USING (experiment))
SELECT experiment, zone, tau, avg(msd) AS msd, count(*) AS n_tracks FROM d JOIN z USING (experiment, parent) GROUP BY experiment, zone, tau""", doubles="msd", digits=3)
def msd_by_zone(df: DataFrame) -> DataFrame:
    return s.msd_by_zone(df, None)


@query("v_tracks", "v_tracks_full", sql="""
WITH o AS (SELECT experiment, time_index, l_partkey AS object, x_pos + 3 AS x_pos, y_pos - 2 AS y_pos FROM v_tracks),
p AS (SELECT o.experiment, o.time_index, o.object, b.parent, sqrt(power(o.x_pos - b.x_pos, 2) + power(o.y_pos - b.y_pos, 2)) AS distance, b.x_pos - o.x_pos AS offset_x_pos, b.y_pos - o.y_pos AS offset_y_pos
  FROM o JOIN v_tracks_full b USING (experiment, time_index) WHERE power(o.x_pos - b.x_pos, 2) + power(o.y_pos - b.y_pos, 2) <= 2500)
SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY experiment, time_index, object ORDER BY distance, parent) = 1""", doubles="distance offset_x_pos offset_y_pos")
def nearest_within(df: DataFrame, full: DataFrame) -> DataFrame:
    objects = df.select("experiment", "time_index", F.col("l_partkey").alias("object"), (F.col("x_pos") + 3).alias("x_pos"), (F.col("y_pos") - 2).alias("y_pos"))
    return s.nearest_within(objects, full.select("experiment", "time_index", "parent", "x_pos", "y_pos"), 50.0, ["experiment", "time_index"], "object", "parent")


@query("v_tracks", "v_tracks_full")
def nearest_within_whole(df: DataFrame, full: DataFrame) -> DataFrame:
    objects = df.select("experiment", "time_index", F.col("l_partkey").alias("object"), (F.col("x_pos") + 3).alias("x_pos"), (F.col("y_pos") - 2).alias("y_pos"))
    return s.nearest_within(objects, full.select("experiment", "time_index", "parent", "x_pos", "y_pos"), 50.0, ["experiment", "time_index"], "object", "parent")


def _objects(df: DataFrame, shift: float) -> DataFrame:
    return df.select("experiment", "time_index", F.col("parent").alias("id"), (F.col("x_pos") + shift).alias("x_pos"), "y_pos")


@query("v_tracks")
def greedy_match(df: DataFrame) -> DataFrame:
    return s.greedy_match(_objects(df, 0.0), _objects(df, 4.0), 60.0, ["experiment", "time_index"])


#: All move alike, so no assignment has a smaller total than each with itself.
@query("v_cells", sql="SELECT experiment, parent AS a, parent AS b, 1.5 AS distance FROM v_cells", doubles="distance")
def assign_tracks(df: DataFrame) -> DataFrame:
    return s.assign_tracks(df, df.withColumn("x_pos", F.col("x_pos") + 1.5), 200.0, ["experiment"])


@query("v_cells", sql="SELECT experiment, parent AS a, parent AS b, 65.0 AS distance FROM v_cells", doubles="distance")
def assign_tracks_far(df: DataFrame) -> DataFrame:
    """Most have another one nearer than their own."""
    return s.assign_tracks(df, df.withColumns({"x_pos": F.col("x_pos") + 25, "y_pos": F.col("y_pos") - 60}), 400.0, ["experiment"])


@query("v_a", "v_b", sql="""
WITH m AS (SELECT a.experiment, a.parent AS a, b.parent + 1 AS b FROM v_a a JOIN v_b b USING (experiment, parent))
SELECT v_a.experiment, m.b AS parent, v_a.area FROM v_a JOIN m ON v_a.experiment = m.experiment AND v_a.parent = m.a""", doubles="area")
def remap_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    matches = a.join(b.select("experiment", "parent"), ["experiment", "parent"]).select("experiment", F.col("parent").alias("a"), (F.col("parent") + 1).alias("b"))
    return s.remap_ids(a, matches, "parent", ["experiment"]).select("experiment", "parent", "area")


@query("v_tracks", sql="""
WITH a AS (SELECT experiment, time_index, parent, x_pos, y_pos FROM v_tracks), b AS (SELECT experiment, time_index, parent, x_pos + 4 AS x_pos, y_pos - 1 AS y_pos FROM a)
SELECT CAST(round(b.x_pos - a.x_pos) AS BIGINT) AS shift_x_pos, CAST(round(b.y_pos - a.y_pos) AS BIGINT) AS shift_y_pos, count(*) AS votes FROM a JOIN b USING (experiment, time_index)
WHERE abs(b.x_pos - a.x_pos) <= 10 AND abs(b.y_pos - a.y_pos) <= 10 GROUP BY 1, 2""")
def offset_vote(df: DataFrame) -> DataFrame:
    a = df.select("experiment", "time_index", "parent", "x_pos", "y_pos")
    b = a.withColumns({"x_pos": F.col("x_pos") + 4, "y_pos": F.col("y_pos") - 1})
    return s.offset_vote(a, b, ["experiment", "time_index"])


@query("v_tracks")
def offset_vote_whole(df: DataFrame) -> DataFrame:
    a = df.select("experiment", "time_index", "parent", "x_pos", "y_pos")
    return s.offset_vote(a, a.withColumns({"x_pos": F.col("x_pos") + 4, "y_pos": F.col("y_pos") - 1}), ["experiment", "time_index"])


@query("v_tracks", sql="""
WITH e AS (SELECT experiment, quantile_cont(y_pos, [0.2, 0.4, 0.6, 0.8]) AS q FROM v_tracks GROUP BY experiment)
SELECT experiment, layer, count(*) AS n, min(y_pos) AS low, max(y_pos) AS high FROM (SELECT experiment, y_pos, CAST(len(list_filter(q, lambda x: x < y_pos)) AS INT) AS layer FROM v_tracks JOIN e USING (experiment)) GROUP BY ALL""", doubles="low high")
def quantile_layers(df: DataFrame) -> DataFrame:
    return s.quantile_layers(df, "y_pos", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], ["experiment"]).groupBy("experiment", "layer").agg(F.count("*").alias("n"), F.min("y_pos").alias("low"), F.max("y_pos").alias("high"))


@query("v_tracks", sql="""
WITH e AS (SELECT quantile_cont(y_pos, [0.1, 0.25, 0.41, 0.6, 0.85, 0.95]) AS q FROM v_tracks)
SELECT layer, count(*) AS n FROM (SELECT CAST(len(list_filter(q, lambda x: x < y_pos)) AS INT) AS layer FROM v_tracks, e) GROUP BY ALL""")
def quantile_layers_fixed(df: DataFrame) -> DataFrame:
    return s.quantile_layers(df, "y_pos", [0.0, 0.1, 0.25, 0.41, 0.6, 0.85, 0.95, 1.0]).groupBy("layer").agg(F.count("*").alias("n"))


@query("v_tracks", sql="""
WITH m AS (SELECT experiment, (min(y_pos) + max(y_pos)) / 2 AS m FROM v_tracks GROUP BY experiment)
SELECT experiment, time_index, CAST(least(floor(abs(y_pos - m) / 30), 4) AS INT) AS layer, avg(area) AS mean, count(area) AS n FROM v_tracks JOIN m USING (experiment) GROUP BY ALL""", doubles="mean", digits=9)
def distance_layers(df: DataFrame) -> DataFrame:
    return s.distance_layers(df, "area")


@query("v_tracks", sql="""
WITH g AS (SELECT experiment, time_index, lag(y_pos) OVER w AS low, y_pos AS high, y_pos - lag(y_pos) OVER w AS gap FROM v_tracks WINDOW w AS (PARTITION BY experiment, time_index ORDER BY y_pos, parent)),
s AS (SELECT experiment, time_index, avg(gap) + 2 * stddev_pop(gap) AS cut FROM g WHERE gap IS NOT NULL GROUP BY ALL)
SELECT experiment, time_index, count(*) FILTER (WHERE gap >= cut AND gap > 0) AS n_bands FROM g JOIN s USING (experiment, time_index) WHERE gap IS NOT NULL GROUP BY ALL""")
def scratch_bands_per_time(df: DataFrame) -> DataFrame:
    return s.scratch_bands(df).select("experiment", "time_index", "n_bands")


@query("v_tracks", sql="""
WITH g AS (SELECT experiment, time_index, lag(y_pos) OVER w AS low, y_pos AS high, y_pos - lag(y_pos) OVER w AS gap FROM v_tracks WINDOW w AS (PARTITION BY experiment, time_index ORDER BY y_pos, parent)),
s AS (SELECT experiment, time_index, avg(gap) + 2 * stddev_pop(gap) AS cut FROM g WHERE gap IS NOT NULL GROUP BY ALL),
e AS (SELECT experiment, time_index, count(*) FILTER (WHERE gap >= cut AND gap > 0) AS n_bands, max(struct_pack(gap := gap, low := low, high := high)) FILTER (WHERE gap >= cut AND gap > 0) AS w
  FROM g JOIN s USING (experiment, time_index) WHERE gap IS NOT NULL GROUP BY ALL),
b AS (SELECT *, n_bands = 0 AND max(CAST(n_bands > 0 AS INT)) OVER (PARTITION BY experiment ORDER BY time_index) = 1 AS shut FROM e),
c AS (SELECT *, max(CAST(shut AS INT)) OVER (PARTITION BY experiment ORDER BY time_index) = 1 AS closed FROM b)
SELECT experiment, time_index, n_bands, CASE WHEN NOT closed THEN w.low END AS band_bottom, CASE WHEN NOT closed THEN w.high END AS band_top, closed FROM c""", doubles="band_bottom band_top")
def scratch_detect(df: DataFrame) -> DataFrame:
    return s.scratch_bands(df)
