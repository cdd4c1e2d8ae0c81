"""The flagship: from raw rows to motility by experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import tracks as t
from trackloom.plans.registry import query
from trackloom.plans.track_queries import KIN, W


@query("v_tracks", sql=f"""
WITH {KIN.replace("FROM v_tracks WINDOW", "FROM v_tracks SEMI JOIN ok USING (experiment, parent) WINDOW").replace("k0 AS", f"ok AS (SELECT experiment, parent FROM (SELECT experiment, parent, time_index - lag(time_index) OVER ({W}) AS gap FROM v_tracks) GROUP BY ALL HAVING count(*) >= 25 AND coalesce(max(gap), 0) <= 5), k0 AS", 1)},
g AS (SELECT experiment, parent, sqrt(power(arg_max(x_pos, time_index) - arg_min(x_pos, time_index), 2) + power(arg_max(y_pos, time_index) - arg_min(y_pos, time_index), 2)) AS net,
  coalesce(sum(step), 0) AS total, avg(speed) AS speed FROM k3 GROUP BY experiment, parent)
SELECT experiment, count(*) AS n_tracks, avg(net / nullif(total, 0)) AS confinement_ratio, avg(speed) AS mean_speed FROM g GROUP BY experiment""", doubles="confinement_ratio mean_speed", digits=4)
def flagship(df: DataFrame) -> DataFrame:
    motility = t.track_motility(t.backward_kinematics(t.valid_tracks(df)))
    return motility.groupBy("experiment").agg(F.count("*").alias("n_tracks"), F.avg("confinement_ratio").alias("confinement_ratio"), F.avg("mean_curvilinear_speed").alias("mean_speed"))
