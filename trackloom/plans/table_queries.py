"""Queries on doses, joins of tables, and grouped summaries."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import columns as c
from trackloom.operators import tables as j
from trackloom.operators import tracks as t
from trackloom.plans.registry import query

K = ["experiment", "parent"]
MODE = "(SELECT {g}, {v} FROM (SELECT {g}, {v}, row_number() OVER (PARTITION BY {g} ORDER BY count(*) DESC, {v}) AS rn FROM {t} WHERE {v} IS NOT NULL GROUP BY {g}, {v}) WHERE rn = 1)"
MEAN_CELLS = "SELECT experiment, parent, avg(area) AS area, avg(intensity) AS intensity FROM v_tracks GROUP BY ALL"


@query("v_tracks", sql=f"""
SELECT m.experiment, m.parent, n_frames, cha1_norm, a.cha1_category, b.cha2_category FROM (SELECT experiment, parent, count(*) AS n_frames, avg(cha1_norm) AS cha1_norm FROM v_tracks GROUP BY ALL) m
JOIN {MODE.format(g="experiment, parent", v="cha1_category", t="v_tracks")} a USING (experiment, parent) JOIN {MODE.format(g="experiment, parent", v="cha2_category", t="v_tracks")} b USING (experiment, parent)""", doubles="cha1_norm", digits=9)
def dose_summary(df: DataFrame) -> DataFrame:
    return j.dose_summary(df, ["cha1_norm"], ["cha1_category", "cha2_category"])


@query("v_tracks", "v_a", sql="SELECT t.experiment, t.parent, time_index, n_frames, cluster FROM v_tracks t LEFT JOIN v_a USING (experiment, parent)")
def join_dose(df: DataFrame, dose: DataFrame) -> DataFrame:
    return j.join_dose(df.select(*K, "time_index"), dose.select(*K, "n_frames", "cluster"))


@query("v_tracks", sql="""
WITH n AS (SELECT parent, time_index, min(cha2_category) AS v FROM v_tracks WHERE parent % 2 = 0 GROUP BY ALL)
SELECT experiment, parent, time_index, coalesce(v, CASE WHEN time_index % 3 = 0 THEN cha1_category END, 'NA') AS cha1_category FROM v_tracks LEFT JOIN n USING (parent, time_index)""")
def join_categories_by_time(df: DataFrame) -> DataFrame:
    new = df.where("parent % 2 = 0").select("parent", "time_index", F.col("cha2_category").alias("cha1_category"))
    old = df.select(*K, "time_index", F.when(F.col("time_index") % 3 == 0, F.col("cha1_category")).alias("cha1_category"))
    return j.join_categories_by_time(old, new, "cha1_category")


@query("v_ids", sql="""
WITH i AS (SELECT DISTINCT experiment FROM v_ids), n AS (SELECT DISTINCT CASE parent % 3 WHEN 0 THEN experiment WHEN 1 THEN substr(experiment, 16, 1) || CAST(parent % 8 + 2 AS VARCHAR) ELSE substr(experiment, 12, 20) END AS name FROM v_ids),
p AS (SELECT experiment, name, CASE WHEN experiment = name THEN 1 WHEN contains(experiment, CASE WHEN regexp_full_match(name, '[A-Za-z][0-9]') THEN upper(name[1]) || '0' || name[2] ELSE name END) THEN 2
  WHEN contains(experiment, name) OR contains(name, experiment) THEN 3 END AS tier FROM i, n)
SELECT experiment, name, tier FROM p WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY tier, name) = 1""")
def join_dose_fuzzy(ids: DataFrame) -> DataFrame:
    kind = F.col("parent") % 3
    name = F.when(kind == 0, F.col("experiment")).when(kind == 1, F.concat(F.substring("experiment", 16, 1), (F.col("parent") % 8 + 2).cast("string"))).otherwise(F.substring("experiment", 12, 20))
    return j.join_dose_fuzzy(ids, ids.select(name.alias("experiment")))


@query("v_tracks", sql="""
WITH s AS (SELECT experiment, parent, avg(area) AS m, stddev_samp(area) AS d FROM v_tracks GROUP BY ALL)
SELECT t.experiment, t.parent, time_index, (area - m) / nullif(d, 0) AS norm, CASE WHEN (area - m) / nullif(d, 0) IS NULL THEN NULL WHEN (area - m) / nullif(d, 0) <= -0.524 THEN 'Neg' WHEN (area - m) / nullif(d, 0) <= 0.524 THEN 'Pos' ELSE 'High' END AS category
FROM v_tracks t JOIN s USING (experiment, parent)""", doubles="norm")
def lookup_norm(df: DataFrame) -> DataFrame:
    norms = j.normalised_intensity(df.select(*K, "time_index", "area"), "area", K)
    return j.lookup_norm(df.select(*K, "time_index"), norms, [*K, "time_index"], "norm", c.dose_category("norm"))


@query("v_tracks", "v_a", sql="SELECT t.experiment, t.parent, time_index, cluster FROM v_tracks t LEFT JOIN v_a USING (experiment, parent)")
def broadcast_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    return j.broadcast_labels(df.select(*K, "time_index"), labels.select(*K, "cluster"))


@query("v_tracks", sql="""
WITH c AS (SELECT experiment, cha1_category || '_' || cha2_category AS combo, count(*) AS n FROM v_tracks GROUP BY ALL)
SELECT experiment, list_sort(list(combo)) AS combos, arg_min(combo, struct_pack(a := -n, b := combo)) AS dominant FROM c GROUP BY experiment""")
def dose_combos_present(df: DataFrame) -> DataFrame:
    return j.dose_combos_present(df.select("experiment", c.joined_doses(["cha1_category", "cha2_category"]).alias("combo")), "combo")


@query("v_a", "v_b", "v_cells", sql="""
SELECT experiment, parent, CASE WHEN a.p AND b.p THEN 'both' WHEN a.p THEN 'only_a' WHEN b.p THEN 'only_b' ELSE 'neither' END AS side FROM v_cells
LEFT JOIN (SELECT experiment, parent, true AS p FROM v_a) a USING (experiment, parent) LEFT JOIN (SELECT experiment, parent, true AS p FROM v_b) b USING (experiment, parent)""")
def compare_sources(a: DataFrame, b: DataFrame, cells: DataFrame) -> DataFrame:
    return j.compare_sources(a, b, K, cells)


@query("v_a", "v_b", sql="""
SELECT 'area' AS feature, count(a.area - b.area) AS n, avg(abs(a.area - b.area)) AS mean_abs_diff FROM v_a a JOIN v_b b USING (experiment, parent) UNION ALL
SELECT 'n_frames', count(a.n_frames - b.n_frames), avg(abs(a.n_frames - b.n_frames)) FROM v_a a JOIN v_b b USING (experiment, parent)""", doubles="mean_abs_diff", digits=9)
def field_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    return j.field_differences(a, b, K, ["area", "n_frames"])


@query("v_a", "v_b", sql="SELECT experiment, parent, n_frames FROM v_a SEMI JOIN v_b USING (experiment, parent)")
def common_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    return j.common_cells(a, b).select(*K, "n_frames")


@query("v_a", "v_b", sql="SELECT experiment, parent, n_frames FROM v_a ANTI JOIN v_b USING (experiment, parent)")
def unmatched(a: DataFrame, b: DataFrame) -> DataFrame:
    return j.unmatched(a, b).select(*K, "n_frames")


@query("v_series", sql="SELECT unique_id FROM v_series GROUP BY unique_id HAVING sum(y) <= 3000")
def removed_series(df: DataFrame) -> DataFrame:
    kept = df.groupBy("unique_id").agg(F.sum("y").alias("s")).where("s > 3000")
    return j.removed_series(df, kept, "unique_id")


@query("v_tracks", sql="SELECT a.experiment AS a, b.experiment AS b FROM (SELECT DISTINCT experiment FROM v_tracks) a JOIN (SELECT DISTINCT experiment FROM v_tracks) b ON a.experiment < b.experiment")
def pair_groups(df: DataFrame) -> DataFrame:
    return j.pair_groups(df, "experiment")


@query("v_a", "v_b", sql="""
SELECT coalesce(a.experiment, b.experiment) AS experiment, CAST(coalesce(a.n, b.n) AS INT) AS position, a.parent AS parent_a, b.parent AS parent_b FROM
(SELECT experiment, parent, row_number() OVER (PARTITION BY experiment ORDER BY parent) AS n FROM v_a) a FULL JOIN (SELECT experiment, parent, row_number() OVER (PARTITION BY experiment ORDER BY parent) AS n FROM v_b) b ON a.experiment = b.experiment AND a.n = b.n""")
def positional_concat(a: DataFrame, b: DataFrame) -> DataFrame:
    side = lambda df, s: df.select("experiment", F.col("parent").alias(f"parent_{s}"))
    return j.positional_concat(side(a, "a"), side(b, "b"), ["parent_a"], ["parent_b"], ["experiment"])


@query("v_tracks", sql="""
WITH c AS (SELECT experiment, parent, arg_min_null(area, time_index) AS first_area FROM v_tracks GROUP BY ALL)
SELECT r.*, n_cells, first_area FROM (SELECT experiment, count(*) AS n_rows, avg(intensity) AS intensity, avg(nullif(cha1_norm, 0)) AS cha1_norm FROM v_tracks GROUP BY experiment) r
JOIN (SELECT experiment, count(*) AS n_cells, avg(first_area) AS first_area FROM c GROUP BY experiment) USING (experiment)""", doubles="intensity cha1_norm first_area")
def well_profile(df: DataFrame) -> DataFrame:
    return j.well_profile(df.withColumn("first_area", F.col("area")), ["intensity"], ["cha1_norm"], ["first_area"])


@query("v_tracks", sql="SELECT experiment AS treatment, time_index, count(area) AS n, avg(area) AS mean, stddev_pop(area) / sqrt(count(area)) AS sem FROM v_tracks GROUP BY ALL", doubles="mean sem", digits=8)
def mean_over_time(df: DataFrame) -> DataFrame:
    return j.mean_over_time(df, "area")


@query("v_tracks", sql="SELECT experiment AS treatment, time_index, cha1_category, count(cha1_norm) AS n, avg(abs(cha1_norm)) AS mean, stddev_pop(abs(cha1_norm)) / sqrt(count(cha1_norm)) AS sem FROM v_tracks GROUP BY ALL", doubles="mean sem", digits=8)
def mean_over_time_by_dose(df: DataFrame) -> DataFrame:
    return j.mean_over_time(df, "cha1_norm", absolute=True, dose="cha1_category")


@query("v_tracks", sql="SELECT experiment, count(area) AS n, avg(area) AS mean, stddev_pop(area) / sqrt(count(area)) AS sem FROM (SELECT experiment, parent, arg_min_null(area, time_index) AS area FROM v_tracks GROUP BY ALL) GROUP BY experiment", doubles="mean sem", digits=8)
def well_bar(df: DataFrame) -> DataFrame:
    return j.well_bar(df, "area", per_cell=True)


@query("v_tracks", sql="SELECT experiment, cha1_category, count(area) AS n, avg(area) AS mean, stddev_pop(area) / sqrt(count(area)) AS sem FROM v_tracks GROUP BY ALL", doubles="mean sem", digits=8)
def well_bar_by_dose(df: DataFrame) -> DataFrame:
    return j.well_bar(df, "area", dose="cha1_category")


@query("v_tracks", sql="SELECT experiment, time_index, count(*) AS n, avg(area) AS area, avg(intensity) AS intensity FROM v_tracks WHERE area IS NOT NULL AND intensity IS NOT NULL GROUP BY ALL", doubles="area intensity", digits=10)
def pair_over_time(df: DataFrame) -> DataFrame:
    return j.pair_over_time(df, "area", "intensity")


@query("v_tracks", sql="""
WITH s AS (SELECT time_index, count(DISTINCT experiment || '/' || parent) AS tracks, count(area) AS surfaces, sum(area) AS voxels FROM v_tracks GROUP BY GROUPING SETS ((time_index), ()))
SELECT time_index, 'tracks' AS variable, CAST(tracks AS DOUBLE) AS value FROM s UNION ALL SELECT time_index, 'surfaces', surfaces FROM s UNION ALL SELECT time_index, 'voxels', voxels FROM s""", doubles="value", digits=4)
def overall_counts(df: DataFrame) -> DataFrame:
    return j.overall_counts(df, {"tracks": F.countDistinct(*K), "surfaces": F.count("area"), "voxels": F.sum("area")})


@query("v_tracks", "v_a", sql="""
WITH c AS (SELECT cha1_category, cluster, count(DISTINCT t.experiment || '/' || t.parent) AS n FROM v_tracks t JOIN v_a USING (experiment, parent) GROUP BY ALL)
SELECT *, n * 100 / sum(n) OVER (PARTITION BY cha1_category) AS row_pct, n * 100 / sum(n) OVER (PARTITION BY cluster) AS col_pct FROM c""", doubles="row_pct col_pct")
def contingency(df: DataFrame, cells: DataFrame) -> DataFrame:
    return j.contingency(df.join(cells.select(*K, "cluster"), K), "cha1_category", "cluster", K)


@query("v_tracks", sql=f"""
WITH m AS (SELECT CAST(parent % 3 AS INT) AS cluster, * FROM ({MEAN_CELLS})), l AS (SELECT cluster, 'area' AS feature, area AS value FROM m UNION ALL SELECT cluster, 'intensity', intensity FROM m),
g AS (SELECT cluster, feature, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM l GROUP BY ALL)
SELECT *, std / sqrt(n) AS se, mean - 1.96 * (std / sqrt(n)) AS low, mean + 1.96 * (std / sqrt(n)) AS high FROM g""", doubles="mean std se low high")
def descriptive_by_cluster(df: DataFrame) -> DataFrame:
    return j.descriptive_by_cluster(df.withColumn("cluster", (F.col("parent") % 3).cast("int")), ["area", "intensity"], "cluster")


@query("v_states", sql="SELECT *, n / sum(n) OVER (PARTITION BY parent) AS share FROM (SELECT parent, cluster, count(*) AS n FROM v_states GROUP BY ALL)", doubles="share")
def model_share(df: DataFrame) -> DataFrame:
    return j.share_of(df, ["parent"], "cluster")


@query("v_states", sql="SELECT * FROM " + MODE.format(g="parent", v="cluster", t="v_states"))
def modal_model(df: DataFrame) -> DataFrame:
    return j.modal(df, ["parent"], "cluster")


@query("v_cells", sql="""
WITH m AS (SELECT 'area' AS feature, cluster, abs(avg(area)) AS mean FROM v_cells GROUP BY cluster UNION ALL SELECT 'intensity', cluster, abs(avg(intensity)) FROM v_cells GROUP BY cluster)
SELECT *, mean / nullif(max(CASE WHEN cluster = 0 THEN mean END) OVER (PARTITION BY feature), 0) * 100 AS pct FROM m""", doubles="mean pct")
def ratio_to_reference(df: DataFrame) -> DataFrame:
    return j.ratio_to_reference(df, ["area", "intensity"], "cluster")


@query("v_tracks", sql="SELECT experiment, greatest(min(intensity), avg(intensity) - 1.5 * stddev_pop(intensity)) AS low, least(max(intensity), avg(intensity) + 1.5 * stddev_pop(intensity)) AS high FROM v_tracks GROUP BY experiment", doubles="low high")
def robust_range(df: DataFrame) -> DataFrame:
    return j.robust_range(df, "intensity", ["experiment"], 1.5)


@query("v_tracks", sql="""
WITH l AS (SELECT 'area' AS feature, area AS value FROM v_tracks UNION ALL SELECT 'intensity', intensity FROM v_tracks), e AS (SELECT feature, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM l GROUP BY feature)
SELECT feature, low, high, count(*) FILTER (WHERE value < low OR value > high) AS n_outside FROM l JOIN e USING (feature) GROUP BY ALL""", doubles="low high")
def clip_percentiles(df: DataFrame) -> DataFrame:
    return j.clip_percentiles(df, ["area", "intensity"])


@query("v_tracks", sql="WITH m AS (SELECT time_index, avg(area) AS m FROM v_tracks GROUP BY ALL), n AS (SELECT m, row_number() OVER (ORDER BY time_index) AS n FROM m) SELECT CAST(b.n - a.n AS INT) AS lag, corr(a.m, b.m) AS acf FROM n a JOIN n b ON b.n - a.n BETWEEN 1 AND 25 GROUP BY 1", doubles="acf")
def feature_acf(df: DataFrame) -> DataFrame:
    return j.feature_acf(df, "area")


@query("v_cells", sql="SELECT 'area' AS a, 'intensity' AS b, corr(area, intensity) AS corr FROM v_cells UNION ALL SELECT 'area', 'x_pos', corr(area, x_pos) FROM v_cells UNION ALL SELECT 'intensity', 'x_pos', corr(intensity, x_pos) FROM v_cells", doubles="corr")
def corr_matrix(df: DataFrame) -> DataFrame:
    return j.corr_matrix(df, ["area", "intensity", "x_pos"], K)


@query("v_cells", sql="""
WITH r AS (SELECT rank() OVER (ORDER BY area) + (count(*) OVER (PARTITION BY area) - 1) / 2 AS a, rank() OVER (ORDER BY n_frames) + (count(*) OVER (PARTITION BY n_frames) - 1) / 2 AS b FROM v_cells)
SELECT 'area' AS a, 'n_frames' AS b, corr(r.a, r.b) AS corr FROM r""", doubles="corr")
def corr_matrix_spearman(df: DataFrame) -> DataFrame:
    return j.corr_matrix(df, ["area", "n_frames"], K, "spearman")


#: Means of conditions, and their features as rows.
_CONDITIONS = """
p AS (SELECT experiment || '|' || cha1_category AS name, avg(area) AS area, avg(intensity) AS intensity, avg(x_pos) AS x_pos, avg(y_pos) AS y_pos, avg(cha1_norm) AS cha1_norm FROM v_tracks GROUP BY ALL),
l AS (SELECT name, feature, value FROM p UNPIVOT (value FOR feature IN (area, intensity, x_pos, y_pos, cha1_norm)))"""
MEANS = ["area", "intensity", "x_pos", "y_pos", "cha1_norm"]


def conditions(df: DataFrame) -> DataFrame:
    return df.groupBy(F.concat_ws("|", "experiment", "cha1_category").alias("name")).agg(*[F.avg(x).alias(x) for x in MEANS])


@query("v_tracks", sql=f"WITH {_CONDITIONS} SELECT a.name AS a, b.name AS b, count(*) AS n, corr(a.value, b.value) AS corr FROM l a JOIN l b ON a.feature = b.feature AND a.name < b.name GROUP BY 1, 2", doubles="corr")
def corr_treatments(df: DataFrame) -> DataFrame:
    return j.corr_between(conditions(df), "name", MEANS)


@query("v_tracks", sql=f"""
WITH {_CONDITIONS}, r AS (SELECT name, feature, rank() OVER (PARTITION BY name ORDER BY value) + (count(*) OVER (PARTITION BY name, value) - 1) / 2 AS value FROM l)
SELECT a.name AS a, b.name AS b, count(*) AS n, corr(a.value, b.value) AS corr FROM r a JOIN r b ON a.feature = b.feature AND a.name < b.name GROUP BY 1, 2""", doubles="corr")
def corr_treatments_spearman(df: DataFrame) -> DataFrame:
    return j.corr_between(conditions(df), "name", MEANS, "spearman")


@query("v_ids", sql="SELECT parent, CASE WHEN parent % 3 = 0 THEN 'T' || (parent % 2) ELSE split_part(substr(experiment, 23), 'NOCO', 1) END AS treatment FROM v_ids")
def treatment_overrides(ids: DataFrame) -> DataFrame:
    """Ids that a map names, beside ids that speak for themselves."""
    own = ids.withColumn("experiment", F.when(F.col("parent") % 3 == 0, F.concat("experiment", F.col("parent").cast("string"))).otherwise(F.col("experiment")))
    known = own.where("parent % 3 = 0").select(F.col("experiment").alias("id"), F.concat(F.lit("T"), (F.col("parent") % 2).cast("string")).alias("treatment"))
    return j.treatments(own, "experiment", known).select("parent", "treatment")


_SCORE = "count(*) AS n, regr_r2(y, x) AS r2, avg(abs(y - x)) AS mae, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept"


@query("v_tracks", sql=f"SELECT experiment, {_SCORE} FROM (SELECT experiment, area AS x, intensity AS y FROM v_tracks WHERE area IS NOT NULL AND intensity IS NOT NULL) GROUP BY experiment", doubles="r2 mae slope intercept")
def agreement_score(df: DataFrame) -> DataFrame:
    return j.agreement_score(df, "area", "intensity", ["experiment"])


@query("v_tracks", sql=f"""
WITH f AS (SELECT 'plain' AS formula, area AS x, intensity AS y FROM v_tracks UNION ALL SELECT 'root', sqrt(area), intensity FROM v_tracks UNION ALL SELECT 'sum', area + x_pos / 100, intensity FROM v_tracks),
g AS (SELECT formula, {_SCORE} FROM f WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY formula) SELECT *, CAST(row_number() OVER (ORDER BY r2 DESC NULLS LAST, mae, formula) AS INT) AS rank FROM g""", doubles="r2 mae slope intercept")
def formula_rank(df: DataFrame) -> DataFrame:
    return j.formula_rank(df, "intensity", {"plain": F.col("area"), "root": F.sqrt("area"), "sum": F.col("area") + F.col("x_pos") / 100})


@query("v_tracks", sql="SELECT experiment, quantile_cont(r, 0.5) AS median, avg(r) AS mean, quantile_cont(r, 0.9) AS p90, quantile_cont(r, 0.99) AS p99, avg(CASE WHEN r * r < 100 THEN 1.0 ELSE 0.0 END) AS inlier_share FROM (SELECT experiment, abs(area - intensity) AS r FROM v_tracks WHERE area IS NOT NULL AND intensity IS NOT NULL) GROUP BY experiment", doubles="median mean p90 p99 inlier_share")
def residual_stats(df: DataFrame) -> DataFrame:
    return j.residual_stats(df.withColumn("r", F.abs(F.col("area") - F.col("intensity"))).where("r is not null"), "r", ["experiment"], 100.0)


@query("v_a", "v_b", sql="SELECT 'area' AS feature, count(*) AS n, regr_r2(b.area, a.area) AS r2, avg(abs(b.area - a.area)) AS mae, regr_slope(b.area, a.area) AS slope, regr_intercept(b.area, a.area) AS intercept FROM v_a a JOIN v_b b USING (experiment, parent)", doubles="r2 mae slope intercept")
def feature_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    return j.feature_agreement(a, b, K, ["area"])


@query("v_tracks", sql="""
WITH p AS (SELECT experiment, parent, area AS a, area + CASE WHEN time_index % 4 = 0 THEN 1.5 ELSE 0 END AS b FROM v_tracks WHERE time_index % 5 <> 0),
g AS (SELECT experiment, parent, count(*) FILTER (WHERE a IS NOT NULL) AS overlap, regr_r2(b, a) AS r2, sqrt(avg(power(a - b, 2))) AS rmse FROM p GROUP BY ALL) SELECT * FROM g""", doubles="r2 rmse")
def validation_metrics(df: DataFrame) -> DataFrame:
    other = df.where("time_index % 5 <> 0").withColumn("area", F.col("area") + F.when(F.col("time_index") % 4 == 0, 1.5).otherwise(0.0))
    return j.validation_metrics(df, other, "area")


@query("v_cells", sql="""
WITH s AS (SELECT experiment, parent, area, row_number() OVER (ORDER BY area DESC, experiment, parent) AS b, row_number() OVER (ORDER BY area, experiment, parent) AS w FROM v_cells)
SELECT experiment, parent, area, 'best' AS "end" FROM s WHERE b <= 10 UNION ALL SELECT experiment, parent, area, 'worst' FROM s WHERE w <= 10""", doubles="area")
def validation_best_and_worst(df: DataFrame) -> DataFrame:
    return j.best_and_worst(df.select(*K, "area"), "area", 10, K)


@query("v_cells", sql="SELECT experiment, parent, (area - avg(area) OVER ()) / stddev_pop(area) OVER () AS area, (intensity - avg(intensity) OVER ()) / stddev_pop(intensity) OVER () AS intensity FROM v_cells", doubles="area intensity")
def standardize(df: DataFrame) -> DataFrame:
    return j.standardize(df, ["area", "intensity"]).select(*K, "area", "intensity")


@query("v_tracks", sql="""
WITH s AS (SELECT experiment, quantile_cont(area, 0.3) AS q30, quantile_cont(area, 0.7) AS q70, avg(area) AS mean, stddev_samp(area) AS std FROM v_tracks GROUP BY experiment)
SELECT experiment, q30, q70, mean, std, CASE WHEN n IS NULL THEN 'NA' WHEN n <= -0.524 THEN 'Neg' WHEN n <= 0.524 THEN 'Pos' ELSE 'High' END AS category, count(*) AS n_rows FROM (SELECT s.*, (area - mean) / nullif(std, 0) AS n FROM v_tracks JOIN s USING (experiment)) GROUP BY ALL""", doubles="q30 q70 mean std")
def dose_categories(df: DataFrame) -> DataFrame:
    normed = j.normalised_intensity(df.select("experiment", "area"), "area", ["experiment"])
    return normed.groupBy("experiment", "q30", "q70", "mean", "std", F.coalesce(c.dose_category("norm"), F.lit("NA")).alias("category")).agg(F.count("*").alias("n_rows"))


@query("v_tracks", sql="SELECT experiment, parent, time_index, cha1_norm / (SELECT max(abs(cha1_norm)) FROM v_tracks) AS cha1_norm, sign(cha1_norm) * ln(1 + abs(cha1_norm)) AS logged FROM v_tracks", doubles="cha1_norm logged", digits=9)
def max_abs_scaling(df: DataFrame) -> DataFrame:
    return j.max_abs_scaled(df.withColumn("logged", c.signed_log("cha1_norm")), ["cha1_norm"]).select(*K, "time_index", "cha1_norm", "logged")


@query("v_cells", sql="""
WITH m AS (SELECT 'area' AS feature, cluster, avg(area) AS mean FROM v_cells GROUP BY cluster UNION ALL SELECT 'intensity', cluster, avg(intensity) FROM v_cells GROUP BY cluster),
z AS (SELECT *, (mean - avg(mean) OVER w) / stddev_samp(mean) OVER w AS z FROM m WINDOW w AS (PARTITION BY feature)) SELECT *, max(abs(z)) OVER () AS "limit" FROM z""", doubles="mean z limit".replace("limit", '"limit"'))
def zscore_profile(df: DataFrame) -> DataFrame:
    return j.zscore_profile(df, ["area", "intensity"], "cluster")


@query("v_tracks", sql="""
WITH p AS (SELECT experiment, cha1_category, coalesce(avg(area), 0) AS area, coalesce(avg(intensity), 0) AS intensity FROM v_tracks GROUP BY ALL)
SELECT experiment, cha1_category, (area - avg(area) OVER ()) / stddev_pop(area) OVER () AS area, (intensity - avg(intensity) OVER ()) / stddev_pop(intensity) OVER () AS intensity FROM p""", doubles="area intensity")
def profile_matrix(df: DataFrame) -> DataFrame:
    return j.profile_matrix(df, ["area", "intensity", "dt"], ["experiment", "cha1_category"])


@query("v_ids", sql="""
WITH s AS (SELECT DISTINCT experiment, substr(replace(experiment, 'NNN0', ''), 19, 8) AS short FROM v_ids), n AS (SELECT *, count(*) OVER (PARTITION BY short) AS n FROM s)
SELECT experiment, CASE WHEN n > 1 THEN substr(experiment, 16, 3) || '_' || short ELSE short END AS short FROM n""")
def collapse_prefix(df: DataFrame) -> DataFrame:
    return j.collapse_prefix(df, "experiment", "NNN0", 19, 8, (16, 3))


@query("v_ids", sql="SELECT parent, experiment FROM v_ids WHERE substr(experiment, 16, 3) IN ('B04', 'C05', 'D06', 'E07')")
def select_wells(df: DataFrame) -> DataFrame:
    return j.select_wells(df, ["B04", "C05", "D06", "E07"])


@query("v_ids", sql="SELECT parent, experiment FROM v_ids WHERE contains(experiment, '293TMETR') OR contains(experiment, '293TGABY')")
def select_combos(df: DataFrame) -> DataFrame:
    return j.select_combos(df, ["293T"], ["METR", "GABY"])


@query("v_ids", sql="SELECT parent, CASE WHEN substr(experiment, 23, 4) = 'NNIR' THEN NULL ELSE 'Pos' END AS cha1_category, CASE WHEN substr(experiment, 27, 4) = 'NNIR' THEN NULL ELSE 'High' END AS cha2_category FROM v_ids")
def mask_control_channel(df: DataFrame) -> DataFrame:
    return j.mask_control_channel(df.withColumns({"cha1_category": F.lit("Pos"), "cha2_category": F.lit("High")}), "NNIR", ["cha1_category", "cha2_category"]).select("parent", "cha1_category", "cha2_category")


@query("v_tracks", sql="""
SELECT 'P' AS pattern, count(*) FILTER (WHERE cha1_category IN ('Pos', 'High')) AS n FROM v_tracks UNION ALL SELECT 'N', count(*) FILTER (WHERE cha1_category = 'Neg') FROM v_tracks
UNION ALL SELECT 'PP', count(*) FILTER (WHERE cha1_category <> 'Neg' AND cha2_category <> 'Neg') FROM v_tracks UNION ALL SELECT 'PN', count(*) FILTER (WHERE cha1_category = 'Neg' AND cha2_category <> 'Neg') FROM v_tracks
UNION ALL SELECT 'PPN', count(*) FILTER (WHERE cha1_category <> 'Neg' AND cha2_category <> 'Neg' AND cha1_category = 'Neg') FROM v_tracks""")
def channel_filter(df: DataFrame) -> DataFrame:
    both = ["cha1_category", "cha2_category", "cha1_category"]
    return df.agg(F.array(*[F.struct(F.lit(p).alias("pattern"), F.count_if(c.channel_pattern(p, both)).alias("n")) for p in ("P", "N", "PP", "PN", "PPN")]).alias("x")).select(F.inline("x"))


@query("v_tracks", "v_cells", sql="SELECT experiment, parent, n_frames FROM v_cells WHERE parent IN (SELECT parent FROM v_tracks WHERE cha1_category = 'High' AND time_index > 90)")
def parent_restrict(df: DataFrame, cells: DataFrame) -> DataFrame:
    survivors = df.where("cha1_category = 'High' and time_index > 90")
    return j.common_cells(cells, survivors, ["parent"]).select(*K, "n_frames")


@query("v_tracks", sql="SELECT experiment, parent, time_index, x_pos * 1.22 + 5 AS x_pos, y_pos * 1.22 - 3 AS y_pos FROM v_tracks", doubles="x_pos y_pos", digits=8)
def scale_offset(df: DataFrame) -> DataFrame:
    return df.select(*K, "time_index", (F.col("x_pos") * 1.22 + 5).alias("x_pos"), (F.col("y_pos") * 1.22 - 3).alias("y_pos"))


@query("v_tracks", sql="SELECT experiment, parent, 'cha1:' || cha1_category || '|cha2:' || cha2_category AS combo, count(*) AS n FROM v_tracks GROUP BY ALL")
def dose_combo(df: DataFrame) -> DataFrame:
    return df.groupBy(*K, c.dose_combo({"cha1": "cha1_category", "cha2": "cha2_category"}).alias("combo")).agg(F.count("*").alias("n"))


@query("v_ids", sql="""
SELECT parent, substr(experiment, 16, 1) AS well_letter, regexp_extract(experiment, 'CHR\\d+([A-Z]\\d{2})', 1) AS well, substr(experiment, 19, 4) AS cell_line, split_part(substr(experiment, 23), 'NOCO', 1) AS treatment,
  CASE parent % 2 WHEN 0 THEN ['METR', 'NNIR'] ELSE ['NNIR'] END AS codes, regexp_replace('Con' || CAST(parent AS VARCHAR) || '_x', '^([A-Za-z]+)\\d+', '\\1') AS base FROM v_ids""")
def id_parts(df: DataFrame) -> DataFrame:
    e = "experiment"
    return df.select(
        "parent", c.part_of_id(e, c.WELL_LETTER).alias("well_letter"), c.well_of(e).alias("well"), c.part_of_id(e, c.CELL_LINE).alias("cell_line"), c.treatment_of(e).alias("treatment"), c.channel_codes(e).alias("codes"),
        c.base_of(F.concat(F.lit("Con"), F.col("parent").cast("string"), F.lit("_x"))).alias("base"),
    )


@query("v_tracks", sql="SELECT experiment || '_' || parent AS unique_id, time_index, TIMESTAMP '2000-01-01' + CAST(time_index * 45 AS INT) * INTERVAL 1 MINUTE AS ds, area FROM v_tracks", doubles="area")
def unique_id_ds(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("_", "experiment", "parent").alias("unique_id"), "time_index", c.time_stamp("time_index", "dt").alias("ds"), "area")


@query("v_cells", sql="SELECT experiment, parent, CASE WHEN parent % 7 = 0 THEN NULL ELSE area END AS area, TRY_CAST(CASE WHEN parent % 5 = 0 THEN 'n/a' ELSE CAST(n_frames AS VARCHAR) END AS DOUBLE) AS n FROM v_cells", doubles="area n")
def finite_guard_and_coerce(df: DataFrame) -> DataFrame:
    odd = F.when(F.col("parent") % 14 == 0, float("nan")).when(F.col("parent") % 7 == 0, float("inf")).otherwise(F.col("area"))
    text = F.when(F.col("parent") % 5 == 0, "n/a").otherwise(F.col("n_frames").cast("string"))
    return df.select(*K, c.finite(odd).alias("area"), c.number(text).alias("n"))


@query("v_tracks", sql="SELECT experiment, parent, time_index, CASE WHEN greatest(x_pos, y_pos) > 0 THEN sqrt(1 - power(least(x_pos, y_pos) / greatest(x_pos, y_pos), 2)) END AS eccentricity, power(pi(), 1 / 3) * power(6 * x_pos, 2 / 3) / nullif(y_pos, 0) AS sphericity, sqrt(4 * area / pi()) AS diameter FROM v_tracks", doubles="eccentricity sphericity diameter")
def shape_measures(df: DataFrame) -> DataFrame:
    return df.select(*K, "time_index", c.eccentricity("x_pos", "y_pos").alias("eccentricity"), c.sphericity("x_pos", "y_pos").alias("sphericity"), c.equivalent_diameter("area").alias("diameter"))


@query("v_series", sql="SELECT unique_id, ds, last_day(ds + INTERVAL 1 MONTH) AS next_month, CAST(ds + INTERVAL 14 DAY AS DATE) AS in_two_weeks FROM v_series")
def date_offsets(df: DataFrame) -> DataFrame:
    return df.select("unique_id", "ds", c.shifted_date("ds", 1, "M").alias("next_month"), c.shifted_date("ds", 2, "W").cast("date").alias("in_two_weeks"))


@query("v_tracks", sql="SELECT experiment, count(*) AS n FROM v_tracks GROUP BY experiment")
def experiment_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("experiment").agg(F.count("*").alias("n"))


@query("v_cells", sql="SELECT experiment, cluster, count(*) AS n, avg(area) AS area, avg(intensity) AS intensity FROM v_cells GROUP BY ALL", doubles="area intensity")
def population_means(df: DataFrame) -> DataFrame:
    return df.groupBy("experiment", "cluster").agg(F.count("*").alias("n"), F.avg("area").alias("area"), F.avg("intensity").alias("intensity"))


@query("v_tracks", sql="SELECT DISTINCT experiment, parent, cha1_category FROM v_tracks")
def distinct_cells(df: DataFrame) -> DataFrame:
    return df.select(*K, "cha1_category").distinct()


@query("v_a", "v_b", sql="SELECT experiment, parent FROM v_a INTERSECT SELECT experiment, parent FROM v_b")
def intersect_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*K).intersect(b.select(*K))


@query("v_cells", sql="SELECT experiment, parent, feature, value FROM (UNPIVOT (SELECT experiment, parent, area, intensity FROM v_cells) ON area, intensity INTO NAME feature VALUE value)", doubles="value")
def melt(df: DataFrame) -> DataFrame:
    return j.melt(df, K, ["area", "intensity"])


@query("v_tracks", sql="""
WITH r AS (SELECT experiment, parent, feature, range, row_number() OVER (PARTITION BY experiment ORDER BY range DESC, parent, feature) AS n FROM (SELECT experiment, parent, 'area' AS feature, max(area) - min(area) AS range FROM v_tracks GROUP BY ALL)) SELECT experiment, parent, feature, range FROM r WHERE n <= 20""", doubles="range", digits=8)
def top_effects(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    ranges = t.track_ranges(j.melt(df, K, ["area"]))
    return ranges.withColumn("n", F.row_number().over(Window.partitionBy("experiment").orderBy(F.desc("range"), "parent", "feature"))).where("n <= 20").drop("n")


