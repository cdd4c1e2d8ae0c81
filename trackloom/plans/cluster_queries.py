"""Queries on components, clusters, classifiers, feature arrays and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import clusters as k
from trackloom.operators import grouped, linkage
from trackloom.operators import tables as j
from trackloom.operators import vectors as v
from trackloom.plans.registry import query

K = ["experiment", "parent"]
FEATURES = ["area", "intensity", "x_pos", "y_pos"]


@query("embeddings")
def pca(df: DataFrame) -> DataFrame:
    return k.pca(df.select("vec_id", "label", "embedding"), ["embedding"], 3)[0].drop("embedding")


@query("v_cells")
def pca_loadings(df: DataFrame) -> DataFrame:
    _, loadings, shares = k.pca(df.select(*K, *FEATURES), FEATURES, 3)
    return df.sparkSession.createDataFrame([(f, i + 1, float(loadings[n, i]), shares[i]) for n, f in enumerate(FEATURES) for i in range(3)], "feature string, component int, loading double, share double")


@query("embeddings")
def kmeans(df: DataFrame) -> DataFrame:
    scores, *_ = k.pca(df.select("vec_id", "embedding"), ["embedding"], 3)
    return k.kmeans(scores.drop("embedding"), ["pc1", "pc2", "pc3"], 4, restarts=10)[0]


@query("embeddings")
def silhouette_sweep(df: DataFrame) -> DataFrame:
    scores, *_ = k.pca(df.select("vec_id", "embedding"), ["embedding"], 3)
    return k.silhouette_sweep(scores, ["pc1", "pc2", "pc3"], range(2, 11))


@query("embeddings")
def gmm(df: DataFrame) -> DataFrame:
    scores, *_ = k.pca(df.select("vec_id", "embedding"), ["embedding"], 2)
    return k.gmm(scores.drop("embedding"), ["pc1", "pc2"], 3)


@query("v_cells")
def cluster_by_group(df: DataFrame) -> DataFrame:
    return k.cluster_by_group(df.select(*K, *FEATURES), FEATURES, "experiment", 3)


@query("v_tracks")
def hierarchy(df: DataFrame) -> DataFrame:
    return k.hierarchy(j.profile_matrix(df, ["area", "intensity", "x_pos"], ["experiment", "cha1_category"]), ["area", "intensity", "x_pos"], 4)


CONDITIONS = ["area", "intensity", "x_pos", "y_pos"]


def _profiles(df: DataFrame) -> DataFrame:
    """Standardised means of each condition (experiment and a tenth of its tracks)."""
    named = df.withColumn("name", F.concat_ws("|", "experiment", "cha1_category", (F.col("parent") % 10).cast("string")))
    return j.profile_matrix(named, CONDITIONS, ["name"])


@query("v_tracks")
def ward_linkage(df: DataFrame) -> DataFrame:
    return linkage.ward(_profiles(df), CONDITIONS, "name")


@query("v_tracks")
def ward_branches(df: DataFrame) -> DataFrame:
    profiles = _profiles(df)
    return linkage.branches(linkage.ward(profiles, CONDITIONS, "name"), profiles, "name", 4)


@query("v_cells")
def euclidean_sweep(df: DataFrame) -> DataFrame:
    return k.euclidean_sweep(grouped.standardized(df.select(*K, *FEATURES), FEATURES, []), FEATURES, range(2, 7))


@query("v_cells")
def euclidean_sweep_by_group(df: DataFrame) -> DataFrame:
    return k.euclidean_sweep(grouped.standardized(df.select(*K, *FEATURES), FEATURES, ["experiment"]), FEATURES, range(2, 6), ["experiment"])


@query("embeddings", sql="""
WITH e AS (SELECT vec_id, label % 3 AS c, embedding[1:4] AS v FROM embeddings),
d AS (SELECT a.vec_id, a.c AS own, b.c, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL),
r AS (SELECT vec_id, max(s / n) FILTER (WHERE c = own) AS a, min(s / n) FILTER (WHERE c <> own) AS b FROM d GROUP BY vec_id)
SELECT 'cluster' AS labelling, count(*) AS n, avg((b - a) / greatest(a, b)) AS silhouette FROM r""", doubles="silhouette", digits=5)
def silhouette_of_labels(df: DataFrame) -> DataFrame:
    """Silhouette of a given labelling."""
    rows = df.select((F.col("label") % 3).alias("cluster"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(4)])
    return grouped.silhouettes(rows, ["e0", "e1", "e2", "e3"], ["cluster"])


@query("v_tracks")
def feature_selection(df: DataFrame) -> DataFrame:
    chosen = k.feature_selection(df, FEATURES, always=["area"])
    return df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(chosen)], "position int, feature string")


@query("v_cells", sql="""
WITH c AS (SELECT experiment || '|' || (parent % 2) AS facet, cluster, count(*) AS n FROM v_cells GROUP BY ALL) SELECT *, n * 100 / sum(n) OVER (PARTITION BY facet) AS row_pct FROM c""", doubles="row_pct")
def treatment_distribution(df: DataFrame) -> DataFrame:
    return k.treatment_distribution(df.withColumn("half", (F.col("parent") % 2).cast("string")), ["experiment", "half"])


@query("v_cells")
def group_cv(df: DataFrame) -> DataFrame:
    labelled = df.withColumn("bright", (F.col("intensity") + F.col("area") > 78).cast("int"))
    return k.group_cv(labelled, FEATURES, "bright", "experiment", 3)


@query("embeddings")
def rf_compare(df: DataFrame) -> DataFrame:
    named = df.select("vec_id", "label", *[F.get("embedding", i).cast("double").alias(f"e{i}") for i in range(64)])
    return k.rf_compare(named, {"few": [f"e{i}" for i in range(4)], "all": [f"e{i}" for i in range(64)]}, "label", ["vec_id"])


@query("v_cells", sql="""
SELECT experiment, parent, [round(area, 6), round(intensity, 6), round(x_pos, 6)] AS vector, CASE experiment[1] WHEN 'N' THEN 'N' ELSE NULL END AS treatment FROM v_cells WHERE area IS NOT NULL AND intensity IS NOT NULL AND parent % 5 <> 0""")
def flatten_vectors(df: DataFrame) -> DataFrame:
    odd = F.when(F.col("parent") % 5 == 0, float("nan")).otherwise(F.col("intensity"))
    values = df.select(*K, F.create_map(F.lit("a"), F.array("area"), F.lit("b"), F.array(odd, F.col("x_pos"))).alias("values"))
    known = df.sparkSession.createDataFrame([("N",), ("NX",)], "treatment string")
    return v.flatten_vectors(values, "values", ["a", "b"], known).select(*K, F.transform("vector", lambda x: F.round(x, 6)).alias("vector"), "treatment")


@query("v_cells", sql="""
WITH z AS (SELECT experiment, parent, (area - avg(area) OVER ()) / stddev_pop(area) OVER () AS a, (x_pos - avg(x_pos) OVER ()) / stddev_pop(x_pos) OVER () AS b FROM v_cells) SELECT experiment, parent, 'f' AS feature, round(a, 6) + 0.0 AS first, round(b, 6) + 0.0 AS second FROM z""")
def scale_per_feature(df: DataFrame) -> DataFrame:
    values = df.select(*K, F.create_map(F.lit("f"), F.array("area", "x_pos")).alias("values"))
    return v.scale_per_feature(values, "values").select(*K, "feature", F.get("vector", 0).alias("first"), F.get("vector", 1).alias("second"))


@query("v_a", "v_b", sql="SELECT experiment, parent, CASE WHEN a.parent % 4 = 1 THEN CAST(2 AS INT) ELSE CAST(4 AS INT) END AS length, a.parent % 4 <> 1 AS complete FROM v_a a JOIN v_b b USING (experiment, parent)")
def concat_emb_fit(a: DataFrame, b: DataFrame) -> DataFrame:
    both = lambda df, gap: df.select(*K, F.create_map(F.lit("p"), F.array("area"), F.lit("q"), F.when(~gap, F.array("x_pos"))).alias("values"))
    return v.concat_emb_fit(both(a, F.lit(False)), both(b, F.col("parent") % 4 == 1), "values", ["p", "q"]).select(*K, F.size("vector").alias("length"), "complete")


@query("v_tracks", sql="SELECT experiment, parent, round(avg(area), 6) + 0.0 AS area, round(avg(intensity), 6) + 0.0 AS intensity FROM v_tracks GROUP BY ALL")
def mean_fallback(df: DataFrame) -> DataFrame:
    values = v.mean_fallback(df, ["area", "intensity"])
    return values.select(*K, F.element_at("values", "area")[0].alias("area"), F.element_at("values", "intensity")[0].alias("intensity"))


_MASKS = "a AS (SELECT DISTINCT frame, y, x FROM v_pixels WHERE label < 5), b AS (SELECT DISTINCT frame, y - 1 AS y, x FROM v_pixels WHERE label < 6 AND y >= 1 AND y < 51)"
_OVERLAY = f"""{_MASKS},
o AS (SELECT coalesce(a.frame, b.frame) AS frame, count(*) FILTER (WHERE a.y IS NOT NULL AND b.y IS NOT NULL) AS intersection, count(*) AS "union", count(a.y) AS n_a, count(b.y) AS n_b FROM a FULL JOIN b ON a.frame = b.frame AND a.y = b.y AND a.x = b.x GROUP BY 1)"""


def _masks(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("label < 5"), v.shift_pixels(df.where("label < 6"), 1, 50)


@query("v_pixels", sql=f'WITH {_OVERLAY} SELECT frame, intersection, "union", intersection / "union" AS iou, 2 * intersection / (n_a + n_b) AS dice FROM o', doubles="iou dice")
def overlay_metrics(df: DataFrame) -> DataFrame:
    return v.overlay_metrics(*_masks(df))


@query("v_pixels", sql=f'WITH {_OVERLAY} SELECT \'shift\' AS algorithm, avg(intersection / "union") AS iou_mean, stddev_samp(intersection / "union") AS iou_std, avg(2 * intersection / (n_a + n_b)) AS dice_mean, stddev_samp(2 * intersection / (n_a + n_b)) AS dice_std, CAST(1 AS INT) AS rank FROM o', doubles="iou_mean iou_std dice_mean dice_std")
def overlay_summary(df: DataFrame) -> DataFrame:
    return v.overlay_summary(v.overlay_metrics(*_masks(df)).withColumn("algorithm", F.lit("shift")), "algorithm")


@query("v_pixels", sql="SELECT frame, label, y - 3 AS y, x, count(*) AS n FROM v_pixels WHERE y - 3 >= 0 AND y - 3 < 40 GROUP BY ALL")
def shift_pixels(df: DataFrame) -> DataFrame:
    return v.shift_pixels(df, 3, 40).groupBy("frame", "label", "y", "x").agg(F.count("*").alias("n"))


@query("v_pixels", sql="""
WITH s AS (SELECT frame, label, count(*) AS n_pixels, avg(y) AS cy, avg(x) AS cx, sum(intensity * y) AS wy, sum(intensity * x) AS wx, sum(intensity) AS intensity_sum, min(intensity) AS intensity_min, max(intensity) AS intensity_max, avg(intensity) AS intensity_mean,
  quantile_cont(intensity, 0.5) AS intensity_median, stddev_pop(intensity) AS intensity_std, var_samp(y) AS vy, var_samp(x) AS vx, covar_samp(y, x) AS c FROM v_pixels GROUP BY ALL),
e AS (SELECT *, (vy + vx) / 2 AS h, sqrt(power((vy - vx) / 2, 2) + c * c) AS r FROM s)
SELECT frame, label, n_pixels, cy, cx, intensity_sum, intensity_min, intensity_max, intensity_mean, intensity_median, intensity_std, wy / intensity_sum AS wy, wx / intensity_sum AS wx, 2 * sqrt(h + r) AS major_axis, 2 * sqrt(greatest(h - r, 0)) AS minor_axis,
  0.5 * atan2(2 * c, vx - vy) AS direction, 1 - sqrt(greatest(h - r, 0)) / nullif(sqrt(h + r), 0) AS ellipticity FROM e""", doubles="cy cx intensity_sum intensity_min intensity_max intensity_mean intensity_median intensity_std wy wx major_axis minor_axis direction ellipticity")
def region_props(df: DataFrame) -> DataFrame:
    return v.region_props(df)
