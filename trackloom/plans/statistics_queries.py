"""Queries on hypothesis tests and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import tails
from trackloom.operators import statistics as s
from trackloom.operators import tables as j
from trackloom.plans.registry import query
from trackloom.plans.table_queries import MEANS, conditions

LONG = "l AS (SELECT experiment, cluster, 'area' AS feature, area AS value FROM v_cells UNION ALL SELECT experiment, cluster, 'intensity', intensity FROM v_cells)"
ANOVA = """
g AS (SELECT feature, {g}, count(*) AS n, avg({v}) AS mean, var_samp({v}) AS var FROM {t} WHERE {v} IS NOT NULL GROUP BY ALL), w AS (SELECT feature, avg({v}) AS grand FROM {t} GROUP BY feature),
a AS (SELECT feature, sum(n * power(mean - grand, 2)) AS ss_between, sum((n - 1) * var) AS ss_within, count(*) - 1 AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within FROM g JOIN w USING (feature) GROUP BY feature),
o AS (SELECT feature, ss_between, ss_within, df_between, df_within, ss_between + ss_within AS ss_total, ss_between / df_between AS ms_between, ss_within / df_within AS ms_within, (ss_between / df_between) / (ss_within / df_within) AS f FROM a)"""


def _long(cells: DataFrame) -> DataFrame:
    return j.melt(cells, ["experiment", "parent", "cluster"], ["area", "intensity"])


@query("v_tracks")
def corr_treatments_with_p(df: DataFrame) -> DataFrame:
    return s.corr_tests(j.corr_between(conditions(df), "name", MEANS))


@query("v_tracks", sql="""
WITH c AS (SELECT experiment, cha1_category, count(*) AS n FROM v_tracks GROUP BY ALL), r AS (SELECT experiment, sum(n) AS r FROM c GROUP BY ALL), k AS (SELECT cha1_category, sum(n) AS k FROM c GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c),
x AS (SELECT coalesce(n, 0) AS n, r * k / t AS e, t FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c USING (experiment, cha1_category)),
s AS (SELECT sum(power(n - e, 2) / e) AS chi2, CAST(max(t) AS BIGINT) AS n FROM x), d AS (SELECT (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM k) AS nk)
SELECT chi2, (nr - 1) * (nk - 1) AS dof, n, sqrt(chi2 / (n * (least(nr, nk) - 1))) AS cramers_v FROM s, d""", doubles="chi2 cramers_v")
def chi2_cramers(df: DataFrame) -> DataFrame:
    return s.chi2_cramers(df, "experiment", "cha1_category")


@query("v_tracks", sql="""
WITH c AS (SELECT experiment, parent % 2 AS a, CASE WHEN cha1_category = 'High' THEN 1 ELSE 0 END AS b, count(*) AS n FROM v_tracks GROUP BY ALL), x AS (SELECT experiment, n, sum(n) OVER (PARTITION BY experiment, a) AS r, sum(n) OVER (PARTITION BY experiment, b) AS k, sum(n) OVER (PARTITION BY experiment) AS t FROM c)
SELECT experiment, sum(power(abs(n - r * k / t) - least(0.5, abs(n - r * k / t)), 2) / (r * k / t)) AS chi2, CAST(1 AS BIGINT) AS dof, CAST(max(t) AS BIGINT) AS n, sqrt(sum(power(abs(n - r * k / t) - least(0.5, abs(n - r * k / t)), 2) / (r * k / t)) / max(t)) AS cramers_v FROM x GROUP BY experiment""", doubles="chi2 cramers_v")
def chi2_per_group(df: DataFrame) -> DataFrame:
    halves = df.select("experiment", (F.col("parent") % 2).alias("a"), (F.col("cha1_category") == "High").cast("int").alias("b"))
    return s.chi2_cramers(halves, "a", "b", ["experiment"])


@query("v_tracks")
def chi2_with_p(df: DataFrame) -> DataFrame:
    return s.with_p(s.chi2_cramers(df, "experiment", "cha1_category"), "p", tails.chi2_sf, "chi2", "dof")


@query("v_tracks")
def perm_test(df: DataFrame) -> DataFrame:
    return s.perm_test(df.withColumn("half", F.col("parent") % 2), "half", "cha1_category", "experiment", 100)


@query("v_tracks", sql="""
WITH g AS (SELECT experiment, count(*) AS n FROM v_tracks WHERE area IS NOT NULL GROUP BY ALL), p AS (SELECT a.experiment AS a, b.experiment AS b, a.n AS n_a, b.n AS n_b FROM g a JOIN g b ON a.experiment < b.experiment),
u AS (SELECT a, b, n_a, n_b, area AS v, 1.0 / n_a AS w FROM p JOIN v_tracks t ON t.experiment = a WHERE area IS NOT NULL UNION ALL SELECT a, b, n_a, n_b, area, -1.0 / n_b FROM p JOIN v_tracks t ON t.experiment = b WHERE area IS NOT NULL),
s AS (SELECT a, b, n_a, n_b, v, sum(w) AS w FROM u GROUP BY ALL), d AS (SELECT *, sum(w) OVER o AS d, lead(v) OVER o - v AS width FROM s WINDOW o AS (PARTITION BY a, b ORDER BY v))
SELECT a, b, n_a, n_b, sum(abs(d) * width) AS wasserstein, max(abs(d)) AS ks, sqrt(2 * sum(d * d * width)) AS energy FROM d GROUP BY ALL""", doubles="wasserstein ks energy")
def dist_shift(df: DataFrame) -> DataFrame:
    return s.dist_shift(df, "area", "experiment")


@query("v_tracks")
def dist_shift_with_p(df: DataFrame) -> DataFrame:
    return s.with_p(s.dist_shift(df, "intensity", "experiment"), "p", tails.ks_sf, "ks", "n_a", "n_b")


@query("v_cells", sql=f"WITH {LONG}, {ANOVA.format(g='cluster', v='value', t='l')} SELECT * FROM o", doubles="ss_between ss_within ss_total ms_between ms_within f")
def anova_oneway(df: DataFrame) -> DataFrame:
    return s.anova_oneway(_long(df), "value", "cluster", ["feature"])


@query("v_cells")
def anova_oneway_with_p(df: DataFrame) -> DataFrame:
    return s.bh_fdr(s.with_p(s.anova_oneway(_long(df), "value", "experiment", ["feature"]), "p", tails.f_sf, "f", "df_between", "df_within"), "p")


@query("v_cells", sql=f"""
WITH {LONG}, m AS (SELECT feature, experiment, quantile_cont(value, 0.5) AS m FROM l GROUP BY ALL), z AS (SELECT l.feature, l.experiment, abs(value - m) AS value FROM l JOIN m USING (feature, experiment)), {ANOVA.format(g='experiment', v='value', t='z')} SELECT * FROM o""", doubles="ss_between ss_within ss_total ms_between ms_within f")
def levene(df: DataFrame) -> DataFrame:
    return s.levene(_long(df), "value", "experiment", ["feature"])


@query("v_cells", sql=f"WITH {LONG} SELECT feature, experiment, count(value) AS n, var_samp(value) AS var, stddev_samp(value) AS std, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, quantile_cont(value, 0.5) AS median, avg(value) AS mean FROM l GROUP BY ALL", doubles="var std iqr median mean")
def group_spread(df: DataFrame) -> DataFrame:
    return s.spread(_long(df), "value", "experiment", ["feature"])


@query("v_tracks")
def block_bootstrap(df: DataFrame) -> DataFrame:
    return s.block_bootstrap(df.withColumn("half", F.col("parent") % 2), "area", "half", "experiment", 500)


@query("v_tracks", sql="""
WITH p AS (SELECT experiment, time_index, CASE WHEN time_index % 9 = 0 THEN NULL ELSE (count(*) * 37 % 101 + time_index) / 300.0 END AS p FROM v_tracks GROUP BY experiment, time_index),
r AS (SELECT *, p * count(p) OVER (PARTITION BY experiment) / (rank() OVER (PARTITION BY experiment, p IS NULL ORDER BY p) + count(*) OVER (PARTITION BY experiment, p) - 1) AS r FROM p)
SELECT experiment, time_index, p, CASE WHEN p IS NOT NULL THEN least(1, min(r) OVER (PARTITION BY experiment, p IS NULL ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS q FROM r""", doubles="p q", digits=8)
def bh_fdr(df: DataFrame) -> DataFrame:
    p = df.groupBy("experiment", "time_index").agg(F.when(F.col("time_index") % 9 == 0, None).otherwise((F.count("*") * 37 % 101 + F.col("time_index")) / 300.0).alias("p"))
    return s.bh_fdr(p, "p", ["experiment"])


@query("v_cells", sql=f"""
WITH {LONG}, b AS (SELECT feature, g.e AS experiment, value, 0 AS side FROM l JOIN (SELECT DISTINCT experiment AS e FROM l WHERE experiment <> 'AF') g ON l.experiment = 'AF' UNION ALL SELECT feature, experiment, value, 1 FROM l WHERE experiment <> 'AF'),
r AS (SELECT *, rank() OVER (PARTITION BY feature, experiment ORDER BY value) + (count(*) OVER (PARTITION BY feature, experiment, value) - 1) / 2 AS r, count(*) OVER (PARTITION BY feature, experiment, value) AS t FROM b),
s AS (SELECT feature, experiment, count(*) FILTER (WHERE side = 1) AS n1, count(*) FILTER (WHERE side = 0) AS n0, sum(r) FILTER (WHERE side = 1) AS r1, sum(t * t - 1) AS ties, avg(value) FILTER (WHERE side = 1) AS m1,
  avg(value) FILTER (WHERE side = 0) AS m0, var_pop(value) FILTER (WHERE side = 1) AS v1, var_pop(value) FILTER (WHERE side = 0) AS v0 FROM r GROUP BY ALL), u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM s)
SELECT feature, experiment, n1, n0, u, (greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS z, (m1 - m0) / sqrt((v1 + v0) / 2) AS cohens_d FROM u""", doubles="u z cohens_d")
def mann_whitney(df: DataFrame) -> DataFrame:
    return s.mann_whitney(_long(df), "value", "experiment", "AF", ["feature"])


@query("v_cells")
def effect_sizes(df: DataFrame) -> DataFrame:
    return s.effect_sizes(_long(df), "value", "experiment", "AF")


@query("v_cells", sql=f"""
WITH {LONG}, {ANOVA.format(g='cluster', v='value', t='l')}, c AS (SELECT feature, count(*) AS k FROM g GROUP BY feature)
SELECT x.feature, x.cluster AS a, y.cluster AS b, y.mean - x.mean AS difference, abs(x.mean - y.mean) / sqrt(ms_within / 2 * (1.0 / x.n + 1.0 / y.n)) AS q, k, df_within FROM g x JOIN g y ON x.feature = y.feature AND x.cluster < y.cluster JOIN o ON o.feature = x.feature JOIN c ON c.feature = x.feature""", doubles="difference q")
def tukey_pairs(df: DataFrame) -> DataFrame:
    return s.tukey_pairs(_long(df), "value", "cluster", ["feature"])


@query("v_cells")
def tukey_hsd(df: DataFrame) -> DataFrame:
    return s.tukey_hsd(_long(df), "value", "cluster", ["feature"])


@query("v_cells")
def anova_twoway(df: DataFrame) -> DataFrame:
    return s.anova_twoway(_long(df), "value", "experiment", "cluster", ["feature"])


@query("v_tracks")
def kde(df: DataFrame) -> DataFrame:
    return s.kde(df, "area", "experiment")


@query("v_tracks", sql="WITH e AS (SELECT min(intensity) AS a, max(intensity) AS b FROM v_tracks) SELECT experiment, CAST(least(floor((intensity - a) / ((b - a) / 20)), 19) AS INT) AS bin, count(*) AS n FROM v_tracks, e WHERE intensity IS NOT NULL GROUP BY ALL")
def histogram(df: DataFrame) -> DataFrame:
    return s.histogram(df, "intensity", 20, ["experiment"])
