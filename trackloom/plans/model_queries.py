"""Queries on trajectory models and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import fits as f
from trackloom.operators import forecast as fc
from trackloom.operators import tables as j
from trackloom.plans.registry import query

K = ["experiment", "parent"]


@query("v_long", sql="""
WITH x AS (SELECT *, CAST(time_index - min(time_index) OVER (PARTITION BY experiment, parent, feature) AS DOUBLE) AS t FROM v_long WHERE value IS NOT NULL)
SELECT experiment, parent, feature, count(*) AS n, regr_r2(value, t) AS r2, regr_slope(value, t) AS slope, regr_intercept(value, t) AS intercept FROM x GROUP BY ALL""", doubles="r2 slope intercept")
def fit_linear(long: DataFrame) -> DataFrame:
    fits = f.fit_linear_family(long).where("model = 'linear'")
    return fits.select(*K, "feature", "n", "r2", F.get("params", 1).alias("slope"), F.get("params", 0).alias("intercept"))


@query("v_long")
def fit_linear_family(long: DataFrame) -> DataFrame:
    return f.fit_linear_family(long)


@query("v_long")
def fit_nonlinear_family(long: DataFrame) -> DataFrame:
    return f.fit_nonlinear_family(long)


@query("v_long", sql="""
WITH x AS (SELECT *, CAST(time_index - min(time_index) OVER (PARTITION BY experiment, parent, feature) AS DOUBLE) AS t FROM v_long WHERE value IS NOT NULL),
g AS (SELECT experiment, parent, feature, rate, regr_slope(value, exp(-rate * t)) AS b, regr_intercept(value, exp(-rate * t)) AS a, regr_r2(value, exp(-rate * t)) AS r2, count(*) AS n FROM x, (SELECT unnest([0.01, 0.03, 0.1, 0.3, 1.0]) AS rate) GROUP BY ALL)
SELECT experiment, parent, feature, CAST(rate AS DOUBLE) AS rate, a, b, r2, n FROM g QUALIFY row_number() OVER (PARTITION BY experiment, parent, feature ORDER BY coalesce(r2, -1) DESC, rate) = 1""", doubles="rate a b r2")
def saturation_grid(long: DataFrame) -> DataFrame:
    return f.saturation_grid(long, [0.01, 0.03, 0.1, 0.3, 1.0])


@query("v_long")
def nrmse_select(long: DataFrame) -> DataFrame:
    return f.nrmse_select(f.fit_linear_family(long)).drop("params")


@query("v_long")
def aic_select(long: DataFrame) -> DataFrame:
    tracks = long.groupBy(*K, "feature").agg(F.count("value").alias("n"))
    return f.aic_select(f.fit_linear_family(long), tracks)


@query("v_long")
def model_shares(long: DataFrame) -> DataFrame:
    return j.share_of(f.aic_select(f.fit_linear_family(long)), ["experiment", "feature"], "model")


def _imputed(df: DataFrame, long: DataFrame) -> DataFrame:
    """Both features, one below the other."""
    return f.impute_all(df, f.fit_linear_family(long), ["area", "intensity"])


@query("v_tracks", "v_long")
def impute(df: DataFrame, long: DataFrame) -> DataFrame:
    return _imputed(df, long)


@query("v_tracks", "v_long")
def impute_log(df: DataFrame, long: DataFrame) -> DataFrame:
    return f.impute_log(_imputed(df, long), [*K, "feature"])


@query("v_long")
def fit_vectors(long: DataFrame) -> DataFrame:
    return f.fit_vectors(f.fit_linear_family(long))


# ---- forecasts ---------------------------------------------------------------------------------------------------------------

DENSE = """
e AS (SELECT unique_id, min(ds) AS a, max(ds) AS b FROM v_series GROUP BY unique_id), g AS (SELECT unique_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS ds FROM e),
d AS (SELECT g.unique_id, g.ds, coalesce(y, 0) AS y, row_number() OVER (PARTITION BY g.unique_id ORDER BY g.ds) - 1 AS n FROM g LEFT JOIN v_series s ON s.unique_id = g.unique_id AND s.ds = g.ds)"""
WINDOWS = f"""{DENSE},
z AS (SELECT unique_id, count(*) AS size FROM d GROUP BY unique_id HAVING count(*) >= 14), o AS (SELECT unique_id, unnest(range(10, size - 4 + 1, 4)) AS origin FROM z), w AS (SELECT o.unique_id, origin, CAST(step AS INT) AS step, d.ds, d.y FROM o CROSS JOIN (SELECT unnest(range(1, 5)) AS step) JOIN d ON d.unique_id = o.unique_id AND d.n = origin + step - 1)"""
FORECASTS = f"""{WINDOWS},
h AS (SELECT unique_id, n, y AS naive, avg(y) OVER (PARTITION BY unique_id ORDER BY n ROWS 6 PRECEDING) AS window_average, avg(y) OVER (PARTITION BY unique_id, n % 7 ORDER BY n ROWS 6 PRECEDING) AS swa FROM d),
f AS (SELECT w.unique_id, w.origin, w.step, w.ds, w.y AS actual, h.naive, h.window_average, s.naive AS seasonal_naive, s.swa AS seasonal_window_average FROM w LEFT JOIN h ON h.unique_id = w.unique_id AND h.n = origin - 1
  LEFT JOIN h s ON s.unique_id = w.unique_id AND s.n = origin + step - 1 - 7 * ceil(step / 7)),
m AS (SELECT unique_id, origin, step, ds, actual, model, forecast FROM (SELECT *, 'naive' AS model, naive AS forecast FROM f UNION ALL SELECT *, 'seasonal_naive', seasonal_naive FROM f UNION ALL SELECT *, 'window_average', window_average FROM f UNION ALL SELECT *, 'seasonal_window_average', seasonal_window_average FROM f))"""
METRICS = FORECASTS + """,
s AS (SELECT unique_id, model, origin, count(*) AS n, avg(power(forecast - actual, 2)) AS mse, sqrt(avg(power(forecast - actual, 2))) AS rmse, avg(abs(forecast - actual)) AS mae, avg(2 * abs(forecast - actual) / (abs(actual) + abs(forecast) + 1e-8)) AS smape,
  avg(abs(forecast - actual) / (abs(actual) + 1e-8)) AS mape FROM m WHERE forecast IS NOT NULL GROUP BY ALL HAVING count(*) >= 4)"""


def _windows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    ready = fc.dense(df, 0.0)
    return ready, fc.backtest_windows(ready, 4, 10, 4)


def _metrics(df: DataFrame) -> DataFrame:
    return fc.forecast_metrics(fc.baseline_forecasts(*_windows(df)), horizon=4)


@query("v_series", sql="SELECT unique_id, ds, y, CASE WHEN row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) <= 3 THEN 'validation' ELSE 'train' END AS part FROM v_series", doubles="y", digits=4)
def train_val_split(df: DataFrame) -> DataFrame:
    return fc.train_val_split(df, 3)


@query("v_series", sql="""
WITH q AS (SELECT unique_id, count(*) AS n, CAST(date_diff('day', min(ds), max(ds)) + 1 AS INT) AS span, avg(CASE WHEN y < 0 THEN 1.0 ELSE 0.0 END) AS negative FROM v_series GROUP BY unique_id)
SELECT *, 1 - n / span AS missing, CASE WHEN span - 7 <= 7 THEN 'too short' WHEN 1 - n / span > 0.6 THEN 'missing dates' WHEN negative > 0.2 THEN 'negative values' END AS reason FROM q""", doubles="negative missing")
def series_quality(df: DataFrame) -> DataFrame:
    return fc.series_quality(df, 7, resample=True, most_missing=0.6)


@query("v_series", sql=f"WITH {DENSE} SELECT unique_id, ds, y FROM d", doubles="y", digits=4)
def dense_series(df: DataFrame) -> DataFrame:
    return fc.dense(df, 0.0)


@query("v_series", sql=f"WITH {WINDOWS} SELECT unique_id, CAST(origin AS BIGINT) AS origin, step, ds, y FROM w", doubles="y", digits=4)
def backtest_windows(df: DataFrame) -> DataFrame:
    return _windows(df)[1].select("unique_id", "origin", "step", "ds", "y")


@query("v_series", sql=f"WITH {FORECASTS} SELECT unique_id, CAST(origin AS BIGINT) AS origin, step, ds, actual, model, forecast FROM m", doubles="actual forecast", digits=4)
def baseline_forecasts(df: DataFrame) -> DataFrame:
    return fc.baseline_forecasts(*_windows(df))


@query("v_series", sql=f"WITH {METRICS} SELECT unique_id, model, CAST(origin AS BIGINT) AS origin, n, mse, rmse, mae, smape, mape FROM s", doubles="mse rmse mae smape mape", digits=10, significant=True)
def forecast_metrics(df: DataFrame) -> DataFrame:
    return _metrics(df)


@query("v_series")
def forecast_metrics_whole(df: DataFrame) -> DataFrame:
    return _metrics(df)


@query("v_series", sql=f"""
WITH {METRICS}, a AS (SELECT unique_id, model, avg(mae) AS score FROM s GROUP BY ALL) SELECT unique_id, model, score FROM a QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY score, model) = 1""", doubles="score", digits=7)
def best_model(df: DataFrame) -> DataFrame:
    return fc.best_model(_metrics(df), metric="mae")


@query("v_series", sql=f"""
WITH {METRICS}, a AS (SELECT unique_id, model, round(avg(mae), 6) AS score FROM s GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY unique_id ORDER BY score) AS place FROM a) SELECT model, count(*) AS wins FROM r WHERE place = 1 GROUP BY model""")
def top_models(df: DataFrame) -> DataFrame:
    means = _metrics(df).groupBy("unique_id", "model").agg(F.round(F.avg("mae"), 6).alias("mae"))
    return fc.wins(fc.best_model(means, metric="mae", rank=True))


@query("v_series", sql=f"""
WITH {METRICS}, a AS (SELECT unique_id, model, avg(mae) AS score FROM s GROUP BY ALL),
p AS (SELECT b.unique_id, b.model AS baseline, round((b.score - c.score) / nullif(b.score, 0) * 100, 2) AS pct FROM a b LEFT JOIN a c ON c.unique_id = b.unique_id AND c.model = 'seasonal_window_average' WHERE b.model IN ('naive', 'window_average'))
SELECT baseline, avg(pct) AS mean_pct_lower, count(pct) AS n_series FROM p GROUP BY baseline""", doubles="mean_pct_lower", digits=3)
def percent_lower(df: DataFrame) -> DataFrame:
    return fc.percent_lower(_metrics(df), "seasonal_window_average", ["naive", "window_average"])


@query("v_series", sql=f"""
WITH {METRICS}, a AS (SELECT unique_id, model, avg(mae) AS metric FROM s GROUP BY ALL), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY metric, model) = 1)
SELECT m.unique_id, model, CAST(origin AS BIGINT) AS origin, step, ds, actual, forecast, metric FROM m JOIN b USING (unique_id, model)""", doubles="actual forecast metric", digits=10, significant=True)
def forecast_best_join(df: DataFrame) -> DataFrame:
    forecasts = fc.baseline_forecasts(*_windows(df))
    return j.forecast_best_join(fc.forecast_metrics(forecasts, horizon=4).select("unique_id", "model", F.col("mae").alias("metric")), forecasts)


@query("v_tracks")
def lag_ridge(df: DataFrame) -> DataFrame:
    return fc.lag_ridge(df, "area", K, "time_index")


@query("v_series")
def dlinear_baseline(df: DataFrame) -> DataFrame:
    return fc.dlinear(*_windows(df))


@query("v_series")
def run_forecast(df: DataFrame) -> DataFrame:
    return fc.evaluate(df)[1]


@query("v_series", sql="SELECT unique_id, CAST(DATE '2020-01-01' + CAST(row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS INT) AS DATE) AS ds, y FROM v_series WHERE unique_id IN ('1', '2', '3', '7')", doubles="y", digits=4)
def panel_prepare(df: DataFrame) -> DataFrame:
    return fc.panel_prepare(df, ["1", "2", "3", "7"])
