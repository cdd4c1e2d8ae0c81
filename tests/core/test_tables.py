
import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import tails
from trackloom.operators import fits, forecast
from trackloom.operators import statistics as s
from trackloom.operators import tables as j
from trackloom.operators import vectors as v
from trackloom.sources import io


def test_majority_takes_the_smallest_of_equals(spark):
    df = spark.createDataFrame([("e", 1, "Pos"), ("e", 1, "Neg"), ("e", 2, None)], "experiment string, parent long, c string")
    assert {r.parent: r.c for r in j.majority(df, ["experiment", "parent"], ["c"]).collect()} == {1: "Neg"}


def test_a_track_has_one_dose(spark):
    cells = spark.createDataFrame([("e", 1)], "experiment string, parent long")
    dose = spark.createDataFrame([("e", 1, 1), ("e", 1, 2)], "experiment string, parent long, d int")
    with pytest.raises(ValueError):
        j.join_dose(cells, dose)


def test_fdr(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double")
    assert {r.p: r.q for r in s.bh_fdr(df, "p").collect()} == {0.01: pytest.approx(0.03), 0.03: pytest.approx(0.04), 0.04: pytest.approx(0.04), None: None}


def test_anova(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 3.0), ("b", 4.0)], "g string, v double")
    r = s.anova_oneway(df, "v", "g").first()
    assert (r.ss_between, r.ss_within, r.f, r.df_between, r.df_within) == (pytest.approx(1.5), pytest.approx(4.0), pytest.approx(1.5), 1, 4)
    assert r.ss_total == pytest.approx(r.ss_between + r.ss_within)
    two = s.anova_twoway(df.withColumns({"h": F.when(F.col("v") > 2, "x").otherwise("y"), "feature": F.lit("f")}), "v", "g", "h", ["feature"])
    assert two.count() == 4


def test_ranks(spark):
    df = spark.createDataFrame([("r", 1.0), ("r", 2.0), ("r", 2.0), ("g", 2.0), ("g", 3.0), ("g", 4.0)], "g string, v double")
    r = s.mann_whitney(df, "v", "g", "r").first()
    assert r.u == 8.0  # 9 - 1, the reference's own being 1


def test_distances(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 2.0), ("b", 3.0)], "g string, v double")
    r = s.dist_shift(df, "v", "g").first()
    assert (r.wasserstein, r.ks) == (pytest.approx(2.0), pytest.approx(1.0))
    same = df.unionByName(df.withColumn("g", F.concat("g", F.lit("2"))))
    assert {(r.a, r.b): r.wasserstein for r in s.dist_shift(same, "v", "g").collect()}[("a", "a2")] == 0.0


def test_chi2(spark):
    cells = {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 20, ("b", "y"): 10}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "g string, l string")
    assert s.chi2_cramers(df, "g", "l", yates=False).first().chi2 == pytest.approx(6.6667, abs=1e-4)
    assert s.chi2_cramers(df, "g", "l").first().chi2 == pytest.approx(5.4)
    assert s.perm_test(df.withColumn("e", F.lit("e")), "g", "l", "e", 200).first().p < 0.1


def test_tails():
    assert tails.normal_sf(1.959964) == pytest.approx(0.025, abs=1e-6)
    assert tails.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and tails.chi2_sf(18.30704, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.f_sf(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.t_sf2(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.tukey_sf(3.877, 3, 10) == pytest.approx(0.05, abs=2e-3) and tails.tukey_sf(3.314, 3, 1e6) == pytest.approx(0.05, abs=2e-3)
    assert tails.ks_sf(1.0, 50, 50) < 1e-6


def test_percentages_sum(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1)], "g string, c int")
    sums = j.contingency(df, "g", "c").groupBy("g").agg(F.sum("row_pct").alias("s")).collect()
    assert {r.s for r in sums} == {100.0}


def test_empty_masks(spark):
    empty = spark.createDataFrame([], "frame int, y int, x int")
    one = spark.createDataFrame([(1, 0, 0)], "frame int, y int, x int")
    assert v.overlay_metrics(empty, empty).count() == 0
    r = v.overlay_metrics(one, empty).first()
    assert (r.iou, r.dice) == (0.0, 0.0)


def test_fits_find_their_curves(spark):
    t = np.arange(1, 41)
    curves = {"linear": 2 + 0.5 * (t - 1), "poly4": 1 + 0.1 * (t - 1) - 0.02 * (t - 1.0) ** 2 + 1e-5 * (t - 1.0) ** 4, "log": 3 * np.log1p(t - 1) + 1}
    rows = [("e", i, name, int(k), float(y)) for i, (name, ys) in enumerate(curves.items()) for k, y in zip(t, ys, strict=True)]
    long = spark.createDataFrame(rows, "experiment string, parent int, feature string, time_index int, value double")
    made = {(r.feature, r.model): r for r in fits.fit_linear_family(long).collect()}
    assert made["linear", "linear"].params == pytest.approx([2, 0.5], abs=1e-5)
    assert made["log", "log"].params == pytest.approx([3, 1], abs=1e-5)
    assert made["poly4", "poly4"].r2 == pytest.approx(1, abs=1e-6)
    best = {r.feature: r.model for r in fits.aic_select(fits.fit_linear_family(long)).collect()}
    assert best["log"] == "log" and best["poly4"] == "poly4"


def test_nonlinear(spark):
    t = np.arange(0, 60)
    y = 10 / (1 + np.exp(-0.3 * (t - 25))) + 2
    long = spark.createDataFrame([("e", 1, "f", int(k), float(x)) for k, x in zip(t, y, strict=True)], "experiment string, parent int, feature string, time_index int, value double")
    made = {r.model: r for r in fits.fit_nonlinear_family(long).collect()}
    assert made["sigmoid"].r2 > 0.999 and made["sigmoid"].params[2] == pytest.approx(25, abs=0.2)  # the form has its middle as third parameter


def test_imputing_stays_inside(spark):
    df = spark.createDataFrame([("e", 1, i, v) for i, v in [(0, None), (1, 1.0), (3, 3.0), (4, None)]] + [("e", 2, 0, 5.0), ("e", 2, 2, None)], "experiment string, parent int, time_index int, v double")
    long = df.selectExpr("experiment", "parent", "'v' as feature", "time_index", "v as value")
    out = {(r.parent, r.time_index): (r.filled, r.v) for r in fits.impute(df, fits.fit_linear_family(long), "v").collect()}
    assert out == {(1, 0): (None, None), (1, 1): ("observed", 1.0), (1, 2): ("line", 2.0), (1, 3): ("observed", 3.0), (1, 4): (None, None), (2, 0): ("observed", 5.0), (2, 1): (None, None), (2, 2): (None, None)}


def test_baselines(spark):
    df = spark.sql("select 'a' as unique_id, date_add(date'2024-01-01', cast(id as int)) as ds, cast(id % 7 as double) as y from range(30)")
    windows = forecast.backtest_windows(df, 7, 14, 7)
    metrics = {r.model: r for r in forecast.forecast_metrics(forecast.baseline_forecasts(df, windows), ["model"]).collect()}
    assert metrics["seasonal_naive"].mae == 0.0 and metrics["window_average"].mae == pytest.approx(12 / 7)
    assert forecast.best_model(forecast.forecast_metrics(forecast.baseline_forecasts(df, windows)), metric="mae").first().model == "seasonal_naive"
    with pytest.raises(ValueError):
        forecast.series_quality(df, 7, resample=True, regressors=["y"])


def test_ridge(spark):
    df = spark.sql("select 'a' as g, cast(id as int) as t, sin(id) as y from range(60) union all select 'b', cast(id as int), 1.0 from range(3)")
    got = {r.g: r.mae for r in forecast.lag_ridge(df, "y", ["g"], "t", alpha=1e-6).collect()}
    assert got["a"] < 1e-4 and got["b"] is None


def test_formulas(spark):
    df = spark.createDataFrame([(4.0, 3.0)], "a double, `b c` double")
    value = lambda text: df.select(io.formula(text, df.columns)).first()[0]
    assert value("sqrt(A) + `b c`**2 * -1") == -7.0 and value('where(a > 3, COL("b c"), 0) % 2') == 1.0 and value("clip(a, 0, 2) / (a - 4)") is None
    with pytest.raises(KeyError):
        io.formula("zz + 1", df.columns)


def test_files(spark, tmp_path):
    (tmp_path / "B02_run_summary.csv").write_text("Unnamed: 0,Parent,TimeIndex,dt,Area\n0,p1,1,45,2.5\n1,p1,2,45,oops\n")
    (tmp_path / "C03_summary.csv").write_text("Parent,TimeIndex,dt,Speed\np2,1,45,inf\n")
    one = io.source_name_column(spark.read.option("header", True).csv(str(tmp_path / "B02_run_summary.csv")))
    assert {r.Experiment for r in one.collect()} == {"B02_run"}
    both = io.union_runs(spark, [str(tmp_path / "B02_run_summary.csv"), str(tmp_path / "C03_summary.csv")])
    rows = {(r.Parent, r.TimeIndex): (r.Area, r.Speed) for r in both.collect()}
    assert rows == {("p1", 1): (2.5, None), ("p1", 2): (None, None), ("p2", 1): (None, None)}
    assert both.schema["TimeIndex"].dataType.simpleString() == "int" and io.features(both) == ["Area", "Speed"]
    io.write_tracks(both.withColumn("Experiment", F.lit("e")), str(tmp_path / "out"))
    assert io.read_tracks(spark, str(tmp_path / "out")).count() == 3
    assert io.file_paths(spark, str(tmp_path), "*.csv").count() == 2


@pytest.mark.parametrize(("name", "params"), [
    ("exponential", [3.0, -0.05]), ("logarithmic", [4.0, 0.5]), ("logistic", [9.0, 0.3, 20.0]), ("power", [2.0, 0.7]), ("inverse", [50.0, 6.0]), ("sigmoid", [1.0, 3.0, 12.0, 9.0]),
    ("gompertz", [12.0, 3.0, 0.2]), ("weibull", [8.0, 5.0, 0.01]), ("plateau", [5.0, 0.2, 1.0]),
])
def test_curves_come_back(name, params):
    import numpy as np

    t = np.arange(40.0)
    got, rss = fits.least_squares(fits.MODELS[name], t, fits.MODELS[name].curve(t, *params), 300)
    assert got == pytest.approx(params, rel=1e-3) and rss < 1e-6


def test_residuals_of_large_means(spark):
    """A small wave around a large mean: residuals as numpy has them."""
    import numpy as np

    t = np.arange(60)
    y = 1e7 + np.sin(t) * 1e-3 + 1e-4 * t
    long = spark.createDataFrame([("e", 1, int(i), "f", float(v)) for i, v in zip(t, y)], "experiment string, parent long, time_index int, feature string, value double")
    rows = {r.model: r for r in fits.fit_linear_family(long).collect()}
    for model, degree in fits.DEGREES.items():
        plain = np.polyval(np.polyfit(t / 59, y - y.mean(), degree), t / 59) + y.mean()
        assert rows[model].rss == pytest.approx(((y - plain) ** 2).sum(), rel=1e-4)


def test_direct_forecasts_do_not_look_ahead(spark):
    """Values from an origin on do not change its forecasts; a line is continued; the registry takes new forecasters."""
    import datetime

    from pyspark.sql import functions as F

    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i)
    rows = [("a", day(i), 2.0 * i + (5.0 if i % 3 == 0 else 0.0)) for i in range(60)] + [("b", day(i), 3.0 + 0.5 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "unique_id string, ds date, y double")
    later = df.withColumn("y", F.when(F.col("ds") >= day(40), -1000.0).otherwise(F.col("y")))
    pick = lambda x, m: {(r.unique_id, r.origin, r.step): r.forecast for r in forecast.FORECASTERS[m](x, forecast.backtest_windows(x, 3, 30, 5)).collect()}
    for m in ("dlinear", "ridge"):
        one, two = pick(df, m), pick(later, m)
        early = [k for k in one if k[1] <= 40]
        assert len(early) == 18 and all(one[k] == pytest.approx(two[k], rel=1e-6) for k in early)
        assert all(one["b", o, s] == pytest.approx(3.0 + 0.5 * (o + s - 1), abs=0.6) for _, o, s in one)
    forecast.register("nought", lambda x, w: w.select("unique_id", "origin", "step", "ds", F.col("y").alias("actual"), F.lit("x").alias("model"), F.lit(0.0).alias("forecast")))
    metrics, best = forecast.evaluate(df, forecast.Spec(horizon=3, start=30, stride=10, models=("naive", "ridge", "nought")))
    assert {r.model for r in metrics.select("model").distinct().collect()} == {"naive", "ridge", "nought"}
    assert {r.unique_id: r.model for r in best.collect()}["b"] == "ridge"
    with pytest.raises(KeyError):
        forecast.forecast(df, forecast.backtest_windows(df, 3, 30, 10), ["unknown"])


def test_nonlinear_fits_of_many_series_at_once(spark):
    rng = np.random.default_rng(3)
    ts = [np.arange(n, dtype=float) * step for n, step in ((5, 1), (30, 2), (11, 1))]
    ys = [3 + 2 * np.exp(-0.1 * t) + rng.normal(0, 0.01, len(t)) for t in ts]
    for name, model in fits.MODELS.items():
        with np.errstate(all="ignore"):
            together = fits.least_squares_of_many(model, ts, ys)
            alone = [fits.least_squares(model, t, y) for t, y in zip(ts, ys, strict=True)]
        assert np.allclose(together[1], [rss for _, rss in alone], rtol=0.05), name
    long = spark.createDataFrame([("e", i, "area", int(t), float(y)) for i, (x, v) in enumerate(zip(ts, ys, strict=True)) for t, y in zip(x, v, strict=True)] + [("e", 9, "area", 0, 1.0)], "experiment string, parent long, feature string, time_index int, value double")
    found = fits.fit_nonlinear_family(long)
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()  # no call for each series
    best = {r.parent: r.rmse for r in found.where("model = 'plateau'").collect()}
    assert best.keys() == {0, 1, 2} and max(best.values()) < 0.02
