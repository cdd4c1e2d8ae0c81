"""Trajectory models: curves fitted to each track's features, their choice, and filling of gaps by the chosen model."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import tails
from trackloom.functions.columns import padded, ratio, signed_log
from trackloom.operators.tables import melt
from trackloom.operators.tracks import KEY, TIME, densify

# ---- linear family -----------------------------------------------------------------------------------------------------------

DEGREES = {"linear": 1, "quadratic": 2, "poly3": 3, "poly4": 4}


def power_sums(long: DataFrame, degree: int = 4, key: Sequence[str] = KEY) -> DataFrame:
    """For each (track, feature): n, mean m, sums of x^i and x^i y, with x the time since its first value, scaled to its span, and y the value less its mean."""
    known = long.where(F.col("value").isNotNull())
    w = Window.partitionBy(*key, "feature")
    first, last = F.min(TIME).over(w), F.max(TIME).over(w)
    xs = known.withColumns({"__x0": (F.col(TIME) - first).cast("double"), "__span": F.greatest(last - first, F.lit(1)).cast("double")})
    xs = xs.withColumns({"__x": F.col("__x0") / F.col("__span"), "__l": F.log1p("__x0"), "__m": F.avg("value").over(w)})
    y, x, l = F.col("value") - F.col("__m"), F.col("__x"), F.col("__l")  # noqa: E741
    sums = [F.sum(F.pow(x, i)).alias(f"s{i}") for i in range(1, 2 * degree + 1)] + [F.sum(F.pow(x, i) * y).alias(f"t{i}") for i in range(degree + 1)]
    logs = [F.sum(l).alias("l1"), F.sum(l * l).alias("l2"), F.sum(l * y).alias("ly")]
    return xs.groupBy(*key, "feature").agg(F.count("*").alias("n"), F.max("__span").alias("span"), F.max("__m").alias("m"), *sums, *logs, F.sum(y * y).alias("yy"), (F.max("value") - F.min("value")).alias("range"))


def fit_linear_family(long: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """track, feature, model, n, k, r2, rmse, params: linear, quadratic, poly3, poly4 and logarithm, by normal equations of the sums.

    Parameters of polynomials go from the constant up, in frames; those of the logarithm are slope (of log(t + 1)) and constant.
    """
    sums = power_sums(long, 4, key)
    names = [*key, "feature"]

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least-norm solutions of a stack of symmetric systems."""
        return (np.linalg.pinv(a, rcond=np.finfo(float).eps * a.shape[-1], hermitian=True) @ b[:, :, None])[:, :, 0] if len(a) else b

    def solve(batches):
        for pdf in batches:
            column = lambda c: pdf[c].to_numpy(float)  # noqa: B023, E731
            n, total, span, mean = (column(c) for c in ("n", "yy", "span", "m"))
            s, t = np.stack([n, *[column(f"s{i}") for i in range(1, 9)]], axis=1), np.stack([column(f"t{i}") for i in range(5)], axis=1)
            parts = []

            def add(model: str, k: int, ok: np.ndarray, a: np.ndarray, b: np.ndarray, to_params) -> None:
                w = least(a, b)
                rss = np.maximum(0.0, total[ok] - (w * b).sum(axis=1))  # noqa: B023
                r2 = np.where(total[ok] > 1e-12, 1 - rss / np.where(total[ok] > 1e-12, total[ok], 1.0), np.nan)  # noqa: B023
                parts.append(pdf.loc[ok, names].assign(model=model, n=pdf.loc[ok, "n"], k=k, r2=r2, rmse=np.sqrt(rss / n[ok]), rss=rss, range=pdf.loc[ok, "range"], params=pd.Series(list(to_params(w)), index=pdf.index[ok], dtype=object)))  # noqa: B023

            for model, d in DEGREES.items():
                ok = n > d + 1
                powers = np.arange(d + 1)
                add(model, d + 1, ok, s[ok][:, np.add.outer(powers, powers)], t[ok, : d + 1], lambda w, ok=ok, powers=powers: w / span[ok, None] ** powers + np.where(powers == 0, mean[ok, None], 0.0))  # noqa: B023
            ok = n > 2
            l1, l2 = column("l1")[ok], column("l2")[ok]
            add("log", 2, ok, np.stack([np.stack([l2, l1], axis=1), np.stack([l1, n[ok]], axis=1)], axis=1), np.stack([column("ly")[ok], t[ok, 0]], axis=1), lambda w, ok=ok: w + np.stack([np.zeros(ok.sum()), mean[ok]], axis=1))  # noqa: B023
            yield pd.concat(parts)

    kinds = ", ".join(f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in names)
    return sums.mapInPandas(solve, f"{kinds}, model string, n long, k long, r2 double, rmse double, rss double, range double, params array<double>")


# ---- nonlinear family --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """A curve with a start and bounds for its parameters. start: of (times, values)."""

    curve: Callable[..., np.ndarray]
    start: Callable[[np.ndarray, np.ndarray], list[float]]
    low: tuple[float, ...]
    high: tuple[float, ...]


def _exp(x: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(x, -50, 50))


_BIG = 1e6


def _at_most(x: np.ndarray, b: float) -> np.ndarray:
    """x to the power b, also where x is 0."""
    return np.maximum(x, 1e-9) ** np.clip(b, -8, 8)


def _line_of_logs(t: np.ndarray, y: np.ndarray) -> list[float]:
    """Start of a * exp(b * t) by the line through the logarithms of the positive values."""
    up = y > 0
    if up.sum() < 2:
        return [float(y.mean()) or 1.0, 0.01]
    slope, level = np.polyfit(t[up], np.log(y[up]), 1)
    return [float(np.exp(np.clip(level, -30, 30))), float(np.clip(slope, -1, 1))]


#: Fixed: the forms of the curves, with parameters in their order; starts and bounds are ours.
MODELS = {
    "exponential": Model(lambda t, a, b: a * _exp(b * t), _line_of_logs, (-_BIG, -1), (_BIG, 1)),
    "logarithmic": Model(lambda t, a, b: a * np.log(b * t + 1), lambda t, y: [np.ptp(y) or 1, 0.1], (-_BIG, 1e-6), (_BIG, 1e3)),
    "logistic": Model(lambda t, a, b, c: c / (1 + a * _exp(-b * t)), lambda t, y: [max(1e-3, y.max() / (y[0] or 1) - 1), 0.1, y.max() or 1], (1e-9, -10, -_BIG), (1e9, 10, _BIG)),
    "power": Model(lambda t, a, b: a * _at_most(t, b), lambda t, y: [y.mean() or 1, 0.5], (-_BIG, -5), (_BIG, 5)),
    "inverse": Model(lambda t, a, b: a / (t + b), lambda t, y: [(y[0] or 1) * max(1.0, np.ptp(t) / 4), max(1.0, np.ptp(t) / 4)], (-_BIG, 1e-3), (_BIG, _BIG)),
    "sigmoid": Model(lambda t, a, b, c, d: d + (a - d) / (1 + _at_most(t / c, b)), lambda t, y: [y[0], 2, max(1.0, t.mean()), y[-1]], (-_BIG, 0.1, 1e-3, -_BIG), (_BIG, 8, 1e4, _BIG)),
    "gompertz": Model(lambda t, a, b, c: a * _exp(-b * _exp(-c * t)), lambda t, y: [y.max() or 1, 1, 0.1], (-_BIG, -50, -5), (_BIG, 50, 5)),
    "weibull": Model(lambda t, a, b, c: a - b * _exp(-c * t**2), lambda t, y: [y[-1], y[-1] - y[0], 1 / max(1.0, t.mean()) ** 2], (-_BIG, -_BIG, 0), (_BIG, _BIG, 10)),
    "plateau": Model(lambda t, a, k, c: a * (1 - _exp(-k * t)) + c, lambda t, y: [np.ptp(y) or 1, 0.1, y[0]], (-_BIG, 0, -_BIG), (_BIG, 10, _BIG)),
}


#: Series that are fitted at once.
TOGETHER = 256


def least_squares(model: Model, t: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[list[float], float]:
    """Levenberg-Marquardt with steps clipped to the bounds; parameters and the sum of squared residuals."""
    params, rss = least_squares_of_many(model, [t], [y], rounds)
    return params[0].tolist(), float(rss[0])


def _solved(a: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of a stack of systems, and which have one."""
    try:
        return np.linalg.solve(a, g[:, :, None])[:, :, 0], np.ones(len(a), bool)
    except np.linalg.LinAlgError:
        out, ok = np.zeros_like(g), np.ones(len(a), bool)
        for i in range(len(a)):
            try:
                out[i] = np.linalg.solve(a[i], g[i])
            except np.linalg.LinAlgError:
                ok[i] = False
        return out, ok


def least_squares_of_many(model: Model, ts: Sequence[np.ndarray], ys: Sequence[np.ndarray], rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """least_squares of many series at once, each with its own steps: parameters (a row for each) and sums of squared residuals."""
    low, high = np.array(model.low), np.array(model.high)
    longest, k = max(map(len, ts)), len(low)
    t, y, there = np.ones((len(ts), longest)), np.zeros((len(ts), longest)), np.zeros((len(ts), longest), bool)
    for i, (x, v) in enumerate(zip(ts, ys, strict=True)):
        t[i, : len(x)], y[i, : len(x)], there[i, : len(x)] = x, v, True
    curve = lambda rows, p: model.curve(t[rows], *[p[:, i, None] for i in range(k)])
    p = np.clip(np.array([model.start(x, v) for x, v in zip(ts, ys, strict=True)], float), low, high)
    r = np.where(there, y - curve(slice(None), p), 0.0)
    rss, damp, open_ = (r * r).sum(axis=1), np.full(len(ts), 1e-2), np.arange(len(ts))
    for _ in range(rounds):
        if not len(open_):
            break
        q, e, w = p[open_], r[open_], there[open_]
        h = 1e-6 * np.maximum(1.0, np.abs(q))
        jac = np.stack([np.where(w, (curve(open_, q + h * (np.arange(k) == i)) - (y[open_] - e)) / h[:, i, None], 0.0) for i in range(k)], axis=1)
        a, g = jac @ jac.transpose(0, 2, 1), (jac @ e[:, :, None])[:, :, 0]
        step, ok = _solved(a + damp[open_, None, None] * np.eye(k) * np.maximum(np.diagonal(a, axis1=1, axis2=2), 1e-12)[:, :, None], g)
        new = np.clip(q + step, low, high)
        r_new = np.where(w, y[open_] - curve(open_, new), 0.0)
        rss_new = (r_new * r_new).sum(axis=1)
        better = ok & np.isfinite(rss_new) & (rss_new < rss[open_])
        done = better & (rss[open_] - rss_new < 1e-10 * rss[open_])
        at = open_[better]
        p[at], r[at], rss[at] = new[better], r_new[better], rss_new[better]
        damp[open_] = np.where(better, damp[open_] / 5, damp[open_] * 4)
        open_ = open_[ok & ~done & (better | (damp[open_] <= 1e8))]
    return p, rss


def _poly_f_p(t: np.ndarray, y: np.ndarray, k: int) -> float | None:
    """F-test of a polynomial with as many terms as the model; unrelated to the fitted curve, as in the original."""
    n, total = len(y), float(((y - y.mean()) ** 2).sum())
    if n <= k or k < 2 or total <= 0:
        return None
    x = np.vander((t - t.mean()) / (t.std() or 1), k)
    w, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss = float(((y - x @ w) ** 2).sum())
    return tails.f_sf((total - rss) / (k - 1) / max(rss / (n - k), 1e-300), k - 1, n - k)


def fit_nonlinear_family(long: DataFrame, models: Sequence[str] = tuple(MODELS), robust: bool = True, key: Sequence[str] = KEY) -> DataFrame:
    """track, feature, model, n, k, r2, rmse, poly_f_p, params: bounded least squares of each curve to each track and feature.

    robust: only fits with finite results, more rows than parameters and a positive r2. A task fits TOGETHER series at once.
    """
    names = [*key, "feature"]
    series = long.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col(TIME).isNotNull()).groupBy(*names).agg(F.sort_array(F.collect_list(F.struct(F.col(TIME).cast("double").alias("t"), F.col("value").cast("double").alias("y")))).alias("__s"))

    def fit(batches):
        for whole in batches:
            sizes = whole.column("__s").value_lengths().to_numpy()
            enough = np.argsort(sizes, kind="stable")  # series of like length go together
            enough = enough[sizes[enough] >= 3]
            for start in range(0, len(enough), TOGETHER):
                yield fitted(whole.take(pa.array(enough[start : start + TOGETHER])))

    def fitted(batch: pa.RecordBatch) -> pa.RecordBatch:
        t, y = (c.to_numpy() for c in batch.column("__s").flatten().flatten())
        cuts = np.cumsum(batch.column("__s").value_lengths().to_numpy())[:-1]
        ts, ys = [x - x[0] for x in np.split(t, cuts)], np.split(y, cuts)
        n, total = np.array([len(x) for x in ys]), np.array([((x - x.mean()) ** 2).sum() for x in ys])
        p_of: dict[tuple[int, int], float | None] = {}
        rows, out = [], {c: [] for c in ("model", "n", "k", "r2", "rmse", "rss", "range", "poly_f_p", "params")}
        for name in models:
            model = MODELS[name]
            k = len(model.low)
            with np.errstate(all="ignore"):
                params, rss = least_squares_of_many(model, ts, ys)
            for i in range(len(ys)):
                r2 = float(1 - rss[i] / total[i]) if total[i] > 1e-12 else None
                if robust and not (np.isfinite(rss[i]) and np.all(np.isfinite(params[i])) and n[i] > k and r2 is not None and r2 > 0):
                    continue
                if (i, k) not in p_of:
                    p_of[i, k] = _poly_f_p(ts[i], ys[i], k)
                rows.append(i)
                for c, x in zip(out, (name, int(n[i]), k, r2, float((rss[i] / n[i]) ** 0.5), float(rss[i]), float(np.ptp(ys[i])), p_of[i, k], params[i].tolist()), strict=True):
                    out[c].append(x)
        types = {"model": pa.string(), "n": pa.int64(), "k": pa.int64(), "params": pa.list_(pa.float64())}
        known = batch.take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([*[known.column(c) for c in names], *[pa.array(v, types.get(c, pa.float64())) for c, v in out.items()]], [*names, *out])

    kinds = ", ".join(f"`{c}` {long.schema[c].dataType.simpleString()}" for c in names)
    return series.mapInArrow(fit, f"{kinds}, model string, n long, k long, r2 double, rmse double, rss double, range double, poly_f_p double, params array<double>")


def saturation_grid(long: DataFrame, rates: Sequence[float], key: Sequence[str] = KEY) -> DataFrame:
    """The best of a grid of rates k for a + b exp(-k t): amplitude and offset in closed form from grouped sums."""
    known = long.where(F.col("value").isNotNull())
    x0 = F.min(TIME).over(Window.partitionBy(*key, "feature"))
    grid = known.withColumn("__t", (F.col(TIME) - x0).cast("double")).withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    e = F.exp(-F.col("rate") * F.col("__t"))
    fits = grid.groupBy(*key, "feature", "rate").agg(F.regr_slope(F.col("value"), e).alias("b"), F.regr_intercept(F.col("value"), e).alias("a"), F.regr_r2(F.col("value"), e).alias("r2"), F.count("*").alias("n"))
    return fits.groupBy(*key, "feature").agg(F.max_by(F.struct("rate", "a", "b", "r2", "n"), F.struct(F.coalesce("r2", F.lit(-1.0)), -F.col("rate"))).alias("m")).select(*key, "feature", "m.*")


# ---- choice ------------------------------------------------------------------------------------------------------------------


def nrmse_select(fits: DataFrame, top: int = 3, p: str | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """The best few models of each (track, feature) by RMSE over range (null where the range is zero), with their place. p: a column that must be below 0.05."""
    scored = fits.withColumn("nrmse", ratio("rmse", "range"))
    if p:
        scored = scored.where(F.col(p) < 0.05)
    order = Window.partitionBy(*key, "feature").orderBy(F.asc_nulls_last("nrmse"), "model")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def aic_select(fits: DataFrame, tracks: DataFrame | None = None, criterion: str = "aic", key: Sequence[str] = KEY) -> DataFrame:
    """The model of least n ln(rss / n) + 2 k (or k ln n) of each (track, feature). tracks (with n): those of fewer than 4 rows are too_short, those without fit no_fit."""
    penalty = 2 * F.col("k") if criterion == "aic" else F.col("k") * F.ln("n")
    score = F.col("n") * F.ln(F.greatest("rss", F.lit(1e-12)) / F.col("n")) + penalty
    best = fits.withColumn("score", score).groupBy(*key, "feature").agg(F.min(F.struct("score", "model")).alias("m")).select(*key, "feature", "m.model", "m.score")
    if tracks is None:
        return best
    joined = tracks.select(*key, "feature", F.col("n").alias("__n")).join(best, [*key, "feature"], "left")
    return joined.withColumn("model", F.when(F.col("__n") < 4, "too_short").otherwise(F.coalesce("model", F.lit("no_fit")))).drop("__n")


def predicted(model: str, params: str, t: str):
    """Column of a linear-family model's value at t."""
    p = lambda i: F.get(params, i)
    x = F.col(t).cast("double")
    poly = sum((F.coalesce(p(i), F.lit(0.0)) * F.pow(x, F.lit(float(i))) for i in range(1, 5)), p(0))
    return F.when(F.col(model) == "log", p(0) * F.log1p(x) + p(1)).otherwise(poly)


def impute(df: DataFrame, fits: DataFrame, feature: str, key: Sequence[str] = KEY) -> DataFrame:
    """impute_all of one feature, its values under its own name."""
    return impute_all(df, fits, [feature], key).select(*key, TIME, "filled", F.col("value").alias(feature))


def impute_all(df: DataFrame, fits: DataFrame, features: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """key, time, feature, value, filled: a dense grid with each feature's gaps filled inside its first and last value: by the track's best model, else linearly. Nothing outside.

    filled: observed, model, line, or null where it stays empty; tracks with fewer than two values are left as they are. All features take one pass.
    """
    best = nrmse_select(fits.where(F.col("feature").isin(*features)), 1, key=key).select(*key, "feature", "model", "params")
    dense = melt(densify(df.select(*key, TIME, *features), key), [*key, TIME], features).join(best, [*key, "feature"], "left")
    w = Window.partitionBy(*key, "feature").orderBy(TIME)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.col("value").isNotNull()
    at = F.when(known, F.col(TIME))
    whole = Window.partitionBy(*key, "feature")
    marked = dense.withColumns({"__first": F.min(at).over(whole), "__n": F.count("value").over(whole), "__t0": F.last(at, True).over(back), "__t1": F.first(at, True).over(ahead), "__v0": F.last("value", True).over(back), "__v1": F.first("value", True).over(ahead)})
    marked = marked.withColumn("__t", F.col(TIME) - F.col("__first"))
    inside = (F.col("__n") >= 2) & F.col("__t0").isNotNull() & F.col("__t1").isNotNull()
    curve = predicted("model", "params", "__t")
    line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * (F.col(TIME) - F.col("__t0")) / F.nullif(F.col("__t1") - F.col("__t0"), F.lit(0))
    filled = F.when(known, "observed").when(inside & curve.isNotNull(), "model").when(inside, "line")
    return marked.select(*key, TIME, "feature", F.when(known, F.col("value")).when(inside, F.coalesce(curve, line)).alias("value"), filled.alias("filled"))


def impute_log(imputed: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """n_observed, n_model and n_line of each track, and its method."""
    n = {k: F.count_if(F.col("filled") == k).alias(f"n_{k}") for k in ("observed", "model", "line")}
    out = imputed.groupBy(*key).agg(*n.values())
    return out.withColumn("method", F.when(F.col("n_observed") < 2, "skipped").when(F.col("n_model") > 0, "model").when(F.col("n_line") > 0, "line").otherwise("none"))


def fit_vectors(fits: DataFrame, size: int = 5, most: int = 3, z: bool = False, key: Sequence[str] = KEY) -> DataFrame:
    """key, feature, vector: parameters of up to `most` best models, padded to `size` each; missing ones are the mean of their place; sign-log1p; optionally z-scored."""
    best = nrmse_select(fits, most, key=key)
    long = best.select(*key, "feature", F.posexplode(padded("params", size)).alias("i", "p"), "place").select(*key, "feature", ((F.col("place") - 1) * size + F.col("i")).alias("pos"), "p")
    frame = best.select(*key, "feature").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(size * most - 1))))
    full = frame.join(long, [*key, "feature", "pos"], "left")
    place = Window.partitionBy("feature", "pos")
    value = signed_log(F.coalesce("p", F.avg("p").over(place), F.lit(0.0)))
    out = full.withColumn("v", value)
    if z:
        s = F.stddev_pop("v").over(place)
        out = out.withColumn("v", (F.col("v") - F.avg("v").over(place)) / F.when(s > 0, s).otherwise(1.0))
    return out.groupBy(*key, "feature").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("vector"))
