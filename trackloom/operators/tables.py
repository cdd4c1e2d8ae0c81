"""Joins of track tables with doses and with each other, and grouped summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.columns import base_of, padded_well, ratio, treatment_of
from trackloom.operators import order
from trackloom.operators.storage import kept
from trackloom.operators.tracks import KEY, TIME


def melt(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """keys, feature, value: a row for each feature."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(list(keys), list(features), "feature", "value")


def mode_of(column: str) -> Column:
    """The most frequent value among those counted in n; the smallest of equals. For groups of (value, n)."""
    return F.min_by(column, F.struct(-F.col("n"), F.col(column)))


# ---- doses -------------------------------------------------------------------------------------------------------------------


def majority(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The most frequent non-null value of each column within the keys; the smallest of equals."""
    stacked = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns])).alias("x")).select(*keys, "x.c", "x.v")
    counts = stacked.where(F.col("v").isNotNull()).groupBy(*keys, "c", "v").agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(*[F.min_by(F.when(F.col("c") == c, F.col("v")), F.when(F.col("c") == c, F.struct(-F.col("n"), F.col("v")))).alias(c) for c in columns])
    return best


def dose_summary(df: DataFrame, norms: Sequence[str], categories: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """n_frames, mean of the norms and majority of the categories of each track."""
    means = df.groupBy(*key).agg(F.count("*").alias("n_frames"), *[F.avg(c).alias(c) for c in norms])
    return means.join(majority(df, key, categories), list(key), "left")


def duplicate_keys(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def join_dose(cells: DataFrame, dose: DataFrame, key: Sequence[str] = KEY, check: bool = True) -> DataFrame:
    """Cells with their track's dose. A track with two doses is an error."""
    if check and not duplicate_keys(dose, key).isEmpty():
        raise ValueError("a track has more than one dose")
    return cells.join(dose, list(key), "left")


def join_categories_by_time(df: DataFrame, categories: DataFrame, column: str, by: Sequence[str] = ("parent", TIME)) -> DataFrame:
    """A column by track and time: the new table's value (the smallest, if it has several), else the old, else NA."""
    new = categories.groupBy(*by).agg(F.min(column).alias("__new"))
    old = F.col(column) if column in df.columns else F.lit(None).cast("string")
    return df.join(new, list(by), "left").withColumn(column, F.coalesce("__new", old, F.lit("NA"))).drop("__new")


def join_dose_fuzzy(df: DataFrame, dose: DataFrame, id_column: str = "experiment") -> DataFrame:
    """The dose's id for each id of df, by tier: 1 equal, 2 holding the padded well, 3 one holding the other. Of several the smallest.

    Only distinct ids are compared, whose number does not grow with the rows.
    """
    ids, names = df.select(id_column).distinct(), dose.select(F.col(id_column).alias("name")).distinct()
    a, b = F.col(id_column), F.col("name")
    tier = F.when(a == b, 1).when(F.contains(a, padded_well(b)), 2).when(F.contains(a, b) | F.contains(b, a), 3)
    pairs = ids.join(F.broadcast(names), tier.isNotNull()).select(id_column, "name", tier.alias("tier"))
    best = pairs.groupBy(id_column).agg(F.min(F.struct("tier", "name")).alias("m"))
    return best.select(id_column, "m.name", "m.tier")


def lookup_norm(sheet: DataFrame, norms: DataFrame, by: Sequence[str], column: str, category: Column) -> DataFrame:
    """Normalised values pushed onto another sheet by key, and binned again."""
    return sheet.join(norms.select(*by, column), list(by), "left").withColumn("category", category)


def broadcast_labels(df: DataFrame, labels: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Track-level labels on every row; rows of tracks without labels keep nulls."""
    return df.join(labels, list(key), "left")


def dose_combos_present(df: DataFrame, combo: str, by: str = "experiment") -> DataFrame:
    """The sorted combos of each group, those of nothing but NA left out, and the most frequent."""
    counts = df.where(F.col(combo).rlike("[^NA_]")).groupBy(by, combo).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.sort_array(F.collect_set(combo)).alias("combos"), mode_of(combo).alias("dominant"))


# ---- two tables --------------------------------------------------------------------------------------------------------------


def compare_sources(a: DataFrame, b: DataFrame, keys: Sequence[str], everything: DataFrame | None = None) -> DataFrame:
    """keys and side: both, only_a, only_b, and neither for keys of `everything` that neither has."""
    left, right = a.select(*keys).distinct().withColumn("__a", F.lit(True)), b.select(*keys).distinct().withColumn("__b", F.lit(True))
    joined = left.join(right, list(keys), "full_outer")
    if everything is not None:
        joined = everything.select(*keys).distinct().join(joined, list(keys), "full_outer")
    side = F.when(F.col("__a") & F.col("__b"), "both").when(F.col("__a"), "only_a").when(F.col("__b"), "only_b").otherwise("neither")
    return joined.select(*keys, side.alias("side"))


def field_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """field, n and mean absolute difference over the keys that both have."""
    joined = melt(a, keys, fields).withColumnRenamed("value", "a").join(melt(b, keys, fields).withColumnRenamed("value", "b"), [*keys, "feature"])
    return joined.groupBy("feature").agg(F.count(F.col("a") - F.col("b")).alias("n"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_diff"))


def common_cells(a: DataFrame, b: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return a.join(b.select(*key).distinct(), list(key), "left_semi")


def unmatched(a: DataFrame, b: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return a.join(b.select(*key).distinct(), list(key), "left_anti")


def removed_series(before: DataFrame, after: DataFrame, id_column: str) -> DataFrame:
    return before.select(id_column).distinct().exceptAll(after.select(id_column).distinct())


def pair_groups(df: DataFrame, group: str) -> DataFrame:
    """All unordered pairs of groups, as a and b."""
    names = df.select(group).distinct()
    return names.select(F.col(group).alias("a")).join(names.select(F.col(group).alias("b")), F.col("a") < F.col("b"))


def positional_concat(a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rows of a and b side by side by their position in an explicit order within each group of `by`. Groups of unequal length are an error in the result: position is null on one side."""
    number = lambda order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return a.withColumn("position", number(order_a)).join(b.withColumn("position", number(order_b)), [*by, "position"], "full_outer")


def forecast_best_join(scores: DataFrame, forecasts: DataFrame, series: str = "unique_id") -> DataFrame:
    """Forecasts of each series' best model (least mean metric; ties by name)."""
    mean = scores.groupBy(series, "model").agg(F.avg("metric").alias("metric"))
    best = mean.groupBy(series).agg(F.min(F.struct("metric", "model")).alias("m")).select(series, "m.model", "m.metric")
    return forecasts.join(best, [series, "model"])


# ---- summaries ---------------------------------------------------------------------------------------------------------------


def first_row_of_cell(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Each track's first row."""
    return df.groupBy(*key).agg(F.min_by(F.struct(*[c for c in df.columns if c not in key]), TIME).alias("r")).select(*key, "r.*")


def well_profile(df: DataFrame, features: Sequence[str], nonzero: Sequence[str] = (), per_cell: Sequence[str] = (), key: Sequence[str] = KEY) -> DataFrame:
    """Means of each well: of rows, of non-zero values only (wave fields), and of the cells' first rows (per-cell fields)."""
    rows = df.groupBy(key[0]).agg(F.count("*").alias("n_rows"), *[F.avg(c).alias(c) for c in features], *[F.avg(F.nullif(F.col(c), F.lit(0))).alias(c) for c in nonzero])
    if not per_cell:
        return rows
    cells = df.groupBy(*key).agg(*[F.min_by(c, TIME).alias(c) for c in per_cell]).groupBy(key[0]).agg(F.count("*").alias("n_cells"), *[F.avg(c).alias(c) for c in per_cell])
    return rows.join(cells, key[0])


def mean_sem(df: DataFrame, by: Sequence[str | Column], feature: str, absolute: bool = False) -> DataFrame:
    """n, mean and standard error (deviation of ddof 0 by root n) of a feature in each group."""
    value = F.abs(feature) if absolute else F.col(feature)
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("sem"))


def mean_over_time(df: DataFrame, feature: str, group: str = "experiment", absolute: bool = False, dose: str | None = None) -> DataFrame:
    """mean_sem by treatment base, time and, if given, dose."""
    return mean_sem(df, [base_of(group).alias("treatment"), TIME, *([dose] if dose else [])], feature, absolute)


def well_bar(df: DataFrame, feature: str, per_cell: bool = False, dose: str | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """mean_sem by well (and dose), over rows or over each cell's first row."""
    return mean_sem(first_row_of_cell(df, key) if per_cell else df, [key[0], *([dose] if dose else [])], feature)


def pair_over_time(df: DataFrame, a: str, b: str, by: str = "experiment", absolute: bool = False) -> DataFrame:
    """Means of two features by well and time, over rows that have both."""
    f = F.abs if absolute else F.col
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(by, TIME).agg(F.count("*").alias("n"), F.avg(f(a)).alias(a), F.avg(f(b)).alias(b))


def overall_counts(df: DataFrame, columns: Mapping[str, Column], time: str = TIME) -> DataFrame:
    """variable, time (null: over all) and value: the aggregates by time and in total, from one pass with grouping sets."""
    sets = df.groupingSets([[F.col(time)], []], F.col(time)).agg(*[c.cast("double").alias(n) for n, c in columns.items()])
    return sets.unpivot([time], list(columns), "variable", "value")


def contingency(df: DataFrame, row: str, column: str, cells: Sequence[str] | None = None) -> DataFrame:
    """row, column, n, row_pct and col_pct: rows counted, or distinct cells."""
    n = F.countDistinct(*cells) if cells else F.count("*")
    counts = df.groupBy(row, column).agg(n.alias("n"))
    share = lambda c: F.col("n") * 100 / F.sum("n").over(Window.partitionBy(c))
    return counts.withColumns({"row_pct": share(row), "col_pct": share(column)})


def descriptive_by_cluster(df: DataFrame, features: Sequence[str], cluster: str, key: Sequence[str] = KEY) -> DataFrame:
    """Of the cells' means in each cluster: n, mean, std (of a sample), standard error and 95 % limits."""
    cells = df.groupBy(cluster, *key).agg(*[F.avg(c).alias(c) for c in features])
    long = melt(cells, [cluster], features)
    each = long.groupBy(cluster, "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    each = each.withColumn("se", F.col("std") / F.sqrt("n"))
    return each.withColumns({"low": F.col("mean") - 1.96 * F.col("se"), "high": F.col("mean") + 1.96 * F.col("se")})


def share_of(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """n and share of each label within the groups."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def modal(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """The most frequent label of each group, the smallest of equals."""
    return df.groupBy(*by, label).agg(F.count("*").alias("n")).groupBy(*by).agg(mode_of(label).alias(label))


def ratio_to_reference(df: DataFrame, features: Sequence[str], cluster: str, reference: int = 0) -> DataFrame:
    """Absolute mean of each feature and cluster as a percentage of the reference cluster's; null where that is zero."""
    means = melt(df, [cluster], features).groupBy("feature", cluster).agg(F.abs(F.avg("value")).alias("mean"))
    base = F.max(F.when(F.col(cluster) == reference, F.col("mean"))).over(Window.partitionBy("feature"))
    return means.withColumn("pct", ratio("mean", base) * 100)


def robust_range(df: DataFrame, feature: str, by: Sequence[str] = (), sigmas: float = 2.5) -> DataFrame:
    """low and high: minimum and maximum, clipped to the mean -+ so many deviations (ddof 0)."""
    m, s = F.avg(feature), F.stddev_pop(feature)
    return df.groupBy(*by).agg(F.greatest(F.min(feature), m - sigmas * s).alias("low"), F.least(F.max(feature), m + sigmas * s).alias("high"))


def clip_percentiles(df: DataFrame, features: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """feature, low, high and n_outside: rows outside the percentiles."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])).alias("x")).select("x.*")
    edges = order.quantiles(long, "value", {"low": low, "high": high}, ["feature"])
    joined = long.join(F.broadcast(edges), "feature", "left")  # one row for each feature
    return joined.groupBy("feature").agg(F.first("low").alias("low"), F.first("high").alias("high"), F.count_if((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias("n_outside"))


def feature_acf(df: DataFrame, feature: str, max_lag: int = 25) -> DataFrame:
    """lag and acf: correlation of the per-time mean with itself so many rows before."""
    means = df.groupBy(TIME).agg(F.avg(feature).alias("m"))
    lags = means.select(*[F.lag("m", i).over(Window.orderBy(TIME)).alias(f"l{i}") for i in range(max_lag + 1)])  # a row for each frame number
    return lags.agg(F.array(*[F.struct(F.lit(i).alias("lag"), correlation("l0", f"l{i}").alias("acf")) for i in range(1, max_lag + 1)]).alias("x")).select(F.inline("x"))


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation of two columns over rows that have both; null (not an error) where one does not vary."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def corr_matrix(df: DataFrame, features: Sequence[str], key: Sequence[str], method: str = "pearson") -> DataFrame:
    """a, b and corr of each pair of features (a < b) over rows that have both. key must identify rows.

    Spearman ranks each feature over its own values, by a sort distributed over features.
    """
    if method == "spearman":
        long = kept(melt(df, key, features).where(F.col("value").isNotNull()))  # values that are computed again may differ in the last digit and miss their rank
        ranked = long.join(order.value_ranks(long, "value", ["feature"]), ["feature", "value"]).select(*key, "feature", F.col("rank").alias("value"))
        df = ranked.groupBy(*key).pivot("feature", list(features)).agg(F.first("value"))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    return df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(a, b).alias("corr")) for a, b in pairs]).alias("x")).select(F.inline("x"))


def corr_between(df: DataFrame, name: str, features: Sequence[str], method: str = "pearson") -> DataFrame:
    """a, b, n and corr of each pair of rows (a < b by their name) over the features that both have; spearman: of their ranks within each row. Names must identify rows."""
    long = melt(df, [name], features).where(F.col("value").isNotNull())
    if method == "spearman":
        long = kept(long)  # as in corr_matrix
        long = long.join(order.value_ranks(long, "value", [name]), [name, "value"]).select(name, "feature", F.col("rank").alias("value"))
    a = long.select(F.col(name).alias("a"), "feature", F.col("value").alias("x"))
    b = long.select(F.col(name).alias("b"), "feature", F.col("value").alias("y"))
    return a.join(b, "feature").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), correlation("x", "y").alias("corr"))


def treatments(df: DataFrame, column: str, overrides: DataFrame, most: int = 100_000) -> DataFrame:
    """df with treatment: what `overrides` (id, treatment) says of its id, else what the id itself says. The map is broadcast up to `most` ids, joined beyond."""
    known = overrides.groupBy(F.col("id").alias("__id")).agg(F.min("treatment").alias("__known"))
    joined = df.join(F.broadcast(known) if known.limit(most + 1).count() <= most else known, F.col(column) == F.col("__id"), "left")
    return joined.withColumn("treatment", treatment_of(column, F.col("__known"))).drop("__id", "__known")


def agreement_score(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """n, r2, mae, slope and intercept of b against a over pairs of both; null for fewer than 3 or without variance."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ok = (F.count("*") >= 3) & (F.var_pop(a) > 0) & (F.var_pop(b) > 0)
    y, x = F.col(b), F.col(a)
    return both.groupBy(*by).agg(
        F.count("*").alias("n"), F.when(ok, F.regr_r2(y, x)).alias("r2"), F.avg(F.abs(y - x)).alias("mae"), F.when(ok, F.regr_slope(y, x)).alias("slope"), F.when(ok, F.regr_intercept(y, x)).alias("intercept"),
    )


def formula_rank(df: DataFrame, target: str, formulas: Mapping[str, Column]) -> DataFrame:
    """Candidate formulas for a target, ranked by r2, then by small mean error, then by name."""
    stacked = df.select(F.col(target).alias("__t"), F.explode(F.array(*[F.struct(F.lit(n).alias("formula"), c.cast("double").alias("v")) for n, c in formulas.items()])).alias("x")).select("__t", "x.*")
    scored = agreement_score(stacked, "v", "__t", ["formula"])
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("r2"), F.asc("mae"), "formula")))


def residual_stats(df: DataFrame, residual: str, by: Sequence[str] = (), threshold: float | None = None) -> DataFrame:
    """median, mean, p90 and p99, and the share of squared residuals under a threshold."""
    out = [F.avg(residual).alias("mean")]
    if threshold is not None:
        out.append(F.avg((F.pow(residual, 2) < threshold).cast("double")).alias("inlier_share"))
    found = order.quantiles(df, residual, {"median": 0.5, "p90": 0.9, "p99": 0.99}, by)
    stats = df.groupBy(*by).agg(*out)
    return order.beside(stats, found, by, "left") if by else stats.join(F.broadcast(found), F.lit(True), "left")  # one row each


def feature_agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """agreement_score of each feature over equal keys of two tables."""
    joined = melt(a, keys, features).withColumnRenamed("value", "a").join(melt(b, keys, features).withColumnRenamed("value", "b"), [*keys, "feature"])
    return agreement_score(joined, "a", "b", ["feature"])


def validation_metrics(a: DataFrame, b: DataFrame, feature: str, key: Sequence[str] = KEY) -> DataFrame:
    """Overlapping frames, r2 and RMSE of each track between two tables."""
    both = a.select(*key, TIME, F.col(feature).alias("a")).join(b.select(*key, TIME, F.col(feature).alias("b")), [*key, TIME])
    score = agreement_score(both, "a", "b", key).select(*key, F.col("n").alias("overlap"), "r2")
    return score.join(both.groupBy(*key).agg(F.sqrt(F.avg(F.pow(F.col("a") - F.col("b"), 2))).alias("rmse")), list(key))


def best_and_worst(scores: DataFrame, score: str, n: int, tiebreak: Sequence[str]) -> DataFrame:
    """The n best and n worst rows by a score, marked in `end`."""
    best = scores.orderBy(F.desc_nulls_last(score), *tiebreak).limit(n).withColumn("end", F.lit("best"))
    return best.unionByName(scores.orderBy(F.asc_nulls_last(score), *tiebreak).limit(n).withColumn("end", F.lit("worst")))


def standardize(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), clamp: float | None = None) -> DataFrame:
    """z-scores with deviations of ddof 0; a deviation of zero counts as 1. From one aggregate, joined back."""
    stats = df.groupBy(*by).agg(*[F.avg(c).alias(f"__m_{c}") for c in features], *[F.stddev_pop(c).alias(f"__s_{c}") for c in features])
    joined = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))  # one row
    z = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0) for c in features}
    if clamp is not None:
        z = {c: F.greatest(F.lit(-clamp), F.least(F.lit(clamp), x)) for c, x in z.items()}
    return joined.withColumns(z).drop(*[f"__{k}_{c}" for k in "ms" for c in features])


def normalised_intensity(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """norm: z-score with ddof 1 within groups, and the groups' q0.3, q0.7, mean and std."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    stats = order.beside(stats, order.quantiles(df, value, {"q30": 0.3, "q70": 0.7}, by), by, "left")
    return df.join(stats, list(by)).withColumn("norm", (F.col(value) - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)))


def max_abs_scaled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    stats = df.agg(*[F.max(F.abs(c)).alias(f"__x_{c}") for c in features])
    return df.crossJoin(F.broadcast(stats)).withColumns({c: ratio(c, f"__x_{c}") for c in features}).drop(*[f"__x_{c}" for c in features])


def zscore_profile(df: DataFrame, features: Sequence[str], cluster: str) -> DataFrame:
    """Cluster means of each feature as z-scores (ddof 1; a deviation of zero counts as 1) across clusters, with the shared colour limit."""
    means = melt(df, [cluster], features).groupBy("feature", cluster).agg(F.avg("value").alias("mean"))
    w = Window.partitionBy("feature")
    std = F.stddev_samp("mean").over(w)
    z = means.withColumn("z", (F.col("mean") - F.avg("mean").over(w)) / F.when(std > 0, std).otherwise(1.0))
    return z.withColumn("limit", F.max(F.abs("z")).over(Window.partitionBy(F.lit(0))))  # a row for each feature and cluster


def profile_matrix(df: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Conditions by features, ready for clustering: means; features without values or variance dropped; nulls 0; standardised, infinite values clamped."""
    profile = df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in features])
    seen = profile.agg(*[(F.min(c) < F.max(c)).alias(c) for c in features]).first()
    usable = [c for c in features if seen[c]]
    return standardize(profile.select(*by, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in usable]), usable, clamp=1e6)


def collapse_prefix(df: DataFrame, name: str, drop: str, start: int, length: int, well: tuple[int, int]) -> DataFrame:
    """short: the name without `drop`, cut; names that collide get their well in front."""
    short = F.substring(F.replace(F.col(name), F.lit(drop), F.lit("")), start, length)
    names = df.select(name).distinct().withColumn("short", short).withColumn("n", F.count("*").over(Window.partitionBy("short")))
    return names.select(name, F.when(F.col("n") > 1, F.concat(F.substring(name, *well), F.lit("_"), F.col("short"))).otherwise(F.col("short")).alias("short"))


def select_wells(df: DataFrame, wells: Sequence[str], position: tuple[int, int] = (16, 3), name: str = "experiment") -> DataFrame:
    return df.where(F.substring(name, *position).isin(*wells))


def select_combos(df: DataFrame, lines: Sequence[str], treatments: Sequence[str], name: str = "experiment") -> DataFrame:
    """Experiments whose id holds a cell line followed by a treatment."""
    return df.where(reduce(lambda a, b: a | b, [F.contains(F.col(name), F.lit(x + y)) for x in lines for y in treatments]))


def mask_control_channel(df: DataFrame, control: str, categories: Sequence[str], name: str = "experiment", start: int = 23) -> DataFrame:
    """Categories blanked where the id's channel code at their position is the control's."""
    return df.withColumns({c: F.when(F.substring(name, start + 4 * i, 4) == control, None).otherwise(F.col(c)) for i, c in enumerate(categories)})


def channel_report(df: DataFrame, by: str, pattern: Column) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(pattern).alias("n_kept"))

