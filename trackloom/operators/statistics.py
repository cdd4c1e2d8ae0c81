"""Hypothesis tests and distances. Rows reduce to counts, sums or ranks by features and groups in Spark; tails are evaluated on the few rows left."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions import tails
from trackloom.functions.columns import ratio
from trackloom.operators import order


def with_p(df: DataFrame, name: str, tail, *columns: str) -> DataFrame:
    """df (a few rows for each test) with the tail probability of its columns; null where one is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [None if any(pd.isna(x) for x in row) else float(tail(*row)) for row in pdf[list(columns)].itertuples(index=False)]
            yield pdf.assign(**{name: pd.Series(values, dtype="float64", index=pdf.index)})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


# ---- contingency -------------------------------------------------------------------------------------------------------------


def chi2_cramers(df: DataFrame, row: str, column: str, by: Sequence[str] = (), yates: bool = True) -> DataFrame:
    """chi2 (Yates-corrected for 2 x 2 tables), dof, n and Cramer's V of row and column within each group of `by`."""
    counts = df.groupBy(*by, row, column).agg(F.count("*").alias("n"))
    rows, cols = counts.groupBy(*by, row).agg(F.sum("n").alias("r")), counts.groupBy(*by, column).agg(F.sum("n").alias("c"))
    shape = counts.groupBy(*by).agg(F.countDistinct(row).alias("n_rows"), F.countDistinct(column).alias("n_cols"), F.sum("n").alias("total"))
    pairs = rows.join(cols, list(by)) if by else rows.crossJoin(cols)  # margins only: labels by labels
    full = pairs.join(counts, [*by, row, column], "left").fillna({"n": 0})
    full = full.join(shape, list(by)) if by else full.crossJoin(F.broadcast(shape))
    expected = F.col("r") * F.col("c") / F.col("total")
    corrected = F.lit(yates) & (F.col("n_rows") == 2) & (F.col("n_cols") == 2)
    gap = F.abs(F.col("n") - expected)
    gap = F.when(corrected, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    out = full.groupBy(*by).agg(F.sum(gap * gap / expected).alias("chi2"), F.max((F.col("n_rows") - 1) * (F.col("n_cols") - 1)).alias("dof"), F.max("total").alias("n"), (F.max(F.least("n_rows", "n_cols")) - 1).alias("__k"))
    return out.withColumn("cramers_v", F.sqrt(F.col("chi2") / F.nullif(F.col("n") * F.col("__k"), F.lit(0)))).drop("__k")


def perm_test(df: DataFrame, group: str, label: str, block: str, n_perm: int = 200, seed: int = 42) -> DataFrame:
    """chi2 of group and label, and p: the share of permutations (of labels within blocks) that reach it, (c + 1) / (n + 1).

    Rows are first counted by (block, group, label). A permutation deals a block's labels to its groups by hypergeometric draws on these counts,
    so its work does not grow with the rows.
    """
    counts = df.groupBy(block, group, label).agg(F.count("*").alias("n"))
    observed = chi2_cramers(df, group, label, yates=False).select("chi2")
    labels = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    groups = [r[0] for r in df.select(group).distinct().orderBy(group).collect()]

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index=group, columns=label, values="n", aggfunc="sum", fill_value=0).reindex(index=groups, columns=labels, fill_value=0).to_numpy().astype(np.int64)
        rng = np.random.default_rng([seed, int.from_bytes(str(pdf[block].iloc[0]).encode()[-8:], "little")])
        out = np.zeros((n_perm, len(groups), len(labels)), np.int64)
        for p in range(n_perm):
            left = table.sum(axis=0)
            for g, size in enumerate(table.sum(axis=1)):
                taken = rng.multivariate_hypergeometric(left, size) if size else np.zeros_like(left)
                out[p, g] = taken
                left = left - taken
        p, g, k = np.indices(out.shape)
        return pd.DataFrame({"perm": p.ravel(), "g": g.ravel(), "k": k.ravel(), "n": out.ravel()})

    drawn = counts.groupBy(block).applyInPandas(draw, "perm int, g int, k int, n long").groupBy("perm", "g", "k").agg(F.sum("n").alias("n"))
    r = F.sum("n").over(Window.partitionBy("perm", "g"))
    c = F.sum("n").over(Window.partitionBy("perm", "k"))
    total = F.sum("n").over(Window.partitionBy("perm"))
    e = drawn.withColumn("e", r * c / total)
    stats = e.groupBy("perm").agg(F.sum(F.pow(F.col("n") - F.col("e"), 2) / F.nullif(F.col("e"), F.lit(0.0))).alias("s"))
    return observed.crossJoin(stats).groupBy("chi2").agg(((F.count_if(F.col("s") >= F.col("chi2") - 1e-9) + 1) / F.lit(n_perm + 1)).alias("p"), F.count("*").alias("n_perm"))


def corr_tests(pairs: DataFrame) -> DataFrame:
    """Rows of n and corr with the two-sided p of no correlation (Student's t); null for fewer than three values."""
    return with_p(pairs, "p", lambda r, n: float("nan") if n < 3 else 0.0 if abs(r) >= 1 else tails.t_sf2(r * ((n - 2) / (1 - r * r)) ** 0.5, n - 2), "corr", "n")


# ---- distributions -----------------------------------------------------------------------------------------------------------


def dist_shift(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """wasserstein, ks and energy distance of each pair of groups (a < b) with at least two values each.

    Values are counted by group first. For a pair the distribution functions are running sums over the union of its values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, group, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    sizes = counts.groupBy(*by, group).agg(F.sum("n").alias("size")).where("size >= 2")
    left, right = sizes.select(*by, F.col(group).alias("a"), F.col("size").alias("n_a")), sizes.select(*by, F.col(group).alias("b"), F.col("size").alias("n_b"))
    pairs = (left.join(right, list(by)) if by else left.crossJoin(right)).where("a < b")  # groups by groups
    first = pairs.join(counts.withColumnRenamed(group, "a"), [*by, "a"]).select(*by, "a", "b", "n_a", "n_b", "v", (F.col("n") / F.col("n_a")).alias("w"))
    second = pairs.join(counts.withColumnRenamed(group, "b"), [*by, "b"]).select(*by, "a", "b", "n_a", "n_b", "v", (-F.col("n") / F.col("n_b")).alias("w"))
    steps = first.unionByName(second).groupBy(*by, "a", "b", "n_a", "n_b", "v").agg(F.sum("w").alias("w"))
    summed = order.cumulative(steps, [*by, "a", "b", "n_a", "n_b"], ["v"], around="v", w="w")
    gap = summed.withColumns({"d": F.col("w_before") + F.col("w"), "width": F.col("following") - F.col("v")})
    return gap.groupBy(*by, "a", "b", "n_a", "n_b").agg(
        F.sum(F.abs("d") * F.col("width")).alias("wasserstein"), F.max(F.abs("d")).alias("ks"), F.sqrt(2 * F.sum(F.col("d") * F.col("d") * F.col("width"))).alias("energy")
    )


def group_stats(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, variance (ddof 1) of each group: what the tests below need."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.sum(value).alias("sum"))


def anova_oneway(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Sums of squares, degrees of freedom, mean squares and F of a value over groups; nothing where a group has fewer than two values."""
    stats = group_stats(df, value, group, by)
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row for each group
    marked = stats.withColumns({"total": F.sum("n").over(whole), "grand": F.sum("sum").over(whole) / F.sum("n").over(whole)})
    out = marked.groupBy(*by).agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ss_between"), F.sum((F.col("n") - 1) * F.col("var")).alias("ss_within"), (F.count("*") - 1).alias("df_between"),
        (F.sum("n") - F.count("*")).alias("df_within"), F.min("n").alias("least"),
    ).where("least >= 2 and df_between >= 1").drop("least")
    out = out.withColumns({"ss_total": F.col("ss_between") + F.col("ss_within"), "ms_between": F.col("ss_between") / F.col("df_between"), "ms_within": F.col("ss_within") / F.col("df_within")})
    return out.withColumn("f", ratio("ms_between", "ms_within"))


def levene(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Brown-Forsythe: F of the distances from each group's median."""
    medians = order.quantiles(df, value, {"__m": 0.5}, [*by, group])
    away = df.join(medians, [*by, group]).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    return anova_oneway(away, "__d", group, by)


def spread(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """n, variance, std, interquartile range, median and mean of each group."""
    stats = df.groupBy(*by, group).agg(F.count(value).alias("n"), F.var_samp(value).alias("var"), F.stddev_samp(value).alias("std"), F.avg(value).alias("mean"))
    both = order.beside(stats, order.quantiles(df, value, {"__q1": 0.25, "median": 0.5, "__q3": 0.75}, [*by, group]), [*by, group], "left")
    return both.select(*stats.columns, (F.col("__q3") - F.col("__q1")).alias("iqr"), "median")


def block_bootstrap(df: DataFrame, value: str, group: str, block: str, draws: int = 500, seed: int = 42) -> DataFrame:
    """Mean of each group and its 95 % interval, resampling whole blocks with replacement.

    Rows are reduced to a sum and a count for each (group, block); draws pick blocks by hash.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(group, block).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    numbered = sums.withColumns({"i": F.row_number().over(Window.partitionBy(group).orderBy(block)) - 1, "k": F.count("*").over(Window.partitionBy(group))})
    picks = numbered.select(group, "k", F.col("i").alias("place"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    picks = picks.select(group, "draw", F.pmod(F.xxhash64(group, "draw", "place", F.lit(seed)), F.col("k")).cast("int").alias("i"))
    means = picks.join(numbered.select(group, "i", "s", "n"), [group, "i"]).groupBy(group, "draw").agg((F.sum("s") / F.sum("n")).alias("m"))
    ends = means.groupBy(group).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return sums.groupBy(group).agg((F.sum("s") / F.sum("n")).alias("mean"), F.count("*").alias("n_blocks")).join(ends, group)


def bh_fdr(df: DataFrame, p: str, by: Sequence[str] = (), name: str = "q") -> DataFrame:
    """Benjamini-Hochberg q of the non-null p within each group."""
    known = F.col(p).isNotNull()
    within = Window.partitionBy(*by, known) if by else Window.partitionBy(known)  # a row for each test
    falling = within.orderBy(F.desc(p))
    rank = F.rank().over(within.orderBy(p)) + F.count("*").over(Window.partitionBy(*by, p)) - 1
    ranked = df.withColumn("__r", F.col(p) * F.count("*").over(within) / rank)
    q = F.least(F.lit(1.0), F.min("__r").over(falling.rangeBetween(Window.unboundedPreceding, 0)))
    return ranked.withColumn(name, F.when(known, q)).drop("__r")


def mann_whitney(df: DataFrame, value: str, group: str, reference: str, by: Sequence[str] = ()) -> DataFrame:
    """u, z (tie-corrected, continuity-corrected) and Cohen's d (pooled variance of ddof 0) of each group against the reference."""
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    others = rows.where(F.col("g") != reference).select(*by, "g").distinct()
    mine = rows.where(F.col("g") != reference).select(*by, "g", "v", F.col("n").alias("one"), F.lit(0).cast("long").alias("zero"))
    base = rows.where(F.col("g") == reference).drop("g")
    ref = (base.join(others, list(by)) if by else base.crossJoin(F.broadcast(others))).select(*by, "g", "v", F.lit(0).cast("long").alias("one"), F.col("n").alias("zero"))  # counts, once for each other group
    both = mine.unionByName(ref).groupBy(*by, "g", "v").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero")).withColumn("t", F.col("one") + F.col("zero"))
    ranked = order.cumulative(both, [*by, "g"], ["v"], t="t").withColumn("r", F.col("t_before") + (F.col("t") + 1) / 2)
    moment = lambda k, side: F.sum(F.pow("v", F.lit(float(k))) * F.col(side)) / F.nullif(F.sum(side), F.lit(0))
    s = ranked.groupBy(*by, "g").agg(
        F.sum("one").alias("n1"), F.sum("zero").alias("n0"), F.sum(F.col("r") * F.col("one")).alias("r1"), F.sum((F.pow("t", F.lit(2.0)) - 1) * F.col("t")).alias("ties"),
        moment(1, "one").alias("m1"), moment(1, "zero").alias("m0"),
    )
    # variances about the means, from the counts
    about = order.beside(ranked, s.select(*by, "g", "m1", "m0"), [*by, "g"])
    spread_ = lambda side, m: F.sum(F.pow(F.col("v") - F.col(m), F.lit(2.0)) * F.col(side)) / F.nullif(F.sum(side), F.lit(0))
    s = order.beside(s, about.groupBy(*by, "g").agg(spread_("one", "m1").alias("v1"), spread_("zero", "m0").alias("v0")), [*by, "g"])
    n = F.col("n1") + F.col("n0")
    s = s.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    mu, sigma = F.col("n1") * F.col("n0") / 2, F.sqrt(F.col("n1") * F.col("n0") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    s = s.withColumn("z", F.when(sigma > 0, (F.greatest(F.col("u"), F.col("n1") * F.col("n0") - F.col("u")) - mu - 0.5) / sigma))
    return s.select(*by, F.col("g").alias(group), "n1", "n0", "u", "z", ratio(F.col("m1") - F.col("m0"), F.sqrt((F.col("v1") + F.col("v0")) / 2)).alias("cohens_d"))


def effect_sizes(df: DataFrame, value: str, group: str, reference: str, by: Sequence[str] = ("feature",)) -> DataFrame:
    """mann_whitney with two-sided p and q within each group."""
    tested = with_p(mann_whitney(df, value, group, reference, by), "p", lambda z: min(1.0, 2 * tails.normal_sf(z)), "z")
    return bh_fdr(tested, "p", [group])


def tukey_pairs(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of groups a < b with the studentised range statistic (Tukey-Kramer), k and the degrees of freedom."""
    stats = group_stats(df, value, group, by).select(*by, F.col(group).alias("g"), "n", "mean")
    whole = anova_oneway(df, value, group, by).select(*by, "ms_within", "df_within", (F.col("df_between") + 1).alias("k"))
    a, b = stats.select(*by, F.col("g").alias("a"), F.col("n").alias("n_a"), F.col("mean").alias("m_a")), stats.select(*by, F.col("g").alias("b"), F.col("n").alias("n_b"), F.col("mean").alias("m_b"))
    pairs = (a.join(b, list(by)) if by else a.crossJoin(b)).where("a < b")  # groups by groups
    joined = pairs.join(whole, list(by)) if by else pairs.crossJoin(F.broadcast(whole))
    se = F.sqrt(F.col("ms_within") / 2 * (1 / F.col("n_a") + 1 / F.col("n_b")))
    return joined.select(*by, "a", "b", (F.col("m_b") - F.col("m_a")).alias("difference"), ratio(F.abs(F.col("m_a") - F.col("m_b")), se).alias("q"), "k", "df_within")


def tukey_hsd(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """tukey_pairs with p, BH-adjusted over all pairs and features."""
    tested = with_p(tukey_pairs(df, value, group, by), "p", lambda q, k, dof: tails.tukey_sf(round(q, 6), int(k), float(dof)), "q", "k", "df_within")
    return bh_fdr(tested, "p", (), "p_adjusted")


def anova_twoway(df: DataFrame, value: str, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Type-II sums of squares, F and p of two factors and their interaction, for groups of at least six rows and two levels of each factor.

    Rows are reduced to count, sum and sum of squares for each (by, a, b); nested weighted least squares run on those few cells.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, a, b).agg(F.count("*").cast("double").alias("n"), F.sum(value).alias("s"), F.sum(F.pow(value, 2)).alias("ss"))
    names = list(by)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean = pdf["n"].to_numpy(), (pdf["s"] / pdf["n"]).to_numpy()
        within = float((pdf["ss"] - pdf["s"] ** 2 / pdf["n"]).sum())
        la, lb = sorted(pdf[a].unique()), sorted(pdf[b].unique())
        if n.sum() < 6 or len(la) < 2 or len(lb) < 2:
            return pd.DataFrame({**{c: [] for c in names}, "term": [], "ss": [], "df": [], "f": [], "p": []})
        one = np.ones((len(pdf), 1))
        xa = np.array([[v == x for x in la[1:]] for v in pdf[a]], float)
        xb = np.array([[v == x for x in lb[1:]] for v in pdf[b]], float)

        def rss(*parts: np.ndarray) -> tuple[float, int]:
            x = np.hstack(parts) * np.sqrt(n)[:, None]
            y = mean * np.sqrt(n)
            w, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
            return float(((y - x @ w) ** 2).sum()), int(rank)

        full_cells = len(pdf)
        both, only_a, only_b = rss(one, xa, xb), rss(one, xa), rss(one, xb)
        df_within = float(n.sum() - full_cells)
        rows = []
        for term, ss, d in ((a, only_b[0] - both[0], both[1] - only_b[1]), (b, only_a[0] - both[0], both[1] - only_a[1]), (f"{a}:{b}", both[0], full_cells - both[1])):
            f = (ss / d) / (within / df_within) if d > 0 and df_within > 0 and within > 0 else None
            rows.append({**{c: pdf[c].iloc[0] for c in names}, "term": term, "ss": max(0.0, ss), "df": float(d), "f": f, "p": tails.f_sf(f, d, df_within) if f is not None else None})
        rows.append({**{c: pdf[c].iloc[0] for c in names}, "term": "residual", "ss": within, "df": df_within, "f": None, "p": None})
        return pd.DataFrame(rows).astype({"f": "float64", "p": "float64"})

    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in names)
    return cells.groupBy(*names).applyInPandas(fit, f"{kinds}, term string, ss double, df double, f double, p double")


def kde(df: DataFrame, value: str, group: str, points: int = 50) -> DataFrame:
    """Gaussian density of each group on an even grid over its range, with Scott's bandwidth.

    Values are binned to 16 bins for each grid step first, so the work does not grow with rows times points.
    """
    stats = df.groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), (F.stddev_samp(value) * F.pow(F.count(value), -0.2)).alias("h")).where("h > 0")
    width = (F.col("high") - F.col("low")) / (points - 1) / 16
    bins = df.join(stats, group).where(F.col(value).isNotNull()).groupBy(group, "n", "low", "high", "h", F.round((F.col(value) - F.col("low")) / width).alias("bin")).agg(F.count("*").alias("m"))
    grid = bins.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("low") + (F.col("high") - F.col("low")) / (points - 1) * F.col("i")
    v = F.col("low") + F.col("bin") * width
    kernel = F.exp(-0.5 * F.pow((x - v) / F.col("h"), 2)) / (F.col("h") * float(np.sqrt(2 * np.pi)))
    return grid.groupBy(group, "i", x.alias("x")).agg((F.sum(F.col("m") * kernel) / F.max("n")).alias("density"))


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts by even bins over the whole range; the last bin is closed."""
    ends = df.agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    place = F.least(F.floor((F.col(value) - F.col("__a")) / F.nullif((F.col("__b") - F.col("__a")) / bins, F.lit(0.0))), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))

