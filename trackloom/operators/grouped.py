"""Models of many groups at once: every step is one aggregate keyed by (group, model), whatever the number of groups or restarts.

Groups are values of the columns `by` (none: one model of all rows). What a step needs of a model, its centres or weights, stands in a row for each
group and model and meets the rows by a join on the group. No name of a group, and no row, passes through the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators import order
from trackloom.operators.storage import kept

#: Rows for each centre of the sample that starts are drawn from; models that are broadcast (each a few kilobytes).
STARTS, MOST_MODELS = 50, 2_000
#: Rows that meet in a task when all distances are needed.
BLOCK = 2_048


def _beside_models(rows: DataFrame, models: DataFrame, by: Sequence[str]) -> DataFrame:
    few = models.limit(MOST_MODELS + 1).count() <= MOST_MODELS
    held = F.broadcast(models) if few else models
    return order.beside(rows, held, by) if by else rows.crossJoin(F.broadcast(models))  # a row for each restart


def _vector(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def _squares(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _sum_of(lists: str, n: int) -> Column:
    """Sums of each place of an array column of n values."""
    return F.array(*[F.sum(F.get(lists, F.lit(i))) for i in range(n)])


def standardized(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """df with each column's z-score within its group (ddof 0; a deviation of 0 counts as 1)."""
    stats = df.groupBy(*by).agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    joined = _beside_models(df, stats, by)
    z = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0) for c in columns}
    return joined.withColumns(z).drop(*[f"__{x}_{c}" for x in "ms" for c in columns])


def components(df: DataFrame, columns: Sequence[str], by: Sequence[str], k: int) -> tuple[DataFrame, DataFrame]:
    """df with pc1 to pck of each group's standardised columns, and (by, component, share, loadings) of its models.

    From each group's second moments; eigenvectors of so many columns are found in the task that holds the moments. Each component's loading of largest size is positive.
    """
    n = len(columns)
    z = standardized(df.na.drop(subset=list(columns)), columns, by)
    places = [(i, j) for i in range(n) for j in range(i, n)]
    moments = z.groupBy(*by).agg(F.count("*").alias("__n"), F.array(*[F.sum(F.col(columns[i]) * F.col(columns[j])) for i, j in places]).alias("__c")) if by else z.agg(F.count("*").alias("__n"), F.array(*[F.sum(F.col(columns[i]) * F.col(columns[j])) for i, j in places]).alias("__c"))

    def solve(batches):
        for pdf in batches:
            out = []
            for values, size in zip(pdf["__c"], pdf["__n"], strict=True):
                c = np.zeros((n, n))
                for (i, j), x in zip(places, values, strict=True):
                    c[i, j] = c[j, i] = x / size
                share, vectors = np.linalg.eigh(c)
                share, vectors = share[::-1][:k], vectors[:, ::-1][:, :k]
                vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])] < 0, -1.0, 1.0)
                out.append(([v.tolist() for v in vectors.T], (share / max(np.trace(c), 1e-300)).tolist()))
            yield pdf[list(by)].assign(loadings=[x for x, _ in out], shares=[x for _, x in out])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    models = kept(moments.mapInPandas(solve, f"{kinds}loadings array<array<double>>, shares array<double>"))
    scored = _beside_models(z.withColumn("__v", _vector(columns)), models.select(*by, "loadings"), by)
    dot = lambda i: F.aggregate(F.zip_with("__v", F.get("loadings", F.lit(i)), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return scored.withColumns({f"pc{i + 1}": dot(i) for i in range(k)}).drop("__v", "loadings"), models


def kmeans(df: DataFrame, columns: Sequence[str], by: Sequence[str], k: int, restarts: int = 5, seed: int = 42, steps: int = 20, label: str = "cluster") -> tuple[DataFrame, DataFrame]:
    """df with the label of each row (null where a column is, or its group has fewer than k rows), and (by, centres, cost) of the best of so many starts of each group."""
    labelled, final = kmeans_sweep(df, columns, by, {label: k}, restarts, seed, steps)
    return labelled, final.drop("k")


def kmeans_sweep(df: DataFrame, columns: Sequence[str], by: Sequence[str], ks: Mapping[str, int], restarts: int = 5, seed: int = 42, steps: int = 20) -> tuple[DataFrame, DataFrame]:
    """df with a label for each name in ks (null where a column is, or its group has fewer than k rows), and (by, k, centres, cost) of the best of so many starts of each group and k.

    Lloyd's steps for all groups, numbers of clusters and starts together. Starts are drawn (D2 weights) from a sample of STARTS * k rows of each group by hash. Labels are numbered by the sum of their centre's coordinates.
    """
    n = len(columns)
    rows = kept(df.withColumn("__v", _vector(columns)).withColumn("__id", F.monotonically_increasing_id()))
    points = rows.where(~F.exists("__v", lambda x: x.isNull() | F.isnan(x))).select(*by, "__id", "__v")
    keys = list(by) or [F.lit(0).alias("__all")]
    first = points.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("__v", F.lit(seed)), "__id"))).where(F.col("__k") <= STARTS * max(ks.values()))
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        every = np.stack(pdf.sort_values("__k")["__v"].to_list())
        out = []
        for k in sorted(set(ks.values())):
            x = every[: STARTS * k]
            for r in range(restarts) if len(x) >= k else ():
                rng, chosen = np.random.default_rng([seed, r]), []
                away = np.ones(len(x))
                for _ in range(k):
                    chosen.append(int(rng.choice(len(x), p=away / away.sum())) if away.sum() > 0 else len(chosen))
                    away = np.min([((x - x[c]) ** 2).sum(axis=1) for c in chosen], axis=0)
                out.append((k, r, [v.tolist() for v in x[chosen]]))
        made = pd.DataFrame(out, columns=["k", "model", "centres"]).astype({"k": "int32", "model": "int32", "centres": object})
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(made) for c in by}, **made}) if len(made) else pd.concat([pdf[list(by)].head(0), made], axis=1)

    models = kept(first.groupBy(*keys).applyInPandas(draw, f"{kinds}k int, model int, centres array<array<double>>"))
    best = lambda: F.array_min(F.transform("centres", lambda c, i: F.struct(_squares(F.col("__v"), c).alias("d"), i.alias("i"))))
    for _ in range(steps):
        near = _beside_models(points, models, by).select(*by, "k", "model", "__v", best().alias("__b"))
        sums = near.groupBy(*by, "k", "model", F.col("__b.i").alias("i")).agg(F.count("*").alias("n"), _sum_of("__v", n).alias("s"))
        moved = sums.groupBy(*by, "k", "model").agg(F.map_from_entries(F.collect_list(F.struct("i", F.transform("s", lambda x: x / F.col("n"))))).alias("__to"))
        after = order.beside(models, moved, [*by, "k", "model"]).select(*by, "k", "model", F.transform("centres", lambda c, i: F.coalesce(F.element_at("__to", i), c)).alias("centres"), F.col("centres").alias("__old"))
        after = kept(after)
        shift = after.select(F.max(F.array_max(F.zip_with("centres", "__old", _squares)))).first()[0]
        models = after.drop("__old")
        if not shift or shift < 1e-12:
            break
    costs = _beside_models(points, models, by).groupBy(*by, "k", "model").agg(F.sum(best()["d"]).alias("cost"))
    with_cost = order.beside(models, costs, [*by, "k", "model"])
    chosen = with_cost.groupBy(*by, "k").agg(F.min(F.struct("cost", "model", "centres")).alias("b"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    ordered = F.transform(F.array_sort(F.transform("b.centres", lambda c, i: F.struct(total(c).alias("t"), i.alias("i"), c.alias("c")))), lambda x: x["c"])
    final = kept(chosen.where("b.centres is not null").select(*by, "k", ordered.alias("centres"), F.col("b.cost").alias("cost")))
    each = final.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "centres"))).alias("__by_k"))
    nearest = lambda k: F.array_min(F.transform(F.element_at("__by_k", F.lit(k)), lambda c, i: F.struct(_squares(F.col("__v"), c).alias("d"), i.alias("i"))))["i"]
    labelled = _beside_models(points, each, by).select("__id", *[nearest(k).alias(label) for label, k in ks.items()])
    return rows.join(labelled, "__id", "left").drop("__id", "__v"), final


def silhouettes(df: DataFrame, columns: Sequence[str], labels: Sequence[str], by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """by, labelling, n and silhouette (mean over rows) of several labellings of the same rows, with Euclidean distances; a row that is alone in its cluster counts 0.

    All distances within a group, once for all labellings: blocks of rows meet blocks of rows, and a pair of blocks gives sums by (row, labelling, cluster). Labellings of
    one cluster only, and of as many as rows, have none. Rows with a null column or label are left out.
    """
    keys = list(by)
    rows = kept(df.na.drop(subset=[*columns, *labels]).select(*by, F.monotonically_increasing_id().alias("__id"), _vector(columns).alias("__v"), F.array(*[F.col(x).cast("long") for x in labels]).alias("__l")))
    count = rows.groupBy(*by).agg(F.ceil(F.count("*") / block).alias("__blocks")) if by else rows.agg(F.ceil(F.count("*") / block).alias("__blocks"))
    dealt = _beside_models(rows, count, by).withColumns({"__at": F.pmod(F.xxhash64("__id"), F.col("__blocks")), "__every": F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)})
    side = lambda own, other: dealt.select(*[F.col(c).alias(c) for c in [*by, "__id", "__v", "__l"]], F.col("__at").alias(own), F.explode("__every").alias(other))
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            x, y, la, lb = np.stack(a["__v"].to_list()), np.stack(b["__v"].to_list()), np.stack(a["__l"].to_list()), np.stack(b["__l"].to_list())
            away = np.zeros((len(x), len(y)))
            for i in range(x.shape[1]):
                away += (x[:, i, None] - y[None, :, i]) ** 2
            away = np.sqrt(away)
            for m in range(la.shape[1]):
                c, at = np.unique(lb[:, m], return_inverse=True)
                sums, size = away @ np.eye(len(c))[at.ravel()], np.bincount(at.ravel())  # by row and cluster
                each, there = np.repeat(np.arange(len(a)), len(c)), np.tile(np.arange(len(c)), len(a))
                out.append(pd.DataFrame({**{k: a[k].to_numpy()[each] for k in keys}, "__id": a["__id"].to_numpy()[each], "m": m, "own": la[each, m], "c": c[there], "s": sums.ravel(), "n": size[there]}))
        return pd.concat(out) if out else pd.DataFrame({**{k: a[k].head(0) for k in keys}, "__id": a["__id"].head(0), **{k: pd.Series(dtype="int64") for k in ("m", "own", "c")}, "s": pd.Series(dtype="float64"), "n": pd.Series(dtype="int64")})

    each = side("i", "j").groupBy(*by, "i", "j").cogroup(side("j", "i").groupBy(*by, "i", "j")).applyInPandas(meet, f"{kinds}__id long, m int, own long, c long, s double, n long")
    sums = each.groupBy(*by, "__id", "m", "own", "c").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = F.col("c") == F.col("own")
    per_row = sums.groupBy(*by, "__id", "m").agg(F.max(F.when(own, F.col("s") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"), F.count("*").alias("k"))
    score = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    means = per_row.groupBy(*by, "m").agg(F.count("*").alias("n"), F.avg(score).alias("silhouette"), F.max("k").alias("k"))
    return means.where((F.col("k") > 1) & (F.col("k") < F.col("n"))).select(*by, F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("m") + 1).alias("labelling"), "n", "silhouette")
