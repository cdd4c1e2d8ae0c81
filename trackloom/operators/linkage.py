"""Ward's hierarchical clusters of condition profiles: rounds of reciprocal nearest neighbours.

Ward's distance between clusters, sqrt(2 |A| |B| / (|A| + |B|)) times the distance of their centres, never falls when others merge. So all pairs that are each
other's nearest may merge in the same round, and the merges sorted by height are those of the one-by-one algorithm. Large sets take rounds over all tasks:
blocks of clusters whose nearest one is unknown meet blocks of all, at most BLOCK by BLOCK in a task, and only clusters that have lost their nearest look again.
Once BLOCK clusters or fewer are left, one task ends the work with Lance-Williams updates.

Clusters are named by the least id of their members. Ties go to the pair of least ids. Rows without id or with a null feature are left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import matching, order
from trackloom.operators.storage import kept

#: Clusters that meet in a task: 32 MB of distances.
BLOCK = 2_048


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, the same to the last bit either way round."""
    out = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        out += np.square(x[:, i, None] - y[None, :, i])
    return out


def _ward(squares: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.sqrt(squares * (2 * n[:, None] * m[None, :] / (n[:, None] + m[None, :])))


def _nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    right = right.sort_values("id")
    away = _ward(_squares(np.stack(left["centre"]), np.stack(right["centre"])), left["n"].to_numpy(float), right["n"].to_numpy(float))
    away[left["id"].to_numpy()[:, None] == right["id"].to_numpy()[None, :]] = np.inf
    best = away.argmin(axis=1)  # the first of equals has the least id
    found = np.isfinite(away[np.arange(len(left)), best])
    return pd.DataFrame({"id": left["id"].to_numpy(), "d": away[np.arange(len(left)), best], "other": right["id"].to_numpy()[best]})[found]


def _look(stale: DataFrame, clusters: DataFrame, blocks: int) -> DataFrame:
    """id, d and other: the nearest cluster of each stale one."""
    block = lambda name: F.pmod(F.xxhash64("id"), F.lit(blocks)).alias(name)
    every = F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")
    left = stale.select("id", "n", "centre", block("i"), F.explode(every).alias("j"))
    right = clusters.select(*[F.col(c).alias(c) for c in ("id", "n", "centre")], block("j"), F.explode(every).alias("i"))  # new columns: both sides may come from one frame
    kind = clusters.schema["id"].dataType.simpleString()

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _nearest(a, b) if len(a) and len(b) else a[["id"]].assign(d=0.0, other=a["id"]).head(0)

    each = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(meet, f"id {kind}, d double, other {kind}")
    return each.groupBy("id").agg(F.min(F.struct("d", "other")).alias("b")).select("id", "b.d", "b.other")


def finish(ids: np.ndarray, n: np.ndarray, centres: np.ndarray) -> pd.DataFrame:
    """a, b, height and size of all merges of a few clusters, in rounds of reciprocal pairs on their matrix of squared Ward distances."""
    order_ = np.argsort(ids, kind="stable")
    ids, n, centres = ids[order_], n[order_].astype(float), centres[order_]
    d2 = np.square(_ward(_squares(centres, centres), n, n))
    np.fill_diagonal(d2, np.inf)
    open_, out, turn = np.ones(len(ids), bool), [], 0
    while open_.sum() > 1:
        best = d2.argmin(axis=1)
        pairs = [(i, int(best[i])) for i in np.flatnonzero(open_) if best[best[i]] == i and i < best[i]]
        turn += 1
        for i, j in pairs:
            out.append((ids[i], ids[j], math.sqrt(d2[i, j]), int(n[i] + n[j]), turn))
            others = open_.copy()
            others[[i, j]] = False
            updated = ((n[others] + n[i]) * d2[others, i] + (n[others] + n[j]) * d2[others, j] - n[others] * d2[i, j]) / (n[others] + n[i] + n[j])
            d2[i, others] = d2[others, i] = np.maximum(updated, 0.0)
            d2[j, :] = d2[:, j] = np.inf
            open_[j] = False
            n[i] += n[j]
    return pd.DataFrame(out, columns=["a", "b", "height", "size", "turn"]).astype({"height": float, "size": "int64", "turn": "int32"})


def ward(profiles: DataFrame, features: Sequence[str], id_column: str, most: int = BLOCK) -> DataFrame:
    """step, a, b, height and size of the merges of profiles (one row for each id), by height: those of the one-by-one algorithm.

    a and b: least ids of the two clusters; most: clusters that one task may take on its own.
    """
    ready = profiles.select(F.col(id_column).alias("id"), F.lit(1).cast("long").alias("n"), F.array(*[F.col(c).cast("double") for c in features]).alias("centre"))
    clusters = kept(ready.where(F.col("id").isNotNull() & ~F.exists("centre", lambda x: x.isNull())))
    kind = clusters.schema["id"].dataType.simpleString()
    merges, known, turn = None, None, 0
    while (count := clusters.count()) > most:
        stale = clusters if known is None else clusters.join(known.select("id"), "id", "left_anti")
        looked = _look(stale, clusters, math.ceil(count / most))
        known = kept(looked if known is None else known.unionByName(looked))
        back = known.select(F.col("id").alias("other"), F.col("other").alias("id"))
        pairs = kept(known.join(back, ["id", "other"]).where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"), F.col("d").alias("height")))
        side = lambda x: clusters.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("centre").alias(f"c_{x}"))  # noqa: B023, E731
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        size = F.col("n_a") + F.col("n_b")
        mean = F.zip_with("c_a", "c_b", lambda x, y: (x * F.col("n_a") + y * F.col("n_b")) / (F.col("n_a") + F.col("n_b")))
        joined = kept(both.select("a", "b", "height", size.alias("size"), mean.alias("centre"), F.lit(turn).alias("turn")))
        merged = joined.drop("centre")
        merges = merged if merges is None else merges.unionByName(merged)
        gone = joined.select(F.explode(F.array("a", "b")).alias("id"))
        clusters = kept(clusters.join(gone, "id", "left_anti").unionByName(joined.select(F.col("a").alias("id"), F.col("size").alias("n"), "centre")))
        known = known.join(gone, "id", "left_anti").join(gone.select(F.col("id").alias("other")), "other", "left_anti").select("id", "d", "other")
        turn += 1

    def end(pdf: pd.DataFrame) -> pd.DataFrame:
        return finish(pdf["id"].to_numpy(), pdf["n"].to_numpy(), np.stack(pdf["centre"])).assign(turn=lambda x: x["turn"] + turn)

    last = clusters.groupBy(F.lit(0).alias("all")).applyInPandas(end, f"a {kind}, b {kind}, height double, size long, turn int")  # at most `most` rows
    merges = last if merges is None else merges.unionByName(last)
    # a merge of equal height comes after those that made its parts
    return order.cumulative(merges.withColumn("one", F.lit(1)), [], ["height", "turn", "a", "b"], one="one").select((F.col("one_before") + 1).alias("step"), "a", "b", "height", "size")


def branches(merges: DataFrame, profiles: DataFrame, id_column: str, k: int) -> DataFrame:
    """id_column and branch (the least id of the cluster) when the tree is cut into k clusters: all merges but the last k - 1 are carried out."""
    total = merges.agg(F.max("step")).first()[0] or 0
    roots = matching.components(merges.where(F.col("step") <= total + 1 - k).select(F.col("a").alias("u"), F.col("b").alias("v")))
    return profiles.select(id_column).join(roots.select(F.col("node").alias(id_column), F.col("root").alias("branch")), id_column, "left").withColumn("branch", F.coalesce("branch", id_column))
