"""Components, clusters and classifiers of cells, with Spark's ML library on standardised features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import grouped, order
from trackloom.operators.storage import kept
from trackloom.operators.tables import contingency, corr_matrix, standardize
from trackloom.operators.tracks import KEY


def as_vector(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    """Features (or one array column) as a vector column."""
    array = F.col(features[0]).cast("array<double>") if len(features) == 1 and df.schema[features[0]].dataType.typeName() == "array" else F.array(*[F.col(c).cast("double") for c in features])
    return df.withColumn(name, array_to_vector(array))


def centred(df: DataFrame, column: str) -> DataFrame:
    """An array column less its mean at each place."""
    n = len(df.select(column).first()[0])
    means = df.select(*[F.avg(F.get(column, i)).alias(str(i)) for i in range(n)]).first()
    return df.withColumn(column, F.zip_with(F.col(column).cast("array<double>"), F.array(*[F.lit(float(m)) for m in means]), lambda x, m: x - m))


def pca(df: DataFrame, features: Sequence[str], k: int) -> tuple[DataFrame, np.ndarray, list[float]]:
    """df with pc1 ... pck, the loadings (features by k) and the explained shares. Signs: each component's loading of largest size is positive.

    Features are standardised here (an array column is centred); components of so many features fit the driver.
    """
    if len(features) > 1:
        ready = as_vector(standardize(df, features), features, "__v")
    else:
        ready = as_vector(centred(df, features[0]), features, "__v")
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(ready)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), range(k)])
    scores = model.transform(ready).withColumn("__p", vector_to_array("__p"))
    keep = df.columns
    back = scores.select(*keep if len(features) == 1 else [c for c in keep if c not in features], *[(F.get("__p", i) * float(signs[i])).alias(f"pc{i + 1}") for i in range(k)])
    return back, loadings * signs, [float(x) for x in model.explainedVariance]


def components_for(shares: Sequence[float], fraction: float | None = None, least_share: float = 0.1) -> int:
    """Components that reach a fraction of the variance; or those with more than a share, two at least."""
    if fraction is not None:
        return int(np.searchsorted(np.cumsum(shares), fraction) + 1)
    return max(2, sum(s > least_share for s in shares))


def kmeans(df: DataFrame, columns: Sequence[str], k: int, restarts: int = 5, seed: int = 42, label: str = "cluster") -> tuple[DataFrame, KMeans]:
    """df with a label, from the best of several seeds by cost. Labels are numbered by the sum of their centre's coordinates."""
    ready = as_vector(df, columns, "__v").cache()
    try:
        models = [KMeans(k=k, seed=seed + i, featuresCol="__v", predictionCol=label, initSteps=2).fit(ready) for i in range(restarts)]
        best = min(models, key=lambda m: m.summary.trainingCost)
    finally:
        ready.unpersist()
    order = np.argsort([c.sum() for c in best.clusterCenters()], kind="stable")
    rank = {int(old): new for new, old in enumerate(order)}
    renamed = F.element_at(F.create_map(*[F.lit(x) for pair in rank.items() for x in pair]), F.col(label))
    return best.transform(as_vector(df, columns, "__v")).withColumn(label, renamed).drop("__v"), best


def silhouettes(df: DataFrame, columns: Sequence[str], ks: Sequence[int], seed: int = 42) -> list[tuple[int, float, float]]:
    """(k, silhouette of squared distances, mean distance to the nearest centre) of each k."""
    ready = as_vector(df, columns, "__v").cache()
    out = []
    try:
        for k in ks:
            model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="__c").fit(ready)
            labelled = model.transform(ready)
            score = ClusteringEvaluator(featuresCol="__v", predictionCol="__c").evaluate(labelled)
            centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
            away = F.sqrt(F.aggregate(F.zip_with(vector_to_array("__v"), F.element_at(centres, F.col("__c") + 1), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
            out.append((k, float(score), float(labelled.agg(F.avg(away)).first()[0])))
    finally:
        ready.unpersist()
    return out


def silhouette_sweep(df: DataFrame, columns: Sequence[str], ks: Sequence[int] = range(2, 11), best: int = 2) -> DataFrame:
    """k, silhouette, elbow (mean distance to the nearest centre) and chosen (the best few by silhouette)."""
    rows = silhouettes(df, columns, ks)
    chosen = {k for k, *_ in sorted(rows, key=lambda r: (-r[1], r[0]))[:best]}
    return df.sparkSession.createDataFrame([(*r, r[0] in chosen) for r in rows], "k int, silhouette double, elbow double, chosen boolean")


def gmm(df: DataFrame, columns: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """df with the most probable component and its probability."""
    ready = as_vector(df, columns, "__v")
    out = GaussianMixture(k=k, seed=seed, featuresCol="__v", predictionCol="component", probabilityCol="__p").fit(ready).transform(ready)
    return out.withColumn("probability", F.array_max(vector_to_array("__p"))).drop("__v", "__p")


def cluster_by_group(df: DataFrame, features: Sequence[str], group: str, k: int, n_components: int = 2) -> DataFrame:
    """Components and clusters within each group on its own, all groups at once; groups of fewer rows than k are left out."""
    scores, _ = grouped.components(df, features, [group], n_components)
    labelled, _ = grouped.kmeans(scores, [f"pc{i + 1}" for i in range(n_components)], [group], k)
    return labelled.where(F.col("cluster").isNotNull()).drop(*features)


def euclidean_sweep(df: DataFrame, columns: Sequence[str], ks: Sequence[int] = range(2, 11), by: Sequence[str] = ()) -> DataFrame:
    """by, k and silhouette (Euclidean, over all pairs of a group) of each group's own clusters, for every k below its number of rows."""
    labelled = grouped.kmeans_sweep(df, columns, by, {f"__k{k}": k for k in ks})[0]
    filled = labelled.fillna(0, subset=[f"__k{k}" for k in ks])  # a group too small for k: one cluster, which has no silhouette
    found = grouped.silhouettes(filled, columns, [f"__k{k}" for k in ks], by)
    return found.select(*by, F.substr("labelling", F.lit(4)).cast("int").alias("k"), "silhouette", "n")


def hierarchy(profiles: DataFrame, features: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """Top-down hierarchical clusters of condition profiles (bisecting k-means); linkage.ward has the bottom-up ones."""
    ready = as_vector(profiles, features, "__v")
    return BisectingKMeans(k=k, seed=seed, featuresCol="__v", predictionCol="branch").fit(ready).transform(ready).drop("__v")


def feature_selection(df: DataFrame, features: Sequence[str], always: Sequence[str] = (), step: int = 2, most_alike: float = 0.8, still_share: float = 0.99, still_std: float = 0.2, key: Sequence[str] = KEY) -> list[str]:
    """Features for clustering: ranked by their PCA loadings, as many as give the best silhouette, without near copies and those constant within cells.

    Of two features whose rank correlation exceeds `most_alike`, the one more correlated with all others goes. `always` are added at the end.
    """
    cells = df.groupBy(*key).agg(*[F.avg(c).alias(c) for c in features], *[F.stddev_samp(c).alias(f"__sd_{c}") for c in features]).na.drop(subset=list(features)).cache()
    try:
        _, loadings, _ = pca(cells.select(*features), features, min(len(features), 3))
        ranked = [features[i] for i in np.argsort(-np.abs(loadings).sum(axis=1), kind="stable")]
        scaled = standardize(cells, features)
        best, top = ranked, -2.0
        for n in range(min(2, len(ranked)), len(ranked) + 1, step):
            score = silhouettes(scaled, ranked[:n], [3])[0][1]
            if score > top:
                best, top = ranked[:n], score
        chosen = list(best)
        if len(chosen) > 1:
            alike = {(r.a, r.b): abs(r["corr"] or 0.0) for r in corr_matrix(cells, chosen, key, "spearman").collect()}
            both = lambda a, b: alike.get((a, b), alike.get((b, a), 0.0))
            mean = {a: float(np.mean([both(a, b) for b in chosen if b != a])) for a in chosen}
            for a, b in sorted(alike):
                if a in chosen and b in chosen and alike[a, b] > most_alike:
                    chosen.remove(a if (mean[a], a) > (mean[b], b) else b)
        still = cells.agg(*[F.struct(F.avg((F.coalesce(f"__sd_{c}", F.lit(0.0)) == 0).cast("double")).alias("zero"), F.avg(F.coalesce(f"__sd_{c}", F.lit(0.0))).alias("std")).alias(c) for c in chosen]).first()
        chosen = [c for c in chosen if not (still[c].zero >= still_share and still[c].std <= still_std)]
    finally:
        cells.unpersist()
    return [*chosen, *[c for c in always if c not in chosen]]


def treatment_distribution(df: DataFrame, facets: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Counts and shares of clusters in each facet."""
    return contingency(df.withColumn("facet", F.concat_ws("|", *facets)), "facet", cluster).select("facet", cluster, "n", "row_pct")


# ---- classifiers -------------------------------------------------------------------------------------------------------------


def _scores(predicted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Balanced accuracy and macro F1 from counts of (label, prediction)."""
    counts = predicted.groupBy(*by, "label", "prediction").agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    recall = counts.groupBy(*by, F.col("label").alias("class")).agg(hit.alias("hit"), F.sum("n").alias("actual"))
    said = counts.groupBy(*by, F.col("prediction").alias("class")).agg(F.sum("n").alias("said"))
    each = recall.join(said, [*by, "class"], "left").fillna({"said": 0})
    return each.groupBy(*by).agg(F.avg(F.col("hit") / F.col("actual")).alias("balanced_accuracy"), F.avg(2 * F.col("hit") / (F.col("actual") + F.col("said"))).alias("macro_f1"), F.sum("actual").alias("n"))


def _balanced_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """df with fold: groups in the order of their size are dealt to the folds forth and back, so whole groups stay together and folds are alike in size."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg((-F.count("*")).alias("__size"), F.lit(1).alias("__one"))
    place = order.cumulative(sizes, [], ["__size", group], place="__one").select(group, "place_before")
    turn = F.pmod(F.col("place_before"), F.lit(2 * folds))
    return df.join(place.select(group, F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn).cast("int").alias("fold")), group)


def group_cv(df: DataFrame, features: Sequence[str], label: str, group: str, folds: int = 5, reg: float = 0.1, steps: int = 80) -> DataFrame:
    """fold, balanced accuracy and macro F1 of an L1 logistic model with balanced weights; whole groups are held out.

    The models of all folds are fitted together by accelerated proximal steps: a step is one pass over the rows, whose blocks give the gradients of all models at once. Only
    models (folds by features by classes) and their statistics are held by the driver.
    """
    n = len(features)
    ready = df.withColumn("label", F.col(label).cast("double")).na.drop(subset=[*features, "label", group])
    rows = kept(_balanced_folds(ready, group, folds).select("fold", "label", F.array(*[F.col(c).cast("double") for c in features]).alias("x")))
    each = rows.groupBy("fold", "label").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("x", F.lit(i))) for i in range(n)]).alias("s"), F.array(*[F.sum(F.pow(F.get("x", F.lit(i)), 2)) for i in range(n)]).alias("q")).collect()  # folds by classes
    classes, present = sorted({r.label for r in each}), sorted({r.fold for r in each})
    mean, std, weight = (np.zeros((len(present), n)), np.ones((len(present), n)), np.zeros((len(present), len(classes))))
    for f, fold in enumerate(present):
        train = [r for r in each if r.fold != fold] or each
        total = sum(r.n for r in train)
        mean[f] = np.sum([r.s for r in train], axis=0) / total
        spread = np.sqrt(np.maximum(np.sum([r.q for r in train], axis=0) / total - mean[f] ** 2, 0.0))
        std[f] = np.where(spread > 1e-12 * (1 + np.abs(mean[f])), spread, 1.0)
        counts = np.array([sum(r.n for r in train if r.label == c) for c in classes], float)
        weight[f] = np.where(counts > 0, total / (np.maximum(counts, 1) * (counts > 0).sum()), 0.0) / total

    def gradients(w: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros_like(w)
            for pdf in batches:
                if len(pdf):
                    x, y = np.stack(pdf["x"].to_list()), np.searchsorted(classes, pdf["label"].to_numpy())
                    for f, fold in enumerate(present):
                        mine = (pdf["fold"].to_numpy() != fold) | (len(present) == 1)
                        z = np.hstack([(x[mine] - mean[f]) / std[f], np.ones((mine.sum(), 1))])
                        p = z @ w[f]
                        p = np.exp(p - p.max(axis=1, keepdims=True))
                        p /= p.sum(axis=1, keepdims=True)
                        p[np.arange(len(p)), y[mine]] -= 1.0
                        out[f] += z.T @ (p * weight[f][y[mine], None])
            yield pd.DataFrame({"i": np.arange(out.size), "g": out.ravel()})

        got = rows.mapInPandas(part, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()  # a number for each weight
        out = np.zeros(w.size)
        for r in got:
            out[r.i] = r.g
        return out.reshape(w.shape)

    w = np.zeros((len(present), n + 1, len(classes)))
    ahead, t, step, push = w, 1.0, 2.0 / (n + 1), reg / 10
    for _ in range(steps):
        new = ahead - step * gradients(ahead)
        new[:, :n] = np.sign(new[:, :n]) * np.maximum(np.abs(new[:, :n]) - step * push, 0.0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, moved, w = new + (before - 1) / t * (new - w), float(np.abs(new - w).max()), new
        if moved < 1e-4:
            break

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                f = np.searchsorted(present, pdf["fold"].to_numpy())
                z = np.hstack([(np.stack(pdf["x"].to_list()) - mean[f]) / std[f], np.ones((len(pdf), 1))])
                yield pd.DataFrame({"label": pdf["label"], "prediction": np.array(classes)[np.einsum("ri,rik->rk", z, w[f]).argmax(axis=1)], "fold": pdf["fold"]})

    return _scores(rows.mapInPandas(predict, "label double, prediction double, fold int"), ["fold"])


def rf_compare(df: DataFrame, sets: dict[str, Sequence[str]], label: str, id_columns: Sequence[str], trees: int = 20, test: float = 0.15, seed: int = 42) -> DataFrame:
    """features (name of the set), balanced accuracy and macro F1 of a random forest on a hash-held-out share of the rows."""
    ready = df.withColumn("label", F.col(label).cast("double")).withColumn("__u", F.pmod(F.xxhash64(*id_columns, F.lit(seed)), F.lit(10_000)) / 10_000)
    out = None
    for name, features in sets.items():
        rows = as_vector(ready, features)
        model = RandomForestClassifier(numTrees=trees, seed=seed).fit(rows.where(F.col("__u") >= test))
        scored = _scores(model.transform(rows.where(F.col("__u") < test)).select("label", "prediction", F.lit(name).alias("features")), ["features"])
        out = scored if out is None else out.unionByName(scored)
    return out


def confusion(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predicted.groupBy(label, prediction).agg(F.count("*").alias("n"))
