"""Feature arrays of cells, and pixel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.columns import flattened, ratio
from trackloom.operators import order
from trackloom.operators.tracks import KEY


def flatten_vectors(df: DataFrame, values: str, features: Sequence[str], treatments: DataFrame | None = None, name: str = "experiment") -> DataFrame:
    """vector of each cell whose features are all there and finite; treatment: the longest known one in its id."""
    out = df.withColumn("vector", flattened(values, features)).where(F.col("vector").isNotNull())
    if treatments is None:
        return out
    ids = out.select(name).distinct()
    known = treatments.select("treatment").distinct()
    longest = ids.join(F.broadcast(known), F.contains(F.col(name), F.col("treatment"))).groupBy(name).agg(F.max_by("treatment", F.struct(F.length("treatment"), "treatment")).alias("treatment"))
    return out.join(longest, name, "left")


def scale_per_feature(df: DataFrame, values: str, key: Sequence[str] = KEY) -> DataFrame:
    """key, feature, vector: each place of each feature's array standardised over cells (ddof 0; a deviation of zero counts as 1)."""
    long = df.select(*key, F.explode(values).alias("feature", "v")).select(*key, "feature", F.posexplode("v").alias("pos", "x"))
    stats = long.groupBy("feature", "pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = long.join(F.broadcast(stats), ["feature", "pos"]).withColumn("z", (F.col("x") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0))  # one row for each place of a feature
    return z.groupBy(*key, "feature").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "z"))), lambda p: p["z"]).alias("vector"))


def concat_emb_fit(a: DataFrame, b: DataFrame, values: str, features: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """key, vector (each feature's arrays of both tables, one after the other), complete: whether every feature was on both sides."""
    joined = a.select(*key, F.col(values).alias("__a")).join(b.select(*key, F.col(values).alias("__b")), list(key))
    part = lambda side, f: F.try_element_at(side, F.lit(f))
    whole = [F.when(part("__a", f).isNotNull() & part("__b", f).isNotNull(), F.concat(part("__a", f), part("__b", f))) for f in features]
    complete = F.lit(True)
    for w in whole:
        complete &= w.isNotNull()
    return joined.select(*key, F.flatten(F.array_compact(F.array(*whole))).alias("vector"), complete.alias("complete"))


def mean_fallback(df: DataFrame, features: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """key, values: each feature's track mean as an array of one."""
    means = df.groupBy(*key).agg(*[F.avg(c).alias(c) for c in features])
    return means.select(*key, F.create_map(*[x for c in features for x in (F.lit(c), F.array(F.col(c).cast("double")))]).alias("values"))


# ---- pixels ------------------------------------------------------------------------------------------------------------------


def overlay_metrics(a: DataFrame, b: DataFrame, by: Sequence[str] = ("frame",), axes: Sequence[str] = ("y", "x")) -> DataFrame:
    """intersection, union, iou and dice of two masks (pixel tables) by frame; 0 where both are empty."""
    left, right = a.select(*by, *axes).distinct().withColumn("__a", F.lit(1)), b.select(*by, *axes).distinct().withColumn("__b", F.lit(1))
    both = left.join(right, [*by, *axes], "full_outer")
    n = both.groupBy(*by).agg(F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("intersection"), F.count("*").alias("union"), F.count("__a").alias("n_a"), F.count("__b").alias("n_b"))
    iou = F.coalesce(ratio("intersection", "union"), F.lit(0.0))
    return n.select(*by, "intersection", "union", iou.alias("iou"), F.coalesce(ratio(2 * F.col("intersection"), F.col("n_a") + F.col("n_b")), F.lit(0.0)).alias("dice"))


def overlay_summary(metrics: DataFrame, algorithm: str) -> DataFrame:
    """Mean and deviation (of a sample) of IoU and Dice for each algorithm, ranked by mean IoU."""
    out = metrics.groupBy(algorithm).agg(F.avg("iou").alias("iou_mean"), F.stddev_samp("iou").alias("iou_std"), F.avg("dice").alias("dice_mean"), F.stddev_samp("dice").alias("dice_std"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("iou_mean"), algorithm)))


def region_props(pixels: DataFrame, by: Sequence[str] = ("frame", "label"), axes: tuple[str, str] = ("y", "x")) -> DataFrame:
    """Of each object: pixel count, centroid, intensity-weighted centroid (the plain one where intensities sum to zero), intensity statistics, and axes.

    Axes are those of an ellipse with the coordinates' covariance (ddof 1): lengths twice the root of its eigenvalues, the direction of the longer.
    """
    y, x = axes
    i = F.col("intensity")
    s = pixels.groupBy(*by).agg(
        F.count("*").alias("n_pixels"), F.avg(y).alias("cy"), F.avg(x).alias("cx"), F.sum(i * F.col(y)).alias("__wy"), F.sum(i * F.col(x)).alias("__wx"), F.sum(i).alias("intensity_sum"), F.min(i).alias("intensity_min"),
        F.max(i).alias("intensity_max"), F.avg(i).alias("intensity_mean"), F.stddev_pop(i).alias("intensity_std"),
        F.var_samp(y).alias("__vy"), F.var_samp(x).alias("__vx"), F.covar_samp(y, x).alias("__c"),
    )
    s = order.beside(s, order.quantiles(pixels, "intensity", {"intensity_median": 0.5}, by), by, "left")
    half, root = (F.col("__vy") + F.col("__vx")) / 2, F.sqrt(F.pow((F.col("__vy") - F.col("__vx")) / 2, 2) + F.pow("__c", 2))
    out = s.withColumns({
        "wy": F.coalesce(ratio("__wy", "intensity_sum"), F.col("cy")), "wx": F.coalesce(ratio("__wx", "intensity_sum"), F.col("cx")), "major_axis": 2 * F.sqrt(half + root), "minor_axis": 2 * F.sqrt(F.greatest(half - root, F.lit(0.0))),
        "direction": 0.5 * F.atan2(2 * F.col("__c"), F.col("__vx") - F.col("__vy")),
    })
    return out.withColumn("ellipticity", 1 - ratio("minor_axis", "major_axis")).drop("__wy", "__wx", "__vy", "__vx", "__c")


def shift_pixels(pixels: DataFrame, shift: int, height: int, axis: str = "y") -> DataFrame:
    """A mask moved up by so many pixels at constant size."""
    return pixels.withColumn(axis, F.col(axis) - shift).where((F.col(axis) >= 0) & (F.col(axis) < height))
