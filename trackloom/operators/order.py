"""Ranks, running sums and exact quantiles of groups of any size, without a task that holds a group.

Rows that are equal in group and order are counted into one first. What is left is dealt to tasks by ranges of (group, order), so each part
lies wholly before or after any other; sums of the parts (a row for each part of a group) tell what stands before a part, and a window within
the part the rest. Equal values lie in one part. Quantiles open only the parts that hold a wanted rank.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.storage import kept


def beside(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """a with the other columns of b where `on` is equal, nulls too."""
    named = b.select(*[F.col(c).alias(f"__on{i}") for i, c in enumerate(on)], *[c for c in b.columns if c not in on])
    return a.join(named, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__on{i}")) for i, c in enumerate(on)]), how).drop(*[f"__on{i}" for i in range(len(on))])


def _parts(df: DataFrame, by: Sequence[str], by_order: Sequence[str]) -> DataFrame:
    """df with __part: numbers of ranges of (by, order) that follow each other. Kept, so that a row's part is the same whenever it is read."""
    return kept(df.repartitionByRange(*by, *by_order).withColumn("__part", F.spark_partition_id()))


def _before(placed: DataFrame, by: Sequence[str], sums: Mapping[str, str], around: str | None = None) -> DataFrame:
    """For each part of a group: sums of the parts before it, in the group's order (and the values of `around` that are next to it)."""
    line = Window.partitionBy(*by, F.lit(0)).orderBy("__part")  # a row for each part
    each = placed.groupBy(*by, "__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()], *([F.min(around).alias("__first"), F.max(around).alias("__last")] if around else []))
    back = [F.coalesce(F.sum(f"__{n}").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__{n}") for n in sums]
    return each.select(*by, "__part", *back, *([F.lead("__first").over(line).alias("__next"), F.lag("__last").over(line).alias("__back")] if around else []))


def cumulative(df: DataFrame, by: Sequence[str], by_order: Sequence[str], around: str | None = None, **sums: str) -> DataFrame:
    """df with NAME_before for each NAME=column: its sum over the rows of the group that come before. (by, order) must identify rows.

    around: the first column of the order, whose values in the rows before and after are added as `previous` and `following`.
    """
    placed = _parts(df, by, by_order)
    before = _before(placed, by, sums, around)
    within = Window.partitionBy(*by, "__part").orderBy(*by_order)
    own = [F.coalesce(F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__own_{n}") for n, c in sums.items()]
    ahead = [F.lead(around).over(within).alias("__ahead"), F.lag(around).over(within).alias("__behind")] if around else []
    joined = beside(placed.select("*", *own, *ahead), before, [*by, "__part"])
    return joined.select(*df.columns, *[(F.col(f"__own_{n}") + F.col(f"__{n}")).alias(f"{n}_before") for n in sums], *([F.coalesce("__behind", "__back").alias("previous"), F.coalesce("__ahead", "__next").alias("following")] if around else []))


def value_ranks(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """by, value, n (rows that have it) and rank (their average rank in the group) of each distinct value; nulls have none."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return cumulative(counts, by, [value], n="n").select(*by, value, "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank"))


def quantiles(df: DataFrame, value: str, wanted: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Each group's exact quantiles (linear between neighbours) of its non-null values, a column for each name; groups without values are not there."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    placed = _parts(counts, by, ["__v"])
    whole = Window.partitionBy(*by, F.lit(0))  # a row for each part
    each = placed.groupBy(*by, "__part").agg(F.sum("__n").alias("__size"))
    sized = each.select("*", F.sum("__size").over(whole).alias("__total"), (F.sum("__size").over(whole.orderBy("__part")) - F.col("__size")).alias("__start"))
    places = [F.lit(q) * (F.col("__total") - 1) for q in wanted.values()]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in places])))
    inside = F.filter(ranks, lambda r: (r >= F.col("__start")) & (r < F.col("__start") + F.col("__size")))
    asked = sized.withColumn("__ranks", inside).where(F.size("__ranks") > 0)
    opened = beside(placed, asked.drop("__size"), [*by, "__part"])
    line = Window.partitionBy(*by, "__part").orderBy("__v")
    from_ = F.col("__start") + F.sum("__n").over(line) - F.col("__n")
    at = opened.select(*by, "__v", "__n", "__total", "__ranks", from_.alias("__from"))
    hit = at.select(*by, "__v", "__total", F.explode(F.filter("__ranks", lambda r: (r >= F.col("__from")) & (r < F.col("__from") + F.col("__n")))).alias("__rank"))
    found = hit.groupBy(*by, "__total").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__m"))  # two for each quantile at most
    get = lambda r: F.element_at("__m", r.cast("long"))
    out = []
    for name, p in zip(wanted, places, strict=True):
        low, high = get(F.floor(p)), get(F.ceil(p))
        out.append(F.when(low == high, low).otherwise(low + (high - low) * (p - F.floor(p))).alias(name))
    return found.select(*by, *out)


def with_quantiles(df: DataFrame, value: str, wanted: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """df with its group's quantiles beside each row; null where the group has no values."""
    found = quantiles(df, value, wanted, by)
    if not by:
        return df.join(F.broadcast(found), F.lit(True), "left")  # one row at most
    return beside(df, found, by, "left")
