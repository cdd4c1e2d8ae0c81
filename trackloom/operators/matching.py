"""One-to-one matching along candidate edges: greedy by distance, or as many pairs as possible at the least total distance.

Edges are rows of `by`, a, b and distance. What can be matched on its own is a unit: a group of `by` that is small enough, else a connected
component of its edges. Small units (CELLS places of a by b at most) are solved in one task each, many at a time; only larger ones take rounds of
joins over all tasks, which keep their state in the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.storage import kept

#: Places (objects of a times objects of b) of a unit that one task solves: 32 MB of doubles.
CELLS = 4_000_000
#: Rounds of large units before it is looked for parts that have become small.
ROUNDS = 6

Solver = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def greedy(a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Places of the edges that a pass by ascending (distance, a, b) takes. a and b: numbers in the order of the ids."""
    used_a, used_b, out = np.zeros(a.max() + 1, bool), np.zeros(b.max() + 1, bool), []
    for i in np.lexsort((b, a, distance)):
        if not used_a[a[i]] and not used_b[b[i]]:
            used_a[a[i]] = used_b[b[i]] = True
            out.append(i)
    return np.array(out, np.int64)


def least_cost(cost: np.ndarray) -> np.ndarray:
    """The column of each row of a matrix (no more rows than columns) in an assignment of least total cost: shortest augmenting paths with potentials."""
    n, m = cost.shape
    by_row, by_column = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        best, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        column, at = -1, row
        while True:
            reduced = cost[at] - by_row[at] - by_column
            shorter = ~done & (reduced < best)
            best[shorter], back[shorter] = reduced[shorter], column
            nearest = int(np.where(done, np.inf, best).argmin())
            step = best[nearest]
            by_row[row] += step
            by_row[owner[done]] += step
            by_column[done] -= step
            best[~done] -= step
            column = nearest
            if owner[column] < 0:
                break
            done[column] = True
            at = owner[column]
        while column >= 0:
            before = back[column]
            owner[column] = row if before < 0 else owner[before]
            column = before
    out = np.full(n, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def optimal(a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Places of the edges of a matching with as many pairs as possible and, among these, the least total distance."""
    shape = (a.max() + 1, b.max() + 1)
    none = float(distance.max()) * (min(shape) + 1) + 1.0  # dearer than any detour
    cost, place = np.full(shape, none), np.full(shape, -1)
    order = np.argsort(-distance, kind="stable")  # of edges between the same two, the shortest is written last
    cost[a[order], b[order]], place[a[order], b[order]] = distance[order], order
    flip = shape[0] > shape[1]
    chosen = least_cost(cost.T if flip else cost)
    found = place.T[np.arange(len(chosen)), chosen] if flip else place[np.arange(len(chosen)), chosen]
    return found[found >= 0]


def in_tasks(edges: DataFrame, unit: Sequence[str], by: Sequence[str], solver: Solver) -> DataFrame:
    """The edges that the solver takes in each unit."""
    columns = [*by, "a", "b", "distance"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        return pdf.iloc[solver(pd.factorize(pdf["a"], sort=True)[0], pd.factorize(pdf["b"], sort=True)[0], pdf["distance"].to_numpy())][columns]

    return edges.groupBy(*unit).applyInPandas(run, edges.select(*columns).schema)


def sized(edges: DataFrame, unit: Sequence[str]) -> DataFrame:
    """edges with `cells`: distinct a times distinct b of their unit."""
    ends = [edges.select(*unit, x).distinct().groupBy(*unit).agg(F.count("*").alias(f"__{x}")) for x in ("a", "b")]
    counts = ends[0].join(ends[1], list(unit)).select(*unit, (F.col("__a") * F.col("__b")).alias("cells"))
    return edges.join(counts, list(unit))


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node that it is linked with, over any way) from rows of u and v: alternating large and small stars."""
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())  # noqa: E731  tells sets of edges apart
    edges = kept(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, now = None, mark(edges)
    while before != now:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        edges = kept(small)
        before, now = now, mark(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def by_component(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """edges with `unit`, the least object of a of their component within each group of `by`."""
    node = lambda side, x: F.struct(*by, F.lit(side).alias("side"), F.when(F.lit(side == 0), F.col(x)).cast(edges.schema["a"].dataType).alias("a"), F.when(F.lit(side == 1), F.col(x)).cast(edges.schema["b"].dataType).alias("b"))
    ready = edges.withColumns({"__u": node(0, "a"), "__v": node(1, "b")})
    roots = components(ready.select(F.col("__u").alias("u"), F.col("__v").alias("v")))
    return ready.join(roots.select(F.col("node").alias("__u"), F.col("root").alias("unit")), "__u").drop("__u", "__v")


def matched(edges: DataFrame, by: Sequence[str], solver: Solver, large: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]], most_cells: int = CELLS) -> DataFrame:
    """by, a, b, distance of the chosen pairs: small groups and components in tasks, the others by `large`, which returns what it has chosen and the edges that are left for a next look (or None)."""
    columns = [*by, "a", "b", "distance"]
    own = list(by) or ["__all"]
    edges = kept(sized(edges.select(*columns) if by else edges.select(*columns, F.lit(0).alias("__all")), own))
    out = in_tasks(edges.where(F.col("cells") <= most_cells), own, by, solver)
    rest = edges.where(F.col("cells") > most_cells).select(*columns)
    while not rest.isEmpty():
        parts = kept(sized(by_component(rest, by), ["unit"]))
        out = out.unionByName(in_tasks(parts.where(F.col("cells") <= most_cells), ["unit"], by, solver))
        chosen, rest = large(parts.where(F.col("cells") > most_cells).drop("cells"))
        out = out.unionByName(chosen.select(*columns))
        if rest is None:
            break
    return out


def greedy_match(edges: DataFrame, by: Sequence[str], most_cells: int = CELLS) -> DataFrame:
    """Pairs by ascending (distance, a, b), each object once within its group of `by`."""

    def rounds(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs that are each other's first under one total order are what a global pass takes."""
        open_, won = kept(open_), None
        for _ in range(ROUNDS):
            first = {s: F.row_number().over(Window.partitionBy(*by, s).orderBy("distance", "a", "b")) for s in ("a", "b")}
            new = kept(open_.withColumns({f"__{s}": w for s, w in first.items()}).where("__a = 1 and __b = 1").select(*by, "a", "b", "distance"))
            won = new if won is None else won.unionByName(new)
            open_ = kept(open_.join(new.select(*by, "a"), [*by, "a"], "left_anti").join(new.select(*by, "b"), [*by, "b"], "left_anti"))
            if open_.isEmpty():
                break
        return won, open_.drop("unit")

    return matched(edges, by, greedy, rounds, most_cells)


def optimal_match(edges: DataFrame, by: Sequence[str], most_cells: int = CELLS, epsilon: float = 1e-3) -> DataFrame:
    """As many pairs as possible at the least total distance; in units of more than most_cells, at most their number of objects times epsilon above it."""
    return matched(edges, by, optimal, lambda parts: (auction(parts, by, epsilon), None), most_cells)


def auction(edges: DataFrame, by: Sequence[str], epsilon: float) -> DataFrame:
    """by, a, b and distance of the pairs of an auction with falling steps: every unassigned bidder bids for what it likes best at the present prices, each round a few joins.

    Bidders are the objects of a and mirror images of those of b; goods are the objects of b and mirror images of a. An object that stays alone takes its own image, and the
    images of two that are paired take each other, so all bidders can be served whatever the numbers on both sides, and prices may be kept from one step to the next.
    """
    if edges.isEmpty():
        return edges.drop("unit")
    shortest = kept(edges.groupBy("unit", *by, "a", "b").agg(F.min("distance").alias("distance")))
    worth = shortest.groupBy("unit").agg(((F.least(F.countDistinct("a"), F.countDistinct("b")) + 1) * F.max("distance") + 1).alias("c"))
    thing = lambda image, side, x: F.struct(F.lit(image).alias("image"), F.col("unit").alias("unit"), F.when(F.lit(side == "a"), F.col(x)).cast(edges.schema["a"].dataType).alias("a"), F.when(F.lit(side == "b"), F.col(x)).cast(edges.schema["b"].dataType).alias("b"))
    a, b, a_image, b_image = thing(0, "a", "a"), thing(0, "b", "b"), thing(1, "a", "a"), thing(1, "b", "b")
    real = shortest.join(worth, "unit")
    offers = real.select(a.alias("bidder"), b.alias("good"), (F.col("c") - F.col("distance")).alias("value"))
    offers = offers.unionAll(real.select(b_image.alias("bidder"), a_image.alias("good"), F.lit(0.0).alias("value")))
    offers = offers.unionAll(real.select(a, a_image, F.lit(0.0)).distinct()).unionAll(real.select(b_image, b, F.lit(0.0)).distinct())
    offers = kept(offers)
    bidders = kept(offers.select("bidder").distinct())
    step, last = (worth.agg(F.max("c")).first()[0] or 1.0) / 4, epsilon / 2  # a pair has two bidders
    state = offers.select("good").distinct().select("good", F.lit(0.0).alias("price"))
    while True:
        state = kept(state.select("good", "price", F.lit(None).cast(bidders.schema["bidder"].dataType).alias("owner")))
        while True:
            free = kept(bidders.join(state.where("owner is not null").select(F.col("owner").alias("bidder")), "bidder", "left_anti"))
            if free.isEmpty():
                break
            looked = offers.join(free, "bidder").join(state.select("good", "price"), "good").withColumn("profit", F.col("value") - F.col("price"))
            top = Window.partitionBy("bidder").orderBy(F.desc("profit"), "good")
            two = looked.withColumn("n", F.row_number().over(top)).where("n <= 2").groupBy("bidder").agg(
                F.max(F.when(F.col("n") == 1, F.struct("good", "price", "profit"))).alias("best"), F.max(F.when(F.col("n") == 2, F.col("profit"))).alias("second")
            )
            bids = two.select("bidder", "best.good", (F.col("best.price") + F.col("best.profit") - F.coalesce("second", "best.profit") + step).alias("bid"))
            won = bids.groupBy("good").agg(F.max(F.struct("bid", "bidder")).alias("w"))
            state = kept(state.join(won, "good", "left").select("good", F.coalesce("w.bid", "price").alias("price"), F.coalesce("w.bidder", "owner").alias("owner")))
        if step <= last:
            break
        step = max(step / 5, last)
    pairs = state.where("good.image = 0 and owner.image = 0").select("good.unit", "owner.a", "good.b")
    return pairs.join(shortest, ["unit", "a", "b"]).select(*by, "a", "b", "distance")
