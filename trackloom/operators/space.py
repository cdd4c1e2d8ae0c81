"""Neighbours and matching in space, mean squared displacement, layers and bands.

In the plane, places of one frame meet in the task that holds the frame, without a row for each pair. Other joins by distance are equi-joins on grid cells: an object is copied
to the cells around its own, and meets there only what lies within reach.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trackloom.operators import frames, matching, order
from trackloom.operators.storage import kept
from trackloom.operators.tracks import KEY, TIME


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size).cast("long")


def within(left: DataFrame, right: DataFrame, by: Sequence[str], axes: Sequence[str], reach: float) -> DataFrame:
    """Pairs of rows with equal `by` whose positions differ by at most reach on each axis. Columns of right have the prefix r_; axes must exist in both."""
    around = [F.struct(*[(_cell(c, reach) + d).alias(f"__c{i}") for i, (c, d) in enumerate(zip(axes, move, strict=True))]) for move in itertools.product((-1, 0, 1), repeat=len(axes))]
    a = left.select("*", F.explode(F.array(*around)).alias("__c")).select(*left.columns, "__c.*")
    b = right.select([F.col(c).alias(f"r_{c}") for c in right.columns] + [_cell(c, reach).alias(f"r___c{i}") for i, c in enumerate(axes)])
    on = [F.col(c) == F.col(f"r_{c}") for c in by] + [F.col(f"__c{i}") == F.col(f"r___c{i}") for i in range(len(axes))]
    near = [F.abs(F.col(c) - F.col(f"r_{c}")) <= reach for c in axes]
    joined = a.join(b, on).where(_all(near))
    return joined.drop(*[f"__c{i}" for i in range(len(axes))], *[f"r___c{i}" for i in range(len(axes))])


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out &= c
    return out


def _distance2(axes: Sequence[str]) -> Column:
    return sum((F.pow(F.col(c) - F.col(f"r_{c}"), 2) for c in axes), F.lit(0.0))


#: Bits of a cell's number on an axis, and how many levels of cells lie between two that are used.
BITS, STRIDE = 20, 2


def _code(cells: Sequence[str]) -> Column:
    """The bits of cell numbers in turn: cells that share a larger cell share the leading bits."""
    return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(F.shiftright(F.col(c), k).bitwiseAND(F.lit(1).cast("long")), k * len(cells) + i) for k in range(BITS) for i, c in enumerate(cells)])


def min_distance(df: DataFrame, axes: Sequence[str] = ("x_pos", "y_pos"), having: str | None = "speed", key: Sequence[str] = KEY) -> DataFrame:
    """min_distance of each row to the nearest other track at its experiment and time; null where it is alone.

    Only rows with a value of `having` count, on either side (a row of a track's first frame has no speed); None: all rows. Rows without position have none.

    Places of a frame are numbered by the codes of nested cells. The distance to the neighbours in the order of codes bounds that to the nearest place, so this lies in a cell
    of at least that width that touches the circle: a few cells for each place, of a level that suits how dense it is there. Places of several tracks are at distance 0 and never compared.
    """
    by, n = [key[0], TIME], len(axes)
    cells, at_cell = [f"__i{i}" for i in range(n)], [f"__c{i}" for i in range(n)]
    spots = df.where(_all([F.col(c).isNotNull() for c in [*axes, *([having] if having else [])]]))
    places = spots.groupBy(*by, *axes).agg(F.min(key[1]).alias("__a"), F.max(key[1]).alias("__b"))
    frames = places.groupBy(*by).agg(*[F.min(c).alias(f"__l{i}") for i, c in enumerate(axes)], F.greatest(F.lit(0.0), *[F.max(c) - F.min(c) for c in axes]).alias("__e"))
    sized = frames.withColumn("__s", F.when(F.col("__e") > 0, F.col("__e") * (1 + 1e-9) / 2**BITS).otherwise(1.0)).drop("__e")
    numbered = places.join(sized, by).withColumns({i: F.least(F.floor((F.col(c) - F.col(f"__l{k}")) / F.col("__s")), F.lit(2**BITS - 1)).cast("long") for k, (i, c) in enumerate(zip(cells, axes, strict=True))})
    placed = kept(numbered.withColumn("__code", _code(cells)))
    point = F.min(F.struct("__code", *axes)).alias("__point")
    codes = order.cumulative(placed.groupBy(*by, "__code").agg(F.count("*").alias("__n"), point), by, ["__code"], around="__point")
    to = lambda p: F.sqrt(sum((F.pow(F.col(c) - F.col(f"{p}.{c}"), 2) for c in axes), F.lit(0.0)))
    bound = F.when(F.col("__n") > 1, F.col("__s") * math.sqrt(n)).otherwise(F.least(to("previous"), to("following"))) * (1 + 1e-9)
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col("__bound") / F.col("__s")) / STRIDE).cast("int") * STRIDE)
    near = placed.where("__a = __b").join(codes.select(*by, "__code", "__n", "previous", "following"), [*by, "__code"]).withColumn("__bound", bound).where("__bound is not null")
    asked = kept(near.withColumn("__level", level).select(*by, *axes, "__a", "__s", "__bound", "__level", *cells, *[f"__l{i}" for i in range(n)]))
    used = asked.groupBy(*by).agg(F.collect_set("__level").alias("__levels"))  # BITS / STRIDE + 1 of them at most
    at = lambda i: F.call_function("shiftright", F.col(i), F.col("__level"))  # noqa: E731  the cell's number at the level
    width = F.col("__s") * F.pow(F.lit(2.0), F.col("__level"))
    moves = [F.struct(*[(at(i) + d).alias(c) for c, i, d in zip(at_cell, cells, move, strict=True)]) for move in itertools.product((-1, 0, 1), repeat=n)]
    around = asked.select(*by, *axes, "__a", "__s", "__bound", "__level", *[f"__l{i}" for i in range(n)], F.explode(F.array(*moves)).alias("__c")).select("*", "__c.*")
    gaps = [F.greatest(F.col(f"__c{i}") * width + F.col(f"__l{i}") - F.col(c), F.col(c) - (F.col(f"__c{i}") + 1) * width - F.col(f"__l{i}"), F.lit(0.0)) for i, c in enumerate(axes)]
    left = around.where(sum((g * g for g in gaps), F.lit(0.0)) <= F.pow("__bound", 2) * (1 + 1e-9)).select(*by, *axes, "__a", "__bound", "__level", *at_cell)
    right = placed.join(used, by).select(*by, *[F.col(c).alias(f"r_{c}") for c in axes], F.col("__a").alias("__ra"), F.col("__b").alias("__rb"), *cells, F.explode("__levels").alias("__level"))
    right = right.select(*by, *[f"r_{c}" for c in axes], "__ra", "__rb", "__level", *[at(i).alias(c) for i, c in zip(cells, at_cell, strict=True)])
    other = (F.col("__ra") != F.col("__a")) | (F.col("__rb") != F.col("__a"))
    distance = F.sqrt(F.min(_distance2(axes))).alias("min_distance")
    met = left.join(right, [*by, "__level", *at_cell]).where(other & (_distance2(axes) <= F.pow("__bound", 2)))
    found = kept(met.groupBy(*by, *axes).agg(distance))
    lost = asked.join(found, [*by, *axes], "left_anti").select(*by, *axes, "__a")  # only where a track has several places in a frame: its neighbours were its own
    everything = placed.select(*by, *[F.col(c).alias(f"r_{c}") for c in axes], F.col("__a").alias("__ra"), F.col("__b").alias("__rb"))
    rest = lost.join(everything, by).where(other).groupBy(*by, *axes).agg(distance)
    zero = placed.where("__a <> __b").select(*by, *axes, F.lit(0.0).alias("min_distance"))
    joined = df.join(found.unionByName(rest).unionByName(zero), [*by, *axes], "left")
    return joined.select(*df.columns, F.when(F.col(having).isNotNull(), F.col("min_distance")).alias("min_distance") if having else "min_distance")


def _places(table: pa.Table, axes: Sequence[str]) -> tuple[pa.Table, np.ndarray]:
    """The rows that have a finite position, and these (axes, rows)."""
    places = np.stack([pc.cast(table[c], pa.float64()).to_numpy() for c in axes])
    there = np.isfinite(places).all(axis=0)
    return (table, places) if there.all() else (table.filter(pa.array(there)), places[:, there])


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers from 0 in the order of the values; equal ones have the same."""
    return pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64) - 1


def _typed(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _known(df: DataFrame, by: Sequence[str], others: Sequence[str]) -> DataFrame:
    """These columns of the rows whose group is known, with identities of their own: both sides of a cogroup may come from one frame."""
    return df.where(_all([F.col(c).isNotNull() for c in by])).select(*[F.col(c).alias(c) for c in [*by, *others]])


def collectivity(kinematics: DataFrame, radius: float = 200.0, shape: str = "radius", axes: Sequence[str] = ("x_pos", "y_pos"), key: Sequence[str] = KEY) -> DataFrame:
    """collectivity of each row: mean cosine between its velocity (v_axis) and those of other tracks within the radius (or the cube) at its time.

    0 without such neighbours. Pairs with a zero velocity do not count, and rows without velocity have none.
    """
    moving = kinematics.where(_all([F.col(f"v_{c}").isNotNull() for c in axes])).select(*key, TIME, *axes, *[f"v_{c}" for c in axes])
    names, speeds = [*key, TIME], [f"v_{c}" for c in axes]

    def frame(table: pa.Table) -> pa.Table:
        alone, n_alone = np.zeros(len(table)), np.zeros(len(table), np.int64)
        known = np.ones(len(table), bool)
        for c in names:
            known &= ~table[c].is_null().to_numpy()
        places, speed = (np.stack([pc.cast(table[c], pa.float64()).to_numpy() for c in cs]) for cs in (axes, speeds))
        with np.errstate(all="ignore"):
            size = np.sqrt(speed[0] * speed[0] + speed[1] * speed[1])
            unit = speed / size
        rows = np.flatnonzero(known & np.isfinite(places).all(axis=0) & ~(size <= 0))
        if len(rows):
            p, u, track = places[:, rows], unit[:, rows], _numbers(table[key[1]])
            bad = ~np.isfinite(u).all(axis=0)
            value = np.stack([*np.where(bad, 0.0, u), np.ones(len(rows)), bad.astype(float)])
            sums = frames.sums_around(p, value, radius, shape != "radius") - value  # less its own
            own = track[rows]
            order = np.argsort(own, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                if len(part) > 1:  # less its track's other places in the frame
                    gap = np.abs(p[:, part, None] - p[:, None, part])
                    near = ((gap <= radius).all(axis=0) if shape != "radius" else gap[0] * gap[0] + gap[1] * gap[1] <= radius * radius) & ~np.eye(len(part), dtype=bool)
                    sums[:, part] -= value[:, part] @ near.T
            n = np.rint(sums[2].astype(float))
            total = np.where(bad | (sums[3] > 0.5), np.nan, (value[0] * sums[0] + value[1] * sums[1]).astype(float))
            total = np.where(n > 0, total, 0.0)
            both = np.bincount(own, total, track.max() + 1), np.bincount(own, n, track.max() + 1)
            n_alone = np.where(known, both[1][track], 0).astype(np.int64)
            alone = np.where(n_alone > 0, both[0][track] / np.maximum(both[1][track], 1), 0.0)
        return table.select(names).append_column("collectivity", pa.array(alone)).append_column("n_neighbours", pa.array(n_alone))

    if len(axes) == 2:
        return moving.groupBy(key[0], TIME).applyInArrow(frame, f"{_typed(moving, names)}, collectivity double, n_neighbours long").fillna({"collectivity": 0.0})
    pairs = within(moving, moving, [key[0], TIME], axes, radius).where(F.col(key[1]) != F.col(f"r_{key[1]}"))
    if shape == "radius":
        pairs = pairs.where(_distance2(axes) <= radius**2)
    dot = sum((F.col(f"v_{c}") * F.col(f"r_v_{c}") for c in axes), F.lit(0.0))
    norm = F.sqrt(sum((F.pow(f"v_{c}", 2) for c in axes), F.lit(0.0))) * F.sqrt(sum((F.pow(f"r_v_{c}", 2) for c in axes), F.lit(0.0)))
    mean = pairs.where(norm > 0).groupBy(*key, TIME).agg(F.avg(dot / norm).alias("collectivity"), F.count("*").alias("n_neighbours"))
    return moving.select(*key, TIME).join(mean, [*key, TIME], "left").fillna({"collectivity": 0.0, "n_neighbours": 0})


def nearest_within(objects: DataFrame, tracks: DataFrame, reach: float, by: Sequence[str], object_id: str, track_id: str, axes: Sequence[str] = ("x_pos", "y_pos")) -> DataFrame:
    """Each object with the nearest track of its frame within reach, its distance and offsets; others go. Ties: the smallest track id."""
    names = [*by, object_id, track_id, "distance", *[f"offset_{c}" for c in axes]]

    def frame(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return nothing.empty_table()
        (left, q), (right, p) = _places(left, axes), _places(right, axes)
        rank = _numbers(right[track_id])
        at, away = frames.nearest(q, p, rank, reach)
        found = np.flatnonzero(at >= 0)
        same = _numbers(left[object_id])[found]
        order = np.lexsort((rank[at[found]], away[found], same))
        rows = found[order[np.flatnonzero(np.diff(same[order], prepend=-1))]]
        out = left.take(pa.array(rows)).select([*by, object_id]).append_column(track_id, right[track_id].take(pa.array(at[rows]))).append_column("distance", pa.array(away[rows]))
        for c, there, here in zip(axes, p, q, strict=True):
            out = out.append_column(f"offset_{c}", pa.array(there[at[rows]] - here[rows]))
        return out

    if len(axes) == 2 and object_id != track_id:
        a, b = _known(objects, by, [object_id, *axes]), _known(tracks, by, [track_id, *axes])
        kinds = ", ".join([_typed(a, [*by, object_id]), _typed(b, [track_id]), *[f"`{c}` double" for c in names[len(by) + 2 :]]])
        nothing = to_arrow_schema(StructType.fromDDL(kinds))
        return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(frame, kinds)
    d2 = _distance2(axes)
    pairs = within(objects, tracks, by, axes, reach).where(d2 <= reach**2)
    order = Window.partitionBy(*by, object_id).orderBy("distance", f"r_{track_id}")
    ranked = pairs.select(*by, object_id, F.col(f"r_{track_id}").alias(track_id if track_id != object_id else f"r_{track_id}"), F.sqrt(d2).alias("distance"), *[(F.col(f"r_{c}") - F.col(c)).alias(f"offset_{c}") for c in axes], F.col(f"r_{track_id}"))
    return ranked.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", *([f"r_{track_id}"] if track_id != object_id else []))


def candidate_edges(a: DataFrame, b: DataFrame, reach: float, by: Sequence[str], axes: Sequence[str] = ("x_pos", "y_pos"), candidates: int | None = None) -> DataFrame:
    """by, a, b, distance of rows of a and b (columns id and axes) within reach; candidates: only so many nearest of each row of a."""
    d2 = _distance2(axes)
    edges = within(a.select(*by, "id", *axes), b.select(*by, "id", *axes), by, axes, reach).where(d2 <= reach**2).select(*by, F.col("id").alias("a"), F.col("r_id").alias("b"), F.sqrt(d2).alias("distance"))
    if candidates:
        edges = edges.withColumn("__k", F.row_number().over(Window.partitionBy(*by, "a").orderBy("distance", "b"))).where(F.col("__k") <= candidates).drop("__k")
    return edges


def _matched_in_frames(a: DataFrame, b: DataFrame, by: Sequence[str], axes: Sequence[str], matcher: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """by, a, b, distance of what the matcher of (places of a, places of b, numbers of their ids) pairs in each group."""

    def frame(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return nothing.empty_table()
        (left, p), (right, q) = _places(left, axes), _places(right, axes)
        i, j, d = matcher(p, q, _numbers(left["id"]), _numbers(right["id"]))
        out = left.take(pa.array(i, pa.int64()))
        return out.select(list(by)).append_column("a", out["id"]).append_column("b", right["id"].take(pa.array(j, pa.int64()))).append_column("distance", pa.array(d, pa.float64()))

    left, right = (_known(x, by, ["id", *axes]) for x in (a, b))
    kind = lambda x: x.schema["id"].dataType.simpleString()
    kinds = f"{_typed(left, by)}, a {kind(left)}, b {kind(right)}, distance double"
    nothing = to_arrow_schema(StructType.fromDDL(kinds))
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(frame, kinds)


def greedy_match(a: DataFrame, b: DataFrame, reach: float, by: Sequence[str], axes: Sequence[str] = ("x_pos", "y_pos"), candidates: int | None = None, most_cells: int = matching.CELLS) -> DataFrame:
    """One-to-one pairs (by, a, b, distance) of rows of a and b (columns id and axes) by ascending distance, then ids.

    In the plane a group of `by` is matched in the task that holds its places. Without groups, with other axes or candidates, or with fewer most_cells: along joined edges.
    """
    if by and len(axes) == 2 and candidates is None and most_cells >= matching.CELLS:
        return _matched_in_frames(a, b, by, axes, lambda p, q, m, n: frames.greedy(p, q, m, n, reach))
    return matching.greedy_match(candidate_edges(a, b, reach, by, axes, candidates), by, most_cells)


#: Tracks of a group, both sides together, that one task assigns.
MOST_ASSIGNED = 200_000


def assign_tracks(a: DataFrame, b: DataFrame, reach: float, by: Sequence[str] = (), track: str = "parent", axes: Sequence[str] = ("x_pos", "y_pos"), most_cells: int = matching.CELLS, epsilon: float = 1e-3) -> DataFrame:
    """Tracks of a and b matched one to one by mean position: as many pairs within reach as possible, at the least total distance.

    In the plane, groups of up to MOST_ASSIGNED tracks (of both sides) are solved from their positions in one task each; larger ones along joined edges, like all with fewer most_cells.
    """
    centre = lambda df: df.groupBy(*by, F.col(track).alias("id")).agg(*[F.avg(c).alias(c) for c in axes])
    left, right = centre(a), centre(b)
    along = lambda x, y: matching.optimal_match(candidate_edges(x, y, reach, by, axes), by, most_cells, epsilon)
    if not by or len(axes) != 2 or most_cells < matching.CELLS:
        return along(left, right)
    left, right = kept(left), kept(right)
    large = kept(left.select(*by).unionAll(right.select(*by)).groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > MOST_ASSIGNED).drop("n"))
    if large.isEmpty():
        return _matched_in_frames(left, right, by, axes, lambda p, q, m, n: frames.in_order(p, q, m, n, frames.assigned(p, q, reach)))
    small = _matched_in_frames(*[x.join(large, list(by), "left_anti") for x in (left, right)], by, axes, lambda p, q, m, n: frames.in_order(p, q, m, n, frames.assigned(p, q, reach)))
    return small.unionByName(along(*[x.join(large, list(by), "left_semi") for x in (left, right)]))


def remap_ids(df: DataFrame, matches: DataFrame, id_column: str, by: Sequence[str] = ()) -> DataFrame:
    """Ids of a replaced by the matched ids of b; rows without match go."""
    names = matches.select(*by, F.col("a").alias(id_column), F.col("b").alias("__new"))
    return df.join(names, [*by, id_column]).withColumn(id_column, F.col("__new")).drop("__new")


def offset_vote(a: DataFrame, b: DataFrame, by: Sequence[str], reach: int = 10, size: float = 1.0, axes: Sequence[str] = ("x_pos", "y_pos")) -> DataFrame:
    """Shifts of b against a on a grid, with the number of pairs that agree; the best first by votes, then the smallest shift."""
    pairs = within(a, b, by, axes, float(reach))
    shift = [F.round((F.col(f"r_{c}") - F.col(c)) / size).cast("long").alias(f"shift_{c}") for c in axes]
    return pairs.groupBy(*shift).agg(F.count("*").alias("votes"))


# ---- mean squared displacement -----------------------------------------------------------------------------------------------


#: Frames of a track that are compared with each other in one task.
BLOCK = 512


def _lagged(ta: np.ndarray, xa: np.ndarray, tb: np.ndarray, xb: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """tau, sum of squared distances, pairs and pairs with a distance of all rows of a and later rows of b up to `most` frames apart. x: (axes, rows), missing ones as masked."""
    tau = (tb[None, :] - ta[:, None]).ravel()
    there = np.flatnonzero((tau > 0) & (tau <= most))
    tau = tau[there]
    if not len(tau):
        return tuple(np.zeros(0, t) for t in (np.int64, float, np.int64, np.int64))
    d = sum(((p.data[None, :] - q.data[:, None]) ** 2).ravel()[there] for p, q in zip(xb, xa, strict=True))
    low = tau.min()
    n = known = np.bincount(tau - low)
    gone_a, gone_b = np.ma.getmaskarray(xa).any(axis=0), np.ma.getmaskarray(xb).any(axis=0)
    if gone_a.any() or gone_b.any():
        ok = ~(gone_a[:, None] | gone_b[None, :]).ravel()[there]
        d, known = np.where(ok, d, 0.0), np.bincount(tau - low, ok).astype(np.int64)
    at = np.flatnonzero(n)
    return at + low, np.bincount(tau - low, d)[at], n[at], known[at]


def _spots(column: pa.ListArray) -> list[tuple[np.ndarray, np.ma.MaskedArray]]:
    """Times and positions (axes, rows) of each row's array of structs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
    times = flat[0].cast(pa.int64()).to_numpy(zero_copy_only=False)
    places = np.ma.stack([np.ma.array(c.fill_null(0.0).to_numpy(zero_copy_only=False), mask=c.is_null().to_numpy(zero_copy_only=False)) for c in flat[1:]])
    return [(times[i:j], places[:, i:j]) for i, j in itertools.pairwise(ends)]


_LISTS = {"__taus": pa.int64(), "__sums": pa.float64(), "__ns": pa.int64(), "__knowns": pa.int64()}


def _with_lists(batch: pa.RecordBatch, names: Sequence[str], found: Sequence[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    ends = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[i] for f in found]), t)) for i, t in enumerate(_LISTS.values())]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *lists], [*names, *_LISTS])


def _lag_sums(df: DataFrame, max_tau: int | None, axes: Sequence[str], key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of (key, __taus, __sums, __ns, __knowns, __low, __high, __times): sums of squared distances of pairs of rows by lag, a row or more for each track.

    Blocks of BLOCK frames of a track are compared within themselves and with each other, so no pair of rows is shuffled and no task needs a whole track. __low to __high are
    the track's frames, __times the distinct frames of a row's block. Kept: tables are read once, whatever is made of the curves. Tracks without pairs are there too.
    The second frame has a row for each block: its first frame (__first), the position there, and the least and greatest (__at, __least, __greatest: structs of the axes).
    """
    track = Window.partitionBy(*key)
    spots = df.select(*key, TIME, *[F.col(c).cast("double").alias(c) for c in axes]).repartition(*key)
    placed = F.when(F.col(TIME).isNotNull(), F.struct(TIME, *axes))
    ends = [F.min_by(F.struct(*axes), TIME).alias("__at"), *[F.struct(*[f(c).alias(c) for c in axes]).alias(n) for f, n in ((F.min, "__least"), (F.max, "__greatest"))]]
    blocks = spots.groupBy(*key, F.floor(F.col(TIME) / BLOCK).alias("__block")).agg(F.collect_list(placed).alias("__spots"), F.min(TIME).alias("__first"), F.max(TIME).alias("__h"), *ends)
    low, high = F.min("__first").over(track), F.max("__h").over(track)
    marked = blocks.select(*key, "__block", "__spots", "__first", "__at", "__least", "__greatest", low.alias("__low"), high.alias("__high"), F.collect_list("__block").over(track).alias("__blocks"))
    most = F.ceil((F.col("__high") - F.col("__low")) / 2).cast("long") if max_tau is None else F.lit(max_tau).cast("long")
    places = ["__first", "__at", "__least", "__greatest"]
    names = [*key, "__block", "__low", "__high", "__most", "__blocks", *places]
    lists = ", ".join(f"{c} array<{'double' if t == pa.float64() else 'bigint'}>" for c, t in _LISTS.items())

    def own(batches):
        for batch in batches:
            spots = _spots(batch.column("__spots"))
            found = [_lagged(t, x, t, x, m) for (t, x), m in zip(spots, batch.column("__most").fill_null(0).to_pylist(), strict=True)]
            out = _with_lists(batch, names, found)
            several = pc.greater(pc.list_value_length(batch.column("__blocks")), 1)
            yield out.append_column("__times", pa.array([len(np.unique(t)) for t, _ in spots], pa.int64())).append_column("__spots", pc.if_else(several, batch.column("__spots"), pa.nulls(len(several), batch.column("__spots").type)))

    ready = marked.withColumn("__most", most).select(*names, "__spots")
    kinds = {f.name: f.dataType.simpleString() for f in ready.schema}
    typed = lambda cs: ", ".join(f"`{c}` {kinds[c]}" for c in cs)
    each = kept(ready.mapInArrow(own, f"{typed(names)}, {lists}, __times bigint, {typed(['__spots'])}"))

    several = each.where(F.size("__blocks") > 1)
    later = F.filter("__blocks", lambda o: (o > F.col("__block")) & ((o - F.col("__block") - 1) * BLOCK < F.col("__most")))
    first = several.select(*key, "__low", "__high", "__most", "__spots", F.explode(later).alias("__block"))
    second = several.select(*key, "__block", F.col("__spots").alias("__others"))
    met = first.join(second.hint("shuffle_hash"), [*key, "__block"])
    carried = [*key, "__low", "__high"]

    def across(batches):
        for batch in batches:
            found = [_lagged(*a, *b, m) for a, b, m in zip(_spots(batch.column("__spots")), _spots(batch.column("__others")), batch.column("__most").to_pylist(), strict=True)]
            yield _with_lists(batch, carried, found)

    between = met.select(*carried, "__most", "__spots", "__others").mapInArrow(across, f"{typed(carried)}, {lists}")
    columns = [*carried, *_LISTS]
    return each.select(*columns, "__times").unionByName(between.select(*columns, F.lit(0).cast("long").alias("__times"))), each.select(*key, *places)


def _curves(sums: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, tau, msd, n_pairs, and span and n (frames) of the track, from its sums; tasks hold whole tracks' curves, so what follows by track needs no exchange."""
    whole = sums.repartition(*key).select(*key, *_LISTS, (F.col("__high") - F.col("__low")).alias("span"), F.sum("__times").over(Window.partitionBy(*key)).alias("n"))
    long = whole.select(*key, "span", "n", F.inline(F.arrays_zip(*_LISTS)))
    total = long.where(_all([F.col(c).isNotNull() for c in key])).groupBy(*key, "span", "n", F.col("__taus").cast("int").alias("tau")).agg(F.sum("__sums").alias("__s"), F.sum("__ns").alias("n_pairs"), F.sum("__knowns").alias("__k"))
    return total.select(*key, "tau", (F.col("__s") / F.nullif(F.col("__k"), F.lit(0))).alias("msd"), "n_pairs", "span", "n")


def msd_pairs(df: DataFrame, max_tau: int | None, axes: Sequence[str] = ("x_pos", "y_pos"), key: Sequence[str] = KEY) -> DataFrame:
    """tau, msd and n_pairs of each track, from pairs of rows exactly tau frames apart. max_tau None: every tau up to half the track's span, rounded up."""
    return _curves(_lag_sums(df, max_tau, axes, key)[0], key).drop("span", "n")


def _of_tracks(curves: DataFrame, rule: str) -> DataFrame:
    """Curves up to the longest tau allowed for each track: half its span, rounded down, or (rule "well") up for tracks of more than six frames."""
    half = F.col("span") / 2
    good = F.col("tau") <= F.floor(half) if rule == "track" else (F.col("n") > 6) & (F.col("tau") <= F.ceil(half))
    return curves.where(good).drop("span", "n")


def msd_by_track(df: DataFrame, max_tau: int | None, rule: str = "track", axes: Sequence[str] = ("x_pos", "y_pos"), key: Sequence[str] = KEY) -> DataFrame:
    """msd_pairs up to half the track's span: rounded down, or (rule "well") up for tracks of more than six rows."""
    return _of_tracks(_curves(_lag_sums(df, max_tau, axes, key)[0], key), rule)


def msd_by_well(df: DataFrame, max_tau: int | None, quirk: bool = False, axes: Sequence[str] = ("x_pos", "y_pos"), key: Sequence[str] = KEY) -> DataFrame:
    """Mean of the tracks' curves at each tau of a well, of tracks with at least three taus of which one is 1. quirk: without the longest tau, as in the original."""
    track = Window.partitionBy(*key)
    curves = msd_by_track(df, max_tau, "well", axes, key).withColumns({"__n": F.count("*").over(track), "__least": F.min("tau").over(track)})
    out = curves.where("__n >= 3 and __least = 1").groupBy(key[0], "tau").agg(F.avg("msd").alias("msd"), F.count("*").alias("n_tracks"))
    if not quirk:
        return out
    return out.withColumn("__most", F.max("tau").over(Window.partitionBy(key[0]))).where("tau < __most").drop("__most")


def msd_models(curves: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """For each track of at least three taus with 1 among them: linearity, and D, v and BIC of the Brownian (4 D tau) and the directed model.

    Directed: 4 D tau + v^2 tau^2 by least squares with D >= 0 and v >= 1. Power: D tau^alpha by a line through logarithms.
    """
    t, m = F.col("tau").cast("double"), F.col("msd")
    log = F.when((m > 0), F.ln(m))
    s = curves.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("tau").alias("least"), F.regr_r2(m, t).alias("linearity"), F.sum(t * t).alias("s2"), F.sum(t * t * t).alias("s3"), F.sum(F.pow(t, 4)).alias("s4"), F.sum(t * m).alias("m1"),
        F.sum(t * t * m).alias("m2"), F.sum(m * m).alias("mm"), F.regr_slope(log, F.ln(t)).alias("alpha"), F.regr_intercept(log, F.ln(t)).alias("log_d"),
    ).where("n >= 3 and least = 1")
    n = F.col("n")
    bic = lambda rss, k: n * F.ln(F.greatest(rss, F.lit(1e-12)) / n) + k * F.ln(n)
    s = s.withColumn("brownian_d", F.col("m1") / (4 * F.col("s2")))
    s = s.withColumn("brownian_bic", bic(F.col("mm") - 8 * F.col("brownian_d") * F.col("m1") + 16 * F.pow("brownian_d", 2) * F.col("s2"), 1))
    # least squares in (4 D, v^2); at a bound the other is solved alone
    det = F.nullif(F.col("s2") * F.col("s4") - F.pow("s3", 2), F.lit(0.0))
    p, q = (F.col("m1") * F.col("s4") - F.col("m2") * F.col("s3")) / det, (F.col("m2") * F.col("s2") - F.col("m1") * F.col("s3")) / det
    s = s.withColumns({"__p": p, "__q": q})
    rss = lambda a, b: F.col("mm") - 2 * (a * F.col("m1") + b * F.col("m2")) + a * a * F.col("s2") + 2 * a * b * F.col("s3") + b * b * F.col("s4")
    zero, one = F.lit(0.0), F.lit(1.0)
    on_d = (zero, F.greatest(F.col("m2") / F.col("s4"), one))
    on_v = (F.greatest((F.col("m1") - F.col("s3")) / F.col("s2"), zero), one)
    free = (F.col("__p") >= 0) & (F.col("__q") >= 1)
    better = rss(*on_d) <= rss(*on_v)
    pick = lambda i, f: F.when(free, f).when(better, on_d[i]).otherwise(on_v[i])
    s = s.withColumns({"__a": pick(0, F.col("__p")), "__b": pick(1, F.col("__q"))})
    return s.select(
        *key, "n", "linearity", "brownian_d", "brownian_bic", (F.col("__a") / 4).alias("directed_d"), F.sqrt("__b").alias("directed_v"), bic(rss(F.col("__a"), F.col("__b")), 2).alias("directed_bic"),
        F.exp("log_d").alias("power_d"), F.col("alpha").alias("power_alpha"),
    )


def zones(df: DataFrame, axis: str = "y_pos", key: Sequence[str] = KEY) -> DataFrame:
    """zone (1 to 3, by sixths of the height) of each track by its start's distance from the experiment's mid-line."""
    return _zones(df.groupBy(*key).agg(F.min_by(axis, TIME).alias("start"), F.min(axis).alias("low"), F.max(axis).alias("high")), key)


def _zones(starts: DataFrame, key: Sequence[str]) -> DataFrame:
    """zone of each track from its start and its extent."""
    frame = Window.partitionBy(key[0])
    sized = starts.withColumns({"low": F.min("low").over(frame), "high": F.max("high").over(frame)})
    away = F.abs(F.col("start") - (F.col("low") + F.col("high")) / 2)
    sixth = F.nullif((F.col("high") - F.col("low")) / 6, F.lit(0.0))
    return sized.select(*key, F.least(F.floor(F.coalesce(away / sixth, F.lit(0.0))), F.lit(2)).cast("int").alias("zone0")).select(*key, (F.col("zone0") + 1).alias("zone"))


def msd_by_zone(df: DataFrame, max_tau: int | None, key: Sequence[str] = KEY) -> DataFrame:
    """Mean curve of the tracks of each zone."""
    axes, axis = ("x_pos", "y_pos"), "y_pos"
    sums, blocks = _lag_sums(df, max_tau, axes, key)
    starts = blocks.groupBy(*key).agg(F.min_by(f"__at.{axis}", "__first").alias("start"), F.min(f"__least.{axis}").alias("low"), F.max(f"__greatest.{axis}").alias("high"))
    curves = _of_tracks(_curves(sums, key), "track").join(_zones(starts, key), list(key))
    return curves.groupBy(key[0], "zone", "tau").agg(F.avg("msd").alias("msd"), F.count("*").alias("n_tracks"))


# ---- layers and bands --------------------------------------------------------------------------------------------------------


def quantile_layers(df: DataFrame, column: str, quantiles: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """layer: the number (from 0) of the right-closed bin between the column's quantiles; the lowest value belongs to the first."""
    inner = {f"__e{i}": q for i, q in enumerate(quantiles[1:-1])}
    layer = sum(((F.col(column) > F.col(e)).cast("int") for e in inner), F.lit(0))
    return order.with_quantiles(df, column, inner, by).withColumn("layer", F.when(F.col(column).isNotNull(), layer)).drop(*inner)


#: A row for each of so many groups at most is broadcast.
MOST_GROUPS = 100_000


def distance_layers(df: DataFrame, feature: str, width: float = 30.0, n: int = 5, axis: str = "y_pos", quirk: bool = False, by: str = "experiment") -> DataFrame:
    """Mean of a feature by time and layer of the distance to the experiment's mid-line; the last layer is open. quirk: half the height for the mid-line, as in the original."""
    low, high = F.min(axis), F.max(axis)
    lines = df.groupBy(by).agg(((high - low) / 2 if quirk else (high + low) / 2).alias("__m"))
    middle = df.join(F.broadcast(lines) if lines.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS else lines, by)
    layer = F.least(F.floor(F.abs(F.col(axis) - F.col("__m")) / width), F.lit(n - 1)).cast("int")
    return middle.groupBy(by, TIME, layer.alias("layer")).agg(F.avg(feature).alias("mean"), F.count(feature).alias("n"))


def scratch_bands(df: DataFrame, sigmas: float = 2.0, axis: str = "y_pos", by: str = "experiment") -> DataFrame:
    """The empty band of each experiment and time: the widest gap between neighbours in y, if wider than the mean gap by so many deviations (ddof 0).

    band_top, band_bottom, n_bands (over 1: more than one gap qualifies) and closed: whether the band has vanished by then, which lasts.
    """
    line = Window.partitionBy(by, TIME).orderBy(axis, "parent")
    gaps = df.select(by, TIME, F.lag(axis).over(line).alias("low"), F.col(axis).alias("high")).withColumn("gap", F.col("high") - F.col("low")).where("gap is not null")
    frame = Window.partitionBy(by, TIME)
    marked = gaps.withColumn("wide", F.col("gap") >= F.avg("gap").over(frame) + sigmas * F.stddev_pop("gap").over(frame))
    wide = F.col("wide") & (F.col("gap") > 0)
    widest = F.max(F.when(wide, F.struct("gap", "low", "high")))
    each = marked.groupBy(by, TIME).agg(F.count_if(wide).alias("n_bands"), widest.alias("w"))
    open_ = (F.col("n_bands") > 0).cast("int")
    before = Window.partitionBy(by).orderBy(TIME)
    # closed from the first time without a band that follows one with a band
    seen = each.withColumn("__seen", F.max(open_).over(before)).withColumn("__shut", ((F.col("__seen") == 1) & (F.col("n_bands") == 0)).cast("int"))
    closed = F.max("__shut").over(before) == 1
    return seen.select(by, TIME, "n_bands", F.when(~closed, F.col("w.low")).alias("band_bottom"), F.when(~closed, F.col("w.high")).alias("band_top"), closed.alias("closed"))

