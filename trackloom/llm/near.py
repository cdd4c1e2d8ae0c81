"""SimHash near duplicates: 64-bit fingerprints of word shingles, linked through vantage-point trees.

A tree parts fingerprints by their Hamming distance to vantage points: a node has a vantage point and a radius, and a fingerprint
belongs inside or outside of it, down to a leaf, its home. Who searches within r of a fingerprint at distance d need not look
inside if d - r > radius, nor outside if d + r <= radius (triangle bounds); near the boundary both sides are visited. Each leaf is a
shard: its own fingerprints, and the visitors whose search reaches it, meet in one task and are compared exactly.

On all 64 bits distances of unrelated fingerprints crowd around 32 and a search within 4 would visit most leaves. Of three stretches
of bits, however, one must differ in at most 4 // 3 = 1 bit if all differ in 4, so there is a tree for each stretch, searched within 1; the
comparison then takes all 64 bits. A leaf that is still large is cut into blocks, and each block of visitors meets each block
of its own, so no task holds more than two blocks. A shard returns a star for each group that it finds, not all pairs.

Trees are grown on the driver from a bounded sample of fingerprints (`sample`); all fingerprints are dealt by them, and a bad sample
costs time, not links. Equal fingerprints are one from the start. Groups that reach across shards are joined by minima of neighbours.

Cases: null and empty texts have fingerprint zero, linked like any other; rows without doc_id are linked, but only a doc_id names a
component (null where no member has one); repeated rows each have a result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.shared import kept, releasing, slices, small, texts_as_bytes, unused

#: Fixed: the seed of the shingles' hash.
SEED = 42
BLOCK_OF_SHINGLES = 1 << 16


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of each shingle of so many words, joined by spaces; a text of fewer words is one shingle, one without words has none."""
    split = text.lower().split()
    line = b" ".join(split)
    if len(split) <= words:
        return [xxhash.xxh64_intdigest(line, SEED)] if split else []
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)]


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash of the shingles of so many words (ASCII white space apart, A-Z lower-cased, repeats included)."""
    hashes = shingle_hashes(text, words)
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), BLOCK_OF_SHINGLES):
        block = np.array(hashes[low : low + BLOCK_OF_SHINGLES], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000_000):
            found = np.array([fingerprint(x, words) for x in texts_as_bytes(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), f"doc_id {kind}, fp long")


def stretches(n: int) -> list[int]:
    """Masks of n stretches of the 64 bits."""
    edges = [64 * i // n for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


@dataclass
class Tree:
    """A vantage-point tree for the bits of mask. For each node: vantage point, radius, the nodes inside and outside (a leaf: its number below zero)."""

    mask: int
    vantage: list[int] = field(default_factory=list)
    radius: list[int] = field(default_factory=list)
    inside: list[int] = field(default_factory=list)
    outside: list[int] = field(default_factory=list)
    leaves: int = 0

    @classmethod
    def grown(cls, sample: np.ndarray, mask: int, population: int, capacity: int, seed: int = 7) -> Tree:
        """Split while a leaf is expected to hold more than capacity of the population. The best of a few vantage points is taken."""
        tree, rng = cls(mask), np.random.default_rng(seed)
        each = population / max(1, len(sample))
        top = [(sample.astype(np.uint64), None, False)]
        while top:
            values, parent, is_inside = top.pop()
            best = None
            if len(values) * each > capacity and len(values) >= 4:
                for v in rng.choice(values, min(6, len(values)), replace=False):
                    d = np.bitwise_count((values ^ v) & np.uint64(mask)).astype(np.int64)
                    r = int(np.median(d))
                    for radius in (r - 1, r):  # the middle of few distances is often a crowd on one side
                        share = float((d <= radius).mean())
                        crowd = float(((d == radius) | (d == radius + 1)).mean())
                        if 0 < share < 1 and (best is None or abs(share - 0.5) + 0.5 * crowd < best[0]):
                            best = (abs(share - 0.5) + 0.5 * crowd, int(v), radius, d <= radius)
            if best is None:
                tree.leaves += 1
                number = -tree.leaves
            else:
                number = len(tree.vantage)
                tree.vantage.append(best[1])
                tree.radius.append(best[2])
                tree.inside.append(0)
                tree.outside.append(0)
                top += [(values[best[3]], number, True), (values[~best[3]], number, False)]
            if parent is not None:
                (tree.inside if is_inside else tree.outside)[parent] = number
        return tree

    def visits(self, values: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, leaf and whether it is the row's home, for each leaf that a search within r of a value must look at."""
        if not self.vantage:
            n = len(values)
            return np.arange(n), np.zeros(n, np.int64), np.ones(n, bool)
        out, top = [], [(0, np.arange(len(values)), np.ones(len(values), bool))]
        while top:
            node, rows, home = top.pop()
            if node < 0:
                out.append((rows, np.full(len(rows), -node - 1), home))
                continue
            d = np.bitwise_count((values[rows] ^ np.uint64(self.vantage[node])) & np.uint64(self.mask)).astype(np.int64)
            radius = self.radius[node]
            for child, look, own in ((self.inside[node], d - r <= radius, d <= radius), (self.outside[node], d + r > radius, d > radius)):
                if look.any():
                    top.append((child, rows[look], (home & own)[look]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def groups(values: np.ndarray, r: int) -> np.ndarray:
    """For each of the (distinct) values the first value of its group: all that are reached by steps of at most r bits. Searches from each value once."""
    root, rest = np.zeros(len(values), np.int64), np.arange(len(values))
    while len(rest):
        seed, front, rest = rest[0], rest[:1], rest[1:]
        root[seed] = seed
        while len(front) and len(rest):
            hit = np.zeros(len(rest), bool)
            for low in range(0, len(front), 256):
                hit |= (np.bitwise_count(values[front[low : low + 256], None] ^ values[rest][None, :]) <= r).any(axis=0)
            front, rest = rest[hit], rest[~hit]
            root[front] = seed
    return values[root]


def stars(values: np.ndarray, home: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked in a shard, at least where one side is at home: (value, first of its group), no loops."""
    own, near_own = values[home], np.zeros(int(home.sum()), bool)
    near = np.zeros(len(values), bool)
    for low in range(0, len(values), 256):
        d = np.bitwise_count(values[low : low + 256, None] ^ own[None, :])
        match = (d <= r) & (d > 0)
        near[low : low + 256] = match.any(axis=1)
        near_own |= match.any(axis=0)
    active = np.union1d(values[near], own[near_own])
    root = groups(active, r)
    return active[active != root], root[active != root]


def links(distinct: DataFrame, r: int = 4, parts: int = 3, capacity: int = 512, sample: int = 131_072, block: int = 8_192) -> DataFrame:
    """Pairs a, b of fingerprints of distinct (column fp) that join every pair within r bits: stars, so far fewer than the pairs.

    capacity: fingerprints that a leaf should hold. sample: fingerprints that the trees are grown from, those of least hash.
    block: leaves with more fingerprints or visitors are cut into blocks of about so many.
    """
    population = distinct.count()
    chosen = np.array([x.fp for x in distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], np.int64).view(np.uint64)
    within = r // parts
    trees = [Tree.grown(chosen, mask, population, capacity) for mask in stretches(parts)]
    first = np.concatenate([[0], np.cumsum([max(1, t.leaves) for t in trees])])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                values = batch.column(0).slice(low, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                for tree, offset in zip(trees, first, strict=False):
                    rows, leaf, home = tree.visits(values, within)
                    yield pa.RecordBatch.from_arrays([pa.array((leaf + offset).astype(np.int32)), pa.array(values[rows].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    dealt = distinct.select("fp").mapInArrow(releasing(deal), "shard int, fp long, home boolean")
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("m"), F.ceil(F.count_if("home") / block).cast("int").alias("k")).where(F.col("m") > 1)
    # one row at most for each leaf of trees that were grown from the bounded sample
    cut = dealt.join(F.broadcast(sizes), "shard", "left").withColumns({"m": F.coalesce("m", F.lit(1)), "k": F.greatest(F.coalesce("k", F.lit(1)), F.lit(1))})
    mine = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    mine_home = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("k")).cast("int")
    place = lambda visitor, own, home: F.struct(visitor.cast("int").alias("visitors"), own.cast("int").alias("own"), F.lit(home).alias("home"))
    as_visitor = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: place(mine, i, False))
    as_own = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: place(i, mine_home, True))
    whole = F.col("m") * F.col("k") == 1
    places = F.when(whole, F.array(F.struct(F.lit(0).alias("visitors"), F.lit(0).alias("own"), F.col("home").alias("home")))).when(F.col("home"), F.concat(as_visitor, as_own)).otherwise(as_visitor)
    met = cut.select("shard", "fp", F.explode(places).alias("p")).select("shard", "p.visitors", "p.own", "fp", "p.home")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("home", ascending=False).drop_duplicates("fp")
        a, b = stars(pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy(), r)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return met.groupBy("shard", "visitors", "own").applyInPandas(meet, "a long, b long")


#: So many edges are joined in one task.
FEW_EDGES = 200_000


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """v, root: every end of an edge a, b and the least value of its component (as signed).

    Each round makes all larger neighbours of a value point to the least of its neighbours, then the value and its smaller
    neighbours; both keep components whole. Every component is a star when a round changes nothing.

    Up to `few` edges are one partition, as each of the shuffles of each round would else write files for every shuffle partition, which take more
    space than the edges.
    """
    now = kept(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct())
    dealt = (lambda df: df.coalesce(1)) if now.count() <= few else (lambda df: df)
    state = None
    while True:
        both = dealt(now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u"))))
        least = both.groupBy("v").agg(F.min("u").alias("m"))
        large = both.join(least, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.least("m", "v").alias("u")).where("v <> u").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = dealt(large.join(down, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(down.select("v", F.col("m").alias("u"))).where("v <> u")).distinct()
        now = kept(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return now.select("v", F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("v"), F.col("u").alias("root")).distinct())


#: So many of the most frequent keys are sent to all tasks in with_names.
FREQUENT = 1000


def with_names(rows: DataFrame, named: DataFrame, key: str, name: str) -> DataFrame:
    """rows (kept) with the name of their key. named: key, name and copies (rows that have it), a row for each key.

    The FREQUENT keys of most copies are broadcast, so that no task takes all rows of one of them; the other keys meet by a shuffle.
    """
    frequent = kept(named.orderBy(F.desc("copies"), key).limit(FREQUENT).where("copies > 1").select(key, name))
    others = named.join(F.broadcast(frequent.select(key)), key, "left_anti").select(key, name)
    rare = rows.join(F.broadcast(frequent.select(key)), key, "left_anti")
    return rows.join(F.broadcast(frequent), key).unionByName(rare.join(others, key))


def duplicates(docs: DataFrame, r: int = 4, words: int = 4, **tuning: int) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id linked to it, itself included) of each row of docs."""
    marked = kept(fingerprints(docs, words))
    distinct = kept(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    joined = components(links(distinct, r, **tuning)).withColumnRenamed("v", "fp")
    linked = joined.join(distinct, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = distinct.join(joined.join(least, "root").select("fp", "component"), "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"), "copies")
    return with_names(marked, kept(named), "fp", "component_id").select("doc_id", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    """The columns of op1."""
    return duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, r: int = 4, words: int = 4) -> DataFrame:
    """The rows of docs whose doc_id names their component: one document of each group stays. Rows without doc_id, which can't be named, stay."""
    linked = duplicates(docs.where(F.col("doc_id").isNotNull()), r, words)
    return without(docs, linked.groupBy("doc_id").agg(F.min("component_id").alias("least")).where(F.col("doc_id") != F.col("least")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in gone."""
    name = unused(docs, "gone_id")
    return docs.join(small(kept(gone.select(F.col("doc_id").alias(name)))), F.col("doc_id") == F.col(name), "left_anti")


# ---- sets of shingles: similarity of 0.8 and more ----------------------------------------------------------------------------


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The different shingles of a text, by hash."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64).view(np.int64))


def set_key(shingles: np.ndarray) -> int:
    """A number for a set of shingles, equal for equal sets."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def prefix(shingles: np.ndarray, least: int, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set, so many that sets of at least that similarity (in hundredths) share one of theirs.

    The order is by hash, common shingles (sorted, and how common each is) last; any order that holds for all sets would lose nothing.
    """
    n = len(shingles)
    many = n + least * n // -100 + 1
    names, times = common
    if len(names) and n:
        at = np.minimum(np.searchsorted(names, shingles), len(names) - 1)
        shingles = shingles[np.lexsort((shingles, np.where(names[at] == shingles, times[at], 0)))]
    return shingles[:many]


#: Places of a sketch, and of a fine one (a multiple).
PLACES, FINE = 256, 2048


def sketch(shingles: np.ndarray, places: int = PLACES) -> bytes:
    """For each of so many ranges of the hashes, a byte (1 to 255) of the least shingle within it; 0 where there is none. shingles: sorted."""
    if not len(shingles):
        return bytes(places)
    edges = np.linspace(-(2.0**63), 2.0**63, places + 1)[:-1].astype(np.int64)
    at = np.searchsorted(shingles, edges)
    held = np.diff(np.append(at, len(shingles))) > 0
    least = shingles[np.minimum(at, len(shingles) - 1)].view(np.uint64)
    return np.where(held, least % np.uint64(255) + np.uint64(1), np.uint64(0)).astype(np.uint8).tobytes()


def coarse(fine: np.ndarray) -> np.ndarray:
    """The sketches of which rows of fine ones are made: the first place held in each range."""
    cells = fine.reshape(len(fine), PLACES, FINE // PLACES)
    return np.take_along_axis(cells, (cells > 0).argmax(axis=2)[:, :, None], axis=2)[:, :, 0]


def alike_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of each row of a to the same row of b."""
    either = ((a > 0) | (b > 0)).sum(axis=1)
    return np.where(either > 0, (((a == b) & (a > 0)).sum(axis=1) / np.maximum(either, 1) - 1 / 255) * 255 / 254, 1.0)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the sketches in the rows of a to all those of b: of the places that either holds, how many are equal (less the equal bytes of chance)."""
    equal, either = np.zeros((len(a), len(b)), np.int16), np.zeros((len(a), len(b)), np.int16)
    for place in range(PLACES):
        equal += a[:, place, None] == b[None, :, place]
    held = [np.packbits(x > 0, axis=1).view(np.uint64) for x in (a, b)]
    for word in range(PLACES // 64):
        either += np.bitwise_count(held[0][:, word, None] | held[1][None, :, word])
    equal -= PLACES - either  # places that are empty in both
    return np.where(either > 0, (equal / np.maximum(either, 1).astype(np.float32) - np.float32(1 / 255)) * np.float32(255 / 254), np.float32(1.0))


def forest(sketches: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, the row that each is linked to, and how alike: a spanning forest of most alike links among those of at least `least`.

    What any links join, these join, and two rows are joined by links above a bound if any such links join them.
    """
    n = len(sketches)
    found = np.empty((n, n), np.float32)
    for low in range(0, n, 128):
        found[low : low + 128] = alike(sketches[low : low + 128], sketches)
    np.fill_diagonal(found, -1)
    active = np.flatnonzero((found >= least).any(axis=1))
    best, to, open_ = np.full(n, -2.0, np.float32), np.zeros(n, np.int64), np.zeros(n, bool)
    best[active], open_[active] = -1, True
    rows, how = [], []
    for _ in active:  # the open row most like a row that is done comes next
        i = int(best.argmax())
        if best[i] >= least:
            rows.append(i)
            how.append(best[i])
        best[i], open_[i] = -2, False
        nearer = open_ & (found[i] > best)
        best[nearer] = found[i][nearer]
        to[nearer] = i
    return np.array(rows, np.int64), to[rows] if rows else np.zeros(0, np.int64), np.array(how, np.float32)


def in_shards(members: DataFrame, run_whole, schema: str, places: int = PLACES) -> DataFrame:
    """The Arrow batches that a function makes of whole shards: shard (sorted), set, root and sketch. A shard's rows fit in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3 + [np.zeros((0, places), np.uint8)]
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            new.append(np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, places))
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            shard = held[0]
            if len(shard) and shard[0] != shard[-1]:
                cut = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on in the next batch
                yield from run_whole(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        yield from run_whole(*held)

    return members.select("shard", "set", "root", "sketch").repartition("shard").sortWithinPartitions("shard", "set").mapInArrow(releasing(run), schema)


def starts_of(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each shard of sorted rows starts, and its rows."""
    starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(shard)))


def met(members: DataFrame, least: float) -> DataFrame:
    """shard, a, b, alike: the forests of the sets that share a shard."""

    def links_of(shard: np.ndarray, sets: np.ndarray, _: np.ndarray, sketches: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts, sizes = starts_of(shard)
        two = starts[sizes == 2]
        how = alike_rows(sketches[two], sketches[two + 1])
        two, how = two[how >= least], how[how >= least]
        s, a, b, h = [shard[two]], [sets[two]], [sets[two + 1]], [how]
        for low, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            i, j, found = forest(sketches[low : low + n], least)
            s, a, b, h = [*s, shard[low + i]], [*a, sets[low + i]], [*b, sets[low + j]], [*h, found.astype(np.float64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (s, a, b, h)], ["shard", "a", "b", "alike"])

    return in_shards(members, links_of, "shard long, a long, b long, alike double")


def apart_in(members: DataFrame, least: float, fine_least: float) -> DataFrame:
    """a, b: all pairs of sets of different roots that share a shard and are at least so alike by sketches and by fine sketches (members have the latter)."""

    def pairs_of(shard: np.ndarray, sets: np.ndarray, roots: np.ndarray, fine: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low, n in zip(*(x.tolist() for x in starts_of(shard)), strict=True):
            own, name, root = fine[low : low + n], sets[low : low + n], roots[low : low + n]
            rough = coarse(own)
            for at in range(0, n, 128):
                some = slice(at, at + 128)
                i, j = np.nonzero((alike(rough[some], rough) >= least) & (root[some, None] != root[None]) & (name[some, None] < name[None]))
                for few in range(0, len(i), 2048):
                    x, y = i[few : few + 2048] + at, j[few : few + 2048]
                    hit = alike_rows(own[x], own[y]) >= fine_least
                    yield pa.RecordBatch.from_arrays([pa.array(name[x[hit]]), pa.array(name[y[hit]])], ["a", "b"])

    return in_shards(members, pairs_of, "a long, b long", FINE)


def _by_set(docs: DataFrame, columns: str, rows, schema: str) -> DataFrame:
    """Rows that a function makes of columns of a batch and its texts."""
    names = columns.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, 1_000_000):
            yield rows([batch.column(i) for i in range(len(names))], texts_as_bytes(batch), seen)

    return docs.select(*names, "text").mapInArrow(releasing(run), schema)


def fingerprint_of(shingles: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed number."""
    counts = np.zeros(64, np.int64)
    for low in range(0, len(shingles), BLOCK_OF_SHINGLES):
        counts += np.unpackbits(shingles[low : low + BLOCK_OF_SHINGLES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view("<i8")[0])


def similar(docs: DataFrame, words: int = 5, least: int = 80, share: int = 16, common: int = 3, unsure: tuple[float, float] = (0.1, 0.12), block: int = 1536) -> tuple[DataFrame, DataFrame]:
    """doc_id and set (set_key of the shingles) of each row, and edges a, b between sets whose Jaccard similarity is least hundredths or more.

    First the sets whose fingerprints are linked through the vantage-point trees; then those that share a shingle of their prefixes, which all sets so similar do.
    Sets that share one are a shard, compared by sketches all with all (in blocks where they are more than `block`), and joined by the most alike links.
    Links that the sketches leave unsure (so much below or above the similarity) are tested shingle by shingle, where surer ones do not join the two already.
    Where one fails, others of its shard may hold: all pairs of that shard whose ends are still apart are tested, so no link between components is lost
    (but those that finer sketches, with the same number of standard errors, show to be too far apart). A sketch's standard error is 0.025 at most, so the bounds are four of them.
    share, common: shingles met so often in one of so many texts come last in the prefixes; that changes the time, not the links.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    low, high = least / 100 - unsure[0], least / 100 + unsure[1]

    def keys(given, texts, _):
        sets = [shingle_set(x, words) for x in texts]
        made = [pa.array([f(s) for s in sets], kind) for f, kind in ((set_key, pa.int64()), (fingerprint_of, pa.int64()), (sketch, pa.binary()))]
        return pa.RecordBatch.from_arrays([given[0], *made], ["doc_id", "set", "fp", "sketch"])

    def tokens(given, texts, seen):
        sets = [s for s in (shingle_set(x, words) for x in texts) if (k := set_key(s)) not in seen and not seen.add(k)]
        owner = np.repeat(np.array([set_key(s) for s in sets], np.int64), [len(s) for s in sets])
        return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], ["set", "token"])

    marked = kept(_by_set(docs, "doc_id", keys, f"doc_id {kind}, set long, fp long, sketch binary"))
    sets = kept(marked.groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch")))
    sketches = sets.select("set", "sketch")

    def judged(pairs: DataFrame) -> DataFrame:
        """a, b and alike of pairs a, b: each is a shard."""
        shards = pairs.select(F.xxhash64("a", "b").alias("shard"), F.explode(F.array("a", "b")).alias("set"))
        return met(shards.withColumn("root", F.col("set")).join(sketches, "set"), low).select("a", "b", "alike")

    def texts_of(some: DataFrame) -> DataFrame:
        """Rows of docs that have some sets (column set)."""
        return docs.join(small(kept(sets.join(some.select("set").distinct(), "set", "left_semi").select("doc_id").distinct())), "doc_id", "left_semi")

    def tested(pairs: DataFrame) -> DataFrame:
        pairs = kept(pairs)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("set"))
        held = kept(_by_set(texts_of(ends), "doc_id", shingles, "set long, shingles array<long>").dropDuplicates(["set"]))
        left, right = held.select(F.col("set").alias("a"), F.col("shingles").alias("x")), held.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
        both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
        return kept(both.where(F.col("shared") * 100 >= (F.size("x") + F.size("y") - F.col("shared")) * least).select("a", "b"))

    def shingles(given, texts, _):
        found = [shingle_set(x, words) for x in texts]
        return pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in found], pa.int64()), pa.array([s.tolist() for s in found], pa.list_(pa.int64()))], ["set", "shingles"])

    def fines(given, texts, _):
        found = [shingle_set(x, words) for x in texts]
        return pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in found], pa.int64()), pa.array([sketch(s, FINE) for s in found], pa.binary())], ["set", "sketch"])

    # links of fingerprints, as pairs of the least sets that have them
    heads = kept(sets.groupBy("fp").agg(F.min("set").alias("head")))
    ends = [heads.select(F.col("fp").alias(x), F.col("head").alias(f"{x}_set")) for x in "ab"]
    same = sets.join(heads, "fp").where("set <> head").select(F.col("head").alias("a"), F.col("set").alias("b"))
    near = links(heads.select("fp")).join(ends[0], "a").join(ends[1], "b").select(F.col("a_set").alias("a"), F.col("b_set").alias("b"))
    first = kept(judged(same.unionByName(near).distinct()))

    sampled = _by_set(docs.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0), "doc_id", tokens, "set long, token long").distinct()
    often = sampled.groupBy("token").count().where(F.col("count") >= common).orderBy(F.desc("count"), "token").limit(200_000).toPandas().sort_values("token")
    hot = docs.sparkSession.sparkContext.broadcast((often["token"].to_numpy(np.int64), often["count"].to_numpy(np.int64)))

    def firsts(given, texts, seen):
        found = [(k, s) for k, s in ((set_key(s), s) for s in (shingle_set(x, words) for x in texts)) if k not in seen and not seen.add(k)]
        parts = [prefix(s, least, hot.value) if len(s) else s for _, s in found]
        owner = np.repeat(np.array([k for k, _ in found], np.int64), [len(p) for p in parts])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *parts])), pa.array(owner)], ["token", "set"])

    # shingles of one row each are most of them; those with equal sets do the same, so that one of them is enough
    shared = Window.partitionBy("token")
    rows = _by_set(docs, "doc_id", firsts, "token long, set long").withColumns({"low": F.min("set").over(shared), "high": F.max("set").over(shared)}).where("low <> high").select("token", "set").distinct()
    rows = rows.withColumns({"size": F.count("*").over(shared), "sum": F.sum(F.xxhash64("set").cast("decimal(38,0)")).over(shared)})
    rows = rows.withColumn("one", F.min("token").over(Window.partitionBy("size", "sum", "set"))).where(F.col("one") == F.col("token")).select("token", "set", "size")
    joined = components(first.where(F.col("alike") >= high).select("a", "b")).withColumnRenamed("v", "set")
    rows = kept(rows.join(joined, "set", "left").withColumn("root", F.coalesce("root", "set")))
    mixed = rows.withColumns({"low": F.min("root").over(shared), "high": F.max("root").over(shared)}).where("low <> high")
    many = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("set", F.lit(1)), many).cast("int")
    places = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.xxhash64("token", F.least(own, i), F.greatest(own, i)))
    members = mixed.select("set", "root", F.explode(F.when(many == 1, F.array(F.col("token"))).otherwise(places)).alias("shard"))

    def between(pairs: DataFrame, edges: DataFrame) -> DataFrame:
        """pairs whose ends are in different components of edges."""
        roots = components(edges)
        ends = [roots.select(F.col("v").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab"]
        return pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select(*pairs.columns)

    in_a_shard = kept(met(members.join(sketches, "set"), low))
    found = kept(in_a_shard.select("a", "b", "alike").unionByName(first).groupBy("a", "b").agg(F.max("alike").alias("alike")))
    sure = found.where(F.col("alike") >= high).select("a", "b")
    edges = kept(sure.unionByName(tested(between(found.where(F.col("alike") < high).select("a", "b"), sure))))
    # the links of a shard's forest that failed: the only shards that may hold other links between components
    failed = kept(between(in_a_shard.where(F.col("alike") < high), edges).select("shard").distinct())
    if failed.isEmpty():
        return marked.select("doc_id", "set"), edges
    roots = components(edges).select(F.col("v").alias("set"), F.col("root").alias("now"))
    again = kept(members.join(small(failed), "shard", "left_semi").join(roots, "set", "left").select("shard", "set", F.coalesce("now", "set").alias("root")))
    fine = _by_set(texts_of(again), "doc_id", fines, "set long, sketch binary").dropDuplicates(["set"])
    return marked.select("doc_id", "set"), edges.unionByName(tested(apart_in(again.join(fine, "set"), low, least / 100 - unsure[0] * (PLACES / FINE) ** 0.5).distinct()))


def one_of_similar(docs: DataFrame, words: int = 5, least: int = 80) -> DataFrame:
    """The rows of docs but those linked, by texts of so many hundredths similarity or more each, to one of smaller doc_id.

    Rows without doc_id, which can't be named, stay; rows of one doc_id stay or go together; texts without words are alike.
    """
    marked, edges = similar(docs.where(F.col("doc_id").isNotNull()), words, least)
    sets = kept(marked.groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))
    placed = sets.join(components(edges).withColumnRenamed("v", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    named = placed.join(placed.groupBy("root").agg(F.min("doc_id").alias("least")), "root").select("set", "least", "copies")
    all_ = with_names(marked, kept(named), "set", "least")
    return without(docs, all_.groupBy("doc_id").agg(F.min("least").alias("least")).where(F.col("doc_id") != F.col("least")))
