"""Source divergence: how far the term frequencies of each (lang, source) lie from the language's other sources and from the language.

Terms are counted in Arrow batches and summed by Spark. Each kept term is a row: its counts in the sources where it occurs, in the order
of sources. A pair of sources differs by what it would if no term occurred in either (one number for all terms), and corrections: of
terms that occur in one of the two, from the numbers of terms by (source, count), and of terms that occur in both, from a frequent-pattern tree of
the rows. Equal rows are counted before, then dealt by ranges and sorted, so a task meets its part of the tree in depth-first
order and holds one path of it: a node that is left gives its multiplicity to its parent and one correction for each of its ancestors,
shared by all rows below it. A node whose rows lie in two tasks is met in both, and its corrections add up.

All arithmetic is in whole numbers: a task's sums stay below 2**63 for up to 500 million kept terms of a language, all others are decimals.

Cases: null text, lang and source count as empty; a row without terms still makes its (lang, source) occur; a lang without kept terms has
pairs of value 0 and no terms; repeated rows count as documents of their own; columns other than text, lang and source are not
read; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from trackloom.llm.shared import kept, slices, small, texts_as_bytes

#: A term is kept if so many documents of its lang hold it; the top terms that are reported.
LEAST_DOCS, TOP = 3, 200
#: What an expected frequency is a whole number of.
SCALE = 1_000_000_000
#: Counts whose product with SCALE fits 64 bits.
FITS = 9_000_000_000
#: Terms that a task holds before it hands on their sums, and pairs of frequencies that it corrects at once.
HELD, BLOCK = 200_000, 65_536
#: Fixed: what separates terms becomes a space, A-Z lower case.
_FOLD = bytes(32 if i <= 0x40 or 0x5B <= i <= 0x60 or 0x7B <= i <= 0x7F else i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))
WIDE = "decimal(38,0)"


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that hold it), with partial sums of the reading tasks added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                terms = list(n)
                for low in range(0, len(terms), HELD):
                    part = terms[low : low + HELD]
                    same = lambda x: pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(part), np.int32)), pa.array([x])).dictionary_decode()  # noqa: B023, E731
                    columns = [same(lang), same(source), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([d[t] for t in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for batch in slices(batches, 2_000_000):
            langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lang, source, text in zip(langs, sources, texts_as_bytes(batch), strict=True):
                n, d = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
                words = text.translate(_FOLD).split()
                before = len(n)
                n.update(words)
                d.update(set(words))
                size += len(n) - before
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    partial = docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def frequency(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exactly."""
    n, total, terms = ((F.col(x) if isinstance(x, str) else x).cast("long") for x in (n, total, terms))
    wide = F.call_function("div", (F.lit(SCALE).cast(WIDE) * (n.cast("decimal(27,0)") + 1)).cast(WIDE), (total + terms).cast("decimal(27,0)"))
    return F.when(n < FITS, F.call_function("div", (n + 1) * SCALE, total + terms)).otherwise(wide) + 1


def excess(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q) of long columns."""
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(summed: DataFrame) -> DataFrame:
    """lang, term, row (array of source, n; by source) of the terms that enough documents of the lang hold."""
    by_term = summed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("row"))
    return by_term.where(F.col("docs") >= LEAST_DOCS).select("lang", "term", "row")


def groups(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, total (occurrences of kept terms), terms (kept ones of the lang), whole (their occurrences in the lang) and p0 (the frequency of a term that does not occur; null without kept terms) of each occurring group."""
    totals = terms.select("lang", F.explode("row").alias("r")).groupBy("lang", F.col("r.source").alias("source")).agg(F.sum("r.n").alias("total"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(F.aggregate("row", F.lit(0).cast("long"), lambda a, r: a + r["n"])).alias("whole"))
    occurring = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    every = occurring.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    filled = every.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "terms", "whole")])
    return filled.withColumn("p0", F.when(F.col("terms") > 0, frequency(F.lit(0), "total", "terms")))


def tree_pairs(terms: DataFrame, known: DataFrame) -> DataFrame:
    """lang, a, b, and four sums over the terms that occur in both sources a < b, for each way round: of the excess with both real frequencies, either, or none."""
    rows = terms.groupBy("lang", "row").agg(F.count("*").alias("m"))
    by_lang = known.groupBy("lang").agg(F.first("terms").alias("terms"), F.map_from_entries(F.collect_list(F.struct("source", F.struct("total", "p0")))).alias("of"))
    met = rows.join(small(kept(by_lang)), "lang")
    of = lambda r, x: F.element_at("of", r["source"])[x]
    path = F.transform("row", lambda r: F.struct(r["source"].alias("source"), frequency(r["n"], of(r, "total"), F.col("terms")).alias("p"), of(r, "p0").alias("p0")))
    sorted_rows = met.select("lang", path.alias("path"), "m").repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    flat = sorted_rows.select("lang", *[F.col(f"path.{x}").alias(x) for x in ("source", "p", "p0")], "m")
    return flat.mapInArrow(_walk, "lang string, a string, b string, ab_11 long, ab_10 long, ab_01 long, ab_00 long, ba_11 long, ba_10 long, ba_01 long, ba_00 long")


_SUMS = ("ab_11", "ab_10", "ab_01", "ab_00", "ba_11", "ba_10", "ba_01", "ba_00")


class _Pairs:
    """Sums by pair of sources of the corrections of nodes and ancestors, computed in blocks of at least BLOCK combinations."""

    def __init__(self) -> None:
        self.ids: dict[tuple[str, str], int] = {}
        self.sums: dict[int, np.ndarray] = {}
        self.above: tuple[list[int], list[int], list[int]] = ([], [], [])  # id, p, p0 of the ancestors of all waiting nodes, one node after the other
        self.nodes: list[tuple[int, int, int, int, int]] = []  # id, p, p0, multiplicity and depth of each waiting node

    def source(self, lang: str, name: str) -> int:
        return self.ids.setdefault((lang, name), len(self.ids))

    def add(self, path: tuple[list[int], ...], node: tuple[int, int, int, int]) -> None:
        for held, ancestors in zip(self.above, path, strict=False):
            held.extend(ancestors)
        self.nodes.append((*node, len(path[0])))
        if len(self.above[0]) >= BLOCK:
            self.settle()

    def settle(self) -> None:
        a, p, p0 = (np.array(x, np.int64) for x in self.above)
        fields = np.array(self.nodes, np.int64).reshape(-1, 5)
        b, q, q0, m = np.repeat(fields[:, :4], fields[:, 4], axis=0).T
        keys, inverse = np.unique(a << 32 | b, return_inverse=True)
        sums = np.zeros((len(keys), 8), np.int64)
        for i, (x, y) in enumerate(((p, q), (p, q0), (p0, q), (p0, q0), (q, p), (q, p0), (q0, p), (q0, p0))):
            np.add.at(sums[:, i], inverse, m * ((x - y) ** 2 // y))
        for key, row in zip(keys.tolist(), sums, strict=True):
            self.sums[key] = self.sums[key] + row if key in self.sums else row
        self.nodes.clear()
        for held in self.above:
            held.clear()

    def batch(self) -> pa.RecordBatch:
        self.settle()
        names = list(self.ids)
        ends = [(names[k >> 32], names[k & 0xFFFFFFFF]) for k in self.sums]
        columns = [pa.array(x, pa.string()) for x in ([a[0] for a, _ in ends], [a[1] for a, _ in ends], [b[1] for _, b in ends])]
        values = np.array(list(self.sums.values()), np.int64).reshape(-1, 8)
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(values[:, i]) for i in range(8))], ["lang", "a", "b", *_SUMS])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tree of sorted rows, of which one path is held: id, p, p0 and multiplicity of each node."""
    pairs, path, at = _Pairs(), ([], [], [], []), None
    ids, ps, p0s, ms = path

    def leave(depth: int) -> None:
        while len(ids) > depth:
            node = tuple(x.pop() for x in path)
            if ids:
                pairs.add(path[:3], node)
                ms[-1] += node[3]

    for batch in slices(batches, 1_000_000):
        for lang, source, p, p0, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if lang != at:
                leave(0)
                at = lang
            row = [pairs.source(lang, s) for s in source]
            same = 0
            for i, j, x, y in zip(ids, row, ps, p, strict=False):
                if i != j or x != y:
                    break
                same += 1
            leave(same)
            ids.extend(row[same:])
            ps.extend(p[same:])
            p0s.extend(p0[same:])
            ms.extend([0] * (len(row) - same))
            ms[-1] += m
    leave(0)
    yield pairs.batch()


def pair_values(terms: DataFrame, known: DataFrame) -> DataFrame:
    """lang, source, item (another source of the lang) and value of each ordered pair of sources."""
    wide = lambda c: c.cast(WIDE)
    other = small(known.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")))
    pairs = known.select("lang", "source", "terms", "p0").join(other, "lang").where("source <> item")
    base = pairs.select("lang", "source", "item", F.when(F.col("terms") > 0, wide(F.col("terms")) * wide(excess(F.col("p0"), F.col("q0")))).otherwise(F.lit(0).cast(WIDE)).alias("value"))
    numbers = terms.select("lang", F.explode("row").alias("r")).groupBy("lang", F.col("r.source").alias("source"), F.col("r.n").alias("n")).agg(F.count("*").alias("m"))
    real = numbers.join(small(known.drop("whole")), ["lang", "source"]).select("lang", "source", "p0", "m", frequency("n", "total", "terms").alias("p"))
    ones = real.join(other, "lang").where("source <> item")
    ways = lambda there, back: F.explode(F.array(F.struct("source", "item", there.alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), back.alias("value"))))
    p, p0, q0, m = (F.col(x) for x in ("p", "p0", "q0", "m"))
    more = lambda a, b: (wide(excess(*a)) - wide(excess(*b))) * wide(m)
    summed = ones.groupBy("lang", "source", "item").agg(F.sum(more((p, q0), (p0, q0))).alias("there"), F.sum(more((q0, p), (q0, p0))).alias("back"))
    single = summed.select("lang", ways(wide(F.col("there")), wide(F.col("back"))).alias("w")).select("lang", "w.*")
    total = tree_pairs(terms, known).withColumnsRenamed({"a": "source", "b": "item"}).groupBy("lang", "source", "item").agg(*[F.sum(wide(F.col(c))).alias(c) for c in _SUMS])
    both = lambda w: (F.col(f"{w}_11") - F.col(f"{w}_10") - F.col(f"{w}_01") + F.col(f"{w}_00")).cast(WIDE)
    double = total.select("lang", ways(both("ab"), both("ba")).alias("w")).select("lang", "w.*")
    return base.unionAll(single).unionAll(double).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def top_terms(terms: DataFrame, known: DataFrame) -> DataFrame:
    """lang, source, item (a term that the source has more than the lang), value and rank, to rank TOP."""
    whole = F.aggregate("row", F.lit(0).cast("long"), lambda a, r: a + r["n"])
    each = terms.select("lang", F.col("term").alias("item"), whole.alias("everywhere"), F.explode("row").alias("r")).select("lang", "item", "everywhere", F.col("r.source").alias("source"), F.col("r.n").alias("n"))
    met = each.join(small(known), ["lang", "source"]).select("lang", "source", "item", frequency("n", "total", "terms").alias("p"), frequency("everywhere", "whole", "terms").alias("q"))
    valued = met.where("p > q").select("lang", "source", "item", excess(F.col("p"), F.col("q")).alias("value"))
    return valued.withColumn("rank", F.row_number().over(_order())).where(F.col("rank") <= TOP)


def _order() -> WindowSpec:
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank of op12."""
    terms = kept(kept_terms(counts(docs)))
    known = kept(groups(docs, terms))
    pairs = pair_values(terms, known).withColumn("rank", F.row_number().over(_order()))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionAll(top_terms(terms, known).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  unnest(list_concat([''], regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM documents),
s AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS everywhere FROM s WHERE term <> '' GROUP BY lang, term HAVING sum(docs) >= 3),
l AS (SELECT lang, count(*) AS v, sum(everywhere) AS whole FROM k GROUP BY lang),
c AS (SELECT lang, source, term, n FROM s JOIN k USING (lang, term)),
g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, coalesce(whole, 0) AS whole FROM (SELECT lang, source FROM s WHERE term = '')
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN l USING (lang)),
p AS (SELECT lang, source, term, everywhere, whole, v, coalesce(n, 0) AS n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1)) // (total + v) AS HUGEINT) AS p
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
a AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
b AS (SELECT x.lang, x.source, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
q AS (SELECT lang, source, term AS item, p, 1 + (CAST(1000000000 AS HUGEINT) * (everywhere + 1)) // (whole + v) AS q FROM p WHERE n > 0),
u AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM b UNION ALL SELECT lang, source, 'term', item, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM q WHERE p > q),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= 200
"""
