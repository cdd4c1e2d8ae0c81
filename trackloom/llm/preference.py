"""Quality classifier: a Bradley-Terry model of documents, learnt from pairs of which one is the better.

Each document has a score w.x for its features x, and the better of a pair wins with probability 1 / (1 + exp(-(score - score'))), so w
is fitted by logistic loss on feature differences with a small penalty. All labelled documents are learnt from: each document of the larger class
meets `meets` of the other, round and round. Pairs are not stored: both classes are dealt to groups of a bounded size, and the tasks
of each step of Newton's method form the pairs of their groups and sum loss, slope and curvature, whose size depends on the features alone.

The threshold is an exact quantile of the scores of all labelled documents, at the level (of LEVELS around the share of label 0) that parts the two classes best;
documents below are rejected. Probabilities are logistic in score minus threshold, shifted so that the threshold has probability CUT.

Features: rates of symbols, marks, capitals, digits, lines, stop words, distinct words, repeated lines and shapes of words, lengths, the entropy of bytes, and shares
of pairs of neighbouring bytes in HASHED groups by hash; from bytes of the whole text.

Cases: null and empty texts have all features zero; labels other than 0 and 1, and documents labelled both, are not learnt from; without both
classes every document has probability 1; rows without doc_id are scored but not learnt from; repeated rows have repeated results; of several rows of one doc_id
the one of least features is learnt from.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.rules import STOP_WORDS
from trackloom.llm.shared import fold, kept, releasing, slices, texts_as_bytes

#: Probability of a document at the threshold: predictions are 1 from here on.
CUT = 0.3
#: Levels of the quantile, as multiples of the share of label 0.
LEVELS = (0.5, 0.75, 0.9, 1.0, 1.1, 1.25, 1.5)
#: Documents of the smaller class in a group, and how often a group goes through them.
BLOCK, ROUNDS = 4096, 16
#: Weight of the penalty.
PENALTY = 1e-4
#: Groups of pairs of bytes.
HASHED = 32
NAMES = (
    "symbols", "bars", "shouts", "capitals", "digits", "marks", "lines", "word_length", "stop_words", "distinct", "repeated_lines", "short",
    "upper_words", "title_words", "alphabetic_words", "long_words", "entropy", *[f"pairs_{i}" for i in range(HASHED)],
)
_STOPS = frozenset(w.encode() for w in STOP_WORDS)
#: Classes of bytes: capital, small letter (any byte above ASCII counts as one), digit, symbol, bar, exclamation mark, other mark, line feed.
_CLASS = np.full(256, 9, np.uint8)
for _number, _bytes in enumerate((range(65, 91), [*range(97, 123), *range(128, 256)], range(48, 58), b"#*$%&<>", b"|", b"!", b".,;:?\"'()[]{}/\\-_=+~^@`", b"\n")):
    _CLASS[list(_bytes)] = _number


def features(text: bytes) -> list[float]:
    """The values of NAMES for a text."""
    written, words = text.split(), text.lower().split()
    if not words:
        return [0.0] * len(NAMES)
    n = len(words)
    data = np.frombuffer(text, np.uint8)
    often = np.bincount(data, minlength=256)
    share = often[often > 0] / len(text)
    pairs = (data[:-1].astype(np.uint32) * 251 + data[1:]) * np.uint32(0x9E3779B1) >> np.uint32(27)
    capital, small, digit, symbol, bar, shout, mark, line = np.bincount(_CLASS, often, minlength=10)[:8].tolist()
    lines = [x for x in text.split(b"\n") if x.strip()]
    rate = lambda x: x / (x + n)  # noqa: E731  between 0 and 1 however many there are
    return [
        rate(symbol), rate(bar), rate(shout), capital / max(1, capital + small), digit / len(text), rate(mark), rate(line),
        min(1.0, sum(map(len, words)) / n / 20), sum(w in _STOPS for w in words) / n, len(set(words)) / n, 1 - len(set(lines)) / len(lines), 1 / n,
        sum(map(bytes.isupper, written)) / n, sum(map(bytes.istitle, written)) / n, sum(map(bytes.isalpha, written)) / n, sum(len(w) > 12 for w in words) / n,
        float(-(share * np.log2(share)).sum()) / 8, *(np.bincount(pairs, minlength=HASHED) / max(1, len(pairs))).tolist(),
    ]


def described(docs: DataFrame) -> DataFrame:
    """doc_id and x (array of the features) of each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(x) for x in texts_as_bytes(batch)], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), f"doc_id {kind}, x array<double>")


@dataclass(frozen=True)
class Model:
    """weights of the features and the threshold of the score; none: everything passes."""

    weights: tuple[float, ...] = ()
    threshold: float = 0.0

    def of(self, x: list[float]) -> float:
        """probability() for one document, by the same steps."""
        if not self.weights:
            return 1.0
        score = 0.0
        for value, w in zip(x, self.weights, strict=True):
            score += value * w
        return 1 / (1 + math.exp(max(-500.0, min(500.0, self.threshold - score))) * ((1 - CUT) / CUT))

    def probability(self, x: str = "x"):
        """Column of the probability that a document with features x is good."""
        if not self.weights:
            return F.lit(1.0)
        score = sum((F.get(x, i) * float(w) for i, w in enumerate(self.weights)), F.lit(0.0))
        return 1 / (1 + F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.lit(self.threshold) - score))) * float((1 - CUT) / CUT))


def numbered(rows: DataFrame, *order: Column | str) -> tuple[DataFrame, int]:
    """rows with i, their place in an order (from 0), and how many they are. No task takes more than a range of the order."""
    low = (1 << 33) - 1  # monotonically_increasing_id() has the partition above these bits
    placed = kept(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()))
    sizes = sorted((r.part, r.n) for r in placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    if not sizes:
        return placed.withColumnRenamed("place", "i"), 0
    ends = list(accumulate(n for _, n in sizes))
    before = rows.sparkSession.createDataFrame([(part, end - n) for (part, n), end in zip(sizes, ends, strict=True)], "part long, before long")
    named = placed.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(before), "part")
    return named.withColumn("i", F.col("before") + F.col("place").bitwiseAND(F.lit(low))).drop("part", "place", "before"), ends[-1]


def dealt(large: DataFrame, small: DataFrame, n_large: int, n_small: int, meets: int) -> DataFrame:
    """group, of_small, i and x: document i of the larger class stands in the groups that hold documents i * meets ... of the smaller, which it meets."""
    # a part is so many rounds through a block that a group is bounded however uneven the classes are
    rounds = max(1, ROUNDS * BLOCK // min(BLOCK, n_small))
    parts = (n_large * meets - 1) // n_small // rounds + 1
    start = F.col("i") * meets
    part = F.floor(F.floor(start / n_small) / rounds)
    blocks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(min(meets, n_small) - 1)), lambda k: F.floor((start + k) % n_small / BLOCK)))
    first = large.select("i", "x", part.alias("part"), F.explode(blocks).alias("block")).select((F.col("block") * parts + F.col("part")).alias("group"), F.lit(False).alias("of_small"), "i", "x")
    copies = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    second = small.select("i", "x", copies.alias("part")).select((F.floor(F.col("i") / BLOCK) * parts + F.col("part")).alias("group"), F.lit(True).alias("of_small"), "i", "x")
    return kept(first.unionByName(second).repartition("group").sortWithinPartitions("group", "of_small", "i"))


def differences(batches: Iterable[pa.RecordBatch], n_small: int, meets: int) -> Iterator[np.ndarray]:
    """Feature differences (larger class less smaller) of the pairs of a partition of dealt()."""

    def of_group(of_small: np.ndarray, i: np.ndarray, x: np.ndarray) -> Iterator[np.ndarray]:
        n = int((~of_small).sum())
        own, other, names = x[:n], x[n:], i[n:]
        if not n or not len(names):
            return
        for k in range(min(meets, n_small)):
            at = (i[:n] * meets + k) % n_small - names[0]
            here = (at >= 0) & (at < len(names))  # others are in the group of the next block
            yield own[here] - other[at[here]]

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
        new.append(batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        starts = np.flatnonzero(np.diff(held[0])) + 1
        for low, high in pairwise([0, *starts.tolist()]):
            yield from of_group(*[x[low:high] for x in held[1:]])
        held = [x[starts[-1] :] for x in held] if len(starts) else held  # the last group may go on in the next batch
    if held is not None:
        yield from of_group(*held[1:])


def sums(groups: DataFrame, weights: np.ndarray, n_small: int, meets: int) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Number of pairs, and the sums over them of the logistic loss, its slope and its curvature."""
    p = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + p + p * p)
        for d in differences(batches, n_small, meets):
            s = d @ weights
            wins = 1 / (1 + np.exp(np.minimum(-s, 500.0)))
            total[0] += len(d)
            total[1] += np.logaddexp(0, -s).sum()
            total[2 : 2 + p] += (wins - 1) @ d
            total[2 + p :] += ((d * (wins * (1 - wins))[:, None]).T @ d).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

    found = np.zeros(2 + p + p * p)
    for r in groups.mapInArrow(releasing(run), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        found[r.k] = r.v
    return found[0], found[1], found[2 : 2 + p], found[2 + p :].reshape(p, p)


def newton(groups: DataFrame, p: int, n_small: int, meets: int) -> np.ndarray:
    """The weights of least mean loss with the penalty, PENALTY / 2 times each squared weight times the variance of its differences, pairs taken both ways."""
    w = np.zeros(p)
    n, loss, slope, curve = sums(groups, w, n_small, meets)
    penalty = PENALTY * 2 * 4 * np.diag(curve) / max(1.0, 2 * n - 1)  # at weights of zero the curvature is a quarter of the squares
    used = penalty > 0  # features that are the same everywhere have no weight
    value = lambda loss, w: loss / n + penalty @ (w * w) / 2
    for _ in range(60):
        rise = slope / n + penalty * w
        step = np.zeros(p)
        step[used] = np.linalg.lstsq((curve / n + np.diag(penalty))[np.ix_(used, used)], rise[used], rcond=None)[0]
        gain, part = rise @ step, 1.0
        if gain < 1e-12:
            break
        while part > 1e-6:
            found = sums(groups, w - part * step, n_small, meets)
            if value(found[1], w - part * step) <= value(loss, w) - 1e-4 * part * gain:
                break
            part /= 2
        else:
            break  # no lower value within the precision of the sums
        w = w - part * step
        _, loss, slope, curve = found
    return w


def fit(examples: DataFrame, meets: int = 8) -> Model:
    """A model from examples (doc_id, x, label 0 or 1), all of which are learnt from."""
    (bad, n_bad), (good, n_good) = (numbered(examples.where(F.col("label") == label).select("doc_id", "x", "label"), F.xxhash64("doc_id"), "doc_id") for label in (0, 1))
    if not n_bad or not n_good:
        return Model()
    # document i of the larger class meets documents i * meets ... of the smaller, round and round
    large, small, n_large, n_small, sign = (good, bad, n_good, n_bad, 1.0) if n_good >= n_bad else (bad, good, n_bad, n_good, -1.0)
    p = len(small.select("x").first().x)
    weights = tuple((sign * newton(dealt(large, small, n_large, n_small, meets), p, n_small, meets)).tolist())
    score = sum((F.get("x", i) * w for i, w in enumerate(weights)), F.lit(0.0))
    scored, n = numbered(bad.unionByName(good).select("doc_id", "label", score.alias("s")), "s", "doc_id")
    share = n_bad / n
    levels = sorted({min(0.999, max(0.001, m * share)) for m in LEVELS})
    at = [level * (n - 1) for level in levels]
    near = {r.i: r.s for r in scored.where(F.col("i").isin(sorted({int(x) for x in at} | {math.ceil(x) for x in at}))).select("i", "s").collect()}
    cuts = [near[int(x)] + (x - int(x)) * (near[math.ceil(x)] - near[int(x)]) for x in at]
    wrong = scored.agg(*[F.count(F.when((F.col("label") == 1) == (F.col("s") < c), 1)).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
    best = min(range(len(cuts)), key=lambda i: (wrong[i], abs(levels[i] - share)))
    low, high = scored.agg(F.max(F.when(F.col("s") < cuts[best], F.col("s"))), F.min(F.when(F.col("s") >= cuts[best], F.col("s")))).first()
    return Model(weights, cuts[best] if low is None or high is None else (low + high) / 2)


def learnt(x: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows of x (doc_id, x) whose fold is not 0."""
    clear = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("top")).where(F.col("label") == F.col("top"))
    taught = clear.where(fold("doc_id") != 0).select("doc_id", "label")
    return fit(kept(x.join(taught, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("label").alias("label"))))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of op8."""
    x = kept(described(docs))
    scored = x.select("doc_id", (fold("doc_id") == 0).alias("held_out"), learnt(x, labels).probability().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns. Features are computed twice, to learn and to judge, so that no text moves."""
    model = learnt(kept(described(docs)), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000_000):
            keep = [model.of(features(x)) >= CUT for x in texts_as_bytes(batch)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(releasing(run), docs.schema)
