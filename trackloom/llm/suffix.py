"""Language-model scores from a probabilistic suffix tree over the bytes of words.

A text is its words (A-Z lower-cased) with one space between and an end symbol. The tree's states are contexts of up to DEPTH bytes. A
context is retained if what follows it differs enough from what follows its suffix: n * KL(next | context, next | suffix) must
exceed half the logarithm of n for each symbol that follows (n: how often the context was seen; the price of describing them).
The distribution of a retained context is smoothed towards that of its longest retained suffix, with as much weight as it has different
followers. A text's score sums log10 of each symbol's probability in the longest retained suffix of what came before it.

Counts cover all training texts: tasks count grams (context and symbol) of their texts, sums are grouped by gram, and the tree is
built one context length after the other by joins and windows over at most 256 followers. To score, texts are dealt to chunks
of bounded size; each chunk asks for the words and grams that occur in it, the answers are joined to it from the counts and the tree, and
meet the chunk's texts in one task. So no task holds the whole vocabulary or the whole tree.

Cases: a null text counts as empty: its end is its only token; rows without doc_id are training rows if the empty text's crc32 says so; repeated
rows count as often as they occur; without training texts every symbol is equally likely; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.shared import fold, kept, key_of, slices, texts_as_bytes

#: Bytes of the longest context.
DEPTH = 5
#: A space before a gram, in a number of eight bytes: words hold no space.
GRAM = 0x20 << 56
#: Fixed: the end symbol and end token, which no word holds.
END = b"\n"
#: Bytes of text that a task looks at together.
SLICE = 500_000
#: Bytes of text in a chunk.
CHUNK = 20_000_000


def grams(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The gram at each symbol of the texts (given as words), and how many symbols each text has.

    A gram has the symbol in its lowest byte and what came before it in the next; before a text stands an end, and before that zeros.
    """
    pad = b"\0" * (DEPTH - 1) + END
    lines = [pad + b" ".join(x) + END for x in split]
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    data = b"\0" * 7 + b"".join(lines)
    # the eight bytes up to each place, read as one number
    code = np.ndarray(len(data) - 7, ">u8", data, strides=(1,)).astype(np.uint64) & np.uint64((1 << 8 * (DEPTH + 1)) - 1)
    real = np.ones(len(code), bool)
    starts = np.cumsum(lengths) - lengths
    for k in range(DEPTH):
        real[starts + k] = False
    return code[real], lengths - DEPTH


class Lookup:
    """Values by key, for arrays of keys that are all there: keys are sorted by a short hash, whose places are kept."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        slot = self.slot(keys)
        order = np.argsort(slot)
        self.keys, self.values = keys[order], values[order]
        sizes = np.bincount(slot.astype(np.int64), minlength=1 << (64 - int(self.shift)))
        self.first = (np.cumsum(sizes) - sizes).astype(np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.first[self.slot(keys)]
        missed = np.flatnonzero(self.keys[at] != keys)
        while len(missed):
            at[missed] += 1
            missed = missed[self.keys[at[missed]] != keys[missed]]
        return self.values[at]


def gram_keys(gram: np.ndarray) -> pa.Array:
    """Grams as binary keys that no word can equal."""
    data = (gram | np.uint64(GRAM)).astype(">u8").tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(gram), [None, pa.py_buffer(data)]).cast(pa.binary())


def grams_of(keys: pa.ChunkedArray) -> np.ndarray:
    fixed = keys.cast(pa.binary(8)).combine_chunks()
    if isinstance(fixed, pa.ChunkedArray):
        fixed = pa.concat_arrays(fixed.chunks) if fixed.num_chunks else pa.array([], pa.binary(8))
    return np.frombuffer(fixed.buffers()[1], ">u8", len(fixed), fixed.offset * 8).astype(np.uint64) & np.uint64(GRAM - 1)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted values without repeats (np.unique hashes, which is slower here)."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


class Sums:
    """Counts by gram, gathered in sorted arrays; given out when there are many."""

    def __init__(self, most: int = 2_000_000):
        self.most, self.parts, self.size = most, [], 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.parts.append((values, counts))
        self.size += len(values)
        if self.size > self.most:
            self.merge()
            if self.size > self.most // 2:
                yield from self.all()

    def merge(self) -> None:
        values, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        self.parts = [(values[first], np.add.reduceat(counts, first))]
        self.size = len(first)

    def all(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.size:
            self.merge()
            yield self.parts[0]
        self.parts, self.size = [], 0


def counted(docs: DataFrame) -> DataFrame:
    """gram and n (occurrences in training texts; 0 if only in others) of docs (text, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        rows = lambda found: (pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n)], ["gram", "n"]) for v, n in found)
        for batch in slices(batches, SLICE):
            code, lengths = grams([x.lower().split() for x in texts_as_bytes(batch)])
            held = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(bool), lengths)
            values, counts = np.unique(code[~held], return_counts=True)
            yield from rows(sums.add(values, counts.astype(np.int64)))
            values = distinct(code[held])
            yield from rows(sums.add(values, np.zeros(len(values), np.int64)))
        yield from rows(sums.all())
        pa.default_memory_pool().release_unused()

    return docs.select("text", "held_out").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _low(column: str, n_bytes: int) -> Column:
    return F.col(column).bitwiseAND(F.lit((1 << 8 * n_bytes) - 1))


def tree(counts: DataFrame) -> DataFrame:
    """gram and logp (log10 of its symbol's probability after its context) for each gram of counts, by the retained contexts."""
    levels = [counts.withColumnRenamed("gram", "g")]
    for k in range(DEPTH - 1, -1, -1):
        levels.append(kept(levels[-1].groupBy(_low("g", k + 1).alias("g")).agg(F.sum("n").alias("n"))))
    levels.reverse()
    every = Window.partitionBy(F.lit(0))  # at most 256 rows
    now = levels[0].withColumn("total", F.sum("n").over(every)).withColumn("p", (F.col("n") + 0.5) / (F.col("total") + 128.0))
    for k in range(1, DEPTH + 1):
        above = now.select(F.col("g").alias("suffix"), F.col("n").alias("n_suffix"), F.col("total").alias("total_suffix"), F.col("p").alias("p_suffix"))
        state = Window.partitionBy("context")
        joined = levels[k].withColumn("suffix", _low("g", k)).join(above, "suffix").withColumn("context", F.call_function("shiftright", "g", F.lit(8)))
        summed = joined.withColumns({"total": F.sum("n").over(state), "followers": F.sum((F.col("n") > 0).cast("double")).over(state)})
        gain = F.when(F.col("n") > 0, F.col("n") * F.ln(F.col("n") / F.col("total") * F.col("total_suffix") / F.col("n_suffix")))
        retained = F.coalesce(F.sum(gain).over(state), F.lit(0.0)) > 0.5 * F.col("followers") * F.ln(F.greatest("total", F.lit(1)))
        smoothed = (F.col("n") + F.col("followers") * F.col("p_suffix")) / (F.col("total") + F.col("followers"))
        now = kept(summed.select("g", "n", "total", F.when(retained, smoothed).otherwise(F.col("p_suffix")).alias("p")))
    return now.select(F.col("g").alias("gram"), F.log10("p").alias("logp"))


def questions_of(table: pa.Table) -> pa.Table:
    """What a chunk (text, held_out, chunk) asks for: its words, with their counts in its training texts, and its grams, with zeros."""
    found: Counter[bytes] = Counter({END: 0})
    parts: list[np.ndarray] = []
    for batch in slices(table.select(["text", "held_out"]).to_batches(), SLICE):
        split = [x.lower().split() for x in texts_as_bytes(batch)]
        parts.append(distinct(grams(split)[0]))
        if len(parts) == 6:
            parts = [distinct(np.concatenate(parts))]
        for words, held in zip(split, batch.column(1).to_pylist(), strict=True):
            if held:
                for w in set(words):
                    found[w] += 0
            else:
                found.update(words)
                found[END] += 1
    gram = distinct(np.concatenate(parts))
    key = pa.concat_arrays([pa.array(found.keys(), pa.binary()), gram_keys(gram)])
    value = np.zeros(len(key))
    value[: len(found)] = np.fromiter(found.values(), np.float64, len(found))
    return pa.table({"chunk": pa.array(np.full(len(key), table["chunk"][0].as_py(), np.int32)), "key": key, "value": value})


def scores_of(table: pa.Table, given: pa.Table) -> pa.Table:
    """Scores of a chunk's texts (doc_id, text, held_out) by the answers to its questions (key, value, counts)."""
    is_gram = pc.starts_with(given["key"], " ")
    grams_at = np.asarray(is_gram)
    new_words = int(np.asarray(given["counts"]).sum())
    value = given["value"].to_numpy()
    logp = Lookup(grams_of(given["key"].filter(is_gram)), value[grams_at])
    count = dict(zip(given["key"].filter(pc.invert(is_gram)).to_pylist(), value[~grams_at].tolist(), strict=True))
    del given
    out = []
    for batch in slices(table.select(["doc_id", "text", "held_out"]).to_batches(), SLICE):
        split = [x.lower().split() for x in texts_as_bytes(batch)]
        code, lengths = grams(split)
        for x in split:
            x.append(END)
        tokens = np.fromiter(map(len, split), np.int64, len(split))
        c = np.fromiter(map(count.__getitem__, chain.from_iterable(split)), np.float64, int(tokens.sum()))
        at = np.cumsum(tokens) - tokens
        first = np.zeros(len(split), np.int64)
        first[0], new_words = new_words, 0
        out.append(pa.table({
            "doc_id": batch.column(0), "held_out": batch.column(2), "n_tokens": tokens, "n_known": np.add.reduceat((c > 0).astype(np.int64), at), "raw": np.add.reduceat(np.log10(c + 0.5), at),
            "score": np.add.reduceat(logp(code), np.cumsum(lengths) - lengths), "new_words": first,
        }))
    del count, logp
    pa.default_memory_pool().release_unused()
    return pa.concat_tables(out)


def score(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs: op3's columns."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    all_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = int(all_bytes // chunk_bytes) + 1
    marked = docs.select("doc_id", "text", (fold("doc_id") == 1).alias("held_out"), F.pmod(key_of(), F.lit(chunks)).cast("int").alias("chunk"))
    model = tree(kept(counted(marked)))

    # questions of the chunks and the tree's answers meet by key: a word's counts add up, a gram's log-probability is added to zeros
    questions = marked.groupBy("chunk").applyInArrow(questions_of, "chunk int, key binary, value double")
    told = model.select(F.lit(-1).alias("chunk"), F.unhex(F.hex(F.col("gram").bitwiseOR(F.lit(GRAM)))).alias("key"), F.col("logp").alias("value"))
    same = Window.partitionBy("key")
    met = questions.unionByName(told).withColumns({"total": F.sum("value").over(same), "place": F.row_number().over(same.orderBy("chunk"))})
    # each known word is counted in one of the chunks that ask for it
    answers = met.where("chunk >= 0").select("chunk", "key", F.col("total").alias("value"), ((F.col("place") == 1) & (F.col("total") > 0)).alias("counts"))

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, raw double, score double, new_words long"
    rows = kept(marked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scores_of, schema))
    totals = rows.agg(F.coalesce(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum("new_words"), F.lit(0)).alias("vocabulary"))
    base = F.col("raw") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.5 * (F.col("vocabulary") + 1))
    return rows.crossJoin(F.broadcast(totals)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score")
