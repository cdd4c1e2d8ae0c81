"""Token ids in a binary format of fixed width: each id takes as many bits as the vocabulary's largest id needs.

A data set is a folder of Parquet files whose rows are blocks of consecutive documents (in ascending doc_id order): the ids of all documents of a
block packed end to end in one binary value, the documents' ids and their first positions, the width, and the block's place.
Any document is found by its block's offsets; numpy unpacks a whole block, or any range of it, without a loop over ids.

Texts are split among tasks by ranges of doc_id, encoded with the tokenizers library and packed where they are; only block
headers move afterwards, to number the ids of the whole set.

Cases: doc_id may be of any type that has an order; a null text counts as empty; an empty text has its end id only; rows without doc_id come first; rows with equal doc_id
keep one result each, in the order of their texts; columns other than doc_id and text are not read; an empty table gives an empty data set.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql import functions as F

from trackloom.llm.shared import new_folder, slices, texts_as_strings

#: One space between two characters that no reading of white space could take for one: pre-tokens of byte-level vocabularies never cross it.
GAP = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
#: ASCII marks (the apostrophe is none) are a pre-token of their own behind one of these letters and digits.
MARKS, ENDS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", frozenset(map(chr, [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
#: How byte-level vocabularies write the space and the line feed.
SPACE, FEED = "\u0120", "\u010a"
BLOCK = "part int, block int, at long, bits int, n_ids long, doc_ids array<{kind}>, starts array<long>, packed binary"
#: Bytes of the tables, as Spark estimates them, for each writing task.
PART = 128_000_000
#: Bytes of text encoded at a time, and new stretches that are one text for the library.
AT_ONCE, TOGETHER = 8_000_000, 1000


def width(vocabulary: int) -> int:
    """Bits of the largest id."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (unsigned 32 bits) in so many bits each, the lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for low in range(0, len(ids), 1 << 16):  # a multiple of 8 ids ends on a whole byte
        one = np.ascontiguousarray(ids[low : low + (1 << 16)], dtype="<u4")
        out.append(np.packbits(np.unpackbits(one.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(packed: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop (exclusive) of a packed run, as unsigned 32 bits."""
    if stop <= start:
        return np.zeros(0, "<u4")
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", stop - start, start * (bits // 8)).astype("<u4")
    first = start * bits // 8
    raw = np.frombuffer(packed, np.uint8, (stop * bits + 7) // 8 - first, first)
    wide = np.zeros(len(raw) + 8, np.uint8)
    wide[: len(raw)] = raw
    at = np.arange(start, stop, dtype=np.int64) * bits - first * 8
    value = np.zeros(stop - start, np.uint64)
    for k in range((bits + 7) // 8 + 1):
        value |= wide[at // 8 + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (at % 8).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


def runs(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[b : b + c] for each begin and count, end to end."""
    at = np.repeat(begin - (np.cumsum(count) - count), count)
    at += np.arange(len(at))
    return values[at]


def plain(text: str) -> bool:
    """Whether all spaces stand alone between printable characters, which no reading takes for white space: a split at each space then cuts no pre-token."""
    return not ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ") and text.replace("\n", "x").isprintable()


def before(stretch: str) -> str:
    """A stretch as it stands in its text: it follows a space, or begins with the line feed that it follows."""
    return stretch if stretch[:1] == "\n" else " " + stretch


class Encoder:
    """The tokenizers library on stretches between GAPs or line feeds, each encoded once while it is remembered (so many met last, and as many before).

    The stretches of many texts are told apart by Arrow; what is new among them, without the marks at its end, passes the library's whole pipeline, many as
    one text, and numpy puts the ids of the texts together. Texts that quote one of the vocabulary's added tokens, which the library finds wherever they
    stand, are encoded whole.
    """

    def __init__(self, tokenizer_file: str, remember: int = 400_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        told = json.loads(self.library.to_str())
        if told["normalizer"] or (told["pre_tokenizer"] or {}).get("type") != "ByteLevel" or told["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level vocabularies can be cut at spaces")
        self.added = [t["content"] for t in told["added_tokens"]]
        self.spaced = any(" " in x or "\n" in x for x in self.added)  # joined stretches might quote these
        vocabulary = self.library.get_vocab()
        self.opens = {lead: np.zeros(max(vocabulary.values(), default=0) + 1, bool) for lead in (SPACE, FEED)}
        self.opens[SPACE][[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.opens[FEED][[i for token, i in vocabulary.items() if token == FEED]] = True
        self.remember = remember
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def each(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each text, as unsigned 32-bit integers."""
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, stretches: tuple[str, ...], lead: str) -> list[bytes]:
        """As each(), of stretches with what leads them: a space, or the line feed that they begin with. They hold no other (of line feeds those behind a
        space may) and end in no white space, so that tokens of the lead tell where each begins."""
        texts = [*map(before, stretches)]
        ids = np.array(self.library.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.opens[lead][ids])
        if len(at) != len(texts):  # a vocabulary without a token for the lead
            return self.each(texts)
        whole, edges = ids.tobytes(), [*(at * 4).tolist(), len(ids) * 4]
        return [whole[low:high] for low, high in itertools.pairwise(edges)]

    def learn(self, stretches: list[str]) -> list[bytes | None]:
        """Encode stretches that are not known, and give the ids of those that were."""
        if len(self.known) > self.remember:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = [*map(known.get, stretches)]
        new: dict[str, dict[str, None]] = {SPACE: {}, FEED: {}, "": {}}
        for x in itertools.compress(stretches, [ids is None for ids in found]):
            if (ids := older.get(x)) is not None:
                known[x] = ids
            elif self.spaced or " " in x or x[-1:].isspace():
                new[""][x] = None
            else:
                new[FEED if x[:1] == "\n" else SPACE][x] = None
        for lead in (SPACE, FEED):
            for some in itertools.batched(new[lead], TOGETHER):
                known.update(zip(some, self.joined(some, lead), strict=True))
        known.update(zip(new[""], self.each([*map(before, new[""])]), strict=True))
        return found

    def ids_of(self, stretches: list[str]) -> list[bytes]:
        """Ids of stretches; only what stands before the marks at their ends is remembered."""
        cores = [core if (core := x.rstrip(MARKS))[-1:] in ENDS else x for x in stretches]
        ends = [x[len(core) :] for x, core in zip(stretches, cores, strict=True)]
        found = self.learn(cores)
        if len(self.tails) > 100_000:
            self.tails = {}
        known, tails, new = self.known, self.tails, list(set(ends).difference(self.tails))
        tails.update(zip(new, self.each(new), strict=True))
        return [(ids or known[core]) + tails[end] if end else ids or known[core] for core, ids, end in zip(cores, found, ends, strict=True)]

    def encode_all(self, texts: list[str], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each followed by end, and where each text's begin (and the last ones end). A text's first stretch has no space before it and is not remembered."""
        first: list[str] = []
        rest: list[str | None] = []
        odd: dict[int, list[str]] = {}
        for text in texts:
            head, tail = text, None
            if not any(x in text for x in self.added):
                if plain(text):
                    # of two line feeds each is a pre-token, of more before a character all but the last are one, at the end all
                    head, gap, tail = (text if "\n\n\n" in text or text[-2:] == "\n\n" else text.replace("\n", " \n")).partition(" ")
                    tail = tail if gap else None
                else:
                    head, *odd[len(first)] = GAP.split(text)
            first.append(head)
            rest.append(tail)
        lists = pc.split_pattern(pa.array(rest, pa.large_string()), " ")
        count = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten()
        begin = np.cumsum(count) - count
        if odd:  # their stretches follow all others
            where, more = np.array(list(odd)), np.fromiter(map(len, odd.values()), np.int64, len(odd))
            count[where], begin[where] = more, len(words) + np.cumsum(more) - more
            words = pa.concat_arrays([words, pa.array([x for stretches in odd.values() for x in stretches], pa.large_string())])
        coded = words.dictionary_encode()
        told_apart = self.ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        # all that texts are made of: stretches, first stretches, end
        made_of = [*told_apart, *self.each(first), end]
        length = np.fromiter(map(len, made_of), np.int64, len(made_of)) // 4
        n, m, one = len(texts), len(words), np.ones(len(texts), np.int64)
        codes = np.concatenate([coded.indices.to_numpy(), np.arange(len(told_apart), len(made_of))])
        order = runs(codes, np.stack([m + np.arange(n), begin, (m + n) * one], 1).ravel(), np.stack([one, count, one], 1).ravel())
        lengths = length[order]
        ids = runs(np.frombuffer(b"".join(made_of), "<u4"), (np.cumsum(length) - length)[order], lengths)
        return ids, np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(count + 2)])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers."""
        ids, starts = self.encode_all(texts)
        return [ids[low:high].tobytes() for low, high in itertools.pairwise(starts.tolist())]


@cache
def encoder(tokenizer_file: str) -> Encoder:
    """One for each worker process, so that what it remembers outlives a task."""
    return Encoder(tokenizer_file)


def write(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str, partitions: int | None = None, block_docs: int = 256, block_bytes: int = 2_000_000) -> None:
    """Write docs (doc_id, text) as a data set of packed blocks to folder. A block holds so many documents or bytes of text (or one document).

    partitions: writing tasks; if not given, those of a shuffle, or more if the tables are large.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART if size < 1 << 60 else 0)  # Spark says more where it knows nothing
    schema = pa.schema([pa.field("doc_ids", pa.list_(to_arrow_type(kind))) if f.name == "doc_ids" else f for f in SCHEMA])
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = encoder(tokenizer_file)
        bits = width(max(own.library.get_vocab_size(), end_id + 1))
        end = array("I", [end_id]).tobytes()
        part, number, at = TaskContext.get().partitionId(), 0, 0
        for batch in slices(batches, AT_ONCE):
            everything, begin = own.encode_all(texts_as_strings(batch), end)
            row = 0
            for some in slices([batch], block_bytes):
                for low in range(0, some.num_rows, block_docs):
                    one = some.slice(low, block_docs)
                    starts = begin[row : row + one.num_rows + 1]
                    ids, starts, row = everything[starts[0] : starts[-1]], starts - starts[0], row + one.num_rows
                    yield pa.RecordBatch.from_pylist([{"part": part, "block": number, "at": at, "bits": bits, "n_ids": len(ids), "doc_ids": one.column(0).to_pylist(), "starts": starts.tolist(), "packed": pack(ids, bits)}], schema)
                    number, at = number + 1, at + len(ids)

    rows.mapInArrow(blocks, BLOCK.format(kind=kind.simpleString())).write.parquet(folder)


SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("at", pa.int64()), ("bits", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("packed", pa.binary())])


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of a data set, each with first: the number of ids in all blocks before it.

    The writer has numbered the ids within its part; only the totals of the parts (one row for each writing task) are summed here.
    """
    stored = spark.read.parquet(folder)
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    # one row for each task that wrote: no more than the partitions given to write()
    return stored.join(F.broadcast(before), "part").withColumn("first", F.col("before") + F.col("at"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), ids (array of long) of each stored document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["packed"], r["bits"], 0, r["n_ids"])
                cuts = [ids[a:b].astype(np.int64).tolist() for a, b in zip(r["starts"], r["starts"][1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array([r["first"] + a for a in r["starts"][:-1]], pa.int64()), pa.array(cuts, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    stored = blocks(spark, folder)
    return stored.select("bits", "n_ids", "first", "doc_ids", "starts", "packed").mapInArrow(run, f"doc_id {stored.schema['doc_ids'].dataType.elementType.simpleString()}, start long, ids array<long>")


def lookup(spark: SparkSession, folder: str, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of the whole data set: only the blocks that hold them are read, and only those ids of them unpacked."""
    found = blocks(spark, folder).where((F.col("first") < stop) & (F.col("first") + F.col("n_ids") > start)).select("first", "bits", "n_ids", "packed").orderBy("first").collect()
    return np.concatenate([np.zeros(0, "<u4"), *[unpack(bytes(r.packed), r.bits, max(0, start - r.first), min(r.n_ids, stop - r.first)) for r in found]])


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each stored document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, starts = unpack(r["packed"], r["bits"], 0, r["n_ids"]), r["starts"]
                pairs = list(zip(starts, starts[1:], strict=False))
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array([r["first"] + a for a, _ in pairs], pa.int64()), pa.array([b - a for a, b in pairs], pa.int64()), pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in pairs], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    stored = blocks(spark, folder)
    return stored.select("bits", "n_ids", "first", "doc_ids", "starts", "packed").mapInArrow(run, f"doc_id {stored.schema['doc_ids'].dataType.elementType.simpleString()}, start long, n_tokens long, ids_crc32 long")


def written_digests(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """Write docs to a new folder in the shared storage and return the digests read back from it."""
    folder = new_folder(docs.sparkSession, "packed")
    write(docs, tokenizer_file, end_id, folder)
    return digests(docs.sparkSession, folder)
