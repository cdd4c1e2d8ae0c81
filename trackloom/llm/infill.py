"""Fill-in-middle: texts cut into prefix, middle and suffix, put together in another order by a secondary sort.

Each text becomes pieces of whole units (a run of letters A-Z, a-z, or any other character), keyed by its row and their position in the
output. repartitionAndSortWithinPartitions brings the pieces of a row together in order, so a task streams them into an incremental
digest, one piece at a time, whatever the text's length. The stream of the output is then parsed at its marks, its pieces get their
places in the restored text and are sorted again: both sorts have the same partitioner, so the second one moves nothing between tasks.

A row's key is a digest of doc_id, text and the reading partition, so that a task that is run again gives the same keys and equal rows
of many partitions don't meet in one task; equal rows of one partition are counted, as their pieces come one after the other.

Cases: a null text counts as empty and stays plain; a null doc_id counts as the empty text in the draws; equal rows give equal rows; a
unit longer than a piece is cut; other columns than doc_id and text are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: the marks before the three parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Restored order of the parts, and the mark that opens each.
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
#: Units of a piece, and the bytes that a piece with longer units is cut to.
UNITS, BYTES = 8_192, 65_536
#: Bytes of text that a sorting task should get.
PART = 64_000_000
#: Per cent of the rows that are transformed, and of those with the suffix first.
RATE, SPM = 90, 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass(frozen=True)
class Cut:
    """How one text is cut: bytes where prefix and middle end, and what the result says of it."""

    form: str
    n: int
    first: int
    second: int
    prefix_chars: int | None
    middle_chars: int | None


def unit_starts(data: bytes) -> np.ndarray:
    """The byte at which each unit of a UTF-8 text begins."""
    a = np.frombuffer(data, np.uint8)
    letter = _LETTER[a]
    begins = ~letter & ((a & 0xC0) != 0x80)
    begins[1:] |= letter[1:] & ~letter[:-1]
    begins[:1] |= letter[:1]
    return np.flatnonzero(begins)


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 from a document's id."""
    return struct.unpack(">4I", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def cut(doc_id: int | None, data: bytes, starts: np.ndarray) -> Cut:
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id)
    if not data or any(m in data for m in PLACE) or h3 % 100 >= RATE:
        return Cut("plain", n, len(data), len(data), None, None)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = (int(starts[k]) if k < n else len(data) for k in (low, high))
    chars = lambda a, b: int(np.count_nonzero((np.frombuffer(data, np.uint8, b - a, a) & 0xC0) != 0x80))
    return Cut("spm" if h4 % 100 < SPM else "psm", n, first, second, chars(0, first), chars(first, second))


def pieces(data: bytes, starts: np.ndarray, low: int, high: int) -> Iterator[bytes]:
    """data[low:high] in pieces of UNITS whole units; one that is longer than BYTES is cut between characters."""
    inner = starts[np.searchsorted(starts, low) : np.searchsorted(starts, high)][UNITS::UNITS].tolist()
    for a, b in itertools.pairwise([low, *inner, high]):
        while b - a > BYTES:
            end = a + BYTES
            while data[end] & 0xC0 == 0x80:
                end -= 1
            yield data[a:end]
            a = end
        if b > a:
            yield data[a:b]


def _order(c: Cut, size: int) -> list[tuple[bytes, int, int]]:
    """Marks and stretches of the text in the order of the output."""
    p, m, s = (PREFIX, 0, c.first), (MIDDLE, c.first, c.second), (SUFFIX, c.second, size)
    return {"plain": [(b"", 0, size)], "psm": [p, s, m], "spm": [s, p, m]}[c.form]


def _emit(rows: Iterator[tuple]) -> Iterator[tuple]:
    """((key, position), value): at position -1 what is known of the row, then the pieces of its output."""
    partition = TaskContext.get().partitionId()
    for doc_id, text in rows:
        data = (text or "").encode()
        key = hashlib.blake2b(f"{partition}:{doc_id}:".encode() + data, digest_size=16).digest()
        starts = unit_starts(data)
        c = cut(doc_id, data, starts)
        yield (key, -1), (doc_id, c.n, c.form, c.prefix_chars, c.middle_chars)
        at = 0
        for mark, low, high in _order(c, len(data)):
            for piece in itertools.chain([mark] if mark else [], pieces(data, starts, low, high)):
                yield (key, at), piece
                at += 1


def _rows_of(pairs: Iterator[tuple]) -> Iterator[tuple[bytes, int, object, Iterator[tuple]]]:
    """key, number of equal rows, what is known of them, and (position, piece) of each key of sorted pairs; repeated pieces count once."""
    for key, group in itertools.groupby(pairs, lambda x: x[0][0]):
        copies, (place, known) = 0, (None, None)
        for (_, place), value in group:  # noqa: B007
            if place != -1:
                break
            copies, known = copies + 1, value
        else:
            yield key, copies, known, iter(())
            continue

        def each(group: Iterator[tuple] = group, place: object = place, value: object = value) -> Iterator[tuple]:
            yield place, value
            last = place
            for (_, p), piece in group:
                if p != last:
                    yield p, piece
                    last = p

        yield key, copies, known, each()


def parse(output: Iterator[bytes], form: str) -> Iterator[tuple[int, bytes]]:
    """(place of the part in the text, bytes) of an output that comes in any pieces: its marks are found wherever they are cut."""
    if form == "plain":
        yield from ((0, piece) for piece in output)
        return
    place, held = None, b""
    for piece in itertools.chain(output, [None]):
        held += piece or b""
        while (at := min((i for m in PLACE if (i := held.find(m)) >= 0), default=-1)) >= 0:
            if at:
                yield place, held[:at]
            place, held = PLACE[held[at : at + 3]], held[at + 3 :]
        keep = 0 if piece is None else min(2, len(held))  # a mark may begin at the end
        if len(held) > keep:
            yield place, held[: len(held) - keep]
            held = held[len(held) - keep :]


def _assembled(pairs: Iterator[tuple]) -> Iterator[tuple]:
    """Digests of the outputs, and the pieces by their place in the restored text."""
    for key, copies, known, stream in _rows_of(pairs):
        digest = hashlib.sha256()

        def output(stream: Iterator[tuple] = stream, digest: object = digest) -> Iterator[bytes]:
            for _, piece in stream:
                digest.update(piece)
                yield piece

        for at, (place, piece) in enumerate(parse(output(), known[2])):
            yield (key, place, at), piece
        yield (key, -1, 0), (copies, *known, digest.hexdigest())


def _restored(pairs: Iterator[tuple]) -> Iterator[tuple]:
    for _, group in itertools.groupby(pairs, lambda x: x[0][0]):
        _, (copies, doc_id, n, form, prefix_chars, middle_chars, output) = next(group)
        digest = hashlib.sha256()
        for _, piece in group:
            digest.update(piece)
        yield from [(doc_id, n, form, prefix_chars, middle_chars, output, digest.hexdigest())] * copies


def _partition(key: tuple) -> int:
    return int.from_bytes(key[0][:8], "big")


def _texts(pairs: Iterator[tuple]) -> Iterator[tuple]:
    for _, copies, known, stream in _rows_of(pairs):
        yield from [(known[0], known[2], b"".join(piece for _, piece in stream).decode())] * copies


def _sorted(docs: DataFrame, partitions: int | None) -> tuple[RDD, int]:
    """The pieces of all outputs, those of a row together and in order, and the number of partitions: the session's for shuffles, or more, so that each gets about PART bytes of text."""
    if partitions is None:
        size = docs.select(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART))
    return docs.select("doc_id", "text").rdd.mapPartitions(_emit).repartitionAndSortWithinPartitions(partitions, _partition), partitions


def transform(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of each row of docs."""
    pairs, n = _sorted(docs, partitions)
    restored = pairs.mapPartitions(_assembled, preservesPartitioning=True).repartitionAndSortWithinPartitions(n, _partition).mapPartitions(_restored)
    fields = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output_sha256", T.StringType()), ("restored_sha256", T.StringType())]
    return docs.sparkSession.createDataFrame(restored, T.StructType([docs.schema["doc_id"], *[T.StructField(*f) for f in fields]]), verifySchema=False)


def outputs(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, form and output (the transformed text) of each row of docs, from the same sorted pieces."""
    pairs, _ = _sorted(docs, partitions)
    return docs.sparkSession.createDataFrame(pairs.mapPartitions(_texts), T.StructType([docs.schema["doc_id"], T.StructField("form", T.StringType()), T.StructField("output", T.StringType())]), verifySchema=False)


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
d AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT doc_id, text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
