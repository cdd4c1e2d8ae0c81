"""SentencePiece encoding and decoding of merge-type vocabularies, by a score-ordered agenda of adjacent symbol pairs.

The symbols of a text are its characters; the agenda holds each pair of neighbours whose concatenation is a piece. The pair
with the highest score (the leftmost of equals) is merged and the pairs with its new neighbours enter, until none is left.
Symbols that are no piece become byte pieces, or the unknown id where the vocabulary has none.

No piece has the space mark after another character, which is read off the vocabulary, so no merge crosses such a place: the
stretches between are encoded alone and remembered, up to a size in bytes. Every stretch's ids are compared with those of the sentencepiece library
the first time a worker meets it (check="stretches"), or every text's ids in every Arrow batch (check="texts").

Cases: a null text counts as empty, and an empty text has the end id only; repeated rows give repeated results; other columns
than doc_id and text are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from itertools import chain, repeat
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame

from trackloom.llm.shared import of_worker, releasing, slices, texts_as_strings

#: Fixed: how vocabularies of this kind write a space.
MARK = "▁"


#: Characters of a stretch whose agenda is a list by place, in which a pair is looked for by min(); that is faster than a heap, but goes with the square.
SHORT = 48
#: Bytes of the stretches that a worker keeps, those met last; as many before them are kept as well.
REMEMBER = 96_000_000


class Pieces:
    """A merge-type vocabulary, encoded with an agenda. remember: as REMEMBER."""

    def __init__(self, model_file: str, check: str = "stretches", remember: int = REMEMBER):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.check, self.remember = check, remember
        n = len(self.library)
        self.names = [self.library.id_to_piece(i) for i in range(n)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(n)]
        self.number = {name: i for i, name in enumerate(self.names) if not special[i]}
        self.rank = {name: -self.library.get_score(i) for name, i in self.number.items()}
        self.end, self.unknown = self.library.eos_id(), self.library.unk_id()
        self.byte = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.value = {i: b for b, i in enumerate(self.byte) if i != self.unknown}
        if any(MARK in name.lstrip(MARK) for name in self.number):
            raise ValueError("pieces of this vocabulary span spaces, so its texts can't be cut at spaces")
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.size = 0
        self.digits = [str(i) for i in range(n)]

    def agenda(self, stretch: str) -> tuple[int, ...]:
        """Ids of a stretch that already has the space mark for spaces."""
        symbols = list(stretch)
        if len(symbols) <= SHORT:
            self.merge_short(symbols)
        else:
            symbols = self.merge_long(symbols)
        try:
            return tuple(map(self.number.__getitem__, symbols))
        except KeyError:  # characters that are no piece
            return tuple(chain.from_iterable([self.number[x]] if x in self.number else [self.byte[b] for b in x.encode()] for x in symbols))

    def merge_short(self, symbols: list[str]) -> None:
        """Merge symbols in place, with an agenda that has the order of each pair of neighbours by its place."""
        order, none = self.rank.get, math.inf
        waiting = list(map(order, map(add, symbols, symbols[1:]), repeat(none)))
        while waiting and (best := min(waiting)) is not none:
            i = waiting.index(best)
            symbols[i] = merged = symbols[i] + symbols.pop(i + 1)
            del waiting[i]
            if i < len(waiting):
                waiting[i] = order(merged + symbols[i + 1], none)
            if i:
                waiting[i - 1] = order(symbols[i - 1] + merged, none)

    def merge_long(self, symbols: list[str]) -> list[str]:
        """The merged symbols, by a heap; the right one of two is emptied and left out at the end."""
        rank = self.rank
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = []
        for i in range(n - 1):
            if (order := rank.get(symbols[i] + symbols[i + 1])) is not None:
                waiting.append((order, i, len(symbols[i]) + len(symbols[i + 1])))
        heapq.heapify(waiting)
        while waiting:
            _, left, length = heapq.heappop(waiting)
            if not symbols[left] or (right := after[left]) >= n or len(symbols[left]) + len(symbols[right]) != length:
                continue  # one of the two has been merged meanwhile
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = following = after[right]
            if following < n:
                before[following] = left
                if (order := rank.get(symbols[left] + symbols[following])) is not None:
                    heapq.heappush(waiting, (order, left, len(symbols[left]) + len(symbols[following])))
            if (previous := before[left]) >= 0 and (order := rank.get(symbols[previous] + symbols[left])) is not None:
                heapq.heappush(waiting, (order, previous, len(symbols[previous]) + len(symbols[left])))
        return [x for x in symbols if x]

    def learn(self, stretches: set[str]) -> None:
        """Encode stretches (without their leading mark) that are not known, and check them."""
        if self.size > self.remember:
            self.known, self.older, self.size = {}, self.known, 0
        new = []
        for x in stretches.difference(self.known):
            if (ids := self.older.get(x)) is None:
                ids = self.agenda(MARK + x)
                new.append(x)
            self.known[x] = ids
            self.size += 200 + len(x) + 8 * len(ids)  # about what the two objects and their place take
        if self.check == "stretches":
            for x, ids in zip(new, self.library.encode(new, num_threads=1), strict=True):
                if x and tuple(ids) != self.known[x]:  # the library has no way to encode a lone mark
                    raise ValueError(f"the agenda and the library differ for {x[:80]!r}")

    def cut(self, text: str) -> list[str]:
        """The stretches of a text, each without the mark that it begins with. Runs of spaces stay with the word after them."""
        parts = text.replace(" ", MARK).split(MARK)
        if "" not in parts:
            return parts
        out, gap = [], ""
        for part in parts[:-1]:
            if part:
                out.append(gap + part)
                gap = ""
            else:
                gap += MARK
        out.append(gap + parts[-1])
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with the end id."""
        if self.unknown in self.byte and any(self.byte):
            raise ValueError("the vocabulary has no byte pieces")
        cuts = [self.cut(x) if x else [] for x in texts]
        self.learn(set().union(*cuts))
        known = self.known
        ids = [list(chain.from_iterable(map(known.__getitem__, x))) for x in cuts]
        if self.check == "texts" and ids != self.library.encode(texts, num_threads=1):
            raise ValueError("the agenda and the library differ")
        for x in ids:
            x.append(self.end)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids vanish, runs of byte pieces are read as UTF-8, the first space mark goes."""
        names, value = self.names, self.value
        if value.keys().isdisjoint(ids):
            text = "".join([names[i] for i in ids if i != self.end])
        else:
            out, run = [], bytearray()
            for i in ids:
                if i in value:
                    run.append(value[i])
                    continue
                if run:
                    out.append(run.decode(errors="replace"))
                    run = bytearray()
                if i != self.end:
                    out.append(names[i])
            out.append(run.decode(errors="replace"))
            text = "".join(out)
        return text.removeprefix(MARK).replace(MARK, " ")


@of_worker
def vocabulary(model_file: str, check: str, remember: int = REMEMBER) -> Pieces:
    """One for each worker process, so that what it remembers outlives a task; other stages' tasks drop it."""
    return Pieces(model_file, check, remember)


def encode(docs: DataFrame, model_file: str, check: str = "stretches", remember: int = REMEMBER) -> DataFrame:
    """doc_id, ids (array of int, with the end id) and decoded (the text that these ids give) of each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(model_file, check, remember)
        for batch in slices(batches, 1_000_000):
            ids = pieces.encode(texts_as_strings(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(pieces.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run, "vocabulary"), f"doc_id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, model_file: str, check: str = "stretches") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what encode() gives, without moving the ids out of the workers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(model_file, check)
        for batch in slices(batches, 1_000_000):
            ids = pieces.encode(texts_as_strings(batch))
            coded = [hashlib.sha256(" ".join(map(pieces.digits.__getitem__, x)).encode()).hexdigest() for x in ids]
            decoded = [hashlib.sha256(pieces.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(coded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run, "vocabulary"), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
