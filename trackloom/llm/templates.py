"""Benchmark decontamination by templates: passages of test items are found in documents also where numbers, names or units were changed.

Words are lower-cased and stripped of punctuation (words of nothing else are left out). In a template, numbers become <num>, capitalised
words <name> and units after a number <unit>. Windows of WINDOW words (an item of fewer words: all of it) of items and documents are joined
by hash, twice: as they are, and as templates where they hold a placeholder and enough other words. Windows that meet are compared word for
word. Along one alignment of a document with an item, each value of the item becomes the value that it became in most windows (different values may become
equal); template windows in which it became another do not count. With one_to_one, each value of the item must always have become the same value and each
new value stand for one of the item's, else no template window of the alignment counts. A document is contaminated by an item if a share of SHARE
of the item's windows is found, or so many neighbouring ones along one alignment that they span RUN words.

The hashes of the items' windows go to all tasks, to let only windows that may meet out, while there are at most `filter_windows` of
them; beyond that all windows of documents are joined. The items' windows themselves are broadcast up to `broadcast_windows`.

Cases: null and empty texts have no windows; items of fewer than LEAST words are found where all their words stand as they are, by matches() but not by clean(), which would
drop every document that says so short a thing; items without words are not found; items with equal texts are each reported;
rows without doc_id are told apart by their text and reported with a null doc_id; equal rows are reported once; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.shared import kept, key_of, releasing, slices, small, texts_as_bytes, unused

WINDOW = 8
#: Words that an item must have to be found as a template, and words besides placeholders that a template window of WINDOW words must have.
LEAST = 5
#: Share of an item's windows that must be found, and their number (all, if it has fewer).
SHARE, NUMBER = 0.3, 3
#: Words of a passage that is reported whatever share of the item it is.
RUN = 13
#: Units that count as such after a number.
UNITS = frozenset(
    b"""mm cm m km in inch inches ft foot feet yd yards mile miles mg g kg t oz lb lbs gram grams kilogram kilograms ton tons
    ml cl l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
    hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa bar c f k mph kmh percent dollars euros pounds cents eur usd gbp""".split()
)
#: Written words that a task remembers.
WORDS = 200_000
NUMBER_LIKE = re.compile(rb"[+-]?\d[\d.,]*(?:st|nd|rd|th)?|\d+[a-z]{1,3}")
_EDGES = b".,;:!?\"'()[]{}<>|#$%&*-_~`/\\=+"
_NUM, _NAME, _UNIT = (xxhash.xxh64_intdigest(x) for x in (b"<num>", b"<name>", b"<unit>"))
_SLOT = {1: b"<num>", 2: b"<name>", 3: b"<unit>"}
_ROW = "size int, form int, hash long, at int, words string, slots array<string>"
_SCHEMA = pa.schema([("size", pa.int32()), ("form", pa.int32()), ("hash", pa.int64()), ("at", pa.int32()), ("words", pa.string()), ("slots", pa.list_(pa.string()))])


class Words(dict):
    """Number of each written word met; 0 for punctuation alone. plain and template: hashes; kind: 0 word, 1 number, 2 name, 4 unit after a number."""

    def __init__(self):
        super().__init__()
        self.text, self._plain, self._template, self._kind = [b""], [0], [0], [0]

    def __missing__(self, written: bytes) -> int:
        word = written.strip(_EDGES)
        if not word:
            self[written] = 0
            return 0
        low = word.lower()
        kind = 1 if NUMBER_LIKE.fullmatch(low) else 2 if word[:1].isupper() or (word[:1] == b"\xc3" and 0x80 <= word[1] <= 0x9E) else 4 if low in UNITS else 0
        plain = xxhash.xxh64_intdigest(low)
        self.text.append(low)
        self._plain.append(plain)
        self._template.append({1: _NUM, 2: _NAME}.get(kind, plain))
        self._kind.append(kind)
        self[written] = len(self.text) - 1
        return len(self.text) - 1

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self._plain, np.uint64), np.array(self._template, np.uint64), np.array(self._kind, np.int8)


def _rolled(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of so many ids."""
    n = len(ids) - size + 1
    h = np.full(n, np.uint64(size), np.uint64)
    for k in range(size):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= ids[k : k + n]
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def windows(texts: list[bytes], words: Words, sizes: list[int] | None, wanted: np.ndarray | None) -> tuple[list[int], dict[str, list]]:
    """Windows of texts: the text's number, and the columns of _ROW. sizes: those of windows (None: WINDOW, or a shorter text's own). wanted: sorted hashes; others are left out."""
    split = [x.split() for x in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    number = np.fromiter((words[w] for x in split for w in x), np.int64, int(counts.sum()))
    owner = np.repeat(np.arange(len(texts)), counts)
    owner, number = owner[number > 0], number[number > 0]
    plain, template, kind = (x[number] for x in words.arrays())
    begin = np.searchsorted(owner, np.arange(len(texts) + 1))
    lengths = np.diff(begin)
    after_number = np.zeros(len(kind), bool)
    after_number[1:] = (kind[:-1] == 1) & (owner[1:] == owner[:-1])
    unit = (kind == 4) & after_number
    template = np.where(unit, np.uint64(_UNIT), template)
    slot = np.where(unit, 3, np.where(kind == 4, 0, kind))
    slots_before = np.concatenate([[0], np.cumsum(slot > 0)])
    out_owner: list[int] = []
    out: dict[str, list] = {c: [] for c in _SCHEMA.names}
    own_size = sizes is None
    for size in sorted(set(np.minimum(lengths, WINDOW).tolist())) if own_size else sizes:
        if size < 1 or len(number) < size:
            continue
        n = len(number) - size + 1
        valid = owner[size - 1 :] == owner[:n]
        if own_size:
            valid &= np.minimum(lengths, WINDOW)[owner[:n]] == size
        held = slots_before[size:] - slots_before[:n]
        for form, ids in ((0, plain), (1, template))[: 1 + (size >= LEAST)]:
            h = _rolled(ids, size)
            ok = valid if form == 0 else valid & (held > 0) & (size - held >= min(LEAST, size - 1))
            if wanted is not None:
                # the first bits tell most of the others apart
                ok = ok & wanted[1][(h >> np.uint64(42)).astype(np.int64)]
            at = np.flatnonzero(ok)
            if wanted is not None:
                place = np.minimum(np.searchsorted(wanted[0], h[at]), len(wanted[0]) - 1)
                at = at[wanted[0][place] == h[at]]
            for i in at.tolist():
                here = number[i : i + size].tolist()
                kinds = slot[i : i + size].tolist()
                out_owner.append(int(owner[i]))
                out["size"].append(size)
                out["form"].append(form)
                out["hash"].append(int(h[i].view(np.int64)))
                out["at"].append(int(i - begin[owner[i]]))
                out["words"].append(b" ".join(_SLOT[k] if form and k else words.text[w] for w, k in zip(here, kinds, strict=True)).decode(errors="replace"))
                out["slots"].append([words.text[w].decode(errors="replace") for w, k in zip(here, kinds, strict=True) if k] if form else [])
    return out_owner, out


def _windowed(df: DataFrame, names: str, schema: str, sizes: list[int] | None = None, wanted=None) -> DataFrame:
    """Windows of the texts of df beside its columns in names."""
    columns = names.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        hashes = None
        if wanted is not None:
            first = np.zeros(1 << 22, bool)
            first[(wanted.value >> np.uint64(42)).astype(np.int64)] = True
            hashes = (wanted.value, first)
        for batch in slices(batches, 1_000_000):
            if len(words) > WORDS:
                words = Words()
            owner, out = windows(texts_as_bytes(batch), words, sizes, hashes)
            for low in range(0, max(1, len(owner)), 50_000):
                part = pa.array(owner[low : low + 50_000], pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(part) for i in range(len(columns))], *[pa.array(out[f.name][low : low + 50_000], f.type) for f in _SCHEMA]], [*columns, *_SCHEMA.names])

    return df.select(*columns, "text").mapInArrow(releasing(run), f"{schema}, {_ROW}")


def matches(docs: DataFrame, items: DataFrame, filter_windows: int = 2_000_000, broadcast_windows: int = 50_000, one_to_one: bool = True) -> DataFrame:
    """doc_id, key, item_id, matched (windows of the item found), item_windows, item_words, coverage, first_word and last_word (in the document), reparameterised.

    One row for each document and item that contaminates it. docs: doc_id, text. items: item_id, text.
    """
    spark = docs.sparkSession
    item_kind, doc_kind = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    named = items.select("item_id", "text", F.xxhash64("item_id", "text").alias("item_key")).dropDuplicates(["item_id", "item_key"])
    target = kept(_windowed(named, "item_id item_key", f"item_id {item_kind}, item_key long"))
    shape = target.agg(F.count("*"), F.collect_set("size")).first()
    sizes = sorted(shape[1])
    wanted = None
    if 0 < shape[0] <= filter_windows:
        hashes = target.select("hash").distinct().toArrow()["hash"].to_numpy().astype(np.int64).view(np.uint64)
        wanted = spark.sparkContext.broadcast(np.sort(hashes))
    found = _windowed(docs.withColumn("key", key_of()), "doc_id key", f"doc_id {doc_kind}, key long", sizes, wanted).distinct()
    total = target.groupBy("item_id", "item_key").agg(F.countDistinct("at").alias("item_windows"), (F.max("at") + F.max("size")).cast("long").alias("item_words"))
    goal = target.select("item_id", "item_key", "size", "form", "hash", F.col("at").alias("item_at"), F.col("words").alias("item_words"), F.col("slots").alias("item_slots"))
    if shape[0] <= broadcast_windows:
        goal, total = F.broadcast(goal), F.broadcast(total)
    met = found.join(goal, ["size", "form", "hash"]).where(F.col("words") == F.col("item_words")).withColumn("shift", F.col("at") - F.col("item_at"))
    met = kept(met.select("doc_id", "key", "item_id", "item_key", "size", "form", "at", "item_at", "shift", "slots", "item_slots"))
    line = ["doc_id", "key", "item_id", "item_key", "shift"]
    slots = F.arrays_zip("item_slots", "slots")
    pairs = met.where("form = 1").select(*line, F.explode(slots).alias("p")).select(*line, F.col("p.item_slots").alias("old"), F.col("p.slots").alias("new"))
    if one_to_one:
        fair = pairs.distinct().groupBy(*line).agg(((F.count("*") == F.countDistinct("old")) & (F.count("*") == F.countDistinct("new"))).alias("fair"))
        agrees = F.col("fair")
    else:
        often = pairs.groupBy(*line, "old", "new").agg(F.count("*").alias("k")).groupBy(*line, "old").agg(F.max(F.struct("k", F.col("new") == F.col("old"), "new"))["new"].alias("new"))
        fair = often.groupBy(*line).agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("became"))
        agrees = F.forall(slots, lambda p: F.element_at("became", p["item_slots"]) == p["slots"])
    a, b = met.alias("a"), fair.alias("b")
    same = F.lit(True)
    for c in line:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = a.join(b, same, "left").where((F.col("form") == 0) | agrees)
    changed = (F.col("form") == 1) & F.exists(slots, lambda p: p["item_slots"] != p["slots"])
    # places of the item found along one alignment, and the longest run of neighbours among them
    lined = joined.groupBy(*[F.col(f"a.{c}") for c in line]).agg(
        F.sort_array(F.collect_set("item_at")).alias("places"), F.min("at").alias("low"), F.max(F.col("at") + F.col("size") - 1).alias("high"), F.max(changed).alias("changed"), F.max("size").alias("size"),
    )
    step = lambda r, x: F.struct(x.alias("last"), F.when(x == r["last"] + 1, r["now"] + 1).otherwise(1).alias("now"), F.greatest(r["most"], F.when(x == r["last"] + 1, r["now"] + 1).otherwise(1)).alias("most"))
    run = F.aggregate("places", F.struct(F.lit(-2).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda r: r["most"])
    summed = lined.withColumn("span", run + F.col("size") - 1).groupBy(*line[:4]).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("matched"), F.min("low").cast("long").alias("first_word"), F.max("high").cast("long").alias("last_word"),
        F.max("changed").alias("reparameterised"), F.max("span").alias("span"),
    )
    s, t = summed.alias("s"), total.alias("t")
    out = s.join(t, F.col("s.item_id").eqNullSafe(F.col("t.item_id")) & (F.col("s.item_key") == F.col("t.item_key")))
    coverage = F.col("matched") / F.col("item_windows")
    enough = (coverage >= SHARE) & (F.col("matched") >= F.least(F.lit(NUMBER), F.col("item_windows")))
    return out.where(enough | (F.col("span") >= RUN)).select(
        "doc_id", "key", "s.item_id", "matched", "item_windows", "item_words", coverage.alias("coverage"), "first_word", "last_word", "reparameterised"
    )


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    """op5: the contaminated documents, with the items found in each."""
    return matches(docs, items, one_to_one=False).drop("key")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs in which no item of LEAST words or more is found."""
    doc, bad = unused(docs, "bad_doc"), unused(docs, "bad_key")
    enough = F.col("item_words") >= LEAST
    found = matches(docs, items, one_to_one=False).where(enough).select(F.col("doc_id").alias(doc), F.col("key").alias(bad)).distinct()
    return docs.join(small(kept(found)), (key_of() == F.col(bad)) & F.col("doc_id").eqNullSafe(F.col(doc)), "left_anti")
