"""Secret scans: sure findings by pattern, and multipart credentials whose weak parts count only beside their complements.

A scan of each whole text gives sure spans (assignments, access ids, long hex runs) and parts of credentials: identifiers
(access ids, user and client ids), secrets (sure ones; and weak ones: pass phrases, mixed tokens) and endpoints (URLs, hosts). An interval
join within each text links parts whose starts lie within `scope` characters: a weak secret or identifier is reported beside its
complement, an endpoint beside both. The join is exact without listing pairs: for every stretch of `scope` characters the
first and last start of each kind are kept, and a candidate meets the stretches before, at and after its own.

Cases: a null text counts as empty and has no spans; of overlapping kinds each keeps its span; equal rows are scanned as one
and each keeps its result; rows without doc_id are told apart by their text; other columns than doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.shared import in_batches, kept, key_of, releasing, slices, small, texts_as_strings, unused

#: The order of kinds that begin at the same place.
KINDS = ("assign", "access", "hex", "identifier", "weak_secret", "endpoint")
#: Kinds that are sure.
SURE = 3
#: Fixed patterns of the sure kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINT = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:_?name|_?id)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9][A-Za-z0-9@._+-]{2,})""", re.IGNORECASE | re.ASCII)
IDENTIFIER_HINT = ("user", "login", "account", "client", "key")
PHRASE = re.compile(r"""(?<![A-Za-z0-9])(?:pass(?:phrase|code)?|pwd|pin)["']?\x20*[:=]\x20*["']?([^\s"']{4,})""", re.IGNORECASE | re.ASCII)
MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""(?<![A-Za-z0-9+.-])[0-9+.-]*+[A-Za-z][A-Za-z0-9+.-]*+://[^\s"'<>]{3,}|(?<![A-Za-z0-9])(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9.:-]{2,}""", re.ASCII)
ENDPOINT_HINT = ("://", "host", "endpoint", "server")
SPAN = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _random_looking(token: str) -> bool:
    """Lower case, upper case and digits, with at least 3 bits of entropy a character."""
    if not (any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)):
        return False
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values()) >= 3.0


def sure(text: str) -> list[tuple[str, int, int]]:
    """Spans (code points, end exclusive) of the three sure kinds."""
    out = []
    lower = text.lower()
    if any(h in lower for h in ASSIGN_HINT):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def weak(text: str, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of weak identifiers, secrets and endpoints but those that lie within another span; ones that only overlap stay. Without any complement in the text, secrets are not looked for."""
    lower = text.lower()
    out = []
    if any(h in lower for h in IDENTIFIER_HINT):
        out += [("identifier", *m.span()) for m in IDENTIFIER.finditer(text)]
    if any(h in lower for h in ENDPOINT_HINT):
        out += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    if out or any(k == "access" for k, _, _ in found):
        out += [("weak_secret", *m.span()) for m in PHRASE.finditer(text)]
        out += [("weak_secret", *m.span()) for m in MIXED.finditer(text) if _random_looking(m[0])]
    clear, reached = [], 0
    for a, b, rank in sorted((a, -b, KINDS.index(kind)) for kind, a, b in {*found, *out}):
        if -b > reached and rank >= SURE:
            clear.append((KINDS[rank], a, -b))
        reached = max(reached, -b)
    return clear


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, key (tells rows of different doc_id or text apart), found (sure spans) and parts (weak spans) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, parts = [], []
        for text in texts_as_strings(batch):
            found.append(sure(text))
            parts.append(weak(text, found[-1]))
        as_rows = lambda spans: pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in spans], _SPANS)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), as_rows(found), as_rows(parts)], ["doc_id", "key", "found", "parts"])

    return in_batches(docs.select("doc_id", "text", key_of().alias("key")), run, f"doc_id {kind}, key long, found {SPAN}, parts {SPAN}")


def link(scanned: DataFrame, scope: int = 400) -> DataFrame:
    """doc_id, key, linked: the weak spans of each scanned text that have their complements within `scope` characters."""
    each = scanned.where(F.size("parts") > 0).dropDuplicates(["doc_id", "key"])
    candidates = each.select("doc_id", "key", F.explode("parts").alias("p")).select("doc_id", "key", "p", F.floor(F.col("p.start") / scope).cast("int").alias("bin"))
    every = each.select("doc_id", "key", F.explode(F.concat("found", "parts")).alias("p"))
    role = F.when(F.col("p.kind").isin("access", "identifier"), "identifier").when(F.col("p.kind") == "endpoint", "endpoint").otherwise("secret")
    stretches = every.groupBy("doc_id", "key", role.alias("role"), F.floor(F.col("p.start") / scope).cast("int").alias("bin")).agg(F.min("p.start").alias("low"), F.max("p.start").alias("high"))
    near = candidates.select("doc_id", "key", "p", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    a, b = near.alias("a"), stretches.alias("b")
    start = F.col("a.p.start")
    met = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("b.high") >= start - scope) & (F.col("b.low") <= start + scope))
    roles = met.groupBy("a.doc_id", "a.key", "a.p").agg(F.collect_set("b.role").alias("roles"))
    has = lambda x: F.array_contains("roles", x)
    complete = F.when(F.col("p.kind") == "weak_secret", has("identifier")).when(F.col("p.kind") == "identifier", has("secret")).otherwise(has("identifier") & has("secret"))
    return roles.where(complete).groupBy("doc_id", "key").agg(F.collect_list("p").alias("linked"))


def find(docs: DataFrame, scope: int = 400) -> DataFrame:
    """doc_id, key, found and spans (the sure and the linked ones, by start and kind) of each row of docs."""
    scanned = kept(scan(docs))
    a, b = scanned.alias("a"), link(scanned, scope).alias("b")
    both = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left")
    return both.select("a.doc_id", "a.key", in_order(F.col("a.found")).alias("found"), in_order(F.concat("a.found", F.coalesce("b.linked", F.array().cast(SPAN)))).alias("spans"))


def in_order(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    ranked = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def as_text(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    """The columns of op2."""
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(as_text("found"), 256).alias("base_sha256"), as_text("spans").alias("spans"))


def _without(text: str, spans: list[dict]) -> str:
    """text with each span (in order of their starts) replaced by <kind>; one that begins within another is covered by it or lengthens it."""
    out, at = [], 0
    for span in spans:
        if span["start"] >= at:
            out += [text[at : span["start"]], f"<{span['kind']}>"]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, scope: int = 400) -> DataFrame:
    """docs with every span of its texts replaced by <kind>, overlapping spans by the first's, and n_chars (if there) made to agree. Texts without spans stay as they are."""
    spans = small(kept(find(docs, scope).where(F.size("spans") > 0).select("doc_id", "key", "spans").dropDuplicates(["doc_id", "key"])))
    doc, key, found = (unused(docs, x) for x in ("span_doc", "span_key", "spans_found"))
    named = spans.select(F.col("doc_id").alias(doc), F.col("key").alias(key), F.col("spans").alias(found))
    joined = docs.join(named, F.col("doc_id").eqNullSafe(F.col(doc)) & (key_of() == F.col(key)), "left").select(*[F.col(f"`{c}`") for c in docs.columns], found)
    n = len(docs.columns)
    at = {c: i for i, c in enumerate(docs.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2_000_000):
            columns = list(batch.columns[:n])
            rows = {i: x for i, x in enumerate(batch.column(n).to_pylist()) if x}
            if rows:
                texts = columns[at["text"]].to_pylist()
                for i, x in rows.items():
                    texts[i] = _without(texts[i], x)
                columns[at["text"]] = pa.array(texts, columns[at["text"]].type)
                if "n_chars" in at:
                    lengths = columns[at["n_chars"]].to_pylist()
                    for i in rows:
                        lengths[i] = len(texts[i])
                    columns[at["n_chars"]] = pa.array(lengths, columns[at["n_chars"]].type)
            yield pa.RecordBatch.from_arrays(columns, docs_names)

    docs_names = docs.columns
    return joined.mapInArrow(releasing(run), docs.schema)
