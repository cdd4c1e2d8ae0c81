"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score. Spark expressions only, no shuffle.

Matches of a kind come from regexp_extract_all, the text between them from split with the same pattern, and positions are running sums of both
lengths, taken in blocks so that the work stays near linear in the number of matches. Patterns are written without backtracking into what has been
matched (possessive, begun at the border of a run), so a text of any length is read in linear time; they match what the stated ones match.

Kinds email, ip, card (Luhn) and phone are reported wherever they are valid, whatever their score. Kinds iban (mod 97) and local_phone (a number without
country code) are added where their score reaches REPORTED. Context is the text between a match and its neighbours of the same kind, NEAR characters either side.

Cases: a null text counts as empty and has no spans; spans of different kinds may overlap and all stay; equal rows give equal rows; other columns
than doc_id and text are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of context either side, and the least score of an added span.
NEAR, REPORTED = 48, 70
#: Matches that a running sum takes together.
BLOCK = 128
#: Fixed: characters of an IBAN by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27,
    "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24,
}
IBAN = "|".join(f"{c}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items())
LOCAL = r"\(?[0-9]{3,5}\)?[ ./-][0-9]{3,4}[ .-][0-9]{3,4}"
#: A part of an address that is at most 255, whatever zeros stand before it.
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """pattern: as Java reads it; hint: a plain test that texts with a match pass; score: of a valid match, `more` with a word of `words` nearby, `less` with one of NOT_PERSONAL."""

    name: str
    pattern: str
    hint: str
    valid: Callable[[Column, Column, Column], Column]
    score: int
    words: str
    more: int = 20
    less: int = 30
    base: bool = True


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    digit = lambda i: F.substr(number, F.length(number) - i, F.lit(1)).cast("int")  # noqa: E731  from the right
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, doubled(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether capital letters and digits, the first four moved to the end and letters read as 10 to 35, leave 1 when divided by 97."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))
    step = lambda r, c: F.when(c < "A", (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), lambda r, i: step(r, F.substr(moved, i, F.lit(1)))) == 1


def _alone(before: Column, after: Column) -> Column:
    """No letter or digit touches the match."""
    return ~before.rlike("[A-Za-z0-9]\\z") & ~after.rlike("^[A-Za-z0-9]")


def _any(m: Column, before: Column, after: Column) -> Column:
    return F.lit(True)


def _ip(m: Column, before: Column, after: Column) -> Column:
    return m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")


def _card(m: Column, before: Column, after: Column) -> Column:
    return F.when(F.length(digits(m)) <= 19, luhn(digits(m))).otherwise(False)


def _phone(m: Column, before: Column, after: Column) -> Column:
    return F.length(digits(m)).between(9, 15)


def _iban(m: Column, before: Column, after: Column) -> Column:
    return _alone(before, after) & mod97(F.replace(m, F.lit(" "), F.lit("")))


def _local(m: Column, before: Column, after: Column) -> Column:
    return _alone(before, after) & ~before.rlike(r"\+[0-9 ().-]*\z") & ~after.rlike(r"^[ .-]?[0-9]") & F.length(digits(m)).between(9, 12)


#: Fixed: words that speak for or against a kind, between characters that are no letters a-z.
TELEPHONE = "phone|telephone|tel|mobile|cell|call|fax|whatsapp|telefon|handy|téléphone|teléfono|móvil"
NOT_PERSONAL = "order|invoice|version|serial|isbn|issn|tracking|ticket|build|reference|example"
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", _any, 80, "email|mail|contact|write|e-mail|correo|kontakt"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", _ip, 50, "ip|address|host|server|client|login|adresse"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){11,}+", "", _card, 70, "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|cvv"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", _phone, 60, TELEPHONE),
    Kind("iban", IBAN, "", _iban, 90, "iban|account|bank|konto|compte|cuenta", base=False),
    Kind("local_phone", LOCAL, "", _local, 40, TELEPHONE, more=40, base=False),
)


def _mentions(words: str, before: Column, after: Column) -> Column:
    lower = F.translate(F.concat(before, F.lit(" \n "), after), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower.rlike(f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)")


def _found(docs: DataFrame) -> DataFrame:
    """docs with an array of spans (start, rank, end, kind, score; of valid matches) for each kind."""
    names = [k.name for k in KINDS]
    hint = lambda k: F.contains(F.col("text"), F.lit(k.hint)) if k.hint else F.lit(True)
    digit = F.col("text").rlike("[0-9]")
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    matched = held.select("*", *[F.when(hint(k) & (digit if k.name != "email" else F.lit(True)), F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).alias(k.name) for k in KINDS])
    some = lambda k, x: F.when(F.size(k.name) > 0, x)
    split = matched.select("doc_id", *names, *[some(k, F.split("text", k.pattern, -1)).alias(f"{k.name}_gaps") for k in KINDS])
    steps = split.select(
        "doc_id", *names,
        *[some(k, F.zip_with(F.concat(F.array(F.lit("")), F.slice(k.name, 1, F.size(k.name) - 1)), F.slice(f"{k.name}_gaps", 1, F.size(k.name)), lambda m, g: F.char_length(m) + F.char_length(g))).alias(f"{k.name}_steps") for k in KINDS],
        *[F.transform(f"{k.name}_gaps", lambda g: F.right(g, F.lit(NEAR))).alias(f"{k.name}_before") for k in KINDS],
        *[F.transform(f"{k.name}_gaps", lambda g: F.left(g, F.lit(NEAR))).alias(f"{k.name}_after") for k in KINDS],
    )
    contexts = [f"{k.name}_{x}" for k in KINDS for x in ("before", "after")]
    # where each match starts: what the blocks before its own hold, and the steps of its block up to it
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / BLOCK).cast("int")), lambda b: F.slice(c, b * BLOCK + 1, BLOCK))
    blocks = steps.select("doc_id", *names, *contexts, *[some(k, cut(f"{k.name}_steps")).alias(f"{k.name}_blocks") for k in KINDS])
    sums = blocks.select("*", *[F.transform(f"{k.name}_blocks", total).alias(f"{k.name}_sums") for k in KINDS])
    before = lambda c: F.transform(c, lambda _, i: total(F.slice(c, 1, i)))
    firsts = sums.select("*", *[before(F.col(f"{k.name}_sums")).alias(f"{k.name}_firsts") for k in KINDS]).drop(*[f"{k.name}_sums" for k in KINDS])
    within = lambda b, s: F.transform(b, lambda _, i: s + total(F.slice(b, 1, i + 1)))
    placed = firsts.select("doc_id", *names, *contexts, *[F.flatten(F.zip_with(f"{k.name}_blocks", f"{k.name}_firsts", within)).alias(f"{k.name}_starts") for k in KINDS])

    def spans(k: Kind, rank: int) -> Column:
        each = F.arrays_zip(F.col(k.name).alias("m"), F.col(f"{k.name}_starts").alias("start"), F.slice(f"{k.name}_before", 1, F.size(k.name)).alias("before"), F.slice(f"{k.name}_after", 2, F.size(k.name)).alias("after"))
        valid = F.filter(each, lambda x: k.valid(x["m"], x["before"], x["after"]))
        said = lambda x, words, by: F.when(_mentions(words, x["before"], x["after"]), by).otherwise(0)
        score = lambda x: F.least(F.lit(100), k.score + said(x, k.words, k.more) - said(x, NOT_PERSONAL, k.less))
        done = F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.char_length(x["m"])).alias("end"), F.lit(k.name).alias("kind"), score(x).alias("score")))
        return F.coalesce(some(k, done if k.base else F.filter(done, lambda s: s["score"] >= REPORTED)), F.array().cast(SPAN))

    return placed.select("doc_id", *[spans(k, i).alias(k.name) for i, k in enumerate(KINDS)])


SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:int>>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of start, rank, end, kind, score; by start, then kind as listed) of each row of docs."""
    found = _found(docs)
    return found.select("doc_id", *[F.sort_array(F.concat(*[k.name for k in kinds])).alias(name) for name, kinds in (("base", [k for k in KINDS if k.base]), ("spans", KINDS))])


def as_text(spans: str, *fields: str) -> Column:
    """The fields of each span joined by colons, spans by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *[s[f].cast("string") for f in fields])), ",")


def query(docs: DataFrame) -> DataFrame:
    """The columns of op13, and scores (kind:start:score of each span)."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k.name)).cast("long").alias(f"n_{k.name}")
    where = ("kind", "start", "end")
    return find(docs).select("doc_id", *[count(k) for k in KINDS if k.base], F.sha2(as_text("base", *where), 256).alias("base_sha256"), as_text("spans", *where).alias("spans"), as_text("spans", "kind", "start", "score").alias("scores"))


#: The kinds' patterns as they are stated, for the comparison: an engine that never backtracks needs no others.
_STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": "[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]", "iban": IBAN, "local_phone": LOCAL,
}


def _oracle() -> str:
    each = "\nUNION ALL ".join(f"SELECT r, {i} AS rank, '{k.name}' AS kind, regexp_extract_all(text, '{_STATED[k.name]}') AS ms, string_split_regex(text, '{_STATED[k.name]}') AS gs FROM t" for i, k in enumerate(KINDS))
    said = lambda words: f"regexp_matches(low, '(?:^|[^a-z])(?:{words})(?:[^a-z]|$)')"
    score = "CASE kind " + " ".join(f"WHEN '{k.name}' THEN {k.score} + CASE WHEN {said(k.words)} THEN {k.more} ELSE 0 END - CASE WHEN {said(NOT_PERSONAL)} THEN {k.less} ELSE 0 END" for k in KINDS) + " END"
    alone = "NOT regexp_matches(before, '[A-Za-z0-9]$') AND NOT regexp_matches(after, '^[A-Za-z0-9]')"
    ways = {"spans": "kind || ':' || a || ':' || e", "scores": "kind || ':' || a || ':' || score"}
    joined = {k: f"coalesce(string_agg({v}, ',' ORDER BY a, rank), '')" for k, v in ways.items()}
    base = [k.name for k in KINDS if k.base]
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), f AS ({each}),
x AS (SELECT r, rank, kind, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM f),
p AS (SELECT r, rank, kind, ms[i] AS m, right(gs[i], {NEAR}) AS before, left(gs[i + 1], {NEAR}) AS after,
  CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS INT) AS a FROM x),
d AS (SELECT *, a + length(m) AS e, regexp_replace(m, '[^0-9]', '', 'g') AS n, replace(m, ' ', '') AS c, translate(before || ' ' || chr(10) || ' ' || after, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM p),
v AS (SELECT r, rank, kind, a, e, least(100, {score}) AS score FROM d WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN regexp_matches(m, '^{BYTE}(?:\\.{BYTE}){{3}}$') WHEN 'phone' THEN length(n) BETWEEN 9 AND 15
  WHEN 'card' THEN length(n) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length(n)), lambda k: CASE WHEN k % 2 = 1 THEN CAST(n[length(n) - k] AS INT) * 2 // 10 + CAST(n[length(n) - k] AS INT) * 2 % 10 ELSE CAST(n[length(n) - k] AS INT) END)) % 10 = 0
  WHEN 'iban' THEN {alone} AND list_reduce(list_concat([0], list_transform(string_split(c[5:] || c[:4], ''), lambda x: CASE WHEN x < 'A' THEN ascii(x) - 48 ELSE ascii(x) - 55 END)), lambda s, x: CASE WHEN x < 10 THEN (s * 10 + x) % 97 ELSE (s * 100 + x) % 97 END) = 1
  ELSE {alone} AND NOT regexp_matches(before, '\\+[0-9 ().-]*$') AND NOT regexp_matches(after, '^[ .-]?[0-9]') AND length(n) BETWEEN 9 AND 12 END),
s AS (SELECT * FROM v WHERE rank < {len(base)} OR score >= {REPORTED}),
g AS (SELECT r, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in base)}, coalesce(string_agg({ways["spans"]}, ',' ORDER BY a, rank) FILTER (WHERE rank < {len(base)}), '') AS b, {joined["spans"]} AS spans, {joined["scores"]} AS scores FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM t LEFT JOIN g USING (r)
"""


ORACLE = _oracle()
