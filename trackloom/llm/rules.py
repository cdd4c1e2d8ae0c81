"""Quality rules: a table of thresholds, compiled into one projection of length, symbol, stop-word, repetition and line ratios.

All of it is Spark expressions. Windows of five words are compared by 64-bit hash only to tell that a text repeats none; where
hashes meet, the windows themselves are sorted and compared, so the counts are exact. The work for a text is n log n in its words.

Cases: a null text has no words and fails; lines and words are those of the whole text; repeated rows give repeated results; columns
other than doc_id and text are not read, and the measures are added beside doc_id only; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.shared import SPACE

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = """
the of and to in a is that it for on was be with as are by this from or an at
der die und das den dem des ein eine ist nicht mit von zu auf sich im in an als auch
le la les de des du et en un une que qui est dans pour par sur au pas
el los las de y que en un una es por con para del se no su al
""".split()
#: Fixed: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high (None: open)."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: measure: a SQL expression over the columns of measures().
RULES = (
    Rule("length", "n_words", low=10),
    Rule("repeated_words", "n_repeat_words / n_words", high=0.20),
    Rule("word_length", "word_chars / n_words", low=1.5, high=14.0),
    Rule("symbols", "n_symbols / n_words", high=0.30),
    Rule("stop_words", "n_stop_words / n_words", low=0.01),
    Rule("repeated_lines", "n_dup_lines / n_lines", high=0.50),
)


def _windows(words: str) -> Column:
    """Windows of WINDOW neighbouring words, each as a string. Words hold no space, so different windows differ."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.concat_ws(" ", F.slice(words, i, WINDOW)))


def _hashes(words: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_stop_words, n_repeat_words, all long."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select(
        "doc_id",
        F.array_remove(F.split(text, SPACE + "+"), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
    )
    many = F.size("words") > WINDOW
    hashed = split.select("*", F.when(many, _hashes("words")).alias("hashes"))
    # places of the windows that are equal to another: neighbours in the sorted order
    placed = F.when(many & (F.size("hashes") != F.size(F.array_distinct("hashes"))), F.sort_array(F.transform(_windows("words"), lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    ordered = hashed.select("*", placed.alias("ordered")).drop("hashes")
    first = F.struct(F.lit(None).cast("string").alias("w"), F.lit(-1).alias("i"))
    around = F.arrays_zip(
        F.col("ordered").alias("here"),
        F.concat(F.array(first), F.slice("ordered", 1, F.size("ordered") - 1)).alias("back"),
        F.concat(F.slice("ordered", 2, F.size("ordered")), F.array(first)).alias("ahead"),
    )
    equal = F.transform(
        F.filter(around, lambda x: F.coalesce(x["here"]["w"] == x["back"]["w"], F.lit(False)) | F.coalesce(x["here"]["w"] == x["ahead"]["w"], F.lit(False))),
        lambda x: x["here"]["i"],
    )
    starts = ordered.select("*", F.when(F.col("ordered").isNotNull(), F.sort_array(equal)).alias("starts"))
    # a repeated window covers the words up to the next one's start, WINDOW at most
    covered = F.aggregate(F.zip_with(F.slice("starts", 2, F.size("starts")), F.slice("starts", 1, F.size("starts") - 1), lambda b, a: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW).cast("long"), lambda a, b: a + b)
    return starts.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(F.size("starts") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Whether all rules pass, and the names of those that don't. A measure without a value (no words) fails."""
    fails = []
    for r in rules:
        value = F.expr(r.measure.replace(" / n_words", " / nullif(n_words, 0)").replace(" / n_lines", " / nullif(n_lines, 0)"))
        inside = F.lit(True)
        if r.low is not None:
            inside &= value >= r.low
        if r.high is not None:
            inside &= value <= r.high
        fails.append(F.when(F.coalesce(inside, F.lit(False)), F.lit(None)).otherwise(F.lit(r.name)))
    failed = F.array_compact(F.array(*fails))
    return F.size(failed) == 0, failed


def apply(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measures() with kept (all rules pass) and failed (names of the others)."""
    passes, failed = verdict(rules)
    return measures(docs).withColumns({"kept": passes, "failed": failed})


def query(docs: DataFrame) -> DataFrame:
    """The columns of op4: base_failed is the fixed pair of rules, kept the whole table's verdict."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return apply(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"))


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[ \\x09-\\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS lines FROM t),
w AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS w FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM s)),
d AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
c AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS p FROM d, (SELECT unnest(range(0, 5)) AS k)) GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(words, lambda x: lower(x) IN ({_STOPS}))) AS n_stop FROM s LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND
  word_chars / n_words BETWEEN 1.5 AND 14 AND n_symbols / n_words <= 0.30 AND n_stop / n_words >= 0.01 AND n_dup_lines / n_lines <= 0.50 AS kept FROM b
"""
