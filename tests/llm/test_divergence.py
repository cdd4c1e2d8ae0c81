import random
import re
from collections import Counter, defaultdict

import duckdb

from trackloom.llm import divergence
from trackloom.llm.queries import op12_source_divergence

SCALE = 10**9


def plainly(rows):
    """The contract, word for word: all terms against all pairs of sources."""
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(words)
        held[lang].update(set(words))
    out = set()
    for lang in held:
        terms = [t for t, n in held[lang].items() if n >= 3]
        own = {s: c for (x, s), c in counts.items() if x == lang}
        total = {s: sum(c[t] for t in terms) for s, c in own.items()}
        p = {s: {t: 1 + SCALE * (c[t] + 1) // (total[s] + len(terms)) for t in terms} for s, c in own.items()}
        every = {t: sum(c[t] for c in own.values()) for t in terms}
        q = {t: 1 + SCALE * (every[t] + 1) // (sum(every.values()) + len(terms)) for t in terms}
        for s in own:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in terms), o.encode(), o) for o in own if o != s]
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))}
            best = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in terms if own[s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(best[:200])}
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(t, lang, s, 1, "x", 0) for t, lang, s in rows], "text string, lang string, source string, n long, term string, row int").repartition(4)
    got = [tuple(r) for r in divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plainly(rows)


def corpus(rng, n):
    words = ["the", "The", "é", "ñandú", "a1b", "x_y", "日本", "😀"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    weights = [60, 9, 8, 7, 6, 5, 4, 3] + [1] * 300
    hot = lambda: rng.choice(["s0"] * 5 + ["s1", "s2", "é", "s10", "", None])
    return [(" ".join(rng.choices(words, weights, k=rng.randint(0, 60))), rng.choice(["en", "en", "de", None]), hot()) for _ in range(n)]


def test_equals_the_contract(spark):
    rng = random.Random(11)
    rows = corpus(rng, 300) + [(None, "en", "only nulls"), ("", "fr", "a"), ("x y", "fr", "b"), ("x y", "fr", "b"), (None, None, None)]
    check(spark, rows + rows[:20] + [("same words here", "en", "copies")] * 50)
    check(spark, [])
    check(spark, [("", "en", "a"), (None, "en", "b")])


def test_small_blocks_and_flushes(spark, monkeypatch):
    """Sums are handed on often, and one very long text holds more terms than a task keeps."""
    rng = random.Random(12)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "BLOCK", 7)
    long = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(20_000))
    check(spark, corpus(rng, 60) + [(long, "en", f"s{i}") for i in range(3)] + [("one\x00two\x7fthree", "en", "s1")] * 3)


def test_shared_paths_are_corrected_once():
    """Rows that share a path make one correction for each node and ancestor of the tree."""
    seen = []
    pairs = divergence._Pairs.add
    divergence._Pairs.add = lambda self, path, node: (seen.append((len(path[0]), node[3])), pairs(self, path, node))[1]
    try:
        import pyarrow as pa

        rows = {"lang": ["en"] * 4, "source": [["a", "b", "c"], ["a", "b", "c"], ["a", "b", "d"], ["b"]], "p": [[5, 5, 5], [5, 5, 6], [5, 5, 7], [9]], "p0": [[1, 1, 1]] * 3 + [[1]], "m": [2, 1, 4, 3]}
        (out,) = divergence._walk([pa.RecordBatch.from_pydict(rows)])
    finally:
        divergence._Pairs.add = pairs
    assert sorted(seen) == [(1, 7), (2, 1), (2, 2), (2, 4)]
    got = {(r["a"], r["b"]): r["ab_10"] for r in out.to_pylist()}
    assert got == {("a", "b"): 7 * 16, ("a", "c"): 3 * 16, ("b", "c"): 3 * 16, ("a", "d"): 4 * 16, ("b", "d"): 4 * 16}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    df = op12_source_divergence(spark, "/root/testdata/sf0.001")
    cur = con.execute(divergence.ORACLE)
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in cur.fetchall())
