import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from trackloom.llm import suffix

D = suffix.DEPTH


def brute(rows):
    """Unigram base and suffix tree with dictionaries of contexts."""
    split = [("".join(c.lower() if c.isascii() else c for c in t or "").encode().split()) for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    count = Counter(w for x, h in zip(split, held, strict=True) if not h for w in [*x, b"\n"])
    n, v = sum(count.values()), len(count)
    after = defaultdict(Counter)
    lines = [b" ".join(x) + b"\n" for x in split]
    padded = [b"\0" * (D - 1) + b"\n" + x for x in lines]
    for line, h in zip(padded, held, strict=True):
        if not h:
            for i in range(D, len(line)):
                for k in range(D + 1):
                    after[line[i - k : i]][line[i]] += 1

    def retained(context):
        mine, above = after.get(context, Counter()), after.get(context[1:], Counter())
        total, over = sum(mine.values()), sum(above.values())
        gain = sum(m * math.log(m / total * over / above[a]) for a, m in mine.items())
        return gain > 0.5 * len(mine) * math.log(max(1, total))

    keep = {}

    def p(context, a):
        if not context:
            return (after[b""][a] + 0.5) / (sum(after[b""].values()) + 128)
        if context not in keep:
            keep[context] = retained(context)
        if not keep[context]:
            return p(context[1:], a)
        mine = after[context]
        return (mine[a] + len(mine) * p(context[1:], a)) / (sum(mine.values()) + len(mine))

    out = []
    for x, h, line in zip(split, held, padded, strict=True):
        c = [count[w] for w in [*x, b"\n"]]
        base = sum(math.log10((k + 0.5) / (n + 0.5 * (v + 1))) for k in c)
        out.append((h, len(c), sum(k > 0 for k in c), n, base, sum(math.log10(p(line[i - D : i], line[i])) for i in range(D, len(line)))))
    return out, sum(keep.values())


@pytest.mark.parametrize("chunk", [10**9, 900])
def test_against_dictionaries(spark, chunk):
    rng = random.Random(4)
    syllables = "th er on an re ing ion é ü The AND 一".split()
    rows = [(i, " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 40))) + rng.choice(["", "\n", " \t x", " the usual end of many texts"])) for i in range(150)]
    rows += [(1000, None), (1001, ""), (None, "the end"), (7, "twice the"), (7, "twice the")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(4)
    got = sorted(((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in suffix.score(docs, chunk).collect()), key=lambda r: (r[0], r[-1]))
    made, states = brute(rows)
    assert states > 50
    want = sorted(((i or -1, *m) for (i, _), m in zip(rows, made, strict=True)), key=lambda r: (r[0], r[-1]))
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_probabilities_sum_to_one(spark):
    """After one context, all bytes that were asked for have the mass that is not left to others."""
    text = "abcab abd abe abcab abcab abcab " * 30
    docs = spark.createDataFrame([(i, text) for i in range(40)] + [(i, "zzz ab" + chr(c)) for i, c in zip(range(100, 140), range(97, 137), strict=False)], "doc_id long, text string")
    model = suffix.tree(suffix.counted(docs.selectExpr("doc_id", "text", "doc_id >= 100 as held_out")))
    rows = model.selectExpr("shiftright(gram, 8) as context", "pow(10, logp) as p").groupBy("context").sum("p").collect()
    assert all(r[1] <= 1 + 1e-9 for r in rows) and max(r[1] for r in rows) > 0.9


def test_nothing(spark):
    docs = spark.createDataFrame([(2, "a b")], "doc_id long, text string")
    assert suffix.score(docs.limit(0)).collect() == []
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = suffix.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0) and row.score == pytest.approx(4 * math.log10(1 / 256))
