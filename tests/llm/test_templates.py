import random
import re

from trackloom.llm import templates as t

ITEMS = [
    (1, "A train leaves Boston at 40 km per hour and Anna counts 12 red cars on the long way to Boston before noon"),
    (2, "which of the following animals has never been seen in the cold rivers of the north"),
    (3, "what is the name of her dog"),
    (4, "too short"), (5, None),
]


def brute(docs, items):
    """Every window of every document against every window of every item, word by word."""
    def words(text):
        out = []
        for w in re.split(r"[\x20\x09-\x0d]+", text or ""):
            s = w.strip(".,;:!?\"'()[]{}<>|#$%&*-_~`/\\=+")
            if not s:
                continue
            low = s.lower() if s.isascii() else "".join(c.lower() if c.isascii() else c for c in s)
            kind = "<num>" if re.fullmatch(r"[+-]?[0-9][0-9.,]*(?:st|nd|rd|th)?|[0-9]+[a-z]{1,3}", low) else "<name>" if re.match("[A-ZÀ-Þ]", s) else None
            if kind is None and low.encode() in t.UNITS and out and out[-1][1] == "<num>":
                kind = "<unit>"
            out.append((low, kind))
        return out

    result = {}
    for i, item in items:
        iw = words(item)
        size = min(t.WINDOW, len(iw))
        if size < t.LEAST:
            continue
        for d, doc in docs:
            dw = words(doc)
            lines = {}
            for a in range(len(iw) - size + 1):
                for b in range(len(dw) - size + 1):
                    x, y = iw[a : a + size], dw[b : b + size]
                    if [w for w, _ in x] == [w for w, _ in y]:
                        lines.setdefault(b - a, []).append((a, b, None))
                    slots = sum(k is not None for _, k in x)
                    if slots and size - slots >= min(t.LEAST, size - 1) and [k or w for w, k in x] == [k or w for w, k in y]:
                        lines.setdefault(b - a, []).append((a, b, [(p, q) for (p, k), (q, _) in zip(x, y) if k]))
            hits, changed = [], False
            for found in lines.values():
                pairs = {p for *_, s in found for p in s or ()}
                fair = len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs})
                use = [f for f in found if f[2] is None or fair]
                hits += use
                changed |= fair and any(p != q for p, q in pairs)
            n = len(iw) - size + 1
            at = {a for a, *_ in hits}
            if at and len(at) / n >= t.SHARE and len(at) >= min(t.NUMBER, n):
                result[d, i] = (len(at), n, min(b for _, b, _ in hits), max(b + size - 1 for _, b, _ in hits), changed)
    return result


def test_against_brute_force(spark):
    rng = random.Random(2)
    fill = lambda n: " ".join(rng.choices("red cars on the of way long her dog name is what | ### 7 Bob".split(), k=n))
    first = ITEMS[0][1]
    docs = [
        (1, fill(30) + " " + first + ". " + fill(20)), (2, first.lower()), (3, first.replace("Boston", "Paris").replace("40", "55").replace("km", "miles").replace("Anna", "Eve")),
        (4, first.replace("Boston", "Paris", 1)), (5, first.replace("Anna", "Boston")), (6, None), (7, ""), (8, " | ".join(first.split())), (9, fill(500)),
        (10, "WHAT is (the name) of her dog?"), (11, ITEMS[1][1].replace("the following ", "")), (12, " ".join(ITEMS[1][1].split()[:9])), (13, " ".join(ITEMS[1][1].split()[:11])),
        (14, (ITEMS[1][1] + "\n") * 30), (None, first),
    ]
    for i in range(20, 60):
        w = rng.choice([first, ITEMS[1][1]]).split()
        a, b = sorted(rng.sample(range(len(w) + 1), 2))
        docs.append((i, fill(rng.randint(0, 9)) + " " + " ".join(rng.choice(["Eve", "9", x]) if rng.random() < 0.1 else x for x in w[a:b]) + " " + fill(5)))
    frame = spark.createDataFrame([(*d, "x") for d in docs] + [(1, docs[0][1], "x")], "doc_id long, text string, words string")
    items = spark.createDataFrame([*ITEMS, ITEMS[0]], "item_id long, text string")
    want = brute(docs, ITEMS)
    for options in ({}, {"filter_windows": 0, "broadcast_windows": 0}):
        got = {(r.doc_id, r.item_id): (r.matched, r.item_windows, r.first_word, r.last_word, r.reparameterised) for r in t.matches(frame, items, **options).collect()}
        assert got == want
    assert want[3, 1][-1] and (5, 1) not in {k for k, v in want.items() if v[-1]} and (9, 1) not in want and (12, 2) not in want and (13, 2) in want
    left = t.clean(frame, items)
    assert left.columns == frame.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert t.query(docs.limit(0), items).count() == 0
    assert t.query(docs, items.limit(0)).count() == 0
    assert t.clean(docs, items.limit(0)).count() == 1


def test_values_may_become_equal(spark):
    """Different values that became equal; one value that changed in one place only; the same in one_to_one alone is lost."""
    item = "a farmer buys 3 crates of ripe apples and 4 crates of green pears at the old town market"
    long = " ".join(f"a{i} of b{i} and {i % 3} c{i}" for i in range(8))
    odd = long.replace("and 0 c0", "and 5 c0").replace("and 1", "and 6").replace("and 2", "and 7").replace("and 0", "and 8")
    docs = spark.createDataFrame([(1, item.replace("3", "6").replace("4", "6")), (2, odd), (3, "a farmer sells 6 crates")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, long)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.item_windows, r.reparameterised) for r in t.query(docs, items).collect()}
    assert got.keys() == {(1, 1), (2, 2)} and got[1, 1] == (12, 12, True) and got[2, 2][2] and got[2, 2][0] < got[2, 2][1]
    assert t.matches(docs, items).where("item_id = 1").count() == 0
    assert [r.doc_id for r in t.clean(docs, items).collect()] == [3]


def test_long_passage_of_a_long_item(spark):
    """A run of 13 words is reported whatever share of the item it is, 12 words are not, nor are 13 in pieces."""
    words = [f"w{i}" for i in range(400)]
    texts = [words[100:150], words[100:113], words[100:112], words[100:110] + ["x"] + words[110:120]]
    docs = spark.createDataFrame([(i, " ".join(["q"] * 5 + x + ["z"] * 5)) for i, x in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: (r.matched, r.item_windows, r.first_word, r.last_word) for r in t.query(docs, items).collect()}
    assert got == {0: (43, 393, 5, 54), 1: (6, 393, 5, 17)}


def test_short_items(spark):
    """Items of one to four words are found word for word at word boundaries, but do not clean; those without words are not found."""
    docs = spark.createDataFrame([(1, "he said Yes, of course"), (2, "yesterday of all days"), (3, "what is: the answer?"), (4, "what is an answer")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes"), (2, "What is the answer"), (3, "?"), (4, "3 km of"), (5, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.matched, r.first_word, r.last_word) for r in t.query(docs, items).collect()} == {(1, 1, 1, 2, 2), (3, 2, 1, 0, 3)}
    assert t.clean(docs, items).count() == 4


def test_clashing_columns(spark):
    item = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, item, "a", "b", "c"), (2, "no", "d", "e", "f")], "doc_id long, text string, bad_doc string, bad_key string, `__key` string")
    left = t.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [tuple(r) for r in left.collect()] == [(2, "no", "d", "e", "f")] and left.columns == docs.columns
