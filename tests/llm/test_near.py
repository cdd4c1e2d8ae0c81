import random

import numpy as np
import pytest
import xxhash

from trackloom.llm import near


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(pairs, r=4):
    """(id, fp) to the least id reached, by looking at all pairs."""
    parent = list(range(len(pairs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= r:
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(pairs))]


TEXTS = [None, "", " \n", "One", "one", "a b c d", "A\tb  c\nd", "a b c d e", "é È ü \xa0 x y z w", "the cat " * 300, "x " * 70_000]


def test_fingerprints():
    assert [near.fingerprint((t or "").encode()) for t in TEXTS[:-1]] == [brute_fingerprint(t) for t in TEXTS[:-1]]
    assert near.fingerprint(TEXTS[-1].encode()) == near.fingerprint(b"x x x x")


def test_query_against_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = list(TEXTS)
    for _ in range(25):
        words = rng.choices(vocabulary, k=rng.randint(30, 400))
        for _ in range(rng.randint(1, 8)):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts)] + [(4, "", "x"), (None, texts[20], "x"), (None, "alone and without a number", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in near.query(docs).collect())
    prints = [near.fingerprint((t or "").encode()) for _, t, _ in rows]
    want = brute_components([(r[0], p) for r, p in zip(rows, prints, strict=True)])
    assert got == sorted((r[0] or -1, f"{p:016x}", w or -1) for r, p, w in zip(rows, prints, want, strict=True))


def test_one_of_each(spark):
    """The least of each component of all pairs stays; rows without doc_id stay."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {1: None, 2: "", 3: "few words", 4: "few words"}
    for g in range(20):
        words = rng.choices(vocabulary, k=rng.randint(120, 400))
        for c in range(rng.randint(1, 5)):
            copy = list(words)
            for _ in range(0 if c == 0 else rng.choice([0, 1, 2, 30])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts[100 + g * 10 + c] = " ".join(copy)
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, texts[100], "x"), (3, "few words", "x")], "doc_id long, text string, fp string").repartition(4)
    left = near.one_of_each(docs)
    assert left.columns == docs.columns
    pairs = [(i, near.fingerprint((t or "").encode())) for i, t in texts.items()]
    want = {i for (i, _), c in zip(pairs, brute_components(pairs), strict=True) if c == i}
    assert sorted(r.doc_id or 0 for r in left.collect()) == sorted([*want, 0, 3]) and 3 in want
    assert near.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("capacity", "block", "spread"), [(8, 4096, 64), (16, 20, 12), (4, 7, 64), (10**6, 10**6, 64)])
def test_links_lose_nothing(spark, capacity, block, spread):
    """Many fingerprints in crowded and empty regions, small leaves and small blocks."""
    rng = random.Random(capacity)
    values = {0, 2**64 - 1}
    for _ in range(60):
        base = sum(1 << b for b in range(spread) if rng.random() < 0.5)
        for _ in range(rng.randint(1, 10)):
            values.add(base)
            for _ in range(rng.randint(0, 5)):
                base ^= 1 << rng.randrange(64)
    values = sorted(values)
    distinct = spark.createDataFrame([(v - (v >> 63 << 64),) for v in values], "fp long")
    edges = near.links(distinct, capacity=capacity, block=block, sample=200)
    root = {r.v % 2**64: r.root % 2**64 for r in near.components(edges).collect()}
    want = brute_components([(v, v) for v in values])
    classes = lambda roots: {frozenset(v for v in values if roots[v] == x) for x in roots.values()}
    assert classes({v: root.get(v, v) for v in values}) == classes(dict(zip(values, want, strict=True)))


def test_trees_visit_what_they_must():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 3000, np.uint64)
    for mask in near.stretches(3):
        tree = near.Tree.grown(values[:500], mask, 3000, 40)
        assert tree.leaves > 20
        rows, leaf, home = tree.visits(values, 1)
        assert home.sum() == len(values) and len(rows) < len(values) * tree.leaves / 2
        homes, seen = dict(zip(rows[home], leaf[home], strict=True)), set(zip(rows.tolist(), leaf.tolist(), strict=True))
        d = np.bitwise_count((values[:200, None] ^ values[None]) & np.uint64(mask)) <= 1
        assert all((i, homes[j]) in seen for i, j in zip(*np.nonzero(d), strict=True))


def test_chain_and_nothing(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    assert {(r.v, r.root) for r in near.components(edges).collect()} == {(i, 0) for i in range(301)} | {(1000, 1000), (1001, 1000)}
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near.query(docs).collect() == []


def similarity(a, b):
    grams = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4)) if w}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("share", [1, 16])
def test_one_of_similar(spark, share):
    """All pairs of five-word similarity 0.8 or more are linked, also those of fingerprints far apart, and no others."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    header = rng.choices(vocabulary, k=30)
    texts = {1: None, 2: "", 3: "few words", 4: "few words", 5: "a b c d e f g h i", 6: "a b c d e f g h i j", 7: " Few\nWORDS ", 8: "a b c d e f g h"}
    for g in range(30):
        copy = header + rng.choices(vocabulary, k=rng.randint(20, 300))
        for c in range(rng.randint(1, 6)):
            texts[100 + g * 10 + c] = " ".join(copy)
            copy = list(copy)
            for _ in range(rng.choice([1, 2, 4, 6, 30])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, texts[100], "x"), (3, "few words", "x")], "doc_id long, text string, set string").repartition(4)
    ids = sorted(texts)
    least = {i: i for i in ids}
    far = 0
    for i in ids:
        for k in ids:
            if k < i and similarity(texts[i], texts[k]) >= 0.8:
                far += (near.fingerprint((texts[i] or "").encode()) ^ near.fingerprint((texts[k] or "").encode())).bit_count() > 4
                old, new = sorted([least[i], least[k]], reverse=True)
                least = {x: new if y == old else y for x, y in least.items()}
    assert far > 10
    left = near.one_of_similar(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == sorted([*[i for i in ids if least[i] == i], 0, 3])
    assert near.one_of_similar(docs.limit(0)).count() == 0
    marked, edges = near.similar(docs.where("doc_id is not null"), share=share, common=2)
    root = {r.v: r.root for r in near.components(edges).collect()}
    groups = {}
    for r in marked.collect():
        groups.setdefault(root.get(r.set, r.set), set()).add(r.doc_id)
    assert {frozenset(x) for x in groups.values()} == {frozenset(i for i in ids if least[i] == k) for k in set(least.values())}


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", "y"), (2, "a b c d e f", "x", "y")], "doc_id long, text string, gone_id string, `__doc` string")
    for left in (near.one_of_each(docs), near.one_of_similar(docs)):
        assert [tuple(r) for r in left.collect()] == [(1, "a b c d e f", "x", "y")] and left.columns == docs.columns


def test_sketches():
    """Estimates lie within four standard errors of the similarity, small sets included."""
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 300, 20_000):
        for share in (0.0, 0.5, 0.8, 0.95, 1.0):
            common = int(round(2 * n * share / (1 + share)))
            values = rng.integers(-(2**63), 2**63 - 1, 2 * n - common, np.int64)
            a, b = np.sort(values[:n]), np.sort(values[n - common :])
            x, y = (np.frombuffer(near.sketch(v), np.uint8)[None] for v in (a, b))
            places = ((x > 0) | (y > 0)).sum()
            true = common / (2 * n - common)
            fine = [np.frombuffer(near.sketch(v, near.FINE), np.uint8)[None] for v in (a, b)]
            assert (near.coarse(fine[0]) == x).all() and (near.coarse(fine[1]) == y).all()
            assert abs(near.alike_rows(x, y)[0] - near.alike(x, y)[0, 0]) < 1e-5
            assert abs(near.alike_rows(*fine)[0] - true) < 4.5 * (max(true * (1 - true), 0.004) / near.FINE) ** 0.5 + 0.01
            assert abs(near.alike(x, y)[0, 0] - true) < 4.5 * (max(true * (1 - true), 0.004) / places) ** 0.5 + 0.01


def test_shard_in_blocks(spark):
    """A chain of alike sets in one shard, cut into small blocks, stays one component; sets that share a shingle alone do not join it."""
    head = [f"h{i}" for i in range(8)]
    body = [f"b{i}" for i in range(160)]
    rows = [(i, " ".join(head + body[: 80 + 2 * i])) for i in range(40)] + [(100 + i, " ".join(head + [f"o{i}_{k}" for k in range(20)])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked, edges = near.similar(docs, share=1, common=2, block=7)
    root = {r.v: r.root for r in near.components(edges).collect()}
    groups = {}
    for r in marked.collect():
        groups.setdefault(root.get(r.set, r.set), set()).add(r.doc_id)
    assert sorted(map(len, groups.values())) == [1] * 40 + [40]


def test_forest_joins_what_links_join():
    """A row between two crowds joins them, though each crowd has a centre of its own; the links are the most alike ones."""
    rng = np.random.default_rng(8)
    for n in (2, 3, 40, 150):
        centres = rng.integers(1, 256, (3, near.PLACES), np.uint8)
        rows = centres[rng.integers(0, 3, n)].copy()
        for row in rows:
            at = rng.choice(near.PLACES, rng.integers(0, 120), replace=False)
            row[at] = rng.integers(1, 256, len(at))
        for i in range(0, n - 1, 7):  # half of one, half of another
            rows[i] = np.where(np.arange(near.PLACES) < 128, centres[0], centres[1])
        how = near.alike(rows, rows)
        for least in (0.4, 0.6, 0.8):
            a, b, h = near.forest(rows, least)
            assert np.allclose(h, how[a, b]) and (h >= least).all()
            for bound in (least, least + 0.1):
                assert parts(n, a[h >= bound], b[h >= bound]) == parts(n, *np.nonzero(how >= bound))
            assert len(a) == n - len(parts(n, a, b))


def parts(n, a, b):
    root = list(range(n))
    for i, j in zip(a, b, strict=True):
        root = [root[i] if x == root[j] else x for x in root]
    return {frozenset(k for k in range(n) if root[k] == r) for r in root}


@pytest.mark.parametrize("block", [9, 1536])
def test_all_links_between_crowds(spark, block):
    """Crowds whose members are near the bound to each other: every pair that is alike enough counts, not only the likeliest by its sketch."""
    rng = random.Random(5)
    rows, sets = [], []
    for g in range(25):
        base = [f"g{g}_{i}" for i in range(120)]
        for c in range(8):
            copy = list(base)
            for at in rng.sample(range(120), rng.choice([1, 2, 3])):
                copy[at] = f"x{g}_{c}_{at}"
            rows.append((g * 10 + c, " ".join(copy)))
    ids = [i for i, _ in rows]
    least = {i: i for i in ids}
    for i, x in rows:
        for k, y in rows:
            if k < i and k // 10 == i // 10 and similarity(x, y) >= 0.8:
                old, new = max(least[i], least[k]), min(least[i], least[k])
                least = {v: new if r == old else r for v, r in least.items()}
    assert 30 < len(set(least.values())) < 150
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marked, edges = near.similar(docs, share=1, common=2, block=block)
    root = {r.v: r.root for r in near.components(edges).collect()}
    for r in marked.collect():
        sets.append((root.get(r.set, r.set), r.doc_id))
    groups = {frozenset(d for s, d in sets if s == r) for r, _ in sets}
    assert groups == {frozenset(i for i in ids if least[i] == r) for r in set(least.values())}


def test_few_edges_are_joined_without_shuffle_files_for_every_partition(spark):
    """The same components either way; few edges end in few partitions, however many a shuffle has."""
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (9, 9)], "a long, b long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        few, many = near.components(edges), near.components(edges, few=0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == want
    assert few.select("v").rdd.getNumPartitions() < many.select("v").rdd.getNumPartitions()
