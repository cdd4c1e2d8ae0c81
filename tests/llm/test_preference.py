import random

import pytest

from trackloom.llm import preference as p
from trackloom.llm.shared import fold


def text(rng, good):
    words = [rng.choice("the of and house garden runs small tree was by".split()) for _ in range(rng.randint(5, 200))]
    if not good:
        words = [w.upper() + "!!" if rng.random() < 0.7 else w + " |" for w in words]
    return " ".join(words) + "."


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, i % 5 > 0), int(i % 5 > 0)) for i in range(800)]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(9000, None, "en"), (9001, "", "en"), (None, "a b", "en"), (3, rows[3][1], "en")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2] + [(0, 1, 0), (0, 0, 0), (2, None, 0), (4, 7, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: q for i, _, q in rows}


def test_held_out(world):
    docs, labels, truth = world
    rows = p.query(docs, labels).collect()
    assert len(rows) == 804
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    unseen = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(unseen) > 100 and sum(r.predicted == truth[r.doc_id] for r in unseen) >= 0.99 * len(unseen)


def test_accepted_agrees(world):
    docs, labels, truth = world
    got = p.accepted(docs, labels)
    assert got.columns == docs.columns
    predicted = sorted(r.doc_id or -1 for r in p.query(docs, labels).collect() if r.predicted)
    assert sorted(r.doc_id or -1 for r in got.collect()) == predicted


def test_labels_of_held_out_rows_are_not_used(spark, world):
    docs, labels, _ = world
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(fold("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda x: [r.score for r in sorted(p.query(docs, x).collect(), key=lambda r: (r.doc_id or -1, r.score))]
    assert score(labels) == pytest.approx(score(turned))


def test_nothing_to_learn(spark, world):
    docs, labels, _ = world
    assert {r.predicted for r in p.query(docs, labels.limit(0)).collect()} == {1}
    assert p.query(docs.limit(0), labels).count() == 0
    assert p.accepted(docs, labels.limit(0)).count() == docs.count()


def test_against_a_plain_fit(spark):
    """Newton's method on the same pairs, labels with noise; the threshold by trying every level."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = []
    for i in range(300):
        good = rng.random() < 0.7
        rows.append((i, text(rng, good ^ (rng.random() < 0.15)), int(good)))
    examples = p.described(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).join(spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, label int"), "doc_id")
    model = p.fit(examples)
    taken = examples.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").collect()
    bad, good = ([np.array(r.x) for r in taken if r.label == k] for k in (0, 1))
    large, small, sign = (good, bad, 1) if len(good) >= len(bad) else (bad, good, -1)
    d = np.array([sign * (x - small[(i * 8 + k) % len(small)]) for i, x in enumerate(large) for k in range(min(8, len(small)))])
    d = np.concatenate([d, -d])
    y = np.repeat([1.0, 0.0], len(d) // 2)
    penalty = 1e-4 * d.var(axis=0, ddof=1)
    used = penalty > 0
    w = np.zeros(d.shape[1])
    for _ in range(200):
        q = 1 / (1 + np.exp(-d @ w))
        slope = d.T @ (q - y) / len(d) + penalty * w
        curve = (d * (q * (1 - q))[:, None]).T @ d / len(d) + np.diag(penalty + 1e-12)
        w[used] -= np.linalg.solve(curve[np.ix_(used, used)], slope[used])
    x = np.array([r.x for r in taken])
    label = np.array([r.label for r in taken])
    ours, plain = x @ np.array(model.weights), x @ w
    assert np.corrcoef(ours, plain)[0, 1] > 0.999
    pairs = lambda s: np.mean(s[label == 1][:, None] > s[label == 0][None, :])
    assert abs(pairs(ours) - pairs(plain)) < 0.01 and pairs(ours) > 0.75
    # no level parts the taken documents better than the model's threshold
    wrong = lambda cut: ((ours < cut) & (label == 1)).sum() + ((ours >= cut) & (label == 0)).sum()
    share = (label == 0).mean()
    assert wrong(model.threshold) <= min(wrong(np.quantile(ours, min(0.999, m * share))) for m in p.LEVELS)
    column = [r.s for r in spark.createDataFrame([(r.x,) for r in taken], "x array<double>").select(model.probability().alias("s")).collect()]
    assert column == pytest.approx([model.of(r.x) for r in taken], abs=1e-12)


def test_repeated_ids_are_learnt_alike(spark, world):
    """Of different texts of one doc_id always the same is learnt from, whatever the order of rows."""
    docs, labels, _ = world
    more = docs.unionByName(docs.where("doc_id % 10 = 1").selectExpr("doc_id", "concat('| ', text) as text", "score"))
    first, second = (p.learnt(p.described(x), labels) for x in (more.orderBy("text"), more.repartition(7)))
    assert first.weights == pytest.approx(second.weights, rel=1e-6) and first.threshold == pytest.approx(second.threshold, rel=1e-6)


def test_all_labelled_documents_are_learnt_from(spark):
    """The second feature tells the classes apart only beyond the 20,000 documents of least hash of either class, and the threshold lies where all of them part."""
    from pyspark.sql import functions as F
    from pyspark.sql import Window

    rows = spark.range(0, 50_000, 1, 4).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    late = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")) > 20_000
    told = F.when(late, F.col("label").cast("double")).otherwise(0.0)
    examples = rows.select("doc_id", "label", F.array(F.rand(1) + 0.1 * F.col("label"), told, F.lit(1.0)).alias("x"))
    model = p.fit(examples)
    assert model.weights[1] > 1 and model.weights[0] > 0 and model.weights[2] == 0


def test_pairs_of_groups(spark, monkeypatch):
    """Each document of the larger class meets 8 of the smaller, whatever the sizes of blocks and classes; no pair is lost or doubled."""
    import numpy as np

    for block, rounds, n_large, n_small in ((4, 2, 50, 13), (4, 1, 40, 40), (16, 2, 60, 3), (4096, 16, 30, 9), (5, 3, 1, 1)):
        monkeypatch.setattr(p, "BLOCK", block)
        monkeypatch.setattr(p, "ROUNDS", rounds)
        large = spark.range(n_large).selectExpr("id as i", "array(id * 1000D, 0D) as x")
        small = spark.range(n_small).selectExpr("id as i", "array(-id * 1D, 0D) as x")
        batches = p.dealt(large, small, n_large, n_small, 8).coalesce(1).toArrow().to_batches(max_chunksize=7)
        got = sorted(np.concatenate([d[:, 0] for d in p.differences(batches, n_small, 8)]).tolist())
        assert got == sorted(float(i * 1000 + (i * 8 + k) % n_small) for i in range(n_large) for k in range(min(8, n_small)))


def test_numbered(spark):
    rows, n = p.numbered(spark.range(1000, 0, -1, 5).withColumnRenamed("id", "s"), "s")
    assert n == 1000 and sorted((r.s, r.i) for r in rows.collect()) == [(s, s - 1) for s in range(1, 1001)]
    assert p.numbered(spark.range(0).withColumnRenamed("id", "s"), "s")[1] == 0
