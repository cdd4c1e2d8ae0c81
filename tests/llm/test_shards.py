import hashlib
import random
from collections import defaultdict

import pytest

from trackloom.llm import shards


def brute(rows, limit):
    """Split recursively."""
    out = {}

    def split(members, prefix):
        total = sum(len((t or "").encode()) for _, t, _ in members)
        if total <= limit or len({h for *_, h in members}) == 1:
            for i, _, _ in members:
                out[i] = (prefix, len(members), total, total <= limit)
            return
        for bit in "01":
            if part := [m for m in members if m[2][len(prefix)] == bit]:
                split(part, prefix + bit)

    if rows:
        split([(i, t, f"{int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16):060b}") for i, t in rows], "")
    return out


@pytest.mark.parametrize(("limit", "hot"), [(10**9, 1), (500, 1), (60, 1), (300, 40)])
def test_equals_splitting(spark, limit, hot):
    rng = random.Random(limit)
    rows = [(i, rng.choice([None, "", "é" * rng.randint(0, 40), "x" * rng.randint(0, 400)])) for i in range(300)] + [(999, "same text")] * hot
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, shard string")
    got = shards.assign(docs, limit).collect()
    want = brute(rows, limit)
    assert len(got) == len(rows)
    for r in got:
        assert (r.shard, r.shard_docs, r.shard_bytes, r.fits) == want[r.doc_id] and r.depth == len(r.shard)


def test_fine_cells(spark):
    """Cells of too few bits are cut again."""
    sizes = spark.range(64).selectExpr("id + 1152921504606846976 - 64 as hash", "10L as n_bytes")
    assert shards.directory(sizes, 20, 4).where("depth is null").count() == 1
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('x', 1 + cast(id = 7 as int) * 100000) as text")
    got = shards.assign(docs, 50).collect()
    assert all(r.fits or r.shard_docs == 1 for r in got) and len(got) == 2000


def test_cases(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a"), (None, None), (1, "b")], "doc_id long, text string")
    assert len(shards.assign(docs, 1).collect()) == 3
    assert shards.assign(docs.limit(0), 10).count() == 0
    plan = shards.assign(docs, 1)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    more = spark.range(50).selectExpr("id as doc_id", "repeat('y', 10) as text")
    shards.write(more, str(tmp_path / "out"), 100)
    sizes = defaultdict(int)
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        sizes[r.shard] += 10
    assert sum(sizes.values()) == 500 and max(sizes.values()) <= 100
    with pytest.raises(ValueError):
        shards.write(docs, str(tmp_path / "no"), 100)
