import subprocess
import sys

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from trackloom.llm import pieces, shared
from trackloom.llm.shared import small


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    df = spark.range(50).select("id", F.array(F.repeat(F.lit("x"), 1_000)).alias("long text"))
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString() or "broadcast" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(small(df)) and hinted(small(df.limit(0)))
    assert not hinted(small(df, most=49)) and not hinted(small(df, most_bytes=40_000))


def test_workers_keep_what_the_next_tasks_use_only():
    model = public_tokenizers.path("piece_bpe_32k.model")
    held = pieces.vocabulary(model, "stretches")
    batch = pa.RecordBatch.from_arrays([pa.array(["a"])], ["text"])
    assert list(shared.releasing(iter, "vocabulary")([batch])) == [batch]
    assert pieces.vocabulary(model, "stretches") is held
    assert list(shared.releasing(iter)([batch])) == [batch]
    assert pieces.vocabulary.cache_info().currsize == 0


def test_workers_give_memory_back_after_a_task():
    """A process that has described documents holds little more than before: Arrow would else keep what the batches took."""
    code = """
import re
import numpy as np, pandas, pyarrow as pa
from trackloom.llm.shared import releasing
def used():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
def run(batches):
    held = [pa.array(np.arange(1 << 17) + i).cast(pa.string()) for i in batches]
    yield len(held)
start = used()
assert list(releasing(run)(iter(range(60)))) == [60]
print(used() - start)
"""
    grown = float(subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True).stdout)
    assert grown < 30
