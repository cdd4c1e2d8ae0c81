"""What several corpus operators need: reading tables, shared storage and Arrow batches of texts as bytes."""

from __future__ import annotations

import ctypes
import gc
import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: the white space that ends a word, as a class for Java regular expressions.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from wherever it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster names it. Only a session on one machine (as in tests) may do without, and has one of our own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and context.getCheckpointDir() is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or "/tmp/checkpoints")
    return named or context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: computed once, with its lineage cut.

    Spark removes the files when the frame is no longer referenced, if spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = 100_000, most_bytes: int = 64_000_000) -> DataFrame:
    """df, to be broadcast in a join if it has at most so many rows and bytes (as JSON); else as it is, so that the join shuffles. For kept frames."""
    if df.limit(most + 1).count() > most:
        return df
    size = df.select(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()[0]
    return F.broadcast(df) if (size or 0) <= most_bytes else df


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of new_folder wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts_as_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of each text of an Arrow batch; nulls are empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def texts_as_strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Each text of an Arrow batch; nulls are empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut (without copying) into parts of at most so many bytes or one row, so that Python objects stay few at a time."""
    for batch in batches:
        if batch.nbytes <= most_bytes:
            if batch.num_rows:
                yield batch
            continue
        lengths = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
                lengths += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths + 16) // most_bytes
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for low, high in itertools.pairwise(edges):
            if high > low:
                yield batch.slice(low, high - low)


_OF_WORKER: list = []


def of_worker(make: Callable) -> Callable:
    """make, whose results a worker keeps for its next tasks, until one begins whose releasing() does not name it."""
    _OF_WORKER.append(kept_results := cache(make))
    return kept_results


def drop_all_but(name: str | None) -> None:
    """Forget what this worker keeps for other tasks than those that use the function of that name."""
    for results in _OF_WORKER:
        if results.__name__ != name and results.cache_info().currsize:
            results.cache_clear()
            gc.collect()


def give_back() -> None:
    """Give the memory that Arrow and the C library (glibc) hold free back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, in tasks that leave no memory behind: workers outlive tasks and stages, and would keep it. keeps: the of_worker() function that run uses."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_all_but(keeps)
        yield from run(batches)
        give_back()

    return released


def in_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2_000_000):
            yield function(batch)

    return df.mapInArrow(releasing(run), schema)


def fold(doc_id: Column | str) -> Column:
    """crc32 of the doc_id's decimal text modulo 5; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % 5


def key_of() -> Column:
    """Tells rows of different doc_id or text apart, also where doc_id is null."""
    return F.xxhash64("doc_id", "text")
