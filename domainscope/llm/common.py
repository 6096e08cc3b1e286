"""Helpers that the text operators share: table access, batch mapping, tokenizer files."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domainscope.plans.stable import shared_dir as shared_dir
from domainscope.plans.stable import stable as checkpointed  # noqa: F401

#: What counts as white space between words: space, tab, line feed, vertical tab, form feed, return.
#: ``bytes.split()`` without arguments splits on exactly these six.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as long and the text, null read as empty; every other column is left out before any work."""
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_col))


def _trim() -> Callable[[int], object]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return lambda _: None


_malloc_trim = _trim()


def give_back() -> None:
    """Returns free memory to the system, at the end of a task: an idle Python worker then holds what it keeps, and not its last peak."""
    pa.default_memory_pool().release_unused()
    _malloc_trim(0)


#: Rows and bytes of an Arrow batch at most. Buffers outside the heap grow with a batch: 10,000 texts, the default, can be any size.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, in whose session Arrow batches have been bounded; smaller bounds of its own stay."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def map_rows(df: DataFrame, make: Callable[[], Callable[[Iterable[tuple]], Iterator[tuple]]], schema: str, arrow: pa.Schema, rows: int = 1000) -> DataFrame:
    """mapInArrow over tuples. ``make`` runs once a task and returns the generator function that does the work, over all rows of the task.

    Rows come as they are asked for and results leave in batches of ``rows``, so that a task never holds more than one input batch, one output batch and what
    the work holds."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
            del batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = make()(read(batches))
        while out := list(islice(found, rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)
            del out
        give_back()

    return small_batches(df).mapInArrow(run, schema)


_kept: dict = {}


def kept(key: tuple, make: Callable[[], object]):
    """What an operator keeps in a Python worker from task to task: tables that are costly to make, and memories of results.

    A worker serves many operators, one after another; it keeps the state of the last one only, so that memory doesn't add up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Drops what ``kept`` holds in this worker, for an operator that keeps nothing itself."""
    _kept.clear()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark can write."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Up to so many short rows, under 20 MB, are broadcast after they have been counted; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """df, of so many rows, for a join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def file_bytes(path: str) -> bytes:
    """A tokenizer file, read on the driver (under 2 MB by design of such files; checked) and shipped with the tasks."""
    with open(path, "rb") as f:
        data = f.read(64_000_001)
    if len(data) > 64_000_000:
        raise ValueError(f"{path}: not a tokenizer vocabulary, over 64 MB")
    return data
