"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.storage import discard, materialize, shared_dir  # noqa: F401

T = TypeVar("T")

#: The ten ASCII blanks' trim set: U+0020 and U+0009 to U+000D.
ASCII_BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores behind them as it takes for ``df`` to have no such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_kept: dict[tuple, object] = {}


def worker_keeps(make: Callable[..., T], *args) -> T:
    """What a Python worker keeps from task to task: one object, the last operator's; another operator's goes first."""
    key = (make, *args)
    if key not in _kept:
        release()
        _kept[key] = make(*args)
    return _kept[key]


def release() -> None:
    """Drop what the process keeps, and give freed memory back."""
    _kept.clear()
    trim()


def trim() -> None:
    """Give freed memory back: workers are reused by later stages, and idle ones stay."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A task's function that begins without what other operators kept in its worker, and leaves nothing behind."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        trim()

    return inner


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that few rows at a time become Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is.

    ``lower`` has a byte-wise fast path, which is exact for pure ASCII.
    """
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast where the counted ``rows`` stay within ``limit``; else leave a shuffle join."""
    return F.broadcast(df) if rows <= limit else df
