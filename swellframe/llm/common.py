"""Helpers shared by the training-data operators: hashes and bounded broadcasts, with the library's tables."""

from __future__ import annotations

import ctypes
import zlib
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swellframe.tables import cut, discard, scratch, shared_dir, table

__all__ = ["GOLD", "bounded_ids", "crc_of", "crc_text", "cut", "discard", "kept_in_worker", "lean", "let_go", "mix", "same_columns", "scratch", "shared_dir", "table"]

GOLD = np.uint64(0x9E3779B97F4A7C15)


def bounded_ids(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A one-column table of distinct long keys, marked for broadcast if it has at most `most` rows (8 MB a million);
    beyond that it is joined by a shuffle."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


_kept: list = []


def kept_in_worker(clear) -> None:
    """Registers how to empty what a Python worker keeps from task to task."""
    _kept.append(clear)


#: Hands freed memory back to the system, where the C library can.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def let_go() -> None:
    """Empties it: for tasks of another kind, which may need the memory."""
    for clear in _kept:
        clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run):
    """A task function that lets go before it starts and, as its worker may then idle beside others, when it has ended."""

    @wraps(run)
    def wrapped(batches):
        let_go()
        yield from run(batches)
        let_go()

    return wrapped


def crc_text(col) -> object:
    """crc32 of an id written as text."""
    return F.crc32(col.cast("string").cast("binary"))


def crc_of(value) -> int:
    return zlib.crc32(str(value).encode())


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def same_columns(docs: DataFrame, run) -> DataFrame:
    """docs.mapInArrow(run) for a run that keeps the columns, whatever their names."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
