"""Column helpers shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

# Words are runs of anything but space and the five ASCII line and tab controls.
SPACES = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def shingles(word_list: Column, size: int) -> Column:
    """All runs of ``size`` words; a shorter text is one shingle, an empty one has none."""
    n = F.size(word_list)
    return (
        F.when(n == 0, F.array().cast("array<string>"))
        .when(n < size, F.array(F.concat_ws(" ", word_list)))
        .otherwise(
            F.transform(
                F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))),
                lambda i: F.concat_ws(" ", F.slice(word_list, i, size)),
            )
        )
    )


def _kept() -> dict:
    """What this worker keeps over its tasks.

    Task functions reach workers by value, with module variables of their own;
    what shall outlive a task is therefore kept on the installed pyspark module.
    """
    import pyspark

    return pyspark.__dict__.setdefault("_kept_by_voxelloom", {})


def kept_in_worker(owner: str, key: tuple, make: Callable[[], object]):
    """An object that a Python worker makes once for the tasks of one owner; a task of another one drops it (``lean``)."""
    store = _kept()
    if (owner, key) not in store:
        store[owner, key] = make()
    return store[owner, key]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed table to the shared scratch folder and read it from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(task: Callable[[Iterable], Iterator], owner: str | None = None) -> Callable[[Iterable], Iterator]:
    """A task function that drops what other tasks have kept in its worker, and gives freed memory back at its end.

    Workers live on, idle ones too, so what they hold adds up.
    """

    @wraps(task)
    def run(batches: Iterable) -> Iterator:
        store = _kept()
        for key in [k for k in store if k[0] != owner]:
            del store[key]
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def slices(batch: pa.RecordBatch, limit: int, column: str = "body") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice has few bytes of text, or is one row."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    starts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, batch.num_rows]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b > a:
            yield batch.slice(a, b - a)
