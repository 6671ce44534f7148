"""What several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in every operator here: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once: a lambda's argument is bound, while a projected column may be
    pasted into every place that names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def unit_hash(key: Column, salt: str = "") -> Column:
    """A number in [0, 1) that depends on ``key`` alone: the first 32 bits of an MD5 (the same in other SQL engines)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def free(columns: list[str], *names: str) -> list[str]:
    """Names like ``names`` that no column has, in whatever case."""
    taken = {c.lower() for c in columns}
    return [next(n for k in range(len(taken) + 1) if (n := name + "_" * k).lower() not in taken) for name in names]


def tidied(run: Callable) -> Callable:
    """``run``, a function of a task's batches, after which the worker gives back what memory its allocators hold free: workers
    live on, and the next task may be of another stage."""

    def inner(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow

        try:
            yield from run(batches)
        finally:
            pyarrow.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim is not None:
                trim(0)

    return inner
