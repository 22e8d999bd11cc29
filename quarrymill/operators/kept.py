"""Tables that several parts of a plan read: kept in memory or on disk until they are released.

A DataFrame is lazy, so what it reads can only go once it has been used: call release() then."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

_held: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    # as values: Python's MEMORY_AND_DISK writes Java streams, which hold a partition's rows once more while it is written
    out = df.persist(StorageLevel.MEMORY_AND_DISK_DESER)
    _held.append(out)
    return out


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the files. Spark guesses its size from that of the input, before a file became a text, a tree
    and many rows, and would collect what it takes for small on the driver, to send it to all. Both sides are sorted and merged instead."""
    return df.hint("merge")


def release() -> None:
    """Lets go of everything that was kept."""
    while _held:
        _held.pop().unpersist()
