"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from casetally.session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the provided tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives freed memory back to the system at the end of its task.

    Python workers are kept for later tasks; without this they keep what the largest task of any stage held.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def tidy_group(run: Callable[..., pa.Table], pair: bool = False) -> Callable[..., pa.Table]:
    """A function for applyInArrow, of one table or of a pair, that gives freed memory back to the system after each group."""

    def one(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            release()

    return two if pair else one


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """The same rows, kept as Parquet in the shared folder: computed once, and safe from lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
