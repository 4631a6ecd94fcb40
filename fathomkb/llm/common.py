"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomkb.sources.shared import remove, scratch
from fathomkb.sources.shared import written as cut
from fathomkb.sources.spread import hot_keys, join_spread, some_hot

__all__ = ["BROADCAST_ROWS", "MASK32", "Scratch", "broadcast_if_small", "cut", "hot_keys", "join_spread", "mix64", "packed", "scratch", "slices", "small_batches", "some_hot"]

MASK32 = np.uint64(0xFFFFFFFF)
#: Rows that a broadcast table may have.
BROADCAST_ROWS = 200_000


@contextmanager
def small_batches(spark: SparkSession, size: int = 1 << 22, rows: int = 1_000) -> Iterator[None]:
    """Of what runs inside, Python gets at most about `size` bytes and `rows` rows in a batch, of which executors hold several copies outside the heap."""
    new = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    old = {k: spark.conf.get(k) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


class Scratch:
    """Written tables that are only steps: all are deleted at the end of the with block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def cut(self, df: DataFrame, name: str = "cut") -> DataFrame:
        self.paths.append(path := scratch(self.spark, name))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_: object) -> None:
        remove(self.spark, *self.paths)


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """df's columns as one struct `row` beside columns of our own, so that no name of df can clash; `row.*` unpacks it."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(c.alias(name) for name, c in columns.items()))


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df (written, of narrow rows), to be broadcast if it has at most `most` rows; Spark's choice of a join otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("shuffle_merge")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (shift, multiply, shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose lengths sum to at most `most`; a longer single item stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
