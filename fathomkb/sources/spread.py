"""Numbering, sums and joins that stay even when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

#: Rows of one key that one task may get.
BLOCK = 10_000


def running(rows: DataFrame, by: list[str], order: list[str], value: Column | None = None, cut: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """rows with `before`, the sum of value (1 where none is given) over earlier rows of the same `by`, and `total`, that over all of them.

    Rows are dealt by ranges of (by, order), summed within each range and moved on by the sums of the ranges before it, so
    that one `by` may hold most of the table. The ranges are a table that cut writes, as they must not change; rows that
    are equal in (by, order) fall into one range. Without `by` the whole table is one sequence. Columns of order are sorted
    ascending, nulls first.
    """
    value = F.lit(1) if value is None else value
    dealt = rows.withColumn("running_v_", value.cast("long")).repartitionByRange(*map(F.col, [*by, *order]))
    dealt = cut(dealt.withColumn("running_range_", F.spark_partition_id()), "ranges")
    keys = [F.col(c) for c in by] or [F.lit(0)]
    sums = dealt.groupBy(*by, "running_range_").agg(F.sum("running_v_").alias("running_s_"))
    earlier = Window.partitionBy(*keys).orderBy("running_range_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    sums = sums.select(*(F.col(c).alias(f"running_by_{i}") for i, c in enumerate(by)), F.col("running_range_").alias("running_r_"), F.coalesce(F.sum("running_s_").over(earlier), F.lit(0)).alias("running_base_"), F.sum("running_s_").over(Window.partitionBy(*keys)).alias("total"))
    own = F.sum("running_v_").over(Window.partitionBy(*by, "running_range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("running_v_")
    same = F.col("running_range_") == F.col("running_r_")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"running_by_{i}"))
    return dealt.withColumn("running_own_", own).join(sums, same).select(*rows.columns, (F.col("running_own_") + F.col("running_base_")).alias("before"), "total")


def hot_keys(counts: DataFrame, key: str, count: str, block: int = BLOCK, most: int = 100_000) -> DataFrame:
    """key, pieces: the `most` largest of the keys with more than `block` rows, and into how many parts each is split.

    At most `most` rows, so it may be broadcast: a key beyond them has fewer than a `most`-th part of all rows.
    """
    large = counts.filter(F.col(count) > block).orderBy(F.desc(count), key).limit(most)
    return large.select(key, F.ceil(F.col(count) / block).cast("int").alias("pieces"))


def some_hot(counts: DataFrame, key: str, count: str, cut: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame | None:
    """hot_keys as a table that cut writes, or None where no key is hot, so that join_spread is a plain join without broadcasts."""
    hot = cut(hot_keys(counts, key, count), "hot")
    return None if hot.isEmpty() else hot


def join_spread(left: DataFrame, right: DataFrame, key: str, by: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left and right joined on key; left's rows of a hot key are dealt over parts by the hash of column `by`, right's copied to each part. None: no key is hot."""
    if hot is None:
        return left.join(right, key, how)
    few = F.broadcast(hot.select(F.col(key).alias("_hot"), "pieces"))
    n = F.coalesce("pieces", F.lit(1))
    a = left.join(few, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.pmod(F.xxhash64(by), n).cast("int")).drop("_hot", "pieces")
    b = right.join(few, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1))).drop("_hot", "pieces")
    return a.join(b, [key, "_part"], how).drop("_part")


def range_join(points: DataFrame, spans: DataFrame, scope: str, at: str, start: str, end: str, width: int = 256) -> DataFrame:
    """points with the spans of the same scope that hold them (start <= at <= end), by bins of `width`: an equi-join, whatever the spans' lengths.

    A span is a row for every bin that it reaches, so a scope may be one huge file. Columns of the two sides, but for scope, must differ.
    """
    bins = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    wide = spans.filter(F.col(start) <= F.col(end)).withColumn("bin_", F.explode(bins))
    return points.withColumn("bin_", F.floor(F.col(at) / width)).join(wide, [scope, "bin_"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("bin_")


def first_k(rows: DataFrame, by: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each `by` in order, with their rank from 1.

    Spark keeps at most k rows a key in every task before it shuffles them, and k again after, so no key is gathered whole.
    """
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)
