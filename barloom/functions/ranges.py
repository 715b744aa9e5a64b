"""Ordered work on long histories in many tasks: row numbers, running sums, buckets of rows with their neighbours.

A key's rows are cut into slices; what a slice has to know of the ones before it comes from one row a slice, so no task
reads a whole key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import DATE, SYMBOL
from barloom.sources.store import stored

SLICE_DAYS = 256  # days whose rows of one symbol are numbered by one task
BUCKET = 4096  # rows of one symbol that a task's windows run over, besides neighbours


def slice_of(order: str = DATE, days: int = SLICE_DAYS) -> Column:
    """The number of the range of days that a date lies in."""
    return F.floor(F.unix_date(order) / days)


def numbered(df: DataFrame, out: str, by: list[str], order: list[str], slice_: Column) -> DataFrame:
    """df with the row's number, from 0, among the rows of its key in this order.

    slice_ must not fall while the order rises. Rows are numbered within (key, slice) and moved on by the counts of the
    slices before. Keys are not null; df is read twice. Equal rows are numbered in any order.
    """
    cut = df.withColumn("__slice", slice_)
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*by, "__slice").agg(F.count("*").alias("__n")).select(*by, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = cut.withColumn(out, F.row_number().over(Window.partitionBy(*by, "__slice").orderBy(*order)) - 1)
    return inside.join(offsets, [*by, "__slice"]).withColumn(out, F.col(out) + F.col("__offset")).drop("__slice", "__offset")


def spread(df: DataFrame, before: int = 0, after: int = 0, size: int = BUCKET, order: str = DATE, days: int = SLICE_DAYS) -> DataFrame:
    """df by buckets of `size` successive rows of a symbol, each with the last `before` rows of what precedes it and the first
    `after` rows of what follows.

    `symbol` becomes (symbol, bucket), so that windows of a symbol's rows run by bucket; __own tells a bucket's rows from
    its neighbours'. A row stands in each bucket that needs it: 1 + (before + after) / size times on average.
    """
    rows = numbered(df, "__row", [SYMBOL], [order], slice_of(order, days))
    pos = F.col("__row")
    buckets = F.sequence(F.greatest(F.floor((pos - after) / size), F.lit(0)), F.floor((pos + before) / size))
    many = rows.withColumn("__bucket", F.explode(buckets))
    own = F.col("__bucket") == F.floor(pos / size)
    return many.withColumns({"__own": own, SYMBOL: F.struct(F.col(SYMBOL).alias("name"), F.col("__bucket").alias("bucket"))}).drop("__row", "__bucket")


def gathered(df: DataFrame) -> DataFrame:
    """What spread() made, without neighbours and with the symbols as they were."""
    return df.where("__own").withColumn(SYMBOL, F.col(f"{SYMBOL}.name")).drop("__own")


def by_buckets(df: DataFrame, compute: Callable[[DataFrame], DataFrame], before: int = 0, after: int = 0, size: int = BUCKET, order: str = DATE, days: int = SLICE_DAYS) -> DataFrame:
    """compute(df), for a compute that adds columns to a row from at most `before` rows before it and `after` rows after it."""
    return gathered(compute(spread(df, before, after, size, order, days)))


def running_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """df with, for each {column: new name}, the sum of the column over the rows of its key that come before the row.

    Two levels: df is written in ranges of (key, order), each range sums its keys, and a row adds what the ranges before its
    own have to a scan of its range. (key, order) has no repeated values, or these are in any order. There are at most
    as many range sums as ranges and keys together; keys are meant to be few (folds).
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "__part").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    offsets = totals.select(*by, "__part", *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in sums])
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    scanned = ranged.withColumns({name: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c, name in sums.items()})
    joined = scanned.join(offsets, [*by, "__part"])
    return joined.withColumns({name: F.col(name) + F.col(f"__{c}") for c, name in sums.items()}).drop("__part", *[f"__{c}" for c in sums])


ROUNDS, PRIME = 5, (1 << 31) - 1


def shuffled(number: Column, n: Column, *keys: Column) -> Column:
    """A bijection of 0 .. n - 1 that the keys choose, n from 1 to 2**60: where row `number` goes.

    A Feistel network over the pairs (number div b, number mod b), a * b >= n, whose halves are moved on in turn by a
    square of the other half and the keys modulo 2**31 - 1. What lands beyond n - 1 goes through it again; fewer than a
    of the pairs do, so a path back is at most a steps long, and for large a 64 steps fail with a chance of 2**-300.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")
    key = F.lit(0).cast("long")
    for k in keys:
        key = (key * 8191 + F.pmod(k.cast("long"), F.lit(PRIME)) + 12_345) % PRIME

    def push(half: Column, step: Column) -> Column:
        x = (half % PRIME + key + step * 1_000_003) % PRIME
        return x * x % PRIME

    def once(x: Column) -> Column:
        start = F.struct(F.call_function("div", x, b).alias("left"), (x % b).alias("right"))

        def round_(s: Column, k: Column) -> Column:
            left = (s["left"] + push(s["right"], 2 * k)) % a
            return F.struct(left.alias("left"), ((s["right"] + push(left, 2 * k + 1)) % b).alias("right"))

        end = F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(ROUNDS).cast("long")), start, round_)
        return end["left"] * b + end["right"]

    steps = F.sequence(F.lit(1), F.lit(64))
    walked = F.aggregate(steps, once(number), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("no place found")).cast("long"))
