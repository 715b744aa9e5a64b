"""Sliding minima, first touches of price levels, and as-of joins for long histories and long windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import DATE, SYMBOL, rows
from barloom.functions.ranges import BUCKET, slice_of, spread


def sliding_min(df: DataFrame, value: Column, n: int, out: str, order: str = DATE) -> DataFrame:
    """df with the least value of each row and the n - 1 rows before it; null unless there are n rows. Nulls are passed over.

    A struct whose first field is a price carries its other fields along: the row of the least price, the earliest on
    ties if a date comes second. Each symbol is cut into blocks of n rows; a window is the end of one block and the
    beginning of the next, so its minimum is that of a suffix and a prefix, and a row costs the same for any n.
    """
    place = df.withColumns({"__v": value, "__i": F.row_number().over(rows(order)) - 1})
    place = place.withColumn("__block", F.floor(F.col("__i") / n))
    block = Window.partitionBy(SYMBOL, "__block")
    prefix = F.min("__v").over(block.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    suffix = F.min("__v").over(block.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    both = place.withColumns({"__prefix": prefix, "__suffix": suffix})
    least = F.least("__prefix", F.lag("__suffix", n - 1).over(rows(order))) if n > 1 else F.col("__prefix")
    return both.withColumn(out, F.when(F.col("__i") >= n - 1, least)).drop("__v", "__i", "__block", "__prefix", "__suffix")


def prior_low(df: DataFrame, lookback: int, out: str, price_col: str = "close", carried: str = "rsi14") -> DataFrame:
    """df with (price, at, rsi) of the lowest price in the `lookback` rows before each row, the earliest on ties; null without
    as many prices before it."""
    low = F.when(F.col(price_col).isNotNull(), F.struct(F.col(price_col).alias("price"), F.col(DATE).alias("at"), F.col(carried).alias("rsi")))
    found = sliding_min(df, low, lookback, "__least")
    prices = F.count(price_col).over(rows().rowsBetween(-lookback, -1))
    return found.withColumn(out, F.when(prices == lookback, F.lag("__least").over(rows()))).drop("__least")


def climb(table: list[np.ndarray], level: np.ndarray, most: int, sign: float) -> np.ndarray:
    """For each row the offset, 1 to `most`, of the first later row whose value reaches the level; 0 if none does.

    table[k][i] is the extreme (greatest of sign * value) of the 2**k rows after i. The rows without a touch are passed in
    powers of two, the longest first.
    """
    n = len(level)
    at, passed = np.arange(n), np.zeros(n, np.int64)
    for k in range(len(table) - 1, -1, -1):
        can = (passed + (1 << k) <= most) & (at + (1 << k) < n)
        best = np.full(n, np.inf)
        best[can] = table[k][at[can]]
        step = can & ~(best >= sign * level)  # a missing level is not reached
        at, passed = at + (step << k), passed + (step << k)
    touched = (passed < most) & (at + 1 < n) & (table[0][np.minimum(at, n - 1)] >= sign * level)
    return np.where(touched, passed + 1, 0)


def doubling(values: np.ndarray, most: int) -> list[np.ndarray]:
    """[k][i]: the greatest of values[i + 1 : i + 1 + 2**k], shorter at the end; k while 2**k <= most."""
    out = [np.append(values[1:], -np.inf)]
    while (2 << (len(out) - 1)) <= most:
        last, step = out[-1], 1 << (len(out) - 1)
        out.append(np.maximum(last, np.append(last[step:], np.full(min(step, len(last)), -np.inf))[: len(last)]))
    return out


def first_touches(df: DataFrame, horizon: int, upper: Column, lower: Column, high_col: str = "high", low_col: str = "low", price_col: str = "close", size: int = BUCKET) -> DataFrame:
    """df with __tp and __sl, offsets of the first of the next `horizon` rows whose high reaches the upper level and whose low
    reaches the lower one (0: none), __last, the price `horizon` rows on (null if there are fewer), and __low, the least
    low of those rows.

    Rows go by buckets of a symbol with the next `horizon` rows. Within a bucket, tables of the extremes of the next 1, 2,
    4, ... rows are made by doubling, and each row descends them: log2(horizon) steps a row and no list of rows ahead.
    A missing high or low reaches no level.
    """
    size = max(size, 4 * horizon)
    small = df.select(SYMBOL, DATE, F.col(high_col).cast("double").alias("high"), F.col(low_col).cast("double").alias("low"), F.col(price_col).cast("double").alias("price"), upper.cast("double").alias("up"), lower.cast("double").alias("down"))
    cut = spread(small, after=horizon, size=size)
    ready = cut.select(F.col(f"{SYMBOL}.name").alias(SYMBOL), F.col(f"{SYMBOL}.bucket").alias("__bucket"), DATE, "high", "low", "price", "up", "down", "__own")

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(DATE, kind="stable")
        high = x["high"].fillna(-np.inf).to_numpy(float)
        low = -x["low"].fillna(np.inf).to_numpy(float)
        price, n = x["price"].to_numpy(float), len(x)
        highs, lows = doubling(high, horizon), doubling(low, horizon)
        at = np.arange(n) + horizon
        last = np.where(at < n, price[np.minimum(at, n - 1)], np.nan)
        # the least low of the next `horizon` rows: two overlapping powers of two
        k = len(lows) - 1
        second = np.minimum(np.arange(n) + horizon - (1 << k), n - 1)
        least = -np.maximum(lows[k], lows[k][second])
        with np.errstate(invalid="ignore"):
            out = pd.DataFrame(
                {SYMBOL: x[SYMBOL].to_numpy(), DATE: x[DATE].to_numpy(), "__tp": climb(highs, x["up"].to_numpy(float), horizon, 1.0), "__sl": climb(lows, x["down"].to_numpy(float), horizon, -1.0), "__last": last, "__low": least, "__ahead": np.minimum(horizon, n - 1 - np.arange(n))}
            )
        return out[x["__own"].to_numpy(bool)]

    schema = T.StructType([*small.select(SYMBOL, DATE).schema.fields, *[T.StructField(c, t) for c, t in (("__tp", T.LongType()), ("__sl", T.LongType()), ("__last", T.DoubleType()), ("__low", T.DoubleType()), ("__ahead", T.LongType()))]])
    found = ready.groupBy(SYMBOL, "__bucket").applyInPandas(run, schema)
    tidy = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(F.col(c))
    return df.join(found.withColumns({"__last": tidy("__last"), "__low": tidy("__low")}), [SYMBOL, DATE])


def asof_by_buckets(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, columns: list[str], days: int = 256) -> DataFrame:
    """left with `columns` of the latest right row of the same `by` and right_on <= left_on; null without one.

    Both sides are cut into ranges of `days` days, which are joined apart from each other, so that one long key is no
    longer one task. What a range has to know of the ones before it is their last right row: one row a range, carried
    forward over the ranges. The right row is carried as a whole: its nulls stay nulls.
    """
    shape = right.select(F.struct(*columns)).schema[0].dataType
    mine = left.select(F.col(by), F.col(left_on).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(shape).alias("__right"))
    theirs = right.select(F.col(by), F.col(right_on).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__left"), F.struct(*columns).alias("__right"))
    both = mine.unionByName(theirs).withColumn("__range", slice_of("__at", days))
    ends = both.groupBy(by, "__range").agg(F.max_by(F.col("__right"), F.when(F.col("__side") == 0, F.col("__at"))).alias("__end"))
    before = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(by, "__range", F.last("__end", ignorenulls=True).over(before).alias("__before"))
    inside = Window.partitionBy(by, "__range").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__right", ignorenulls=True).over(inside)).where("__side = 1")
    joined = found.join(carried, [by, "__range"]).withColumn("__found", F.coalesce("__found", "__before"))
    return joined.select("__left.*", *[F.col(f"__found.{c}").alias(c) for c in columns])
