"""Column helpers over windows of one symbol's rows in date order; nulls stand for missing values, NaN is never made."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYMBOL, DATE = "symbol", "dt"


def rows(order: str = DATE):
    return Window.partitionBy(SYMBOL).orderBy(order)


def require_columns(df: DataFrame, names: list[str], step: str = "an earlier step") -> None:
    """Raises KeyError, at plan time, if columns are missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; run {step} first")


def present(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows in which all these columns have a value. One condition a column, because the optimiser tries every mixture of
    columns and their definitions in a condition over many, as dropna makes it."""
    return df.where(reduce(and_, [F.col(n).isNotNull() for n in names]))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def flag(condition: Column) -> Column:
    """1 or 0; a null condition is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def lag(col: str, k: int = 1, order: str = DATE) -> Column:
    return F.lag(col, k).over(rows(order))


def pct_change(col: str, k: int, order: str = DATE) -> Column:
    return ratio(F.col(col), lag(col, k, order)) - 1


def rolling(aggregate, col: str, n: int, last: int = 0, order: str = DATE) -> Column:
    """aggregate over the n rows that end `last` rows from the current one; null unless all n have a value."""
    frame = rows(order).rowsBetween(last - n + 1, last)
    return F.when(F.count(col).over(frame) == n, aggregate(col).over(frame))


def rolling_mean(col: str, n: int, order: str = DATE) -> Column:
    return rolling(F.avg, col, n, order=order)


def rolling_std(col: str, n: int) -> Column:
    return rolling(F.stddev_samp, col, n)


def ewm_length(alpha: float) -> int:
    """Rows after which what lies before weighs less than double precision shows."""
    return math.ceil(math.log(1e-18) / math.log(1 - alpha))


def ewm(col: str, span: int = 14) -> Column:
    """y0 = x0, y = (1 - a) y' + a x with a = 2 / (span + 1), from the first value on; null before it.

    A bounded frame of the last values stands for the whole recursion; its oldest value is the seed.
    """
    a = 2.0 / (span + 1)
    values = F.collect_list(col).over(rows().rowsBetween(-ewm_length(a), 0))
    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(values, F.lit(0)), lambda acc, x: acc * (1 - a) + x * a)


def ewm_blocks(df: DataFrame, col: str, out: str, span: int = 14, size: int = 256) -> DataFrame:
    """The same by blocks of `size` values, for long spans and very long histories: sums within blocks run in parallel
    for one symbol, and a block takes over the ends of the ones before it. Null values keep the last average."""
    a = 2.0 / (span + 1)
    decay = math.log(1 - a)
    numbered = df.where(F.col(col).isNotNull()).select(SYMBOL, DATE, F.col(col).alias("__x"), (F.row_number().over(rows()) - 1).alias("__r"))
    block = numbered.withColumns({"__b": F.floor(F.col("__r") / size), "__p": F.col("__r") % size})
    inside = Window.partitionBy(SYMBOL, "__b").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.when(F.col("__r") == 0, 1.0).otherwise(a)
    own = F.exp(F.col("__p") * decay) * F.sum(weight * F.col("__x") * F.exp(-F.col("__p") * decay)).over(inside)
    block = block.withColumn("__own", own)
    ends = block.groupBy(SYMBOL, "__b").agg(F.max_by("__own", "__p").alias("__end"))
    reach = max(1, math.ceil(ewm_length(a) / size))
    before = Window.partitionBy(SYMBOL).orderBy("__b")
    carry = sum((F.coalesce(F.lag("__end", k).over(before), F.lit(0.0)) * math.exp((k - 1) * size * decay) for k in range(1, reach + 1)), F.lit(0.0))
    full = block.join(ends.select(SYMBOL, "__b", carry.alias("__carry")), [SYMBOL, "__b"])
    values = full.select(SYMBOL, DATE, (F.col("__own") + F.exp((F.col("__p") + 1) * decay) * F.col("__carry")).alias("__y"))
    joined = df.join(values, [SYMBOL, DATE], "left")
    return joined.withColumn(out, F.last("__y", ignorenulls=True).over(rows())).drop("__y")
