"""As-of join: to each left row the latest right row that is not later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, columns: list[str]) -> DataFrame:
    """left with `columns` of the latest right row of the same `by` and right_on <= left_on; null without one.

    Both sides are stacked and the right rows carried forward by one window, so there is one exchange and no join. The
    right row is carried as a whole: its nulls stay nulls and are not filled from older rows.
    """
    mine = left.select(F.col(by), F.col(left_on).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("__right"))
    theirs = right.select(F.col(by), F.col(right_on).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__left"), F.struct(*columns).alias("__right"))
    order = Window.partitionBy(by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = mine.unionByName(theirs).withColumn("__found", F.last("__right", ignorenulls=True).over(order))
    return carried.where("__side = 1").select("__left.*", *[F.col(f"__found.{c}").alias(c) for c in columns])
