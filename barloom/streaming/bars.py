"""Daily bars of a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import DATE, SYMBOL


def daily_bars_stream(ticks: DataFrame, delay: str = "1 day") -> DataFrame:
    """Bars of ticks(symbol, ts timestamp, price, qty, key), each emitted once its day and the delay have passed.

    The same first, highest, lowest, last and sum as sources.bars.daily_bars; ticks later than the delay are left out.
    The state is one row for each symbol and open day.
    """
    day = F.window("ts", "1 day")
    bars = ticks.withWatermark("ts", delay).groupBy(SYMBOL, day).agg(
        F.min_by("price", "key").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "key").alias("close"), F.sum("qty").alias("volume")
    )
    return bars.select(SYMBOL, F.to_date("window.start").alias(DATE), "open", "high", "low", "close", "volume")
