"""Daily and weekly indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import ewm, lag, pct_change, ratio, rolling_mean, rolling_std

WEEKLY = ["weekly_ma5", "weekly_ma13", "weekly_ma5_slope", "weekly_ma13_slope", "weekly_trend"]


def add_true_range(df: DataFrame) -> DataFrame:
    """true_range: the largest of the day's range and the distances of high and low from the previous close, if any."""
    before = lag("close")
    return df.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def add_gain_loss(df: DataFrame) -> DataFrame:
    """gain and loss of the close; null on a symbol's first row."""
    move = F.col("close") - lag("close")
    return df.withColumns({"gain": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))), "loss": F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0)))})


def add_daily_features(df: DataFrame, span: int = 14) -> DataFrame:
    """ATR, Bollinger %b, RSI, moving averages and deviations, range against ATR, momentum."""
    mean, std = rolling_mean("close", 20), rolling_std("close", 20)
    base = add_gain_loss(add_true_range(df)).withColumns({"__m": mean, "__s": std, "__g": ewm("gain", span), "__l": ewm("loss", span), "atr14": ewm("true_range", span), "ma25": rolling_mean("close", 25), "ma75": rolling_mean("close", 75), "mom5": pct_change("close", 5), "mom20": pct_change("close", 20)})
    low, high = F.col("__m") - 2 * F.col("__s"), F.col("__m") + 2 * F.col("__s")
    close = F.col("close")
    return base.withColumns(
        {
            "bb_pct_b": ratio(close - low, high - low),
            "rsi14": 100 - 100 / (1 + ratio(F.col("__g"), F.col("__l"))),
            "dev_ma25": ratio(close - F.col("ma25"), F.col("ma25")),
            "dev_ma75": ratio(close - F.col("ma75"), F.col("ma75")),
            "range_vs_atr": ratio(F.col("high") - F.col("low"), F.col("atr14")),
            "mom_accel": F.col("mom5") - F.col("mom20"),
        }
    ).drop("true_range", "gain", "loss", "__m", "__s", "__g", "__l")


def add_wick_features(df: DataFrame) -> DataFrame:
    """Wicks against the day's range and body, null where these are 0, and the candle's direction."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    upper, lower, span, body = F.col("high") - top, bottom - F.col("low"), F.col("high") - F.col("low"), top - bottom
    return df.withColumns(
        {
            "upper_wick_ratio": ratio(upper, span),
            "lower_wick_ratio": ratio(lower, span),
            "upper_wick_body_ratio": ratio(upper, body),
            "lower_wick_body_ratio": ratio(lower, body),
            "candle_dir": F.when(F.col("close") >= F.col("open"), 1).otherwise(-1),
        }
    )


def add_weekly_features(weekly: DataFrame) -> DataFrame:
    """Means of 5 and 13 weekly closes, their slopes, and the trend: 1 if the short one is higher, else -1, also while unknown."""
    means = weekly.withColumns({"weekly_ma5": rolling_mean("close", 5, "week_end"), "weekly_ma13": rolling_mean("close", 13, "week_end")})
    return means.withColumns(
        {
            "weekly_ma5_slope": pct_change("weekly_ma5", 1, "week_end"),
            "weekly_ma13_slope": pct_change("weekly_ma13", 1, "week_end"),
            "weekly_trend": F.when(F.col("weekly_ma5") > F.col("weekly_ma13"), 1).otherwise(-1),
        }
    )
