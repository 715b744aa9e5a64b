"""The three-level signal and its check against the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import flag, lag, require_columns, rolling

# Labels of the signal, in the order of reports (fixed values)
CAUTION, BULLISH, NEUTRAL = "警戒", "強気", "中立"
ORDER = [BULLISH, CAUTION, NEUTRAL]


def add_signal_flags(df: DataFrame, rsi_lookback: int = 5, dev_lookback: int = 5) -> DataFrame:
    """rsi_reversal_flag, deviation_shrink_flag and overheat_warning_flag."""
    require_columns(df, ["rsi14", "rsi_bullish_divergence", "dev_ma25_zscore", "is_overbought_heat"], "step 2")
    rsi, z = F.col("rsi14"), F.col("dev_ma25_zscore")
    turned = F.coalesce((rolling(F.min, "rsi14", rsi_lookback, -1) <= 35) & (rsi > lag("rsi14")), F.lit(False))
    return df.withColumns(
        {
            "rsi_reversal_flag": (turned | (F.col("rsi_bullish_divergence") == 1)).cast("int"),
            "deviation_shrink_flag": flag((z < 0) & (z > lag("dev_ma25_zscore", dev_lookback))),
            "overheat_warning_flag": flag(F.col("is_overbought_heat") == 1),
        }
    )


def generate_assist_signal(df: DataFrame, rsi_lookback: int = 5, dev_lookback: int = 5) -> DataFrame:
    """assist_signal: caution if overheated, else bullish if the RSI turned and the deviation shrinks, else neutral."""
    out = add_signal_flags(df, rsi_lookback, dev_lookback)
    bullish = (F.col("rsi_reversal_flag") == 1) & (F.col("deviation_shrink_flag") == 1)
    return out.withColumn("assist_signal", F.when(F.col("overheat_warning_flag") == 1, CAUTION).when(bullish, BULLISH).otherwise(NEUTRAL))


def evaluate_signal_quality(df: DataFrame) -> DataFrame:
    """position, assist_signal, n and, if labels are there, win_rate and mean_return; signals that occur, in fixed order."""
    require_columns(df, ["assist_signal"], "generate_assist_signal")
    extra = [F.avg("tb_label").alias("win_rate"), F.avg("tb_return").alias("mean_return")] if {"tb_label", "tb_return"} <= set(df.columns) else []
    position = F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("assist_signal")).cast("int").alias("position")
    return df.groupBy("assist_signal").agg(F.count("*").alias("n"), *extra).select(position, "*").orderBy("position")
