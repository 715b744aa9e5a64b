"""Relative indicators, RSI divergence and overheat flags, over the rows that survive step 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import DATE, flag, ratio, require_columns, rolling_mean, rolling_std, rows


def add_relative_indicators(df: DataFrame, zscore_window: int = 60) -> DataFrame:
    require_columns(df, ["dev_ma25", "dev_ma75"], "step 1")
    out = df.withColumns({f"{c}_zscore": ratio(F.col(c) - rolling_mean(c, zscore_window), rolling_std(c, zscore_window)) for c in ("dev_ma25", "dev_ma75")})
    z = F.col("dev_ma25_zscore")
    return out.withColumns({"oversold_flag": flag(z <= -2), "overbought_flag": flag(z >= 2)})


def detect_rsi_bullish_divergence(df: DataFrame, lookback: int = 20, price_col: str = "close", rsi_col: str = "rsi14") -> DataFrame:
    """Flag and strength: the price is at or under the lowest of the previous `lookback` rows (the earliest, on ties), yet
    the RSI is above that row's. Rows without a full look-back are 0."""
    require_columns(df, [price_col, rsi_col], "step 1")
    frame = rows().rowsBetween(-lookback, -1)
    low = F.min(F.struct(F.col(price_col).alias("price"), F.col(DATE).alias("at"), F.col(rsi_col).alias("rsi"))).over(frame)
    out = df.withColumn("__low", F.when(F.count(price_col).over(frame) == lookback, low))
    hit = F.coalesce((F.col(price_col) <= F.col("__low.price")) & (F.col(rsi_col) > F.col("__low.rsi")), F.lit(False))
    return out.withColumns({"rsi_bullish_divergence": hit.cast("int"), "rsi_divergence_strength": F.when(hit, F.col(rsi_col) - F.col("__low.rsi")).otherwise(0.0)}).drop("__low")


def add_overheat_features(df: DataFrame, overheat_threshold: float = 2.0) -> DataFrame:
    require_columns(df, ["close", "ma25", "atr14", "mom_accel"], "step 1")
    t, far = overheat_threshold, F.col("atr_dev_ma25")
    out = df.withColumn("atr_dev_ma25", ratio(F.col("close") - F.col("ma25"), F.col("atr14")))
    out = out.withColumns({"is_overheated": flag(F.abs(far) >= t), "is_overbought_heat": flag(far >= t), "is_oversold_heat": flag(far <= -t)})
    zero = F.lit(0.0)
    score = F.when(far.isNotNull() & F.col("mom_accel").isNotNull(), F.greatest(far, zero) * F.greatest(F.col("mom_accel"), zero))
    return out.withColumns({"pump_temporary_score": score, "is_likely_temporary_pump": flag((F.col("is_overbought_heat") == 1) & (F.col("mom_accel") > 0))})
