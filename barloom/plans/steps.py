"""The five steps. Each drops rows and only then the next one's windows count rows, so the steps are not fused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from barloom.functions.columns import DATE, SYMBOL, present
from barloom.operators.asof import asof_backward
from barloom.operators.domain import add_overheat_features, add_relative_indicators, detect_rsi_bullish_divergence
from barloom.operators.indicators import WEEKLY, add_daily_features, add_weekly_features, add_wick_features
from barloom.operators.labels import BarrierSpec, apply_forward_drawdown, apply_triple_barrier
from barloom.operators.signals import generate_assist_signal
from barloom.sources.bars import OHLCV, weekly_bars

# Columns of step 1 in the reference's order (fixed values)
STEP1 = [*OHLCV, "atr14", "bb_pct_b", "rsi14", "ma25", "ma75", "dev_ma25", "dev_ma75", "range_vs_atr", "mom5", "mom20", "mom_accel", "upper_wick_ratio", "lower_wick_ratio", "upper_wick_body_ratio", "lower_wick_body_ratio", "candle_dir", *WEEKLY]

# What can be missing at the end of each step (fixed values); every other column is missing only where one of these is.
MISSING1 = [*OHLCV, "bb_pct_b", "rsi14", "dev_ma25", "dev_ma75", "range_vs_atr", "mom_accel", "upper_wick_ratio", "upper_wick_body_ratio", "weekly_ma5_slope", "weekly_ma13_slope"]
MISSING2 = ["dev_ma25_zscore", "dev_ma75_zscore", "atr_dev_ma25"]
MISSING3 = ["tb_label", "avoid_entry_flag"]

Keep = Callable[[DataFrame, list[str]], DataFrame]  # drops the rows in which one of the columns is missing


def build_step1(daily: DataFrame, weekly: DataFrame | None = None, keep: Keep = present) -> DataFrame:
    """Daily and weekly indicators, joined as-of; rows with any missing value go (warm-up, doji, no loss so far).

    weekly: stored weekly bars, dated by the last day of the week; without them they are made from the daily bars.
    """
    week = add_weekly_features(weekly if weekly is not None else weekly_bars(daily))
    features = add_wick_features(add_daily_features(daily))
    return keep(asof_backward(features, week, SYMBOL, DATE, "week_end", WEEKLY).select(SYMBOL, DATE, *STEP1), MISSING1)


def build_step2(step1: DataFrame, zscore_window: int = 60, divergence_lookback: int = 20, overheat_threshold: float = 2.0, keep: Keep = present) -> DataFrame:
    out = detect_rsi_bullish_divergence(add_relative_indicators(step1, zscore_window), divergence_lookback)
    return keep(add_overheat_features(out, overheat_threshold), MISSING2)


def build_step3(step2: DataFrame, spec: BarrierSpec = BarrierSpec(), keep: Keep = present) -> DataFrame:
    out = apply_forward_drawdown(apply_triple_barrier(step2, spec), spec.holding_period, spec.drawdown_threshold)
    return keep(out, MISSING3)


def build_step5(step3: DataFrame, rsi_lookback: int = 5, dev_lookback: int = 5) -> DataFrame:
    return generate_assist_signal(step3, rsi_lookback, dev_lookback)
