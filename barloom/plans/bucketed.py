"""The steps for long histories: the same tables, with windows over buckets of rows instead of whole symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import DATE, SYMBOL, ewm_length, flag, present, ratio, require_columns
from barloom.functions.ranges import BUCKET, by_buckets
from barloom.operators.domain import add_overheat_features, add_relative_indicators
from barloom.operators.extremes import asof_by_buckets, first_touches, prior_low
from barloom.operators.indicators import WEEKLY, add_daily_features, add_weekly_features, add_wick_features
from barloom.operators.labels import BarrierSpec
from barloom.operators.signals import generate_assist_signal
from barloom.plans.steps import MISSING1, MISSING2, MISSING3, STEP1
from barloom.sources.bars import weekly_bars
from barloom.sources.store import stored


def build_step1_buckets(daily: DataFrame, weekly: DataFrame | None = None, span: int = 14, size: int = BUCKET) -> DataFrame:
    """build_step1() by buckets. Its windows look back as far as the exponential means do, or 75 rows; weeks look back 14."""
    daily = stored(daily)
    week = by_buckets(stored(weekly if weekly is not None else weekly_bars(daily)), add_weekly_features, before=14, size=size, order="week_end", days=1792)
    back = max(75, ewm_length(2.0 / (span + 1)) + 2)
    features = by_buckets(daily, lambda df: add_wick_features(add_daily_features(df, span)), before=back, size=size)
    joined = asof_by_buckets(features, week.select(SYMBOL, "week_end", *WEEKLY), SYMBOL, DATE, "week_end", WEEKLY)
    return present(joined.select(SYMBOL, DATE, *STEP1), MISSING1)


def detect_divergence_by_blocks(df: DataFrame, lookback: int = 20, price_col: str = "close", rsi_col: str = "rsi14") -> DataFrame:
    """detect_rsi_bullish_divergence() by block minima, at the same cost a row for any look-back."""
    require_columns(df, [price_col, rsi_col], "step 1")
    found = prior_low(df, lookback, "__low", price_col, rsi_col)
    hit = F.coalesce((F.col(price_col) <= F.col("__low.price")) & (F.col(rsi_col) > F.col("__low.rsi")), F.lit(False))
    return found.withColumns({"rsi_bullish_divergence": hit.cast("int"), "rsi_divergence_strength": F.when(hit, F.col(rsi_col) - F.col("__low.rsi")).otherwise(0.0)}).drop("__low")


def build_step2_buckets(step1: DataFrame, zscore_window: int = 60, divergence_lookback: int = 20, overheat_threshold: float = 2.0, size: int = BUCKET) -> DataFrame:
    """build_step2() by buckets of the rows that survive step 1."""
    compute = lambda df: detect_divergence_by_blocks(add_relative_indicators(df, zscore_window), divergence_lookback)
    out = by_buckets(stored(step1), compute, before=max(zscore_window, divergence_lookback), size=size)
    return present(add_overheat_features(out, overheat_threshold), MISSING2)


def label_by_doubling(df: DataFrame, spec: BarrierSpec = BarrierSpec(), size: int = BUCKET) -> DataFrame:
    """The columns of apply_triple_barrier() and apply_forward_drawdown(), by doubling tables over buckets; for horizons of any
    length, in memory that does not grow with the horizon a row. df is read twice."""
    require_columns(df, ["close", "high", "low"] + (["atr14"] if spec.mode == "atr" else []), "step 2")
    h, price = spec.holding_period, F.col("close")
    up = price + spec.tp_atr_mult * F.col("atr14") if spec.mode == "atr" else price * (1 + spec.tp_pct)
    down = price - spec.sl_atr_mult * F.col("atr14") if spec.mode == "atr" else price * (1 - spec.sl_pct)
    out = first_touches(df, h, up, down, size=size)
    tp, sl, last = F.col("__tp"), F.col("__sl"), F.col("__last")
    stop = (sl > 0) & ((tp == 0) | (sl <= tp))
    pick = lambda on_stop, on_take, on_time: F.when(F.col("__ahead") == h, F.when(stop, on_stop).when(tp > 0, on_take).otherwise(on_time))
    out = out.withColumns(
        {
            "tb_label": pick(F.lit(0), F.lit(1), (last > price).cast("int")),
            "tb_barrier": pick(F.lit("stop_loss"), F.lit("take_profit"), F.lit("time_out")),
            "tb_days_to_touch": pick(sl.cast("int"), tp.cast("int"), F.lit(h)),
            "tb_return": ratio(pick(down, up, last) - price, price),
            "tb_barrier_mode": F.lit(spec.mode),
            "forward_max_drawdown": ratio(F.col("__low") - price, price),
        }
    )
    dd = F.col("forward_max_drawdown")
    return out.withColumn("avoid_entry_flag", F.when(dd.isNotNull(), flag(dd <= -spec.drawdown_threshold))).drop("__tp", "__sl", "__last", "__low", "__ahead")


def build_step3_buckets(step2: DataFrame, spec: BarrierSpec = BarrierSpec(), size: int = BUCKET) -> DataFrame:
    """build_step3() by buckets of the rows that survive step 2."""
    return present(label_by_doubling(stored(step2), spec, size), MISSING3)


def build_step5_buckets(step3: DataFrame, rsi_lookback: int = 5, dev_lookback: int = 5, size: int = BUCKET) -> DataFrame:
    """build_step5() by buckets of the rows that survive step 3."""
    return by_buckets(stored(step3), lambda df: generate_assist_signal(df, rsi_lookback, dev_lookback), before=max(rsi_lookback, dev_lookback), size=size)
