"""Triple-barrier labels and forward drawdown, over the rows that survive step 2."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import flag, ratio, require_columns, rows


@dataclass(frozen=True)
class BarrierSpec:
    """Barrier settings. tp_pct and sl_pct go together and select fixed_pct mode; atr mode takes neither; fixed_pct mode
    named alone means 10 % and 5 %. The holding period defaults to 10 rows in atr mode, 45 in fixed_pct mode."""

    mode: str | None = None
    holding_period: int | None = None
    tp_atr_mult: float = 2.0
    sl_atr_mult: float = 1.5
    tp_pct: float | None = None
    sl_pct: float | None = None
    drawdown_threshold: float = 0.03

    def __post_init__(self) -> None:
        given = [x is not None for x in (self.tp_pct, self.sl_pct)]
        if any(given) and not all(given):
            raise ValueError("tp_pct and sl_pct must be given together")
        if self.mode not in (None, "atr", "fixed_pct"):
            raise ValueError(f"unknown barrier mode {self.mode!r}")
        if self.mode == "atr" and any(given):
            raise ValueError("atr mode takes tp_atr_mult and sl_atr_mult, not tp_pct and sl_pct")
        mode = self.mode or ("fixed_pct" if any(given) else "atr")
        put = lambda name, value: object.__setattr__(self, name, value)
        put("mode", mode)
        if mode == "fixed_pct" and not any(given):
            put("tp_pct", 0.10)
            put("sl_pct", 0.05)
        if self.holding_period is None:
            put("holding_period", 45 if mode == "fixed_pct" else 10)


def apply_triple_barrier(df: DataFrame, spec: BarrierSpec = BarrierSpec(), price_col: str = "close", high_col: str = "high", low_col: str = "low", atr_col: str = "atr14") -> DataFrame:
    """tb_label, tb_barrier, tb_days_to_touch, tb_return, tb_barrier_mode.

    The next rows are read in order: the first whose high or low reaches a level decides, the lower level first if both
    are reached on one row; with none in the holding period it is time_out, labelled by the last close. Rows without a
    complete holding period ahead are null.
    """
    need = [price_col, high_col, low_col] + ([atr_col] if spec.mode == "atr" else [])
    require_columns(df, need, "step 2")
    h, price = spec.holding_period, F.col(price_col)
    if spec.mode == "atr":
        upper, lower = price + spec.tp_atr_mult * F.col(atr_col), price - spec.sl_atr_mult * F.col(atr_col)
    else:
        upper, lower = price * (1 + spec.tp_pct), price * (1 - spec.sl_pct)
    frame = rows().rowsBetween(1, h)
    ahead = F.collect_list(F.struct(F.col(high_col).alias("high"), F.col(low_col).alias("low"), price.alias("close"))).over(frame)
    out = df.withColumns({"__next": ahead, "__up": upper, "__down": lower})
    out = out.withColumns({"__tp": F.array_position(F.transform("__next", lambda x: x["high"] >= F.col("__up")), F.lit(True)), "__sl": F.array_position(F.transform("__next", lambda x: x["low"] <= F.col("__down")), F.lit(True))})
    tp, sl = F.col("__tp"), F.col("__sl")
    stop = (sl > 0) & ((tp == 0) | (sl <= tp))
    last = F.get(F.col("__next.close"), F.lit(h - 1))
    complete = F.size("__next") == h
    pick = lambda on_stop, on_take, on_time: F.when(complete, F.when(stop, on_stop).when(tp > 0, on_take).otherwise(on_time))
    return out.withColumns(
        {
            "tb_label": pick(F.lit(0), F.lit(1), (last > price).cast("int")),
            "tb_barrier": pick(F.lit("stop_loss"), F.lit("take_profit"), F.lit("time_out")),
            "tb_days_to_touch": pick(sl.cast("int"), tp.cast("int"), F.lit(h)),
            "tb_return": ratio(pick(F.col("__down"), F.col("__up"), last) - price, price),
            "tb_barrier_mode": F.lit(spec.mode),
        }
    ).drop("__next", "__up", "__down", "__tp", "__sl")


def apply_forward_drawdown(df: DataFrame, holding_period: int = 10, drawdown_threshold: float = 0.03, price_col: str = "close", low_col: str = "low") -> DataFrame:
    """The lowest low of the next rows against the price, fewer rows at the end, null on the last; and the avoid flag."""
    require_columns(df, [price_col, low_col], "step 2")
    low = F.min(low_col).over(rows().rowsBetween(1, holding_period))
    out = df.withColumn("forward_max_drawdown", ratio(low - F.col(price_col), F.col(price_col)))
    dd = F.col("forward_max_drawdown")
    return out.withColumn("avoid_entry_flag", F.when(dd.isNotNull(), flag(dd <= -drawdown_threshold)))
