"""Report tables: what charts would plot, and the summaries that are read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import DATE, SYMBOL
from barloom.operators.signals import BULLISH, CAUTION, ORDER


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def signal_counts(df: DataFrame) -> DataFrame:
    """Counts in fixed order; a signal that does not occur stays, with a null count."""
    order = df.sparkSession.createDataFrame([(i + 1, s) for i, s in enumerate(ORDER)], "position int, assist_signal string")
    return order.join(value_counts(df, "assist_signal"), "assist_signal", "left").select("position", "assist_signal", "n")


def avoid_share(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("avoid_entry_flag").alias("avoid_share"))


def barrier_shares(df: DataFrame) -> DataFrame:
    counts = value_counts(df, "tb_barrier")
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def histogram(df: DataFrame, value, bins: int, by: list[str] | None = None) -> DataFrame:
    """(by, bin, low, n): equal bins from the least to the greatest value of each group, the last one closed; bins
    without a value have no row. One value alone fills the first bin."""
    by = by or []
    x = df.select(*by, value.cast("double").alias("__x")).where("__x is not null")
    edges = x.groupBy(*by).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    both = x.join(F.broadcast(edges), by) if by else x.crossJoin(F.broadcast(edges))
    width = (F.col("__hi") - F.col("__lo")) / bins
    place = F.least(F.floor((F.col("__x") - F.col("__lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    place = F.when(F.col("__hi") == F.col("__lo"), 0).otherwise(place).cast("int")
    return both.select(*by, place.alias("bin"), (F.col("__lo") + place * width).alias("low")).groupBy(*by, "bin").agg(F.min("low").alias("low"), F.count("*").alias("n"))


def fold_starts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("fold").agg(F.min(DATE).alias("first_date"))


def confusion(predictions: DataFrame) -> DataFrame:
    """All four cells, 0 where none."""
    cells = predictions.sparkSession.createDataFrame([(t, p) for t in (0, 1) for p in (0, 1)], "y_true int, y_pred int")
    counts = predictions.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    return cells.join(counts, ["y_true", "y_pred"], "left").fillna(0, ["n"])


def probability_histogram(predictions: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(predictions.withColumn("correct", F.col("y_true") == F.col("y_pred")), F.col("y_proba"), bins, ["correct"])


def top(df: DataFrame, col: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(col), *[c for c in df.columns if c != col]).limit(n)


def head(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows by symbol and date."""
    return df.orderBy(SYMBOL, DATE).limit(n)


def step1_panels(step1: DataFrame) -> DataFrame:
    return step1.select(SYMBOL, DATE, "close", "ma25", "ma75", "volume", "rsi14", "bb_pct_b", "atr14", "mom5", "mom20", (F.col("weekly_trend") == 1).alias("uptrend"))


def step2_markers(step2: DataFrame) -> DataFrame:
    """One row for each marker of a bar, with the z-score clipped at 2 either way."""
    kinds = {"divergence": "rsi_bullish_divergence", "pump": "is_likely_temporary_pump", "overbought": "is_overbought_heat", "oversold": "is_oversold_heat"}
    marks = F.explode(F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(k)) for k, c in kinds.items()])))
    z = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("dev_ma25_zscore")))
    return step2.select(SYMBOL, DATE, "close", z.alias("zscore_clipped"), marks.alias("marker"))


def step3_points(step3: DataFrame) -> DataFrame:
    return step3.select(SYMBOL, DATE, "close", (F.col("tb_label") == 1).alias("win"), (F.col("avoid_entry_flag") == 1).alias("avoid"), (F.col("tb_return") * 100).alias("return_pct"), "tb_barrier", (F.col("forward_max_drawdown") * 100).alias("drawdown_pct"))


def step4_metrics_long(metrics: DataFrame) -> DataFrame:
    return metrics.unpivot(["fold"], ["accuracy", "precision", "recall", "f1", "roc_auc"], "metric", "value")


def step4_prices(step3: DataFrame, predictions: DataFrame) -> DataFrame:
    """Closes of all bars with the predicted probability where there is one."""
    return step3.select(SYMBOL, DATE, "close").join(predictions.select(SYMBOL, DATE, "fold", "y_proba"), [SYMBOL, DATE], "left")


def step5_points(step5: DataFrame) -> DataFrame:
    return step5.select(SYMBOL, DATE, "close", (F.col("assist_signal") == BULLISH).alias("bullish"), (F.col("assist_signal") == CAUTION).alias("caution"))
