"""The queries of the price-bar engine. All read `lineitem`: its lines are ticks, its return flags symbols."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import DATE, SYMBOL, ewm, ewm_blocks, lag, pct_change, rolling, rolling_mean, rolling_std, rows
from barloom.operators import domain, indicators, labels, signals, walkforward
from barloom.operators.asof import asof_backward
from barloom.operators.extremes import asof_by_buckets, prior_low
from barloom.plans import bucketed, reports
from barloom.plans.accounting import Account
from barloom.plans.steps import MISSING1, MISSING2, MISSING3, STEP1, build_step1, build_step2, build_step3, build_step5
from barloom.sources import bars as source
from barloom.sources.store import stored, write_buckets
from barloom.sql import EXACT, bars_by, query, rounded

ATR, PCT = labels.BarrierSpec(), labels.BarrierSpec(mode="fixed_pct")
FLOATS1 = [c for c in STEP1 if c not in ("candle_dir", "weekly_trend")]
INTS2 = ["oversold_flag", "overbought_flag", "rsi_bullish_divergence", "is_overheated", "is_overbought_heat", "is_oversold_heat", "is_likely_temporary_pump"]
FLOATS2 = ["dev_ma25_zscore", "dev_ma75_zscore", "rsi_divergence_strength", "atr_dev_ma25", "pump_temporary_score"]
INTS3, FLOATS3 = ["tb_label", "tb_days_to_touch", "tb_barrier", "tb_barrier_mode", "avoid_entry_flag"], ["tb_return", "forward_max_drawdown"]
FLAGS5 = ["rsi_reversal_flag", "deviation_shrink_flag", "overheat_warning_flag", "assist_signal"]


def lines(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet")


def daily(spark: SparkSession, d: str) -> DataFrame:
    return source.daily_bars(source.ticks_of_lineitem(lines(spark, d)))


def step1(spark: SparkSession, d: str) -> DataFrame:
    return build_step1(daily(spark, d))


def step2(spark: SparkSession, d: str) -> DataFrame:
    return build_step2(step1(spark, d))


def step3(spark: SparkSession, d: str, spec: labels.BarrierSpec = ATR) -> DataFrame:
    return build_step3(step2(spark, d), spec)


def step5(spark: SparkSession, d: str) -> DataFrame:
    return build_step5(step3(spark, d))


def shown(df: DataFrame, keys: list[str], same: list[str] = (), floats: list[str] = ()) -> DataFrame:
    return df.select(*keys, *same, *[F.col(c) if c in EXACT else F.round(c, 6).alias(c) for c in floats])


KEY = [SYMBOL, DATE]
FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    FOUND[name] = (make, sql)


def table(name: str, make: Callable[[SparkSession, str], DataFrame], part: str, same: list[str] = (), floats: list[str] = (), keys: list[str] = KEY) -> None:
    """A query that shows columns of a table, and its SQL from the part of that content."""
    register(name, lambda s, d: shown(make(s, d), keys, same, floats), rounded(" ".join(keys), " ".join(same), " ".join(floats), part))


# A: sources and cleaning
OHLCV = source.OHLCV


def vendor_sheet(spark: SparkSession, d: str) -> DataFrame:
    """The lines as a text sheet of one row each, with junk dates and words for volumes among them."""
    x = lines(spark, d)
    price = (F.col("l_extendedprice") / F.col("l_quantity")).cast("string")
    date = F.when(F.col("l_linenumber") == 1, "--------").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    volume = F.when(F.col("l_linenumber") == 2, "n/a").otherwise(F.col("l_quantity").cast("string"))
    return x.select(F.col("l_returnflag").alias(SYMBOL), F.lit("name").alias("name"), F.lit("market").alias("market"), F.lit("D").alias("bar_type"), date.alias("dt"), F.lit("").alias("time"), *[price.alias(c) for c in OHLCV[:4]], volume.alias("volume"))


register(
    "vendor_clean",
    lambda s, d: source.clean(vendor_sheet(s, d)).groupBy(KEY).agg(F.count("*").alias("n"), F.max("close").alias("highest"), F.sum("volume").alias("volume")),
    "SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS dt, count(*) AS n, max(CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE)) AS highest, CAST(sum(l_quantity) AS DOUBLE) AS volume FROM lineitem WHERE l_linenumber NOT IN (1, 2) GROUP BY 1, 2",
)
table("bars_daily", daily, "bars", floats=OHLCV)
register("repeated_keys", lambda s, d: source.repeated_keys(source.ticks_of_lineitem(lines(s, d))), "SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS dt, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
register("symbol_selection", lambda s, d: shown(source.select_symbols(daily(s, d), "R", "unknown"), KEY, floats=OHLCV), rounded("symbol dt", "", " ".join(OHLCV), "bars WHERE symbol = 'R'"))


def from_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Daily and weekly bars written as vendor sheets to the shared folder, read from there and cleaned."""
    root, bars = source.shared_folder(spark), daily(spark, d)
    days = source.clean(source.read_vendor(spark, source.write_vendor(bars, f"{root}/daily")))
    weeks = source.read_vendor(spark, source.write_vendor(source.weekly_bars(bars), f"{root}/weekly", "week_end", "W"))
    return days, source.clean(weeks, "week_end")


def stored_step1(spark: SparkSession, d: str) -> DataFrame:
    """Step 1 of the files' daily and stored weekly bars, written by symbol and loaded again."""
    root = source.shared_folder(spark)
    source.write_step(build_step1(*from_files(spark, d)), root, "step1")
    return source.read_step(spark, root, "step1")


table("files_daily", lambda s, d: from_files(s, d)[0], "bars", floats=OHLCV)
table("files_weekly", lambda s, d: from_files(s, d)[1], "weeks", floats=OHLCV, keys=[SYMBOL, "week_end"])
table("stored_step1", stored_step1, "step1", ["candle_dir", "weekly_trend"], FLOATS1)
register("stored_step1_symbol", lambda s, d: shown(source.select_symbols(stored_step1(s, d), "N"), KEY, ["weekly_trend"], ["close", "rsi14"]), rounded("symbol dt", "weekly_trend", "close rsi14", "step1 WHERE symbol = 'N'"))
# B: weeks, as-of
table("bars_weekly", lambda s, d: source.weekly_bars(daily(s, d)), "weeks", floats=OHLCV, keys=[SYMBOL, "week_end"])
table("weekly_features", lambda s, d: indicators.add_weekly_features(source.weekly_bars(daily(s, d))), "weekly", ["weekly_trend"], indicators.WEEKLY[:4], [SYMBOL, "week_end"])
table("asof_weekly", lambda s, d: asof_backward(daily(s, d), indicators.add_weekly_features(source.weekly_bars(daily(s, d))), SYMBOL, DATE, "week_end", indicators.WEEKLY), "with_weeks", ["weekly_trend"], [*OHLCV, *indicators.WEEKLY[:4]])
table("step1_stored_weekly", lambda s, d: build_step1(daily(s, d), source.weekly_bars(daily(s, d)).withColumn("note", F.lit("stored"))), "step1", ["weekly_trend"], ["close", "weekly_ma13"])
# C: windows
register(
    "window_shifts",
    lambda s, d: daily(s, d).select(*KEY, lag("close").alias("shift1"), lag("close", 5).alias("shift5"), (F.col("close") - lag("close")).alias("diff"), *[F.round(pct_change("close", k), 6).alias(f"pct{k}") for k in (1, 5, 20)]),
    query("SELECT symbol, dt, lag(close) OVER w AS shift1, lag(close, 5) OVER w AS shift5, close - lag(close) OVER w AS diff, " + ", ".join(f"round(close / nullif(lag(close, {k}) OVER w, 0) - 1, 6) AS pct{k}" for k in (1, 5, 20)) + " FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt)"),
)
register(
    "window_rolling",
    lambda s, d: daily(s, d).select(*KEY, *[F.round(rolling_mean("close", n), 6).alias(f"mean{n}") for n in (5, 13, 20, 60)], *[F.round(rolling_std("close", n), 6).alias(f"std{n}") for n in (20, 60)], rolling(F.min, "low", 5, -1).alias("min5_before")),
    query("SELECT symbol, dt, " + ", ".join([f"round(CASE WHEN count(close) OVER w{n} = {n} THEN {f}(close) OVER w{n} END, 6) AS {a}{n}" for f, a, ns in (("avg", "mean", (5, 13, 20, 60)), ("stddev_samp", "std", (20, 60))) for n in ns] + ["CASE WHEN count(low) OVER b = 5 THEN min(low) OVER b END AS min5_before"]) + " FROM bars WINDOW " + ", ".join([f"w{n} AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 13, 20, 60)] + ["b AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"])),
)
register("window_ewm", lambda s, d: daily(s, d).select(*KEY, F.round(ewm("volume"), 6).alias("ewm")), query("SELECT symbol, dt, round(list_reduce(list(volume) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 290 PRECEDING AND CURRENT ROW), lambda a, x: a * 0.8666666666666667 + x * 0.13333333333333333), 6) AS ewm FROM bars"))
register("window_ewm_blocks", lambda s, d: ewm_blocks(daily(s, d), "volume", "ewm").select(*KEY, F.round("ewm", 6).alias("ewm")), FOUND["window_ewm"][1])
register(
    "window_forward",
    lambda s, d: daily(s, d).select(*KEY, F.min("low").over(rows().rowsBetween(1, 10)).alias("low_ahead"), (F.count("*").over(rows().rowsBetween(1, 10)) == 10).alias("complete")),
    query("SELECT symbol, dt, min(low) OVER w AS low_ahead, count(*) OVER w = 10 AS complete FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)"),
)
# D: indicators
table("true_range_gain_loss", lambda s, d: indicators.add_gain_loss(indicators.add_true_range(daily(s, d))), "moves", floats=["true_range", "gain", "loss"])
table("daily_indicators", lambda s, d: indicators.add_daily_features(daily(s, d)), "daily", floats=[c for c in STEP1[5:16]])
table("wick_features", lambda s, d: indicators.add_wick_features(daily(s, d)), "daily", ["candle_dir"], STEP1[16:20])
table("step1", step1, "step1", ["candle_dir", "weekly_trend"], FLOATS1)
# E: domain features
table("relative_indicators", lambda s, d: domain.add_relative_indicators(step1(s, d)), "flagged", ["oversold_flag", "overbought_flag"], ["dev_ma25_zscore", "dev_ma75_zscore"])
table("rsi_divergence", lambda s, d: domain.detect_rsi_bullish_divergence(step1(s, d)), "flagged", ["rsi_bullish_divergence"], ["rsi_divergence_strength"])
table("overheat_features", lambda s, d: domain.add_overheat_features(step1(s, d)), "flagged", INTS2[3:], ["atr_dev_ma25", "pump_temporary_score"])
table("step2", step2, "step2", ["candle_dir", "weekly_trend", *INTS2], [*FLOATS1, *FLOATS2])
# F: labels
table("labels_atr", lambda s, d: labels.apply_triple_barrier(step2(s, d), ATR), "atr_all", INTS3[:4], ["tb_return"])
table("labels_fixed_pct", lambda s, d: labels.apply_triple_barrier(step2(s, d), PCT), "pct_all", INTS3[:4], ["tb_return"])
table("forward_drawdown", lambda s, d: labels.apply_forward_drawdown(step2(s, d)), "atr_all", ["avoid_entry_flag"], ["forward_max_drawdown"])
table("step3_atr", step3, "atr_step3", [*INTS2, *INTS3], ["close", *FLOATS2, *FLOATS3])
table("step3_fixed_pct", lambda s, d: step3(s, d, PCT), "pct_step3", [*INTS2, *INTS3], ["close", *FLOATS2, *FLOATS3])
# Long histories: the same tables by buckets of 512 rows, with their neighbours
SIZE = 512


def step1_buckets(spark: SparkSession, d: str) -> DataFrame:
    return bucketed.build_step1_buckets(daily(spark, d), size=SIZE)


def step2_buckets(spark: SparkSession, d: str) -> DataFrame:
    return bucketed.build_step2_buckets(step1_buckets(spark, d), size=SIZE)


def step3_buckets(spark: SparkSession, d: str, spec: labels.BarrierSpec = ATR) -> DataFrame:
    return bucketed.build_step3_buckets(step2_buckets(spark, d), spec, SIZE)


def one_symbol(spark: SparkSession, d: str) -> DataFrame:
    """All lines as the ticks of one symbol."""
    return source.daily_bars(source.ticks_of_lineitem(lines(spark, d).withColumn("one", F.lit("all")), "one"))


def brands(spark: SparkSession, d: str) -> DataFrame:
    """The lines as ticks of their part's brand."""
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return source.daily_bars(source.ticks_of_lineitem(lines(spark, d).join(part, "l_partkey"), "p_brand"))


LONG = labels.BarrierSpec(holding_period=500, tp_atr_mult=6.0, sl_atr_mult=5.0)
BRANDS = {"bars": bars_by("p_brand", "lineitem JOIN part ON l_partkey = p_partkey")}
table("step1_buckets", step1_buckets, "step1", ["candle_dir", "weekly_trend"], FLOATS1)
table("step2_buckets", step2_buckets, "step2", ["candle_dir", "weekly_trend", *INTS2], [*FLOATS1, *FLOATS2])
table("step3_atr_buckets", step3_buckets, "atr_step3", [*INTS2, *INTS3], ["close", *FLOATS2, *FLOATS3])
table("step3_fixed_pct_buckets", lambda s, d: step3_buckets(s, d, PCT), "pct_step3", [*INTS2, *INTS3], ["close", *FLOATS2, *FLOATS3])
table("step5_buckets", lambda s, d: bucketed.build_step5_buckets(step3_buckets(s, d), size=SIZE), "step5", [*INTS3, *FLAGS5], ["close", "rsi14", "dev_ma25_zscore", *FLOATS3])
table("labels_500_rows", lambda s, d: bucketed.label_by_doubling(stored(step2(s, d)), LONG, SIZE), "long_all", [*INTS3[:4], "avoid_entry_flag"], FLOATS3)
register("step1_one_symbol", lambda s, d: shown(bucketed.build_step1_buckets(one_symbol(s, d), size=SIZE), KEY, ["candle_dir", "weekly_trend"], FLOATS1), rounded("symbol dt", "candle_dir weekly_trend", " ".join(FLOATS1), "step1", bars=bars_by("'all'")))
register("step3_brands", lambda s, d: shown(step3_of(brands(s, d)), KEY, INTS3, ["close", "rsi14", *FLOATS3]), rounded("symbol dt", " ".join(INTS3), " ".join(["close", "rsi14", *FLOATS3]), "atr_step3", **BRANDS))


def asof_one_symbol(spark: SparkSession, d: str) -> DataFrame:
    bars = stored(one_symbol(spark, d))
    return asof_by_buckets(bars, indicators.add_weekly_features(source.weekly_bars(bars)), SYMBOL, DATE, "week_end", indicators.WEEKLY)


def step3_of(bars: DataFrame) -> DataFrame:
    """Steps 1 to 3 of bars, by buckets."""
    return bucketed.build_step3_buckets(bucketed.build_step2_buckets(bucketed.build_step1_buckets(bars)))


register("asof_one_symbol", lambda s, d: shown(asof_one_symbol(s, d), KEY, ["weekly_trend"], [*OHLCV, *indicators.WEEKLY[:4]]), rounded("symbol dt", "weekly_trend", " ".join([*OHLCV, *indicators.WEEKLY[:4]]), "with_weeks", bars=bars_by("'all'")))
for _n in (20, 250):
    register(
        f"prior_low_{_n}",
        lambda s, d, n=_n: shown(prior_low(daily(s, d).withColumn("rsi14", F.col("volume")), n, "low_before").select(*KEY, F.col("low_before.price").alias("low"), F.col("low_before.at").alias("low_dt"), F.col("low_before.rsi").alias("volume")), KEY, ["low_dt"], ["low", "volume"]),
        query(f"SELECT symbol, dt, p.at AS low_dt, p.price AS low, p.v AS volume FROM (SELECT symbol, dt, CASE WHEN count(close) OVER w = {_n} THEN min({{'price': close, 'at': dt, 'v': volume}}) OVER w END AS p FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN {_n} PRECEDING AND 1 PRECEDING))"),
    )


def bucketed_step2(spark: SparkSession, d: str) -> DataFrame:
    """Step 2 from step 1 as a table in buckets of symbols, which its windows read without an exchange."""
    return build_step2(write_buckets(step1(spark, d), f"step1_{uuid.uuid4().hex}", [SYMBOL], [SYMBOL, DATE], 8))


table("stored_step2_buckets", bucketed_step2, "step2", ["candle_dir", "weekly_trend", *INTS2], [*FLOATS1, *FLOATS2])
table("files_preamble", lambda s, d: source.clean(source.read_vendor(s, source.write_sheets(daily(s, d), f"{source.shared_folder(s)}/sheets"), skip=3)), "bars", floats=OHLCV)


def step_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Rows in, out and dropped by reason of steps 1 to 3, each run and written once."""
    account = Account()
    one = stored(build_step1(daily(spark, d), keep=account.keep("step1")))
    two = stored(build_step2(one, keep=account.keep("step2")))
    stored(build_step3(two, keep=account.keep("step3")))
    return account.table(spark)


def _account_sql(step: str, before: str, names: list[str]) -> str:
    first = " ".join(f"WHEN {n} IS NULL THEN '{n}'" for n in names)
    one = f"SELECT CASE {first} END AS missing FROM {before}"
    counts = [("rows_in", "TRUE"), ("rows_out", "missing IS NULL"), ("dropped", "missing IS NOT NULL"), *[(f"missing {n}", f"missing = '{n}'") for n in names]]
    return " UNION ALL ".join(f"SELECT '{step}' AS step, '{reason}' AS reason, count(*) FILTER (WHERE {c}) AS n FROM ({one})" for reason, c in counts)


register("step_accounts", step_accounts, query(" UNION ALL ".join(_account_sql(*x) for x in (("step1", "with_weeks", MISSING1), ("step2", "flagged", MISSING2), ("step3", "atr_all", MISSING3)))))
# H: signal
table("signal_flags", lambda s, d: signals.add_signal_flags(step3(s, d)), "turns", FLAGS5[:3])
table("step5", step5, "step5", [*INTS3, *FLAGS5], ["close", "rsi14", "dev_ma25_zscore", *FLOATS3])
POSITION = "CAST(CASE assist_signal WHEN '強気' THEN 1 WHEN '警戒' THEN 2 ELSE 3 END AS INTEGER) AS position"
register("signal_quality", lambda s, d: shown(signals.evaluate_signal_quality(step5(s, d)), ["position", "assist_signal", "n"], floats=["win_rate", "mean_return"]), query(f"SELECT {POSITION}, assist_signal, count(*) AS n, round(avg(tb_label), 6) AS win_rate, round(avg(tb_return), 6) AS mean_return FROM step5 GROUP BY assist_signal"))
# B6-B13 and I: reports
for _name, _col in (("label_counts", "tb_label"), ("barrier_counts", "tb_barrier")):
    register(_name, lambda s, d, c=_col: reports.value_counts(step3(s, d), c), query(f"SELECT {_col}, count(*) AS n FROM atr_step3 GROUP BY 1"))
register("signal_counts", lambda s, d: reports.signal_counts(step5(s, d)), query("SELECT o.position, o.assist_signal, c.n FROM (VALUES (1, '強気'), (2, '警戒'), (3, '中立')) o(position, assist_signal) LEFT JOIN (SELECT assist_signal, count(*) AS n FROM step5 GROUP BY 1) c ON o.assist_signal = c.assist_signal"))
register("avoid_share", lambda s, d: reports.avoid_share(step3(s, d)).select(F.round("avoid_share", 6).alias("avoid_share")), query("SELECT round(avg(avoid_entry_flag), 6) AS avoid_share FROM atr_step3"))
register("barrier_shares", lambda s, d: shown(reports.barrier_shares(step3(s, d)), ["tb_barrier", "n"], floats=["percent"]), query("SELECT tb_barrier, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM atr_step3 GROUP BY 1"))
HISTOGRAM = """SELECT {by}bin, round(min(lo + bin * ((hi - lo) / {bins})), 6) AS low, count(*) AS n FROM (SELECT *, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / {bins})), {last}) END AS INTEGER) AS bin
  FROM (SELECT *, min(x) OVER ({part}) AS lo, max(x) OVER ({part}) AS hi FROM ({source}))) GROUP BY {by}bin"""
# values are rounded first, so that both engines cut the same numbers
register("return_histogram", lambda s, d: shown(reports.histogram(step3(s, d), F.round(F.col("tb_return") * 100, 6), 40), ["bin"], ["n"], ["low"]), query(HISTOGRAM.format(by="", bins=40, last=39, part="", source="SELECT round(tb_return * 100, 6) AS x FROM atr_step3")))
table("panels_step1", lambda s, d: reports.step1_panels(step1(s, d)), "(SELECT *, weekly_trend = 1 AS uptrend FROM step1)", ["uptrend"], ["close", "ma25", "ma75", "volume", "rsi14", "bb_pct_b", "atr14", "mom5", "mom20"])
register("markers_step2", lambda s, d: shown(reports.step2_markers(step2(s, d)), [*KEY, "marker"], floats=["close", "zscore_clipped"]), query(" UNION ALL ".join(f"SELECT symbol, dt, '{k}' AS marker, close, round(greatest(-2.0, least(2.0, dev_ma25_zscore)), 6) AS zscore_clipped FROM step2 WHERE {c} = 1" for k, c in (("divergence", "rsi_bullish_divergence"), ("pump", "is_likely_temporary_pump"), ("overbought", "is_overbought_heat"), ("oversold", "is_oversold_heat")))))
table("points_step3", lambda s, d: reports.step3_points(step3(s, d)), "(SELECT *, tb_label = 1 AS win, avoid_entry_flag = 1 AS avoid, tb_return * 100 AS return_pct, forward_max_drawdown * 100 AS drawdown_pct FROM atr_step3)", ["win", "avoid", "tb_barrier"], ["close", "return_pct", "drawdown_pct"])
table("points_step5", lambda s, d: reports.step5_points(step5(s, d)), "(SELECT *, assist_signal = '強気' AS bullish, assist_signal = '警戒' AS caution FROM step5)", ["bullish", "caution"], ["close"])
register("head_step5", lambda s, d: shown(reports.head(step5(s, d)), KEY, ["assist_signal"], ["close"]), query("SELECT symbol, dt, assist_signal, close FROM step5 ORDER BY symbol, dt LIMIT 5"))


# G: walk-forward; a fixed rule stands in for the model where SQL checks what follows it
def standin(spark: SparkSession, d: str) -> DataFrame:
    df = stored(step3(spark, d))
    folds = stored(walkforward.date_folds(df))
    kept = walkforward.fold_table(folds).select("fold")
    test = folds.where("role = 'test'").join(kept, "fold").select(DATE, "fold")
    proba = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.round("mom5", 3)))
    return df.join(test, DATE).select(*KEY, "fold", F.col("tb_label").alias("y_true"), (F.col("mom5") > 0).cast("int").alias("y_pred"), proba.alias("y_proba"))


METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]
register("fold_table", lambda s, d: walkforward.fold_table(walkforward.date_folds(step3(s, d))), query("SELECT * FROM fold_table"))
table("standin_predictions", standin, "standin", ["fold", "y_true", "y_pred"], ["y_proba"])
table("fold_metrics", lambda s, d: walkforward.fold_metrics(standin(s, d)), "metrics", ["n_test"], METRICS, ["fold"])
register("mean_metrics", lambda s, d: shown(walkforward.mean_metrics(walkforward.fold_metrics(standin(s, d))), [], floats=METRICS), query("SELECT " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS) + " FROM metrics"))
register("metrics_long", lambda s, d: shown(reports.step4_metrics_long(walkforward.fold_metrics(standin(s, d)).drop("n_test")), ["fold", "metric"], floats=["value"]), query(" UNION ALL ".join(f"SELECT fold, '{m}' AS metric, round({m}, 6) AS value FROM metrics" for m in METRICS)))
register("confusion", lambda s, d: reports.confusion(standin(s, d)), query("SELECT t AS y_true, p AS y_pred, (SELECT count(*) FROM standin WHERE y_true = t AND y_pred = p) AS n FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(t, p)"))
register("probability_histogram", lambda s, d: shown(reports.probability_histogram(standin(s, d)), ["correct", "bin"], ["n"], ["low"]), query(HISTOGRAM.format(by="correct, ", bins=20, last=19, part="PARTITION BY correct", source="SELECT y_true = y_pred AS correct, y_proba AS x FROM standin")))
register("fold_starts", lambda s, d: reports.fold_starts(standin(s, d)), query("SELECT fold, min(dt) AS first_date FROM standin GROUP BY 1"))
register("prices_with_probability", lambda s, d: shown(reports.step4_prices(step3(s, d), standin(s, d)), KEY, ["fold"], ["close", "y_proba"]), query("SELECT a.symbol, a.dt, s.fold, a.close, round(s.y_proba, 6) AS y_proba FROM atr_step3 a LEFT JOIN standin s ON a.symbol = s.symbol AND a.dt = s.dt"))
register(
    "top_importance",
    lambda s, d: reports.top(walkforward.mean_importance(step3(s, d).unpivot(["tb_label"], ["mom5", "mom20", "bb_pct_b", "dev_ma25"], "feature", "x").groupBy("feature").agg(F.round(F.abs(F.corr("x", "tb_label")), 6).alias("importance"))), "importance", 3),
    query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(abs(corr({f}, tb_label)), 6) AS importance FROM atr_step3" for f in ("mom5", "mom20", "bb_pct_b", "dev_ma25")) + ") ORDER BY importance DESC, feature LIMIT 3"),
)


def standin_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Permutation importance of the rule's columns, fold by fold."""
    df = stored(step3(spark, d))
    folds = stored(walkforward.date_folds(df))
    right = lambda x: x.withColumn("__ok", ((F.col("mom5") > 0).cast("int") == F.col("tb_label")).cast("double"))
    parts = []
    for k in sorted(r["fold"] for r in walkforward.fold_table(folds).select("fold").collect()):
        test = df.join(folds.where((F.col("fold") == k) & (F.col("role") == "test")).select(DATE), DATE, "left_semi").select(*KEY, "tb_label", "mom5", "mom20")
        parts.append(walkforward.accuracy_lost(walkforward.with_permuted(test, ["mom5", "mom20"], k), test, right, k))
    return reduce(DataFrame.unionByName, parts)


register(
    "standin_permutation",
    lambda s, d: shown(standin_permutation(s, d), ["fold", "feature"], floats=["importance"]),
    query("""SELECT t.fold, v.feature, round(avg(CAST(CAST(t.mom5 > 0 AS INTEGER) = t.tb_label AS DOUBLE)) - avg(CAST(CAST(CASE v.feature WHEN 'mom5' THEN o.mom5 ELSE t.mom5 END > 0 AS INTEGER) = t.tb_label AS DOUBLE)), 6) AS importance
  FROM walk w JOIN tested t ON w.fold = t.fold AND w.i = t.i JOIN tested o ON w.fold = o.fold AND w.place = o.i, (VALUES ('mom5'), ('mom20')) v(feature) WHERE w.place < w.n GROUP BY 1, 2"""),
)


def purge_table(spark: SparkSession, d: str) -> DataFrame:
    """Training rows of each fold, and those whose labels reach into its test."""
    labelled = walkforward.label_ends(stored(labels.apply_forward_drawdown(labels.apply_triple_barrier(step2(spark, d)))))
    df = stored(labelled.dropna(subset=MISSING3).select(*KEY, "label_end"))
    folds = stored(walkforward.date_folds(df))
    kept = walkforward.fold_table(folds).select("fold")
    of = lambda role: df.join(folds.where(F.col("role") == role).join(kept, "fold").select(DATE, "fold"), DATE)
    left = walkforward.purged(of("train"), of("test"), [SYMBOL, "fold"]).groupBy("fold").agg(F.count("*").alias("kept"))
    every = of("train").groupBy("fold").agg(F.count("*").alias("n_train"))
    return every.join(left, "fold", "left").select("fold", "n_train", (F.col("n_train") - F.coalesce("kept", F.lit(0))).alias("purged"))


register(
    "purge_table",
    purge_table,
    query("""SELECT f.fold, count(*) AS n_train, count(*) FILTER (WHERE s.dt <= p.last AND coalesce(s.label_end, s.dt) >= p.first) AS purged
  FROM ends_of_labels s JOIN folds f ON s.dt = f.dt AND f.role = 'train' JOIN fold_table USING (fold) LEFT JOIN spans p ON p.fold = f.fold AND p.symbol = s.symbol GROUP BY 1"""),
)
ROUNDS = 300  # as in the reference


WALKED: OrderedDict[tuple, walkforward.WalkForward] = OrderedDict()  # the latest walks of this application, by content of the input


def content_of(spark: SparkSession, path: str) -> tuple:
    """How many files a table has, and a hash of their names, lengths and times of change."""
    files = spark.read.format("binaryFile").load(path)
    return tuple(files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first())


def walked(spark: SparkSession, d: str) -> walkforward.WalkForward:
    """One walk for all queries of an input: what they show are its tables, which are written. Two walks are remembered; a
    changed table is walked again. None of the queries of a walk needs the final fit."""
    key = (spark.sparkContext.applicationId, d, content_of(spark, f"{d}/lineitem.parquet"))
    if key not in WALKED:
        WALKED[key] = walkforward.walk_forward_validation(step3(spark, d), rounds=ROUNDS, final=False)
        while len(WALKED) > 2:
            WALKED.popitem(last=False)
    return WALKED[key]


def permuted_model(spark: SparkSession, d: str) -> DataFrame:
    """Mean loss of accuracy by feature over the walk's folds, five repeats each."""
    walk = walked(spark, d)
    each = [walkforward.permutation_importance(m, walk.fold_tests[k], walk.features, k) for k, m in walk.fold_models.items()]
    return walkforward.mean_importance(reduce(DataFrame.unionByName, each))


def reloaded_model(spark: SparkSession, d: str) -> DataFrame:
    """The final model, fitted on all rows, saved to the shared folder and loaded: its scores of all rows, and whether they are
    those of the model before it was saved."""
    df = stored(step3(spark, d))
    features = walkforward.select_feature_columns(df)
    model = walkforward.fit(df.coalesce(1 + df.count() // walkforward.TASK_ROWS), features, rounds=ROUNDS)
    path = f"{source.shared_folder(spark)}/model"
    model.write().overwrite().save(path)
    before, after = (walkforward.predict(m, df, 0) for m in (model, PipelineModel.load(path)))
    return after.drop("fold").join(before.select(*KEY, F.col("y_proba").alias("__p"), F.col("y_pred").alias("__y")), KEY).select(*KEY, "y_true", "y_pred", "y_proba", ((F.col("__p") == F.col("y_proba")) & (F.col("__y") == F.col("y_pred"))).alias("same"))


register("model_predictions", lambda s, d: walked(s, d).predictions)
register("model_importance", lambda s, d: walked(s, d).feature_importance)
register("model_fold_metrics", lambda s, d: walked(s, d).fold_metrics)
register("model_top_importance", lambda s, d: reports.top(walked(s, d).feature_importance, "importance", 15))
register("model_permutation_importance", permuted_model)
register("model_reloaded", reloaded_model)
register("model_mean_metrics", lambda s, d: walkforward.mean_metrics(walked(s, d).fold_metrics))
register("model_metrics_long", lambda s, d: reports.step4_metrics_long(walked(s, d).fold_metrics.select("fold", *METRICS)))
register("model_confusion", lambda s, d: reports.confusion(walked(s, d).predictions))
register("model_probability_histogram", lambda s, d: reports.probability_histogram(walked(s, d).predictions))
register("model_fold_starts", lambda s, d: reports.fold_starts(walked(s, d).predictions))
register("model_prices", lambda s, d: reports.step4_prices(step3(s, d), walked(s, d).predictions))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: make for name, (make, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
