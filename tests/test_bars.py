import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from barloom import queries as Q
from barloom.functions.columns import ewm, ewm_blocks, require_columns
from barloom.operators import domain, indicators, labels, signals, walkforward
from barloom.operators.asof import asof_backward
from barloom.plans import reports
from barloom.plans.steps import STEP1, build_step1, build_step2, build_step3, build_step5
from barloom.sources import bars as B
from oracle import check, connection

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)  # a Monday


def frame(spark, rows, symbol="X"):
    """Bars from (open, high, low, close) rows on successive days; one number is a bar of that close."""
    full = [(r, r + 1.0, r - 1.0, r) if isinstance(r, (int, float)) else r for r in rows]
    data = [(symbol, DAY + dt.timedelta(i), *map(float, r), 1.0) for i, r in enumerate(full)]
    return spark.createDataFrame(data, B.BARS)


def closes(n, seed=0):
    """A walk that rises and falls, with opens off the closes."""
    out, x = [], 100.0
    for i in range(n):
        o = x + math.sin(i * 1.7 + seed) * 0.8
        x = x + math.sin(i * 0.9 + seed) + 0.3 * math.cos(i * 2.3)
        out.append((o, max(o, x) + 0.5, min(o, x) - 0.5, x))
    return out


CHECKED = ["vendor_clean", "files_daily", "files_weekly", "stored_step1", "stored_step1_symbol", "bars_daily", "bars_weekly", "weekly_features", "asof_weekly", "window_rolling", "window_ewm_blocks", "daily_indicators", "step1", "rsi_divergence", "step2", "labels_fixed_pct", "step3_atr", "step5", "signal_quality", "fold_table", "fold_metrics", "confusion", "probability_histogram", "return_histogram"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    make, sql = Q.FOUND[name]
    assert check(make(spark, SF), connection(SF), sql) > 0


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).columns == ["position", "assist_signal", "n", "win_rate", "mean_return"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def labelled(spark, rows, **spec):
    df = frame(spark, rows).withColumn("atr14", F.lit(2.0))
    return labels.apply_triple_barrier(df, labels.BarrierSpec(**spec)).orderBy("dt").collect()


def test_both_levels_on_one_row_is_a_stop(spark):
    r = labelled(spark, [100, (100, 110, 90, 100)] + [100] * 10)[0]
    assert (r["tb_barrier"], r["tb_label"], r["tb_days_to_touch"]) == ("stop_loss", 0, 1) and abs(r["tb_return"] + 0.03) < 1e-12


@pytest.mark.parametrize(("last", "label"), [(100.5, 1), (99.5, 0), (100, 0)])
def test_time_out_is_labelled_by_the_last_close(spark, last, label):
    rows = [100] * 10 + [last, 100]
    r = labelled(spark, rows)[0]
    assert (r["tb_barrier"], r["tb_label"], r["tb_days_to_touch"]) == ("time_out", label, 10)


def test_short_tail_has_no_label(spark):
    assert all(r["tb_label"] is None for r in labelled(spark, [100] * 10))


def test_fixed_percentages_time_out(spark):
    r = labelled(spark, [100] * 47, mode="fixed_pct")[0]
    assert (r["tb_barrier"], r["tb_barrier_mode"], r["tb_days_to_touch"]) == ("time_out", "fixed_pct", 45)


def test_barrier_rules():
    spec = labels.BarrierSpec
    assert (spec().mode, spec().holding_period) == ("atr", 10)
    assert (spec(mode="fixed_pct").tp_pct, spec(mode="fixed_pct").sl_pct, spec(mode="fixed_pct").holding_period) == (0.10, 0.05, 45)
    assert spec(tp_pct=0.2, sl_pct=0.1).mode == "fixed_pct"
    for bad in ({"tp_pct": 0.1}, {"sl_pct": 0.1}, {"mode": "atr", "tp_pct": 0.1, "sl_pct": 0.1}, {"mode": "x"}):
        with pytest.raises(ValueError):
            spec(**bad)


def test_drawdown_on_the_last_row_is_null(spark):
    out = labels.apply_forward_drawdown(frame(spark, [100, 95, 100])).orderBy("dt").collect()
    assert abs(out[0]["forward_max_drawdown"] + 0.06) < 1e-12 and out[0]["avoid_entry_flag"] == 1 and out[2]["forward_max_drawdown"] is None and out[2]["avoid_entry_flag"] is None


def test_first_row_and_flat_bars(spark):
    out = indicators.add_gain_loss(indicators.add_true_range(frame(spark, [(1, 3, 0, 2), (2, 2, 2, 2)]))).orderBy("dt").collect()
    assert out[0]["true_range"] == 3 and out[0]["gain"] is None and out[1]["gain"] == 0
    flat = indicators.add_wick_features(indicators.add_daily_features(frame(spark, [(5, 5, 5, 5)] * 80))).collect()
    assert all(r["range_vs_atr"] is None and r["upper_wick_ratio"] is None for r in flat)


def test_doji_and_gains_only_rows_are_dropped(spark):
    rows = closes(130)
    doji = [(r[3], r[1], r[2], r[3]) if i in (100, 101, 102) else r for i, r in enumerate(rows)]
    kept = build_step1(frame(spark, rows)).count()
    assert kept > 20 and build_step1(frame(spark, doji)).count() == kept - 3
    assert build_step1(frame(spark, [(i, i + 2, i - 1, i + 1) for i in range(1, 120)])).count() == 0


def test_weeks(spark):
    df = frame(spark, list(range(1, 29))).where("dayofweek(dt) between 2 and 6").where("not (dt between '2024-01-08' and '2024-01-14')")
    week = B.weekly_bars(df)
    assert [str(r["week_end"]) for r in week.orderBy("week_end").collect()] == ["2024-01-05", "2024-01-19", "2024-01-26"]
    got = {str(r["dt"]): r["w"] for r in asof_backward(df, week.withColumn("w", F.col("close")), "symbol", "dt", "week_end", ["w"]).collect()}
    assert got["2024-01-04"] is None and got["2024-01-05"] == 5 and got["2024-01-18"] == 5 and got["2024-01-19"] == 19


def test_a_null_of_the_latest_week_is_kept(spark):
    left, right = frame(spark, [1, 2, 3]), spark.createDataFrame([("X", DAY, 7.0), ("X", DAY + dt.timedelta(1), None)], "symbol string, week_end date, w double")
    assert [r["w"] for r in asof_backward(left, right, "symbol", "dt", "week_end", ["w"]).orderBy("dt").collect()] == [7.0, None, None]


def test_earliest_low_supplies_the_rsi(spark):
    df = frame(spark, [50 - (i in (5, 9)) for i in range(20)] + [48, 47]).withColumn("rsi14", F.dayofmonth("dt").cast("double"))
    r = domain.detect_rsi_bullish_divergence(df).orderBy("dt").collect()
    assert [x["rsi_bullish_divergence"] for x in r[:20]] == [0] * 20 and r[20]["rsi_bullish_divergence"] == 1 and r[20]["rsi_divergence_strength"] == 21 - 6


def test_exponential_means_equal_pandas(spark):
    df = frame(spark, closes(700)).withColumn("x", F.when(F.col("dt") > F.lit(DAY), F.col("close")))
    want = df.orderBy("dt").toPandas()["x"].ewm(span=14, adjust=False).mean()
    for got in (df.withColumn("y", ewm("x")), ewm_blocks(df, "x", "y")):
        y = got.orderBy("dt").toPandas()["y"]
        assert pd.isna(y[0]) and (y[1:] - want[1:]).abs().max() < 1e-9


def test_no_look_ahead_and_no_bleed(spark):
    rows = closes(220)
    one = build_step2(build_step1(frame(spark, rows[:200])))
    more = build_step2(build_step1(frame(spark, rows).unionByName(frame(spark, closes(150, 3), "Y")).repartition(5)))
    last = frame(spark, rows[:200]).agg(F.max("dt")).first()[0]
    key = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    same = more.where((F.col("symbol") == "X") & (F.col("dt") <= last)).select(*one.columns)
    assert one.count() > 30 and key(one) == key(same)


def test_missing_columns_raise(spark):
    df = frame(spark, [1, 2])
    for f in (domain.add_relative_indicators, domain.add_overheat_features, signals.generate_assist_signal, domain.detect_rsi_bullish_divergence):
        with pytest.raises(KeyError):
            f(df)
    require_columns(df, ["close"])


def test_vendor_files(spark, tmp_path):
    (tmp_path / "6981.csv").write_text("preamble\nnote\nname,mkt,D,dt,time,o,h,l,c,v\nn,m,D,2024-01-05,,1,2,0.5,1.5,100\nn,m,D,--------,,1,2,3,4,5\nn,m,D,2024-01-09,,1,2,x,4,5\nn,m,D,2024-01-04,,2,3,1,2.5,NaN\n", encoding="utf-8")
    got = B.clean(B.read_vendor(spark, str(tmp_path), skip=3)).collect()
    assert [tuple(r) for r in got] == [("6981", dt.date(2024, 1, 5), 1.0, 2.0, 0.5, 1.5, 100.0)]


def test_metrics_with_one_class_and_ties(spark):
    rows = [(1, 0, 0, 0.1)] * 3 + [(2, 1, 1, 0.5), (2, 0, 1, 0.5), (2, 0, 0, 0.2), (2, 1, 0, 0.9)]
    got = {r["fold"]: r for r in walkforward.fold_metrics(spark.createDataFrame(rows, "fold int, y_true int, y_pred int, y_proba double")).collect()}
    assert got[1]["roc_auc"] is None and (got[1]["precision"], got[1]["recall"], got[1]["f1"], got[1]["accuracy"]) == (0, 0, 0, 1)
    assert abs(got[2]["roc_auc"] - 3.5 / 4) < 1e-12 and got[2]["precision"] == 0.5


def test_feature_selection_folds_model_and_sinks(spark, tmp_path):
    step2 = build_step2(build_step1(frame(spark, closes(520)).unionByName(frame(spark, closes(520, 1), "Y"))))
    step3 = build_step3(step2)
    features = walkforward.select_feature_columns(step3)
    assert len(features) == 28 and not {"close", "tb_return", "symbol"} & set(features)
    planted = step3.withColumn("tb_label", (F.col("mom5") > 0).cast("int"))
    out = walkforward.walk_forward_validation(planted, features, n_splits=2, rounds=6)
    metrics = out.fold_metrics.collect()
    assert [r["fold"] for r in metrics] == [1, 2] and all(r["roc_auc"] > 0.9 and r["train_end"] < r["test_start"] for r in metrics)
    assert out.feature_importance.first()["feature"] == "mom5" and out.predictions.count() == sum(r["n_test"] for r in metrics)
    loss = walkforward.permutation_importance(out.final_model, planted, ["mom5", "bb_pct_b"], 1, repeats=2).collect()
    assert max(loss, key=lambda r: r["importance"])["feature"] == "mom5"
    walkforward.save_walk_forward(out, str(tmp_path))
    B.write_step(build_step5(step3), str(tmp_path), "step5")
    again = B.read_step(spark, str(tmp_path), "step5")
    assert again.count() == step3.count() and reports.head(again).count() == 5
    back = walkforward.load_walk_forward(spark, str(tmp_path))
    assert back.predictions.count() == out.predictions.count() and back.fold_metrics.count() == 2
    scores = lambda m: [round(r["y_proba"], 9) for r in walkforward.predict(m, planted, 1).orderBy("symbol", "dt").collect()]
    assert scores(back.final_model) == scores(out.final_model)
    assert len(STEP1) == 26


def test_signal_order_and_missing_signals(spark):
    df = spark.createDataFrame([(signals.NEUTRAL, 1, 0.1), (signals.BULLISH, 0, 0.2)], "assist_signal string, tb_label int, tb_return double")
    assert [r["assist_signal"] for r in signals.evaluate_signal_quality(df).collect()] == [signals.BULLISH, signals.NEUTRAL]
    assert signals.evaluate_signal_quality(df.select("assist_signal")).columns == ["position", "assist_signal", "n"]
    counts = {r["assist_signal"]: r["n"] for r in reports.signal_counts(df).collect()}
    assert counts[signals.CAUTION] is None and counts[signals.BULLISH] == 1


def test_empty_tables(spark):
    empty = frame(spark, [1]).limit(0)
    assert build_step5(build_step3(build_step2(build_step1(empty)))).count() == 0
