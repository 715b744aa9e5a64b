import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom import queries as Q
from barloom.functions import ranges as R
from barloom.operators import domain, extremes, labels
from barloom.operators.asof import asof_backward
from barloom.plans import bucketed
from barloom.plans.steps import build_step1, build_step2, build_step3, build_step5
from test_bars import DAY, closes, frame

SF = "/root/testdata/sf0.001"


def rows_of(df, digits=9):
    return sorted(tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_numbers_and_running_sums_over_slices(spark):
    rng = random.Random(1)
    data = [(s, DAY + dt.timedelta(d), rng.randrange(100)) for s in "AB" for d in sorted(rng.sample(range(3000), 400))]
    df = spark.createDataFrame(data, "symbol string, dt date, v long")
    got = {(r["symbol"], r["dt"]): r["n"] for r in R.numbered(df, "n", ["symbol"], ["dt"], R.slice_of(days=50)).collect()}
    sums = {(r["symbol"], r["dt"]): r["s"] for r in R.running_sums(df, ["symbol"], ["dt"], {"v": "s"}, parts=7).collect()}
    for s in "AB":
        mine = sorted(x for x in data if x[0] == s)
        assert [got[x[:2]] for x in mine] == list(range(len(mine)))
        assert [sums[x[:2]] for x in mine] == [sum(y[2] for y in mine[:k]) for k in range(len(mine))]
    assert R.running_sums(df.limit(0), ["symbol"], ["dt"], {"v": "s"}).count() == 0


@pytest.mark.parametrize(("before", "after", "size"), [(3, 0, 10), (0, 4, 10), (25, 13, 8)])
def test_buckets_hold_their_neighbours(spark, before, after, size):
    df = frame(spark, list(range(1, 58))).unionByName(frame(spark, list(range(1, 8)), "Y"))
    window = Q.rows().rowsBetween(-before, after)
    add = lambda x: x.withColumn("seen", F.collect_list("close").over(window))
    key = lambda x: sorted((r["symbol"], r["dt"], r["seen"]) for r in x.collect())
    assert key(R.by_buckets(df, add, before, after, size, days=20)) == key(add(df))
    cut = R.spread(df, before, after, size)
    assert cut.select("symbol").distinct().count() >= 57 // size + 1 and cut.where("__own").count() == 64


def bars(spark):
    return frame(spark, closes(700)).unionByName(frame(spark, closes(420, 2), "Y")).unionByName(frame(spark, closes(3, 1), "Z"))


def test_steps_by_buckets_equal_steps_by_symbol(spark):
    daily = bars(spark)
    one = build_step1(daily)
    by = bucketed.build_step1_buckets(daily, size=64)
    assert rows_of(by) == rows_of(one) and one.count() > 500
    two, two_by = build_step2(one), bucketed.build_step2_buckets(by, size=64)
    assert rows_of(two_by.select(two.columns)) == rows_of(two)
    for spec in (labels.BarrierSpec(), labels.BarrierSpec(mode="fixed_pct", tp_pct=0.02, sl_pct=0.01), labels.BarrierSpec(holding_period=100)):
        three, three_by = build_step3(two, spec), bucketed.build_step3_buckets(two_by, spec, size=64)
        assert rows_of(three_by.select(three.columns)) == rows_of(three) and three.count() > 100
    five = build_step5(build_step3(two))
    assert rows_of(bucketed.build_step5_buckets(bucketed.build_step3_buckets(two_by, size=64), size=64).select(five.columns)) == rows_of(five)


@pytest.mark.parametrize("horizon", [1, 2, 3, 7, 10, 45, 500])
def test_doubling_tables_find_first_touches(horizon):
    rng = np.random.default_rng(horizon)
    n = 700
    high = np.round(rng.normal(100, 3, n), 1)
    level = np.where(rng.random(n) < 0.1, np.nan, np.round(high + rng.normal(6, 4, n), 1))
    got = extremes.climb(extremes.doubling(high, horizon), level, horizon, 1.0)
    want = [next((k for k in range(1, horizon + 1) if i + k < n and high[i + k] >= level[i]), 0) for i in range(n)]
    assert got.tolist() == want
    low = -high
    got = extremes.climb(extremes.doubling(-low, horizon), -level, horizon, -1.0)
    assert got.tolist() == want


@pytest.mark.parametrize("horizon", [10, 45, 500])
def test_labels_by_doubling_equal_lists_of_rows_ahead(spark, horizon):
    df = bars(spark).withColumn("atr14", F.when(F.dayofmonth("dt") != 3, 1.5 + F.dayofmonth("dt") / 10))
    spec = labels.BarrierSpec(holding_period=horizon)
    want = labels.apply_forward_drawdown(labels.apply_triple_barrier(df, spec), horizon)
    got = bucketed.label_by_doubling(df, spec, size=100)
    key = lambda x: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x.select(want.columns).collect()), key=repr)
    assert key(got) == key(want)


@pytest.mark.parametrize("n", [1, 2, 5, 20, 500])
def test_block_minima_equal_sliding_ones(spark, n):
    rng = random.Random(n)
    df = frame(spark, [rng.choice((5, 6, 7, 8)) for _ in range(640)]).unionByName(frame(spark, [3, 2, 1], "Y"))
    df = df.withColumn("close", F.when(F.dayofmonth("dt") != 9, F.col("close")))
    low = F.when(F.col("close").isNotNull(), F.struct("close", "dt"))
    want = df.withColumn("m", F.when(F.count("*").over(Q.rows().rowsBetween(-n + 1, 0)) == n, F.min(low).over(Q.rows().rowsBetween(-n + 1, 0))))
    key = lambda x: sorted(((r["symbol"], r["dt"], r["m"]) for r in x.collect()), key=repr)
    assert key(extremes.sliding_min(df, low, n, "m")) == key(want)


@pytest.mark.parametrize("lookback", [5, 20, 500])
def test_divergence_by_blocks(spark, lookback):
    rng = random.Random(lookback)
    df = frame(spark, [rng.choice((5, 6, 7)) for _ in range(640)]).withColumn("rsi14", F.pmod(F.xxhash64("dt"), F.lit(100)).cast("double"))
    want = domain.detect_rsi_bullish_divergence(df, lookback)
    assert rows_of(bucketed.detect_divergence_by_blocks(df, lookback).select(want.columns)) == rows_of(want)
    assert lookback == 500 or want.where("rsi_bullish_divergence = 1").count() > 0


def test_asof_by_buckets(spark):
    rng = random.Random(3)
    left = spark.createDataFrame([(s, DAY + dt.timedelta(d), d) for s in "ABC" for d in sorted(rng.sample(range(2000), 300))], "symbol string, dt date, k int")
    right = spark.createDataFrame([(s, DAY + dt.timedelta(d), float(d) if d % 3 else None, "x") for s in "ABD" for d in sorted(rng.sample(range(300, 1500), 40))], "symbol string, at date, v double, w string")
    want = asof_backward(left, right, "symbol", "dt", "at", ["v", "w"])
    for days in (1, 30, 256):
        got = extremes.asof_by_buckets(left, right, "symbol", "dt", "at", ["v", "w"], days)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 64, 100, 1000, 4097])
def test_shuffled_numbers_are_a_permutation(spark, n):
    df = spark.range(n).select(*[R.shuffled(F.col("id"), F.lit(n), F.lit(42), F.lit(k)).alias(f"p{k}") for k in range(3)])
    got = [sorted(r[k] for r in df.collect()) for k in range(3)]
    assert got == [list(range(n))] * 3
    if n >= 64:
        rows = df.collect()
        assert [r[0] for r in rows] != [r[1] for r in rows] and sum(r[0] == k for k, r in enumerate(rows)) < n / 8


def driver_shuffled(i, n, *keys):
    """The same with Python integers."""
    a = 1
    while a * a < n:
        a += 1
    b = -(-n // a)
    key = 0
    for k in keys:
        key = (key * 8191 + k % R.PRIME + 12_345) % R.PRIME
    push = lambda half, step: ((half % R.PRIME + key + step * 1_000_003) % R.PRIME) ** 2 % R.PRIME
    while True:
        left, right = divmod(i, b)
        for k in range(1, R.ROUNDS + 1):
            left = (left + push(right, 2 * k)) % a
            right = (right + push(left, 2 * k + 1)) % b
        i = left * b + right
        if i < n:
            return i


def test_shuffled_numbers_equal_the_driver_version(spark):
    n = 2500
    got = [r[0] for r in spark.range(n).orderBy("id").select(R.shuffled(F.col("id"), F.lit(n), F.lit(7), F.lit(3))).collect()]
    assert got == [driver_shuffled(i, n, 7, 3) for i in range(n)]
    big = 3_000_000_019
    assert [r[0] for r in spark.range(5).orderBy("id").select(R.shuffled(F.col("id") * 599_999_999, F.lit(big), F.lit(1))).collect()] == [driver_shuffled(i * 599_999_999, big, 1) for i in range(5)]
