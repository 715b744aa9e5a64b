import datetime as dt
import shutil
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from barloom import queries
from barloom.operators import walkforward
from barloom.plans.steps import build_step1, build_step2
from test_bars import DAY, closes, frame

SF = "/root/testdata/sf0.001"


def test_model_queries_fit_300_rounds_and_notice_changed_tables(spark, monkeypatch, tmp_path):
    asked = []
    importance = spark.createDataFrame([(f"f{k}", k / 20) for k in range(20)], "feature string, importance double")

    def validation(df, rounds=300, final=True):
        asked.append((rounds, final))
        return SimpleNamespace(predictions="predictions", feature_importance=importance, fold_metrics="metrics")

    monkeypatch.setattr(walkforward, "walk_forward_validation", validation)
    monkeypatch.setattr(queries, "step3", lambda s, d: None)
    monkeypatch.setattr(queries, "WALKED", queries.OrderedDict())
    found = queries.queries()
    at = [str(tmp_path / f"d{k}") for k in range(3)]
    for k, d in enumerate(at):
        (tmp_path / f"d{k}").mkdir()
        shutil.copy(f"{SF}/lineitem.parquet", f"{d}/lineitem.parquet")
    assert found["model_predictions"](spark, at[0]) == "predictions" and found["model_importance"](spark, at[0]) is importance
    assert found["model_fold_metrics"](spark, at[0]) == "metrics"
    assert [r["feature"] for r in found["model_top_importance"](spark, at[0]).collect()] == [f"f{k}" for k in range(19, 4, -1)]
    assert asked == [(300, False)] and not {n for n in found if n.startswith("model_")} & set(queries.oracle_sql())
    shutil.copy(f"{SF}/orders.parquet", f"{at[0]}/lineitem.parquet")  # another table under the same path
    found["model_predictions"](spark, at[0])
    assert len(asked) == 2
    for d in at[1:]:
        found["model_predictions"](spark, d)
    assert len(asked) == 4 and len(queries.WALKED) == 2


def planted(spark):
    step2 = build_step2(build_step1(frame(spark, closes(520)).unionByName(frame(spark, closes(520, 1), "Y"))))
    return step2.withColumns({"tb_label": (F.col("mom5") > 0).cast("int"), "tb_days_to_touch": F.lit(7)})


def test_walks_write_once_and_purge(spark, monkeypatch):
    df = walkforward.label_ends(planted(spark)).dropna(subset=["label_end"])
    walk = walkforward.walk_forward_validation(df, ["mom5", "bb_pct_b"], n_splits=2, rounds=3, purge_labels=True, final=False)
    plan = walk.predictions._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Exchange" not in plan
    assert sorted(walk.fold_models) == [1, 2] and walk.fold_metrics.count() == 2
    loss = {r["feature"]: r["importance"] for r in walkforward.permutation_importance(walk.fold_models[2], walk.fold_tests[2], walk.features, 2).collect()}
    assert loss["mom5"] > 0.2 and abs(loss["bb_pct_b"]) < 0.1
    with pytest.raises(KeyError):
        walkforward.walk_forward_validation(planted(spark), ["mom5"], rounds=1, purge_labels=True)


def test_permuted_rows_keep_all_but_one_column(spark):
    test = spark.createDataFrame([("X" if k % 3 else "Y", DAY + dt.timedelta(k), k % 2, float(k), float(-k)) for k in range(100)], "symbol string, dt date, tb_label int, a double, b double")
    rows = walkforward.with_permuted(test, ["a", "b"], 1, repeats=3).collect()
    assert len(rows) == 600
    for f, other, sign in (("a", "b", -1), ("b", "a", 1)):
        for repeat in (1, 2, 3):
            mine = [r for r in rows if (r["__feature"], r["__repeat"]) == (f, repeat)]
            assert sorted(r[f] for r in mine) == sorted(float(-sign * k) for k in range(100))
            assert all(r[other] == sign * (r["dt"] - DAY).days for r in mine) and sum(abs(r[f]) != abs(r[other]) for r in mine) > 80
    empty = walkforward.with_permuted(test.limit(0), ["a"], 1)
    assert empty.count() == 0


def test_purged_rows_are_those_whose_labels_reach_the_test(spark):
    day = lambda k: DAY + dt.timedelta(k)
    rows = [(s, day(k), 3 if s == "X" else 5) for s in "XY" for k in range(20)]
    ends = walkforward.label_ends(spark.createDataFrame(rows, "symbol string, dt date, tb_days_to_touch int"))
    got = {(r["symbol"], r["dt"]): r["label_end"] for r in ends.collect()}
    assert got["X", day(2)] == day(5) and got["Y", day(2)] == day(7) and got["X", day(17)] is None
    train, test = ends.where(F.col("dt") < F.lit(day(12))), ends.where((F.col("dt") >= F.lit(day(12))) & (F.col("dt") < F.lit(day(15))) & ((F.col("symbol") == "X") | (F.col("dt") > F.lit(day(12)))))
    left = {(r["symbol"], r["dt"]) for r in walkforward.purged(train, test).collect()}
    assert left == {("X", day(k)) for k in range(9)} | {("Y", day(k)) for k in range(8)}
    assert walkforward.purged(train, test.limit(0)).count() == 24


def test_purge_rows_leave_out_dates_before_the_test(spark):
    df = frame(spark, list(range(1, 121)))
    plain, gap = ({(r["fold"], r["role"]): r["n"] for r in walkforward.date_folds(df, 5, k).groupBy("fold", "role").count().withColumnRenamed("count", "n").collect()} for k in (0, 4))
    assert all(gap[f, "train"] == plain[f, "train"] - 4 and gap[f, "test"] == plain[f, "test"] for f in range(1, 6))
    last = walkforward.date_folds(df, 5, 4).where("fold = 1 and role = 'train'").agg(F.max("dt")).first()[0]
    first = walkforward.date_folds(df, 5, 4).where("fold = 1 and role = 'test'").agg(F.min("dt")).first()[0]
    assert (first - last).days == 5


def test_folds_with_few_training_rows_are_left_out(spark):
    folds = walkforward.date_folds(frame(spark, list(range(1, 241))))
    assert [r["fold"] for r in walkforward.fold_table(folds).orderBy("fold").collect()] == [3, 4, 5]
    assert [r["fold"] for r in walkforward.fold_table(folds, 41).orderBy("fold").collect()] == [2, 3, 4, 5]
