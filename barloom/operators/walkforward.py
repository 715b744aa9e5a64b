"""Walk-forward validation: expanding folds by date, boosted trees, predictions, metrics and importances."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import DATE, SYMBOL, ratio
from barloom.functions.ranges import numbered, running_sums, shuffled, slice_of
from barloom.sources.store import stored

# Columns that are no features: prices and levels, targets, and what is known only afterwards (fixed values)
EXCLUDED = {"open", "high", "low", "close", "volume", "ma25", "ma75", "weekly_ma5", "weekly_ma13", "atr14", "tb_label", "avoid_entry_flag", "tb_barrier", "tb_days_to_touch", "tb_return", "forward_max_drawdown", SYMBOL, DATE}


TASK_ROWS = 100_000  # training rows of a task, at least


def select_feature_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in EXCLUDED and isinstance(f.dataType, T.NumericType)]


def date_folds(df: DataFrame, n_splits: int = 5, purge_rows: int = 0) -> DataFrame:
    """(dt, n, fold, role): each date's rows and its role, train or test, in each fold that uses it.

    The distinct dates are cut like a sorted series: the last n_splits blocks of len // (n_splits + 1) dates are tested,
    each after training on all dates before it, less `purge_rows` of them. With one symbol dates are rows.
    """
    dates = df.groupBy(DATE).agg(F.count("*").alias("n"))
    whole = Window.orderBy(DATE)
    numbered = dates.withColumns({"__i": F.row_number().over(whole) - 1, "__all": F.count("*").over(Window.partitionBy())})
    block = F.floor(F.col("__all") / (n_splits + 1))
    fold = F.explode(F.sequence(F.lit(1), F.lit(n_splits)))
    out = numbered.select("*", block.alias("__ts"), fold.alias("fold"))
    start = F.col("__all") - (n_splits + 1 - F.col("fold")) * F.col("__ts")
    role = F.when(F.col("__i") < start - purge_rows, "train").when((F.col("__i") >= start) & (F.col("__i") < start + F.col("__ts")), "test")
    return out.select(DATE, "n", "fold", role.alias("role")).where("role is not null")


def fold_table(folds: DataFrame, min_train_size: int = 100) -> DataFrame:
    """First and last date and rows of either part of each fold; folds with too few training rows are left out."""
    part = lambda f, role, c: f(F.when(F.col("role") == role, F.col(c)))
    return folds.groupBy("fold").agg(
        part(F.min, "train", DATE).alias("train_start"), part(F.max, "train", DATE).alias("train_end"), part(F.min, "test", DATE).alias("test_start"), part(F.max, "test", DATE).alias("test_end"),
        F.coalesce(part(F.sum, "train", "n"), F.lit(0)).alias("n_train"), F.coalesce(part(F.sum, "test", "n"), F.lit(0)).alias("n_test"),
    ).where((F.col("n_train") >= min_train_size) & (F.col("n_test") > 0))


def classifier(rounds: int = 300, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(labelCol="__label", featuresCol="__features", maxIter=rounds, maxDepth=5, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed, checkpointInterval=20)


def fit(train: DataFrame, features: list[str], target: str = "tb_label", rounds: int = 300) -> PipelineModel:
    assembler = VectorAssembler(inputCols=features, outputCol="__features")
    return Pipeline(stages=[assembler, classifier(rounds)]).fit(train.withColumn("__label", F.col(target).cast("double")))


def predict(model: PipelineModel, test: DataFrame, fold: int, target: str = "tb_label") -> DataFrame:
    out = model.transform(test)
    return out.select(SYMBOL, DATE, F.lit(fold).alias("fold"), F.col(target).alias("y_true"), F.col("prediction").cast("int").alias("y_pred"), vector_to_array("probability")[1].alias("y_proba"))


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and f1 (0 where undefined) and ROC-AUC (null with one class) of each fold, exactly.

    Predictions are read once: their distinct scores are written in ranges, which no task holds a whole fold of.
    """
    is_ = lambda c, v: (F.col(c) == v)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    scores = predictions.groupBy("fold", "y_proba").agg(
        F.count("*").alias("n"), count(is_("y_true", 1) & is_("y_pred", 1)).alias("tp"), count(is_("y_true", 0) & is_("y_pred", 1)).alias("fp"), count(is_("y_true", 1) & is_("y_pred", 0)).alias("fn"),
        count(is_("y_true", F.col("y_pred"))).alias("ok"), count(is_("y_true", 1)).alias("p"),
    )
    # equal scores share their average rank; how many rows have lower ones comes from sums over ranges of scores
    ranked = running_sums(scores, ["fold"], ["y_proba"], {"n": "before"}).withColumn("ranks", F.col("p") * (F.col("before") + (F.col("n") + 1) / 2))
    sums = ranked.groupBy("fold").agg(*[F.sum(c).alias(c) for c in ("n", "tp", "fp", "fn", "ok", "p", "ranks")])
    zero = F.lit(0.0)
    precision, recall = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), zero), F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), zero)
    f1 = F.coalesce(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero)
    auc = ratio(F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p")))
    return sums.select("fold", F.col("n").alias("n_test"), (F.col("ok") / F.col("n")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), auc.alias("roc_auc"))


def mean_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.avg(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")])


def model_importance(model: PipelineModel, features: list[str], fold: int, like: DataFrame) -> DataFrame:
    """(fold, feature, importance) by the trees' own measure."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return like.sparkSession.createDataFrame([(fold, f, float(v)) for f, v in zip(features, values, strict=True)], "fold int, feature string, importance double")


def with_permuted(test: DataFrame, features: list[str], fold: int, repeats: int = 5, seed: int = 42) -> DataFrame:
    """test's rows for each feature and repeat (__feature, __repeat), with that feature's values dealt anew among the rows.

    Rows are numbered by date and symbol, and a keyed bijection of the numbers says whose value a row gets, so each
    repeat is one join and nothing is sorted by variant. The features of a repeat are dealt by the same bijection, one
    at a time. test is written once.
    """
    values = [F.col(f).cast("double").alias(f) for f in features]
    others = [c for c in test.columns if c not in features]
    rows = stored(numbered(test.select(*others, *values), "__i", [], [DATE, SYMBOL], slice_of()))
    n = rows.count()
    donors = rows.select(F.col("__i").alias("__from"), F.struct(*features).alias("__other"))
    each = rows.withColumn("__repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    moved = each.withColumn("__from", shuffled(F.col("__i"), F.lit(n).cast("long"), F.lit(seed), F.lit(fold), F.col("__repeat"))).join(donors, "__from") if n else each.withColumn("__other", F.struct(*features)).where("false")
    many = moved.withColumn("__feature", F.explode(F.array(*[F.lit(f) for f in features])))
    return many.withColumns({f: F.when(F.col("__feature") == f, F.col(f"__other.{f}")).otherwise(F.col(f)) for f in features}).drop("__i", "__from", "__other")


def accuracy_lost(permuted: DataFrame, test: DataFrame, right: Callable[[DataFrame], DataFrame], fold: int) -> DataFrame:
    """(fold, feature, importance): the accuracy on test less that on its permuted rows, averaged over repeats."""
    base = right(test).agg(F.avg("__ok").alias("__base"))
    lost = right(permuted).groupBy(F.col("__feature").alias("feature")).agg(F.avg("__ok").alias("__got"))
    return lost.crossJoin(F.broadcast(base)).select(F.lit(fold).alias("fold"), "feature", (F.col("__base") - F.col("__got")).alias("importance"))


def permutation_importance(model: PipelineModel, test: DataFrame, features: list[str], fold: int, target: str = "tb_label", repeats: int = 5, seed: int = 42) -> DataFrame:
    """(fold, feature, importance): the mean loss of accuracy when the values of one of these features are dealt anew among the
    rows. model is one of fit()'s."""
    right = lambda df: model.transform(df).withColumn("__ok", (F.col("prediction") == F.col(target)).cast("double"))
    small = test.select(SYMBOL, DATE, target, *model.stages[0].getInputCols())
    return accuracy_lost(with_permuted(small, features, fold, repeats, seed), small, right, fold)


def label_ends(labelled: DataFrame, days_col: str = "tb_days_to_touch") -> DataFrame:
    """labelled, all rows that labels count (step 2's), with label_end: the date on which a row's label is known, days_col rows
    on; null where there is no label. Rows are found by number, so the horizon does not matter. labelled is read three times."""
    rows = numbered(labelled, "__i", [SYMBOL], [DATE], slice_of())
    ends = numbered(labelled.select(SYMBOL, DATE), "__to", [SYMBOL], [DATE], slice_of()).withColumnRenamed(DATE, "label_end")
    return rows.withColumn("__to", F.col("__i") + F.col(days_col)).join(ends, [SYMBOL, "__to"], "left").drop("__i", "__to")


def purged(train: DataFrame, test: DataFrame, by: list[str] = [SYMBOL]) -> DataFrame:  # noqa: B006
    """The rows of train(*by, dt, label_end, ...) whose label does not reach into the dates tested: an anti-join of the intervals
    from dt to label_end with the span of test(*by, dt) of the same symbol (and fold)."""
    spans = test.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min(DATE).alias("__first"), F.max(DATE).alias("__last"))
    same = reduce(and_, [F.col(c) == F.col(f"__{c}") for c in by])
    overlap = (F.col(DATE) <= F.col("__last")) & (F.coalesce("label_end", DATE) >= F.col("__first"))
    return train.join(spans, same & overlap, "left_anti")


def mean_importance(importance: DataFrame) -> DataFrame:
    return importance.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature")


@dataclass(frozen=True)
class WalkForward:
    fold_metrics: DataFrame
    feature_importance: DataFrame
    predictions: DataFrame
    final_model: PipelineModel | None
    fold_models: dict[int, PipelineModel] = field(default_factory=dict)
    fold_tests: dict[int, DataFrame] = field(default_factory=dict)
    features: list[str] = field(default_factory=list)


def walk_forward_validation(
    df: DataFrame, features: list[str] | None = None, target: str = "tb_label", n_splits: int = 5, min_train_size: int = 100, rounds: int = 300, purge_rows: int = 0, purge_labels: bool = False, permute: bool = False, final: bool = True
) -> WalkForward:
    """One model for all symbols, folds by date. What the driver holds is the fold table and the models.

    Boosting rounds follow each other, but folds do not: their fits (and the final one, on all rows, if asked for) are
    submitted together, so that their jobs share the cluster. The input, the folds and the predictions are written
    once. purge_rows leaves that many dates out before each test; purge_labels leaves out the training rows whose
    label_end (see label_ends()) reaches into the test, and needs that column.
    """
    features = [f for f in features or select_feature_columns(df)]
    if purge_labels and "label_end" not in df.columns:
        raise KeyError("purge_labels needs the column label_end; run label_ends first")
    frame = stored(df)
    folds = stored(date_folds(frame, n_splits, purge_rows))
    table = stored(fold_table(folds, min_train_size))
    sizes = {r["fold"]: r["n_train"] for r in table.select("fold", "n_train").collect()}
    numbers = sorted(sizes)
    if not numbers:
        raise ValueError("no fold has enough training rows")
    of = lambda k, role: frame.join(folds.where((F.col("fold") == k) & (F.col("role") == role)).select(DATE), DATE, "left_semi")
    train = lambda k: purged(of(k, "train"), of(k, "test")) if purge_labels else of(k, "train")
    with ThreadPoolExecutor(len(numbers) + 1) as pool:
        # every level of every tree is a job; few rows are not spread over more tasks than they need
        fits = [pool.submit(fit, train(k).coalesce(1 + sizes[k] // TASK_ROWS), features, target, rounds) for k in numbers]
        last = pool.submit(fit, frame, features, target, rounds) if final else None
        models = {k: x.result() for k, x in zip(numbers, fits, strict=True)}
        final_model = last.result() if final else None
    tests = {k: of(k, "test") for k in numbers}
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    predictions = stored(union([predict(m, tests[k], k, target) for k, m in models.items()]))
    importance = [permutation_importance(m, tests[k], features, k, target) if permute else model_importance(m, features, k, df) for k, m in models.items()]
    metrics = stored(table.join(fold_metrics(predictions).drop("n_test"), "fold").orderBy("fold"))
    return WalkForward(metrics, mean_importance(union(importance)), predictions, final_model, models, tests, features)


def save_walk_forward(result: WalkForward, root: str) -> None:
    """Three tables and the model under one folder."""
    for name in ("fold_metrics", "feature_importance", "predictions"):
        getattr(result, name).write.mode("overwrite").parquet(f"{root.rstrip('/')}/step4_{name}")
    if result.final_model is None:
        raise ValueError("there is no final model to save")
    result.final_model.write().overwrite().save(f"{root.rstrip('/')}/step4_model")


def load_walk_forward(spark: SparkSession, root: str) -> WalkForward:
    """What save_walk_forward() wrote."""
    at = root.rstrip("/")
    tables = [spark.read.parquet(f"{at}/step4_{name}") for name in ("fold_metrics", "feature_importance", "predictions")]
    return WalkForward(*tables, PipelineModel.load(f"{at}/step4_model"))
