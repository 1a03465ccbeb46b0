"""Model fit, walk-forward evaluation, prediction and bundles on pyspark.ml."""

from __future__ import annotations

import json
import random
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import evaluate

#: A missing value is put far below all others, so that a tree can tell it.
MISSING = -1e6


def boosted_trees(**params) -> GBTClassifier:
    return GBTClassifier(featuresCol="_features", labelCol="_label", seed=7, **{"maxIter": 20, "maxDepth": 4, **params})


def logistic(**params) -> LogisticRegression:
    return LogisticRegression(featuresCol="_features", labelCol="_label", **{"maxIter": 50, "regParam": 0.01, **params})


def prepared(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """Features as doubles without NULL, and with a label the 0/1 _label of rows that went up or down."""
    out = df.withColumns({f"_f{i}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for i, c in enumerate(features)})
    if label is None:
        return out
    return out.where(F.col(label).isNotNull() & (F.col(label) != 0)).withColumn("_label", (F.col(label) > 0).cast("double"))


def fit(df: DataFrame, features: list[str], label: str, factory: Callable = boosted_trees) -> PipelineModel:
    stages = [VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_features"), factory()]
    return Pipeline(stages=stages).fit(prepared(df, features, label))


def predict(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """`df` with proba_up and pred_direction (1 or -1)."""
    lacking = [c for c in features if c not in df.columns]
    if lacking:
        raise ValueError(f"table lacks {lacking}")
    out = model.transform(prepared(df, features)).withColumn("proba_up", vector_to_array("probability")[1])
    own = [F.col(c) for c in df.columns]
    return out.select(*own, "proba_up", F.when(F.col("proba_up") >= 0.5, 1).otherwise(-1).alias("pred_direction"))


def walk_forward(df: DataFrame, features: list[str], label: str, group: str, keys: list[str], n_splits: int = 5, factory: Callable = boosted_trees) -> DataFrame:
    """keys, fold, label, pred_direction, proba_up, majority of every tested row, over folds that divide no group."""
    chunked = evaluate.assign_chunks(df.where(F.col(label).isNotNull() & (F.col(label) != 0)), group, n_splits)
    last = chunked.agg(F.max("chunk")).first()[0] or 0
    out = None
    for k in range(1, last + 1):
        train, test = chunked.where(F.col("chunk") < k), chunked.where(F.col("chunk") == k)
        model = fit(train, features, label, factory)
        base = evaluate.majority(train, label)
        part = predict(model, test, features).join(F.broadcast(base), F.lit(True)).select(*keys, F.lit(k).alias("fold"), label, "pred_direction", "proba_up", "majority")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("too few groups for a fold")
    return out


def fold_metrics(predictions: DataFrame, label: str) -> DataFrame:
    """One row a fold: the metrics of evaluate.binary_metrics(), the baseline's accuracy, and the exact test against it."""
    p = predictions.withColumn("_t", (F.col(label) > 0).cast("int")).withColumn("_p", (F.col("pred_direction") > 0).cast("int")).withColumn("_b", (F.col("majority") > 0).cast("int"))
    metrics = evaluate.binary_metrics(p, "_t", "_p", "proba_up", "fold")
    base = p.groupBy("fold").agg(F.avg((F.col("_t") == F.col("_b")).cast("double")).alias("majority_baseline_accuracy"))
    tested = evaluate.mcnemar(evaluate.mcnemar_counts(p, "_t", "_p", "_b", "fold"))
    out = metrics.join(base, "fold").join(tested, "fold")
    return out.withColumn("beats_baseline", F.col("accuracy") > F.col("majority_baseline_accuracy")).withColumn("significantly_beats_baseline", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def importances(model: PipelineModel, features: list[str], spark: SparkSession, fold: int = 0) -> DataFrame:
    """(fold, feature, importance); none where the model has no importances."""
    found = getattr(model.stages[-1], "featureImportances", None)
    rows = [] if found is None else [(fold, f, float(v)) for f, v in zip(features, found.toArray())]
    return spark.createDataFrame(rows, "fold int, feature string, importance double")


def importance_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("feature").agg(F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("std"))


def save_bundle(model: PipelineModel, features: list[str], metadata: dict, path: str, spark: SparkSession) -> None:
    """Model and, beside it, the feature list and metadata it must be used with."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps({"features": features, **metadata}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_bundle(path: str, spark: SparkSession) -> tuple[PipelineModel, dict]:
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if "features" not in metadata:
        raise KeyError("bundle without a feature list")
    return PipelineModel.load(f"{path}/model"), metadata


def search(df: DataFrame, features: list[str], label: str, group: str, keys: list[str], space: dict[str, list], trials: int, seed: int = 0, n_splits: int = 3, factory: Callable = boosted_trees) -> list[tuple[float, dict]]:
    """(mean accuracy, parameters), best first: `trials` random points of the grid, each evaluated walk-forward."""
    rng, seen, out = random.Random(seed), set(), []
    for _ in range(trials):
        params = {k: rng.choice(v) for k, v in sorted(space.items())}
        mark = json.dumps(params, sort_keys=True)
        if mark in seen:
            continue
        seen.add(mark)
        found = walk_forward(df, features, label, group, keys, n_splits, lambda params=params: factory(**params))
        out.append((found.agg(F.avg((F.col(label) == F.col("pred_direction")).cast("double"))).first()[0], params))
    return sorted(out, key=lambda x: (-x[0], json.dumps(x[1], sort_keys=True)))


def local_search(df: DataFrame, features: list[str], label: str, group: str, keys: list[str], space: dict[str, list], start: dict, seen: list[tuple[float, dict]] = (), most: int = 50, n_splits: int = 3, factory: Callable = boosted_trees) -> list[tuple[float, dict]]:
    """(mean accuracy, parameters), best first: from `start`, the best neighbour on the grid as long as one is better, at most `most` points.

    `seen` are results of search() on the same rows, which are not fitted again.
    """
    known = {json.dumps(p, sort_keys=True): (score, p) for score, p in seen}
    fitted = 0

    def score(params: dict) -> float:
        nonlocal fitted
        mark = json.dumps(params, sort_keys=True)
        if mark not in known:
            fitted += 1
            found = walk_forward(df, features, label, group, keys, n_splits, lambda: factory(**params))
            known[mark] = (found.agg(F.avg((F.col(label) == F.col("pred_direction")).cast("double"))).first()[0], params)
        return known[mark][0]

    best = (score(start), start)
    while fitted < most:
        around = [(score(p), p) for p in neighbours(best[1], space) if fitted < most]
        better = max(around, key=lambda x: (x[0], json.dumps(x[1], sort_keys=True)), default=best)
        if better[0] <= best[0]:
            break
        best = better
    return sorted(known.values(), key=lambda x: (-x[0], json.dumps(x[1], sort_keys=True)))


def neighbours(params: dict, space: dict[str, list]) -> list[dict]:
    """Points one grid step from `params`, without repeats."""
    out = []
    for name, values in sorted(space.items()):
        at = values.index(params[name])
        out += [{**params, name: values[i]} for i in (at - 1, at + 1) if 0 <= i < len(values)]
    return out


def telltale_features(df: DataFrame, features: list[str], period: str, drop: int = 4) -> list[str]:
    """The features by which a model best tells two periods (a -1/1 column) apart, to leave out in an ablation."""
    found = fit(df, features, period).stages[-1].featureImportances.toArray()
    return [f for _, f in sorted(zip(found, features), key=lambda x: (-x[0], x[1]))[:drop]]
