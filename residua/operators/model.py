"""Regularised logistic regression: a fit, the seven fits of a training in one set of passes, scoring and storage."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.operators.sampling import class_quotas, stratified_folds, stratified_split
from residua.operators.scoring import class_name
from residua.scratch import materialize

MAX_ITERATIONS = 1000
STRENGTH = 1.0
#: Partial sums up to which the driver adds them itself, a set of at most this many for each fit.
TREE_PARTS = 4
PACKED = "fit int, sums binary"


def fit(df: DataFrame, features: str = "features", label: str = "label", strength: float = STRENGTH) -> LogisticRegressionModel:
    """Sum of losses times ``strength`` plus half the squared weights: Spark's mean loss needs 1 / (strength * rows)."""
    rows = df.count()
    data = df.select(array_to_vector(F.col(features)).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=MAX_ITERATIONS, regParam=1.0 / (strength * rows), elasticNetParam=0.0, standardization=False, tol=1e-9).fit(data)


def score(model: LogisticRegressionModel, df: DataFrame, features: str = "features") -> DataFrame:
    """Adds ``prediction`` (0 or 1), ``class_name`` and ``probability`` of class 1 in one pass."""
    data = df.withColumn("__x", array_to_vector(F.col(features)))
    out = model.setFeaturesCol("__x").transform(data)
    return out.withColumns({"probability": vector_to_array("probability")[1], "prediction": F.col("prediction").cast("int")}).withColumn("class_name", class_name(F.col("prediction") == 1)).drop("__x", "rawPrediction")


@dataclass
class Training:
    model: LogisticRegressionModel
    train_accuracy: float
    test_accuracy: float
    cv_mean: float
    cv_two_std: float
    steps: int = 0


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column as a matrix with a column of ones behind."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def members(test: np.ndarray, fold: np.ndarray, folds: int) -> np.ndarray:
    """Which rows each fit takes: of the training part all, then all but each fold, and last every row."""
    return np.stack([~test, *(~test & (fold != k) for k in range(folds)), np.ones(len(test), bool)])


def tree_sum(sums: DataFrame, fits: int, size: int) -> np.ndarray:
    """Sums of packed doubles by ``fit``, added up in the cluster in stages until few rows are left for the driver."""
    parts = sums.rdd.getNumPartitions()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column("fit").to_pylist(), batch.column("sums"), strict=True):
                got = np.frombuffer(packed.as_buffer(), np.float64)
                total[k] = total[k] + got if k in total else got.copy()
        if total:
            yield _packed(total)

    while parts > TREE_PARTS:
        parts = math.ceil(math.sqrt(parts))
        sums = sums.repartition(parts).mapInArrow(add, PACKED)
    rows = sums.toArrow()
    out = np.zeros((fits, size))
    for k, packed in zip(rows.column("fit").to_pylist(), rows.column("sums"), strict=True):
        out[k] += np.frombuffer(packed.as_buffer(), np.float64)
    return out


def _packed(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["fit", "sums"])


def pass_over(rows: DataFrame, weights: np.ndarray, folds: int, what: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """One job: the ``size`` sums of ``what`` (features, labels, rows' margins, whether a row is taken) of each fit over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                some = batch.slice(lo, 2000)
                x, y = matrix(some.column("features")), some.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
                test, fold = (some.column(c).to_numpy(zero_copy_only=False) for c in ("is_test", "fold"))
                taken = members(test.astype(bool), fold, folds)
                for k, w in enumerate(weights):
                    got = what(x, y, x @ w, taken[k])
                    total[k] = total[k] + got if k in total else got
        if total:
            yield _packed(total)

    found = rows.select("features", "label", "is_test", "fold").mapInArrow(run, PACKED)
    return tree_sum(found, len(weights), size)


def newton_sums(x: np.ndarray, y: np.ndarray, z: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of a fit's rows, side by side."""
    x, y, z = x[taken], y[taken], z[taken]
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    loss = np.logaddexp(0, z) - y * z
    return np.concatenate([[loss.sum()], x.T @ (p - y), (x.T @ (x * (p * (1 - p))[:, None])).ravel()])


def right_sums(x: np.ndarray, y: np.ndarray, z: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Rows and right answers among those that a fit takes, and among the others."""
    right = (z > 0) == (y == 1)
    return np.array([taken.sum(), (taken & right).sum(), (~taken).sum(), (~taken & right).sum()], np.float64)


def fit_all(rows: DataFrame, folds: int, strength: float = STRENGTH) -> tuple[np.ndarray, int]:
    """Weights (the intercept last) of the hold-out fit, of each fold's fit and of the fit of all rows, and the passes made.

    Newton steps of all fits at once: a pass adds up every fit's loss, gradient and Hessian. A step that
    doesn't lessen its fit's loss is halved, so that each comes to the one minimum.
    """
    width = len(rows.select("features").first()[0]) + 1
    weights = np.zeros((folds + 2, width))
    steps, losses, open_ = np.zeros_like(weights), np.full(folds + 2, np.inf), np.ones(folds + 2, bool)
    penalty = np.append(np.ones(width - 1), 0.0)
    passes = 0
    for passes in range(1, MAX_ITERATIONS + 1):
        sums = pass_over(rows, weights, folds, newton_sums, 1 + width + width * width)
        for k in np.flatnonzero(open_):
            w = weights[k]
            loss = strength * sums[k, 0] + 0.5 * (penalty * w * w).sum()
            if loss > losses[k] + 1e-12 * abs(losses[k]):
                steps[k] /= 2
                weights[k] = w - steps[k]
                continue
            gradient = strength * sums[k, 1 : width + 1] + penalty * w
            hessian = strength * sums[k, width + 1 :].reshape(width, width) + np.diag(penalty)
            step = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            losses[k], open_[k] = loss, -gradient @ step > 1e-16 * (1 + abs(loss)) and bool(np.abs(step).max() > 1e-12)
            if open_[k]:
                steps[k], weights[k] = step, w + step
        if not open_.any():
            break
    return weights, passes


def as_model(spark: SparkSession, weights: np.ndarray) -> LogisticRegressionModel:
    """A stored and scored model of weights with the intercept last."""
    vector = _py2java(spark.sparkContext, Vectors.dense(weights[:-1].tolist()))
    java = spark.sparkContext._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(f"residua-{uuid.uuid4().hex[:12]}", vector, float(weights[-1]))
    return LogisticRegressionModel(java)


def train(df: DataFrame, key: str, features: str = "features", label: str = "label", test_size: float = 0.2, folds: int = 5, seed: int = 42) -> Training:
    """Hold-out score, cross-validation on the training part, and a model of all rows: seven fits in one set of passes."""
    df = df.select(F.col(key).alias("key"), F.col(features).alias("features"), F.col(label).cast("int").alias("label"))
    sizes = {r[0]: r[1] for r in df.groupBy("label").count().collect()}  # a row for each class
    if len(sizes) < 2 or min(sizes.values()) < folds:
        raise ValueError(f"training needs at least {folds} rows of each of two classes, there are {sizes}")
    tests = class_quotas(sizes, test_size)
    if not all(tests.values()) or any(sizes[k] - tests[k] < folds for k in sizes):
        raise ValueError(f"a test size of {test_size} leaves too few rows to test or to train on: {sizes}")
    split = materialize(stratified_split(df, "label", "key", test_size, seed), "split")
    fit_rows = stratified_folds(split.filter(~F.col("is_test")), "label", "key", folds)
    held = split.filter("is_test").withColumn("fold", F.lit(-1))
    rows = materialize(fit_rows.unionByName(held).select("features", "label", "is_test", F.col("fold").cast("int").alias("fold")), "folds")
    weights, passes = fit_all(rows, folds)
    right = pass_over(rows, weights, folds, right_sums, 4)
    n_test = sum(tests.values())
    # the rows that a fold's fit leaves out are that fold and the test part
    by_fold = pass_over(rows.filter(~F.col("is_test")), weights, folds, right_sums, 4)[1 : folds + 1]
    each = by_fold[:, 3] / by_fold[:, 2]
    return Training(as_model(df.sparkSession, weights[-1]), float(right[0, 1] / right[0, 0]), float(right[0, 3] / n_test), float(each.mean()), float(2 * each.std()), passes)


def save(model: LogisticRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)


#: The names under which the package exports them.
load_model, predict, save_model, train_classifier = load, score, save, train
