"""Weighted logistic regression: fitting, model search, storage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinarium.operators.grid import Problem, fit_together, held_out_counts
from opinarium.session import scratch_path

# Searched strengths and class weights of the sparse models.
GRID_C = (0.01, 0.1, 1.0, 10.0)
SPARSE_CLASS_WEIGHTS = {0: 2.5, 1: 1.0}


def macro_f1(tp: int, fp: int, fn: int, tn: int) -> float:
    """Unweighted mean of both classes' F1; 0 for a class that never occurs."""
    scores = [2 * hit / (2 * hit + fp + fn) if hit else 0.0 for hit in (tp, tn)]
    return float(sum(scores) / 2)


def training_table(features: DataFrame, labels: DataFrame, key: str, class_weights: DataFrame) -> DataFrame:
    """Features, label, weight and any fold column, written once as a table.

    Fitting reads its input many times; the written copy keeps each pass a plain
    scan and survives lost executors. ``features`` is either a dense array or
    the sparse struct of :func:`features.sparse_rows`, which is read back as an
    ML vector without a Python step. Rows without a label drop out.
    """
    spark = features.sparkSession
    # Two classes, hence two rows.
    weights = class_weights.filter(F.col("label").isin(0, 1)).select("label", "class_weight")
    rows = (
        features.join(labels.filter(F.col("label").isNotNull()), key)
        .join(F.broadcast(weights), "label")
        .withColumn("label", F.col("label").cast("double"))
    )
    path = scratch_path(spark, "training")
    rows.write.parquet(path)
    dense = isinstance(rows.schema["features"].dataType, T.ArrayType)
    fields = [
        T.StructField(f.name, VectorUDT() if f.name == "features" and not dense else f.dataType) for f in rows.schema.fields
    ]
    table = spark.read.schema(T.StructType(fields)).parquet(path)
    return table.withColumn("features", array_to_vector(F.col("features").cast("array<double>"))) if dense else table


def ridge(c: float, total_weight: float) -> float:
    """``regParam`` equal to a penalty of 1/C on the summed, weighted loss."""
    return 1.0 / (c * total_weight)


def _estimator(max_iter: int) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="features",
        labelCol="label",
        weightCol="class_weight",
        maxIter=max_iter,
        elasticNetParam=0.0,
        standardization=False,
        tol=1e-4,
    )


def _total_weight(table: DataFrame) -> float:
    return table.agg(F.sum("class_weight")).first()[0]


def fit(table: DataFrame, c: float = 1.0, max_iter: int = 1000) -> LogisticRegressionModel:
    return _estimator(max_iter).setRegParam(ridge(c, _total_weight(table))).fit(table)


@dataclass(frozen=True)
class SearchResult:
    model: LogisticRegressionModel
    best_c: float
    best_f1: float
    scores: dict[float, float]
    passes: int


def grid_search(table: DataFrame, grid: Sequence[float] = GRID_C, max_iter: int = 1000) -> SearchResult:
    """Mean macro-F1 over the stratified folds in ``fold``; the best strength is
    refitted on all rows. The first of equal strengths wins.

    All (fold, strength) models are fitted together, one pass over the table per
    step. The penalty of each follows the weight of its own rows.
    """
    weights = dict(table.groupBy("fold").agg(F.sum("class_weight")).collect())
    total, size = sum(weights.values()), table.select("features").first()[0].size
    tasks = [(fold, c) for fold in sorted(weights) for c in grid]
    problems = [Problem(fold, ridge(c, total - weights[fold])) for fold, c in tasks]
    points, passes = fit_together(table, problems, size, max_iter)
    found = dict(zip(tasks, map(macro_f1, *held_out_counts(table, problems, points))))
    scores = {c: sum(found[fold, c] for fold in weights) / len(weights) for c in grid}
    best = max(grid, key=lambda c: scores[c])
    model = _estimator(max_iter).setRegParam(ridge(best, total)).fit(table)
    return SearchResult(model, best, scores[best], scores, passes)


def coefficients(model: LogisticRegressionModel, vocabulary: DataFrame) -> DataFrame:
    """``(term, idf, coefficient)``: the model as a table over its vocabulary."""
    spark = vocabulary.sparkSession
    values = spark.createDataFrame(
        [(i, float(v)) for i, v in enumerate(model.coefficients.toArray())], "term_id int, coefficient double"
    )
    return vocabulary.join(values, "term_id").select("term", "idf", "coefficient")


def save_model(model: LogisticRegressionModel, vocabulary: DataFrame, path: str) -> None:
    """Vocabulary and classifier side by side."""
    vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    model.write().overwrite().save(f"{path}/classifier")


def load_model(spark: SparkSession, path: str) -> tuple[LogisticRegressionModel, DataFrame]:
    return LogisticRegressionModel.load(f"{path}/classifier"), spark.read.parquet(f"{path}/vocabulary")


def champion(metrics: DataFrame, split: str = "test", metric: str = "f1_macro") -> DataFrame:
    """The model with the highest metric on a split; ties by name."""
    return (
        metrics.filter(F.col("split") == split)
        .orderBy(F.desc_nulls_last(metric), F.asc("model"))
        .limit(1)
    )
