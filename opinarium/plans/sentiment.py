"""Training a sparse sentiment model and scoring reviews with it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinarium.operators import features, scoring, splits, training
from opinarium.operators.sentiment import class_weights
from opinarium.session import materialize
from opinarium.sources import artifacts


@dataclass(frozen=True)
class SparseModel:
    """A fitted vocabulary and classifier; ``coefficients`` joins both."""

    mode: str
    vocabulary: DataFrame
    classifier: LogisticRegressionModel
    best_c: float
    cv_f1: float

    @property
    def coefficients(self) -> DataFrame:
        return training.coefficients(self.classifier, self.vocabulary)


def train_sparse(
    docs: DataFrame,
    key: str,
    text: str,
    label: str,
    mode: str = "both",
    grid: Sequence[float] = training.GRID_C,
    k: int = 5,
    weights: dict[int, float] | None = training.SPARSE_CLASS_WEIGHTS,
    max_features: int = features.MAX_FEATURES,
    max_iter: int = 1000,
    seed: int = 42,
) -> SparseModel:
    """Vocabulary, folds, search and final fit on the labelled training rows."""
    labelled = docs.filter(F.col(label).isNotNull()).select(key, text, F.col(label).cast("int").alias("label"))
    terms = features.document_terms(labelled, key, text, mode)
    vocabulary = materialize(
        features.index_vocabulary(features.fit_vocabulary(terms, max_features=max_features)), "vocabulary"
    )
    rows = features.sparse_rows(terms, vocabulary, key)
    folded = splits.stratified_folds(labelled.select(key, "label"), key, "label", k, seed)
    table = training.training_table(rows, folded, key, class_weights(labelled, "label", weights))
    found = training.grid_search(table, grid, max_iter)
    return SparseModel(mode, vocabulary, found.model, found.best_c, found.best_f1)


def score(docs: DataFrame, model: SparseModel, key: str, text: str) -> DataFrame:
    """Label and probability of every document, neutral ones included."""
    terms = features.document_terms(docs, key, text, model.mode)
    return scoring.score_terms(terms, model.coefficients, model.classifier.intercept, key)


def scored_reviews(docs: DataFrame, model: SparseModel, key: str, text: str) -> DataFrame:
    """All columns of the documents plus label and probability, the input of the
    per-product scores and the catalog."""
    return docs.drop("pred_label", "pred_prob").join(score(docs, model, key, text), key)


def save(model: SparseModel, path: str) -> None:
    """Vocabulary, classifier and a record of n-gram mode, strength and search score."""
    training.save_model(model.classifier, model.vocabulary, path)
    record = {"mode": model.mode, "best_c": float(model.best_c), "cv_f1": float(model.cv_f1)}
    artifacts.write_record(model.vocabulary.sparkSession, record, f"{path}/settings")


def load(spark: SparkSession, path: str) -> SparseModel:
    """A model written by :func:`save`, ready to score."""
    classifier, vocabulary = training.load_model(spark, path)
    row = spark.read.schema("mode string, best_c double, cv_f1 double").json(f"{path}/settings").first()
    return SparseModel(row["mode"], vocabulary, classifier, row["best_c"], row["cv_f1"])
