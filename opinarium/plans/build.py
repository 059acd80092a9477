"""From reviews to a searchable corpus and a browsable storefront."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinarium.functions.scorers import Scorer, label_scorer
from opinarium.functions.vectors import QUERY_INSTRUCTION, EncoderFactory, query_text
from opinarium.operators.catalog import build_catalog, counted_catalog, cut_catalog
from opinarium.operators.features import embed
from opinarium.operators.ranking import MIN_REVIEWS
from opinarium.session import materialize
from opinarium.sources import artifacts


def corpus(reviews: DataFrame, encoder: EncoderFactory, scorer: Scorer | None = None, min_reviews: int = 1, limit: int | None = None) -> DataFrame:
    """Catalog rows with the vector of their title as a document."""
    return _titled(build_catalog(reviews, scorer or label_scorer(), min_reviews, limit), encoder)


def _titled(catalog: DataFrame, encoder: EncoderFactory) -> DataFrame:
    return embed(catalog, "product_name", encoder)


def storefront(reviews: DataFrame, encoder: EncoderFactory, scorer: Scorer | None = None, limit: int | None = None) -> DataFrame:
    """Every product with the vector of its title as a query."""
    return _asked(build_catalog(reviews, scorer or label_scorer(), 1, limit), encoder)


def _asked(catalog: DataFrame, encoder: EncoderFactory) -> DataFrame:
    asked = embed(catalog.withColumn("_query", query_text(F.col("product_name"))), "_query", encoder)
    return asked.drop("_query")


def build(
    reviews: DataFrame,
    path: str,
    encoder: EncoderFactory,
    model: str,
    scorer: Scorer | None = None,
    min_reviews: int = 1,
    limit: int | None = None,
    label_column: str = "pred_label",
    storefront_reviews: DataFrame | None = None,
    recommend_min_reviews: int = MIN_REVIEWS,
    positive_threshold: float = 4,
    sources: Sequence[str] = (),
) -> dict[str, int]:
    """Writes scores, corpus, storefront and a build record as a new version under ``path``.

    The record holds the model and its vector dimension, the query instruction, the
    review minima, the rating threshold, the label column, the names in ``sources``
    the labels come from, and the counts.

    All tables are made in the shared folder first and counted on the way. The
    version is published when all of it is written and no table is empty, so readers
    (``artifacts.published``) see one whole build, the earlier one until then.
    """
    spark = reviews.sparkSession
    counts, made = {}, {}
    # Both sides of the same reviews are cut from one catalog, written once.
    whole = materialize(build_catalog(reviews, scorer or label_scorer()), "whole-catalog")
    sides = {
        "corpus": _titled(cut_catalog(whole, min_reviews, limit), encoder),
        "storefront": _asked(cut_catalog(whole, limit=limit), encoder) if storefront_reviews is None else storefront(storefront_reviews, encoder, scorer, limit),
    }
    for name, table in sides.items():
        made[name], counts[name] = counted_catalog(table, name)
    version = artifacts.new_version(path)
    artifacts.write_sentiment_scores(reviews, f"{version}/sentiment_scores", label_column)
    for name, table in made.items():
        artifacts.write_corpus(table, f"{version}/{name}")
    record = {
        "model": model,
        "dimension": len(made["corpus"].select("embedding").first()[0]),
        "query_instruction": QUERY_INSTRUCTION,
        "min_reviews": min_reviews,
        "recommend_min_reviews": recommend_min_reviews,
        "positive_threshold": positive_threshold,
        "label_column": label_column,
        "label_sources": ",".join(sources),
    }
    artifacts.write_record(spark, record | {f"{n}_products": c for n, c in counts.items()}, f"{version}/build")
    artifacts.publish(spark, path, version)
    return counts
