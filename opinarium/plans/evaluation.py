"""Objective quality of recommendations against mean ratings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinarium.operators import ranking_metrics as metrics
from opinarium.operators.exploration import category_ratings
from opinarium.session import materialize


def graded_products(reviews: DataFrame | Sequence[DataFrame], min_reviews: int = 5) -> DataFrame:
    """Relevance of every product in every category it was reviewed under; several tables
    hold the reviews of different products.

    The ratings are read for the bounds of each category and for each use in an
    evaluation, so they are written once."""
    tables = [reviews] if isinstance(reviews, DataFrame) else reviews
    rated = reduce(DataFrame.unionByName, [category_ratings(table, min_reviews) for table in tables])
    return metrics.add_relevance(materialize(rated, "ratings"))


def evaluate(recommendations: DataFrame, graded: DataFrame, queries: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """Precision, recall and NDCG for a batch of query products.

    ``queries`` has ``query_id``, ``query_product`` and ``query_category``; a
    query that is not graded in its category is left out, see :func:`unknown`.
    """
    known = queries.join(_rated(graded), ["query_product", "query_category"], "left_semi")
    judged = metrics.judge(recommendations, graded, known.select("query_id", "query_category"))
    return metrics.list_metrics(judged, metrics.relevant_counts(graded, known), ks)


def unknown(graded: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries whose product is not graded in the category asked for."""
    return queries.join(_rated(graded), ["query_product", "query_category"], "left_anti")


def _rated(graded: DataFrame) -> DataFrame:
    return graded.select(F.col("product_id").alias("query_product"), F.col("site_category_lv1").alias("query_category"))
