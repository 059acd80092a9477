"""Quality of recommendation lists. Lists are short (``top_n`` rows a query)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinarium.functions.scorers import Share
from opinarium.session import broadcast_if_small

# Fixed value: relevance from which a product counts as relevant.
RELEVANT = 0.7


def add_relevance(products: DataFrame, category: str = "site_category_lv1") -> DataFrame:
    """Mean rating scaled to [0, 1] within its category; 0 where all are equal.

    Bounds are map-side sums joined back, so a large category stays spread.
    """
    bounds = products.groupBy(category).agg(F.min("avg_rating").alias("_lo"), F.max("avg_rating").alias("_hi"))
    bounds = broadcast_if_small(bounds, F.col(category))
    return (
        products.join(bounds, category)
        .withColumn("relevance", Share.ratio(F.col("avg_rating") - F.col("_lo"), F.col("_hi") - F.col("_lo")))
        .drop("_lo", "_hi")
    )


def relevant(relevance: Column, threshold: float = RELEVANT) -> Column:
    return F.coalesce(relevance >= threshold, F.lit(False))


def judge(recommendations: DataFrame, relevance: DataFrame, query_category: DataFrame) -> DataFrame:
    """Recommendations with the relevance each has in its query's category; what
    is not rated there has relevance 0 and no mean rating."""
    graded = relevance.select(
        F.col("site_category_lv1").alias("query_category"), "product_id", "avg_rating", "relevance"
    )
    return (
        recommendations.join(query_category, "query_id")
        .join(graded, ["query_category", "product_id"], "left")
        .withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))
        .withColumn("is_relevant", relevant(F.col("relevance")))
    )


def relevant_counts(relevance: DataFrame, queries: DataFrame, threshold: float = RELEVANT) -> DataFrame:
    """Relevant products of each query's category, the query itself left out.

    ``queries`` has ``query_id``, ``query_category`` and ``query_product``.
    """
    totals = relevance.groupBy(F.col("site_category_lv1").alias("query_category")).agg(
        F.count_if(relevant(F.col("relevance"), threshold)).alias("_all")
    )
    totals = broadcast_if_small(totals, F.col("query_category"))
    own = relevance.select(
        F.col("site_category_lv1").alias("query_category"),
        F.col("product_id").alias("query_product"),
        relevant(F.col("relevance"), threshold).cast("long").alias("_own"),
    )
    return (
        queries.join(totals, "query_category", "left")
        .join(own, ["query_category", "query_product"], "left")
        .select(
            "query_id",
            (F.coalesce("_all", F.lit(0)) - F.coalesce("_own", F.lit(0))).alias("total_relevant"),
        )
    )


def _hits(ks: Sequence[int], threshold: float) -> list[Column]:
    good = relevant(F.col("relevance"), threshold)
    return [F.count_if((F.col("rank") <= k) & good).alias(f"_hit{k}") for k in ks]


def _gains(ks: Sequence[int], exponential: bool) -> list[Column]:
    """NDCG aggregates over rows that carry ``_best``, the ideal position."""
    relevance = F.col("relevance")
    gain = F.pow(F.lit(2.0), relevance) - 1.0 if exponential else relevance

    def total(position: Column, k: int) -> Column:
        return F.sum(F.when(position <= k, gain / F.log2(position + 1.0)).otherwise(0.0))

    return [
        Share.ratio(total(F.col("rank"), k), F.nullif(total(F.col("_best"), k), F.lit(0.0))).alias(f"ndcg_at_{k}") for k in ks
    ]


def _with_ideal(judged: DataFrame) -> DataFrame:
    ideal = Window.partitionBy("query_id").orderBy(F.desc("relevance"), F.asc("rank"))
    return judged.withColumn("_best", F.row_number().over(ideal))


def _shares(ks: Sequence[int]) -> list[Column]:
    return [
        *[(F.col(f"_hit{k}") / F.lit(float(k))).alias(f"precision_at_{k}") for k in ks],
        *[Share.ratio(F.col(f"_hit{k}"), F.col("total_relevant")).alias(f"recall_at_{k}") for k in ks],
    ]


def precision_recall(judged: DataFrame, totals: DataFrame, ks: Sequence[int] = (5, 10), threshold: float = RELEVANT) -> DataFrame:
    """Precision (over k, however short the list) and recall at each k."""
    counts = judged.groupBy("query_id").agg(*_hits(ks, threshold))
    return counts.join(totals, "query_id", "left").select("query_id", "total_relevant", *_shares(ks))


def ndcg(judged: DataFrame, ks: Sequence[int] = (5, 10), exponential: bool = False) -> DataFrame:
    """NDCG at each k with gain rel, or 2^rel - 1 when ``exponential``.

    The ideal order is the returned list itself, best first; 0 without gain.
    """
    return _with_ideal(judged).groupBy("query_id").agg(*_gains(ks, exponential))


def list_metrics(judged: DataFrame, totals: DataFrame, ks: Sequence[int] = (5, 10), threshold: float = RELEVANT, exponential: bool = False) -> DataFrame:
    """Precision, recall and NDCG of every query in ``totals`` out of one pass
    over the lists; a query without a list scores 0."""
    found = _with_ideal(judged).groupBy("query_id").agg(*_hits(ks, threshold), *_gains(ks, exponential))
    names = [f"ndcg_at_{k}" for k in ks]
    return (
        totals.join(found, "query_id", "left")
        .na.fill(0, [f"_hit{k}" for k in ks])
        .na.fill(0.0, names)
        .select("query_id", "total_relevant", *_shares(ks), *names)
    )


def list_quality(recommendations: DataFrame, query_category: DataFrame | None = None) -> DataFrame:
    """Per query: mean similarity, mean and least S(p), counts of low, high and
    off-topic products and of those in the query's own category."""
    sim, s = F.col("similarity"), F.col("sentiment_score")
    same = []
    if query_category is not None:
        recommendations = recommendations.join(query_category, "query_id")
        same = [F.count_if(F.col("site_category_lv1") == F.col("query_category")).alias("n_same_category")]
    return recommendations.groupBy("query_id").agg(
        F.round(F.avg(sim), 4).alias("mean_similarity"),
        F.round(F.avg(s), 4).alias("mean_sentiment"),
        F.round(F.min(s), 4).alias("min_sentiment"),
        F.count_if(s < 0.3).alias("n_low_relevance"),
        F.count_if(s > 0.7).alias("n_high_relevance"),
        F.count_if(sim < 0.5).alias("n_off_topic"),
        *same,
    )
