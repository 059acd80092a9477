"""Per-product sentiment scores and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinarium.functions.labels import number
from opinarium.functions.scorers import Scorer, Share, label_scorer


def sentiment_scores(reviews: DataFrame, label_column: str = "pred_label", positive: int = 1) -> DataFrame:
    """Reviews, positive reviews and their ratio; missing labels count as reviews."""
    share = label_scorer(label_column, positive, count_missing=True)(reviews)
    return (
        reviews.filter(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("num_reviews"), F.sum(share.hits).alias("num_positive"))
        .withColumn("sentiment_score", Share.ratio(F.col("num_positive"), F.col("num_reviews")))
    )


def product_scores(reviews: DataFrame, scorer: Scorer) -> DataFrame:
    """S(p) of each product under any scorer."""
    share = scorer(reviews)
    return (
        reviews.filter(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(Share.ratio(F.sum(share.hits), F.sum(share.base)).alias("sentiment_score"))
    )


def product_stats(reviews: DataFrame) -> DataFrame:
    """Mean rating to one decimal (0.0 without ratings) and the review count."""
    return (
        reviews.filter(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(
            F.round(F.coalesce(F.avg(number(reviews, "overall_rating")), F.lit(0.0)), 1).alias("avg_rating"),
            F.count(F.lit(1)).alias("review_count"),
        )
    )


def class_weights(labelled: DataFrame, label: str = "label", fixed: dict[int, float] | None = None) -> DataFrame:
    """Rows per class with a fixed weight or the balanced one, n / (classes * n_c)."""
    counts = labelled.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    if fixed:
        weight = F.lit(None).cast("double")
        for value, number_ in fixed.items():
            weight = F.when(F.col(label) == value, F.lit(float(number_))).otherwise(weight)
        return counts.withColumn("class_weight", weight)
    # One row per class reaches this point, so the total is taken over classes.
    total = counts.select(F.sum("n").alias("t"), F.count(F.lit(1)).alias("c"))
    return counts.withColumn(
        "class_weight",
        total.select("t").scalar().cast("double") / (total.select("c").scalar() * F.col("n")),
    )
