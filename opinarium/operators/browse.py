"""Catalog browsing and review pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinarium.functions import labels
from opinarium.operators.catalog import in_catalog_order


def matching_products(catalog: DataFrame, category: str | None = None, subcategory: str | None = None, query: str | None = None) -> DataFrame:
    """Products of a category and subcategory whose name matches a pattern,
    whatever the case."""
    if category:
        catalog = catalog.filter(F.col("site_category_lv1") == category)
    if subcategory:
        catalog = catalog.filter(F.col("site_category_lv2") == subcategory)
    if query:
        catalog = catalog.filter(F.col("product_name").rlike(f"(?iu){query}"))
    return catalog


def catalog_page(
    catalog: DataFrame, limit: int = 20, offset: int = 0, category: str | None = None, subcategory: str | None = None, query: str | None = None
) -> DataFrame:
    """One page in catalog order; all filters apply before the page is cut."""
    found = matching_products(catalog, category, subcategory, query)
    return in_catalog_order(found).offset(offset).limit(limit)


def count_products(catalog: DataFrame, category: str | None = None, subcategory: str | None = None, query: str | None = None) -> DataFrame:
    return matching_products(catalog, category, subcategory, query).agg(F.count(F.lit(1)).alias("total"))


def category_list(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("site_category_lv1").isNotNull()).select("site_category_lv1").distinct().orderBy("site_category_lv1")


def subcategory_list(catalog: DataFrame, category: str | None = None) -> DataFrame:
    found = matching_products(catalog, category).filter(F.col("site_category_lv2").isNotNull())
    return found.select("site_category_lv2").distinct().orderBy("site_category_lv2")


def product(catalog: DataFrame, product_id: str) -> DataFrame:
    """The product's row, or none."""
    return catalog.filter(F.col("product_id") == product_id)


def review_page(reviews: DataFrame, product_id: str | None = None) -> DataFrame:
    """Reviews as shown on a product page, neutral ones included."""
    if product_id is not None:
        reviews = reviews.filter(F.col("product_id") == product_id)

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    label = F.col("pred_label") if "pred_label" in reviews.columns else F.lit(None).cast("int")
    probability = F.col("pred_prob") if "pred_prob" in reviews.columns else F.lit(None).cast("double")
    return reviews.filter(F.col("product_id").isNotNull()).select(
        "product_id",
        F.concat(F.substring(F.coalesce("reviewer_id", F.lit("")), 1, 8), F.lit("...")).alias("reviewer_id"),
        shown("review_title"),
        labels.number(reviews, "overall_rating").cast("int").alias("overall_rating"),
        shown("recommend_to_a_friend"),
        shown("review_text"),
        labels.number(reviews, "reviewer_birth_year").cast("int").alias("reviewer_birth_year"),
        shown("reviewer_gender"),
        shown("reviewer_state"),
        F.substring(F.coalesce(F.col("submission_date").cast("string"), F.lit("")), 1, 10).alias("submission_date"),
        labels.sentiment_label(label).alias("sentiment_label"),
        labels.sentiment_confidence(label, probability).alias("sentiment_confidence"),
    )


def filter_reviews(reviews: DataFrame, recommends: str = "all", stars: int = 0) -> DataFrame:
    """``recommends`` is all, yes or no; ``stars`` above 0 keeps that rating."""
    if recommends != "all":
        reviews = reviews.filter(F.lower("recommend_to_a_friend") == recommends)
    if stars > 0:
        reviews = reviews.filter(F.col("overall_rating") == stars)
    return reviews
