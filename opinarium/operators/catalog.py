"""The product catalog: one row per product out of many reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinarium.functions.scorers import Scorer, Share
from opinarium.schemas import CATALOG, CATALOG_ATTRIBUTES
from opinarium.session import materialize

_TOTALS = -1
# A product of more reviews than this, and than this part of all, is too much for one task.
CROWDED, _CROWDED_PART = 1 << 18, 1000


def _cell(attribute: int, value: Column, hits: Column, base: Column) -> Column:
    return F.struct(
        F.lit(attribute).alias("attribute"),
        value.cast("string").alias("value"),
        hits.cast("long").alias("hits"),
        base.cast("long").alias("base"),
    )


def build_catalog(
    reviews: DataFrame, scorer: Scorer, min_reviews: int = 1, limit: int | None = None
) -> DataFrame:
    """Most frequent attributes, review count and S(p) of each product.

    Counting goes by (product, attribute, value) before one row per product is
    formed, so a product holding a third of the reviews spreads over many tasks
    and no task holds all values of it. Reviews that are partitioned by product already
    are not shuffled again; leave :func:`crowded_products` out of such. Ties take the
    smallest value; a product without any value gets a blank.
    """
    share = scorer(reviews)
    none = F.lit(None).cast("long")
    cells = [_cell(_TOTALS, F.lit(None), share.hits, share.base)]
    cells += [_cell(i, F.col(name), none, none) for i, name in enumerate(CATALOG_ATTRIBUTES)]
    counted = (
        reviews.filter(F.col("product_id").isNotNull())
        .select("product_id", F.inline_outer(F.array(*cells)))
        .filter((F.col("attribute") == _TOTALS) | F.col("value").isNotNull())
        .groupBy("product_id", "attribute", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("hits").alias("hits"), F.sum("base").alias("base"))
    )
    best = []
    for i, name in enumerate(CATALOG_ATTRIBUTES):
        ranked = F.struct((-F.col("n")).alias("n"), F.col("value").alias("value"))
        first = F.min(F.when(F.col("attribute") == i, ranked)).getField("value")
        best.append(F.coalesce(first, F.lit("")).alias(name))
    products = (
        counted.groupBy("product_id")
        .agg(
            *best,
            F.max(F.when(F.col("attribute") == _TOTALS, F.col("n"))).alias("num_reviews"),
            Share.ratio(F.sum("hits"), F.sum("base")).alias("sentiment_score"),
        )
        .filter(F.col("num_reviews") >= min_reviews)
    )
    return cut_catalog(catalog_columns(products), limit=limit)


def crowded_products(reviews: DataFrame, least: int = CROWDED) -> tuple[list[str], int]:
    """Products whose reviews are too many for one task, by a sketch of frequent ids that
    misses none of a thousandth of all rows, and the number of reviews; one pass, and one
    sketch a task travels."""
    top = f"approx_top_k(product_id, {_CROWDED_PART}, {20 * _CROWDED_PART})"
    named = reviews.filter(F.col("product_id").isNotNull())
    row = named.agg(F.expr(top).alias("top"), F.count(F.lit(1)).alias("n")).first()
    most = max(least, row["n"] // _CROWDED_PART)
    return sorted(item["item"] for item in row["top"] if item["count"] > most), row["n"]


def cut_catalog(catalog: DataFrame, min_reviews: int = 1, limit: int | None = None) -> DataFrame:
    """The products of enough reviews, the first ``limit`` of them in catalog order."""
    if min_reviews > 1:
        catalog = catalog.filter(F.col("num_reviews") >= min_reviews)
    return catalog if limit is None else in_catalog_order(catalog).limit(limit)


def in_catalog_order(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.desc("num_reviews"), F.asc("product_id"))


def catalog_columns(catalog: DataFrame) -> DataFrame:
    """The fixed column order and types of a catalog; missing texts are blank."""
    return catalog.select(
        *[
            (F.coalesce(F.col(f.name).cast(f.dataType), F.lit("")) if f.name in CATALOG_ATTRIBUTES else F.col(f.name).cast(f.dataType)).alias(f.name)
            for f in CATALOG.fields
        ]
    )


def describe_product(brand: Column, lv1: Column, lv2: Column) -> Column:
    """A one-line description from the brand and the category path."""
    brand, lv1, lv2 = (F.coalesce(c, F.lit("")) for c in (brand, lv1, lv2))
    return F.concat_ws(
        " ",
        F.when(brand != "", F.concat(F.lit("Marca: "), brand, F.lit("."))),
        F.when(
            (lv1 != "") & (lv2 != "") & (lv1 != lv2),
            F.concat(F.lit("Categoria: "), lv1, F.lit(" › "), lv2, F.lit(".")),
        ).when(lv1 != "", F.concat(F.lit("Categoria: "), lv1, F.lit("."))),
    )


def enrich_products(products: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds rating, review count and description; a product without reviews
    keeps the count it came with."""
    return (
        products.join(stats.select("product_id", "avg_rating", "review_count"), "product_id", "left")
        .withColumn("review_count", F.coalesce(F.col("review_count"), F.col("num_reviews")))
        .withColumn(
            "description",
            describe_product(F.col("product_brand"), F.col("site_category_lv1"), F.col("site_category_lv2")),
        )
    )


def counted_catalog(catalog: DataFrame, name: str = "catalog") -> tuple[DataFrame, int]:
    """The catalog written to the shared folder, with its row count; an empty one
    is an error. Counting the written table reads no column."""
    stored = materialize(catalog, name)
    count = stored.count()
    if count == 0:
        raise ValueError("the catalog has no rows")
    return stored, count
