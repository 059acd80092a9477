"""Explicit table schemas; nothing is inferred from files."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


REVIEWS = _struct(
    submission_date=T.TimestampNTZType(),
    reviewer_id=T.StringType(),
    product_id=T.StringType(),
    product_name=T.StringType(),
    product_brand=T.StringType(),
    site_category_lv1=T.StringType(),
    site_category_lv2=T.StringType(),
    review_title=T.StringType(),
    overall_rating=T.IntegerType(),
    recommend_to_a_friend=T.StringType(),
    review_text=T.StringType(),
    reviewer_birth_year=T.DoubleType(),
    reviewer_gender=T.StringType(),
    reviewer_state=T.StringType(),
)

SCORED_REVIEWS = T.StructType(
    REVIEWS.fields
    + [T.StructField("pred_label", T.IntegerType()), T.StructField("pred_prob", T.DoubleType())]
)

PREDICTIONS = T.StructType(
    REVIEWS.fields
    + _struct(
        row_id=T.StringType(),
        split=T.StringType(),
        true_polarity=T.IntegerType(),
        raw_response=T.StringType(),
        predicted_polarity=T.IntegerType(),
        error=T.StringType(),
        input_tokens=T.LongType(),
        output_tokens=T.LongType(),
        response_time_s=T.DoubleType(),
    ).fields
)

CATALOG = _struct(
    product_id=T.StringType(),
    product_name=T.StringType(),
    product_brand=T.StringType(),
    site_category_lv1=T.StringType(),
    site_category_lv2=T.StringType(),
    num_reviews=T.LongType(),
    sentiment_score=T.DoubleType(),
)

PRODUCT_VECTORS = _struct(
    product_id=T.StringType(),
    embedding=T.ArrayType(T.FloatType()),
    num_reviews=T.LongType(),
)

# Columns a review table must have before a catalog can be built from it.
REQUIRED_REVIEW_COLUMNS = (
    "product_id",
    "product_name",
    "product_brand",
    "site_category_lv1",
    "site_category_lv2",
    "overall_rating",
)

CATALOG_ATTRIBUTES = ("product_name", "product_brand", "site_category_lv1", "site_category_lv2")
