"""The driver's tables seen as reviews, documents, vectors and predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinarium.functions import labels
from opinarium.functions.scorers import label_scorer
from opinarium.operators.catalog import CROWDED, build_catalog, crowded_products
from opinarium.session import broadcast_if_small, materialize

# Lines of a task where they are dealt by product; its sums then fit in memory.
TASK_LINES = 250_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text(column: str):
    return F.col(column).cast("string")


def reviews(spark: SparkSession, folder: str, names: bool = True, brands: bool = True) -> DataFrame:
    """Order lines as reviews; parts are products, suppliers lend brand names.

    Queries that need neither part nor supplier columns leave the joins out. Parts come
    last: where lines are shuffled for them, the lines of a product then lie in one task, so
    that sums per product are nearly whole before the next shuffle.
    """
    return _as_reviews(_lines(spark, folder), spark, folder, names, brands)


def by_product(spark: SparkSession, folder: str, brands: bool = True, least: int = CROWDED) -> list[DataFrame]:
    """The reviews in one or two tables of different products: those of ordinary products, whose
    lines are dealt by product before parts and suppliers widen them, so that nothing per
    product is shuffled again, and those of crowded products, whose lines stay spread."""
    lines = _lines(spark, folder)
    crowded, number = crowded_products(lines, least)
    ordinary = lines.filter(~F.col("product_id").isin(crowded)) if crowded else lines
    tables = [ordinary.repartition(-(-number // TASK_LINES) or 1, "product_id")]
    if crowded:
        tables.append(lines.filter(F.col("product_id").isin(crowded)))
    return [_as_reviews(lines, spark, folder, True, brands, dealt=True) for lines in tables]


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").withColumn("product_id", text("l_partkey"))


def _as_reviews(lines: DataFrame, spark: SparkSession, folder: str, names: bool, brands: bool, dealt: bool = False) -> DataFrame:
    if brands:
        suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_name")
        lines = lines.join(broadcast_if_small(suppliers, F.col("s_name")), F.col("l_suppkey") == F.col("s_suppkey"))
    if names:
        parts = table(spark, folder, "part").withColumn("_part", text("p_partkey"))
        # Lines dealt by the text of a key meet the parts by it, and stay where they are.
        same = F.col("product_id") == F.col("_part") if dealt else F.col("l_partkey") == F.col("p_partkey")
        lines = lines.join(parts, same)
    rating = F.when(F.col("l_linenumber") != 7, F.floor((F.col("l_quantity") - 1) / 10).cast("int") + 1)
    probability = F.round(F.col("l_discount") * 10, 4)
    columns = {
        "review_id": F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey")),
        "reviewer_id": F.md5(text("l_orderkey")),
        "product_id": F.col("product_id"),
        "overall_rating": rating,
        "polarity": labels.polarity(rating),
        "recommend_to_a_friend": F.when(F.col("l_linestatus") == "O", "Yes").otherwise("No"),
        "pred_prob": probability,
        "pred_label": F.when(F.col("l_returnflag") != "R", (probability >= 0.5).cast("int")),
        "submission_date": F.col("l_shipdate"),
        "reviewer_birth_year": F.when(F.col("l_linenumber") != 5, (F.col("l_suppkey") % 60 + 1940).cast("double")),
        "reviewer_gender": F.when(F.col("l_linenumber") < 4, "F").otherwise("M"),
        "reviewer_state": F.when(F.col("l_linenumber") != 2, F.concat(F.lit("S"), F.col("l_linenumber").cast("string"))),
        "split": F.when(F.col("l_linenumber").isin(2, 4, 6), "val").otherwise("test"),
        "model": F.concat(F.lit("model_"), F.col("l_linestatus")),
        "tokens_in": (F.col("l_partkey") % 200 + 200).cast("long"),
        "tokens_out": (F.col("l_suppkey") % 10 + 5).cast("long"),
        "seconds": F.round(F.col("l_extendedprice") / 100000, 4),
        "failure": F.when(F.col("l_returnflag") == "R", "TimeoutError: late").when(F.col("l_linenumber") < 4, ""),
    }
    if names:
        columns |= {
            "product_name": F.col("p_name"),
            "site_category_lv1": F.col("p_type"),
            "site_category_lv2": F.concat(F.lit("size-"), F.col("p_size").cast("string")),
            "review_title": F.col("p_name"),
        }
    if brands:
        columns["product_brand"] = F.when(F.col("l_linenumber") != 6, F.col("s_name"))
        columns["review_text"] = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("Sold by "), F.col("s_name")))
    return lines.select(*[column.alias(name) for name, column in columns.items()])


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as review texts; quality labels give polarity and stars."""
    quality = F.col("quality")
    return (
        table(spark, folder, "documents")
        .join(table(spark, folder, "labels"), "doc_id", "left")
        .select(
            "doc_id",
            F.col("text").alias("review_text"),
            F.substring_index("text", "\n", 1).alias("review_title"),
            F.col("source").alias("product_id"),
            F.col("lang").alias("reviewer_id"),
            quality.alias("polarity"),
            F.when(quality == 1, 5).when(quality == 0, 1).alias("overall_rating"),
        )
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(text("vec_id").alias("product_id"), "embedding")


def catalog(spark: SparkSession, folder: str, min_reviews: int = 1) -> DataFrame:
    parts = [build_catalog(rows, label_scorer(), min_reviews) for rows in by_product(spark, folder)]
    return reduce(DataFrame.unionByName, parts)


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog rows with their vector, written as a build would leave them: the
    search and the details both read it."""
    return materialize(catalog(spark, folder).join(vectors(spark, folder), "product_id"), "corpus")


def product_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every product vector as a query that leaves out its own product."""
    return vectors(spark, folder).select(
        F.col("product_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("product_id").alias("exclude_id")
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Non-neutral rated reviews as answers of a prompted model."""
    return (
        reviews(spark, folder, names=False, brands=False)
        .filter(F.col("polarity").isNotNull())
        .select(
            F.col("review_id").alias("row_id"),
            "split",
            F.col("polarity").alias("true_polarity"),
            F.col("pred_label").alias("predicted_polarity"),
            F.col("failure").alias("error"),
            F.col("tokens_in").alias("input_tokens"),
            F.col("tokens_out").alias("output_tokens"),
            F.col("seconds").alias("response_time_s"),
        )
    )


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Events as raw answers: valid, wrong value, wrong object, broken JSON."""
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", '{"sentiment": "positive"}')
        .when(kind == "view", '{"sentiment": "negative"}')
        .when(kind == "purchase", '{"sentiment": "neutral"}')
        .when(kind == "signup", F.substring("props", 1, 3))
        .otherwise(F.col("props"))
    )
    return table(spark, folder, "events").select("event_id", "user_id", raw.alias("raw"))


def lemmas(spark: SparkSession, folder: str) -> DataFrame:
    """A form table derived from the documents: a plural s is dropped."""
    from opinarium.functions.text import alphabetic_tokens

    forms = documents(spark, folder).select(F.explode_outer(alphabetic_tokens(F.col("review_text"))).alias("form")).distinct()
    return forms.filter((F.length("form") > 3) & F.col("form").endswith("s")).select(
        "form", F.expr("substring(form, 1, length(form) - 1)").alias("lemma")
    )
