"""Exploratory aggregates. Each is one pass with map-side partial sums; the
fixed-size reports (poles, bins) come out of a single aggregate row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinarium.functions import labels, text
from opinarium.functions.labels import number


def word_counts(reviews: DataFrame, column: str = "review_text", stop_words: Sequence[str] = text.REPORT_STOP_WORDS) -> DataFrame:
    return (
        reviews.select(F.explode_outer(text.report_words(F.col(column), stop_words)).alias("word"))
        .filter(F.col("word").isNotNull())
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_words(reviews: DataFrame, n: int = 20, column: str = "review_text", stop_words: Sequence[str] = text.REPORT_STOP_WORDS) -> DataFrame:
    return word_counts(reviews, column, stop_words).orderBy(F.desc("n"), F.asc("word")).limit(n)


def words_by_class(reviews: DataFrame, n: int = 20, column: str = "review_text", label: str = "polarity", stop_words: Sequence[str] = text.REPORT_STOP_WORDS) -> DataFrame:
    """The most frequent words of each class, ranked."""
    counts = (
        reviews.filter(F.col(label).isNotNull())
        .select(label, F.explode_outer(text.report_words(F.col(column), stop_words)).alias("word"))
        .filter(F.col("word").isNotNull())
        .groupBy(label, "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy(label).orderBy(F.desc("n"), F.asc("word"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def top_categories_by_products(reviews: DataFrame, n: int = 10) -> DataFrame:
    return (
        reviews.filter(F.col("site_category_lv1").isNotNull())
        .groupBy("site_category_lv1")
        .agg(F.countDistinct("product_id").alias("products"))
        .orderBy(F.desc("products"), F.asc("site_category_lv1"))
        .limit(n)
    )


def categories_by_rating(reviews: DataFrame, n: int = 10, min_reviews: int = 50, best: bool = True) -> DataFrame:
    """Categories with enough reviews, best or worst mean rating first."""
    means = (
        reviews.filter(F.col("site_category_lv1").isNotNull())
        .groupBy("site_category_lv1")
        .agg(F.avg(number(reviews, "overall_rating")).alias("avg_rating"), F.count(F.lit(1)).alias("reviews"))
        .filter(F.col("reviews") >= min_reviews)
    )
    order = F.desc_nulls_last("avg_rating") if best else F.asc_nulls_last("avg_rating")
    return means.orderBy(order, F.asc("site_category_lv1")).limit(n)


def product_volume(reviews: DataFrame, n: int | None = None) -> DataFrame:
    """Reviews per product name, most reviewed first when cut to ``n``."""
    counts = (
        reviews.filter(F.col("product_name").isNotNull())
        .groupBy("product_name")
        .agg(F.count(F.lit(1)).alias("reviews"))
    )
    return counts if n is None else counts.orderBy(F.desc("reviews"), F.asc("product_name")).limit(n)


def rating_histogram(reviews: DataFrame) -> DataFrame:
    rating = number(reviews, "overall_rating")
    return (
        reviews.select(rating.alias("overall_rating"))
        .filter(F.col("overall_rating").isNotNull())
        .groupBy("overall_rating")
        .agg(F.count(F.lit(1)).alias("reviews"))
    )


def _fixed_report(df: DataFrame, key: str, names: Sequence[str], member: Column, value: str) -> DataFrame:
    """Counts of the named members in their given order; absent ones show 0."""
    totals = df.agg(*[F.count_if(member == name).alias(f"c{i}") for i, name in enumerate(names)])
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(name).alias(key), F.col(f"c{i}").alias(value))
            for i, name in enumerate(names)
        ]
    )
    return totals.select(F.inline(rows))


def pole_share(reviews: DataFrame) -> DataFrame:
    """Reviews and percentage per two-way pole, negative first."""
    pole = labels.two_pole(number(reviews, "overall_rating"))
    counts = _fixed_report(reviews, "pole", labels.TWO_POLES, pole, "reviews")
    total = F.sum("reviews").over(Window.partitionBy())  # two rows
    return counts.withColumn(
        "percentage", F.round(F.coalesce(F.try_divide(F.col("reviews") * 100.0, total), F.lit(0.0)), 1)
    )


def strict_pole_counts(reviews: DataFrame) -> DataFrame:
    """Reviews per strict pole; ratings of neither pole are not shown."""
    pole = labels.strict_pole(number(reviews, "overall_rating"))
    return _fixed_report(reviews, "pole", labels.STRICT_POLES, pole, "reviews")


# Upper edges (inclusive) and names of the two bin sets. The wide
# set drops counts above its last edge; the dense set is open at the top.
WIDE_BINS = ((9, "1 a 9"), (99, "10 a 99"), (299, "100 a 299"), (399, "300 a 399"), (500, "400 a 500"))
DENSE_BINS = (
    (1, "1"), (2, "2"), (3, "3"), (4, "4"), (5, "5"), (10, "6 a 10"), (20, "11 a 20"),
    (50, "21 a 50"), (100, "51 a 100"), (300, "101 a 300"), (None, "301+"),
)


def review_count_bins(reviews: DataFrame, key: str = "product_id", bins: Sequence[tuple[int | None, str]] = DENSE_BINS) -> DataFrame:
    """Products per right-closed bin of their review count; empty bins show 0."""
    counts = reviews.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    first_edge, first_name = bins[0]
    name = F.when(F.col("n") <= first_edge, first_name)
    for edge, label in bins[1:]:
        name = name.when(F.lit(True) if edge is None else F.col("n") <= edge, label)
    return _fixed_report(counts, "bin", [label for _, label in bins], name, "products")


def top_categories_sentiment(reviews: DataFrame, n: int = 5) -> DataFrame:
    """The largest categories with the percentage of each pole."""
    pole = labels.two_pole(number(reviews, "overall_rating"))
    counts = (
        reviews.filter(F.col("site_category_lv1").isNotNull())
        .groupBy("site_category_lv1")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(pole == labels.TWO_POLES[1]).alias("positive"),
        )
        .orderBy(F.desc("total"), F.asc("site_category_lv1"))
        .limit(n)
    )
    return counts.select(
        "site_category_lv1",
        "total",
        F.round(F.col("positive") * 100.0 / F.col("total"), 1).alias("positive_pct"),
        F.round((F.col("total") - F.col("positive")) * 100.0 / F.col("total"), 1).alias("negative_pct"),
    )


def corpus_profile(reviews: DataFrame, text_column: str = "review_text") -> DataFrame:
    """One row: reviews, distinct reviewers and products, tokens, pole shares.

    One reading of the table: each row gives one cell per distinct token and one
    each for its length, reviewer, product and pole; cells of equal value meet in
    one shuffle after a map-side sum. The median is read off the histogram of
    lengths, so its state is one entry per distinct length and not one per
    review. Without rows the counts are 0, the median and the shares null.
    """
    rating = number(reviews, "overall_rating")
    pole = F.when(rating.isin(1, 2), "negative").when(rating == 3, "neutral").when(rating.isin(4, 5), "positive")

    def cell(kind: str, value: Column, length: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), length.cast("long").alias("len"))

    none = F.lit(None)
    named = [cell("reviewer", F.col("reviewer_id"), none), cell("product", F.col("product_id"), none), cell("pole", pole, none)]
    tokens = text.analyzer_tokens(F.coalesce(F.col(text_column), F.lit("")))
    # Each row's tokens are found once, in a column of their own.
    rows = reviews.withColumn("_tokens", tokens).select(
        F.concat(F.array(*named, cell("length", none, F.size("_tokens"))), F.transform(F.array_distinct("_tokens"), lambda t: cell("token", t, none))).alias("cells")
    )
    cells = rows.select(F.inline_outer("cells")).groupBy("kind", "value", "len").agg(F.count(F.lit(1)).alias("n"))
    present = lambda kind: F.count_if((F.col("kind") == kind) & F.col("value").isNotNull())
    total = lambda chosen, value: F.coalesce(F.sum(F.when(chosen, value)), F.lit(0))
    length = F.col("kind") == "length"
    sums = cells.agg(
        total(length, F.col("n")).alias("reviews"),
        present("reviewer").alias("reviewers"),
        present("product").alias("products"),
        total(length, F.col("len") * F.col("n")).alias("tokens"),
        present("token").alias("distinct_tokens"),
        F.percentile(F.when(length, F.col("len")), 0.5, F.col("n")).alias("median_tokens"),
        *[total((F.col("kind") == "pole") & (F.col("value") == side), F.col("n")).alias(side) for side in ("negative", "neutral", "positive")],
    )
    return sums.select(
        "reviews", "reviewers", "products", "tokens", "distinct_tokens", "median_tokens",
        *[F.round(F.try_divide(F.col(side) * 100.0, F.col("reviews")), 1).alias(f"{side}_pct") for side in ("negative", "neutral", "positive")],
    )


def missing_values(reviews: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null or blank values per column, in one pass."""
    def absent(name: str) -> Column:
        column = F.col(name)
        return column.isNull() | (F.trim(column.cast("string")) == "")

    totals = reviews.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(absent(c)).alias(f"m_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("missing"), F.col("rows")) for c in columns])
    return totals.select(F.inline(rows))


def length_by_polarity(reviews: DataFrame, column: str = "review_text", label: str = "polarity") -> DataFrame:
    """Mean text length in characters per class; unlabelled rows are a class."""
    return reviews.groupBy(label).agg(
        F.avg(F.length(F.coalesce(F.col(column), F.lit("")))).alias("avg_chars"),
        F.count(F.lit(1)).alias("reviews"),
    )


def category_ratings(reviews: DataFrame, min_reviews: int = 5) -> DataFrame:
    """Mean rating of each product inside each category, products with enough
    reviews only; of several names the smallest is shown.

    Sums are taken per name first, so that the step that compares names sees a
    few rows per product and not its reviews.
    """
    rating = number(reviews, "overall_rating")
    return (
        reviews.filter(F.col("site_category_lv1").isNotNull() & F.col("product_id").isNotNull())
        .groupBy("site_category_lv1", "product_id", "product_name")
        .agg(F.sum(rating).alias("_sum"), F.count(rating).alias("_rated"), F.count(F.lit(1)).alias("_n"))
        .groupBy("site_category_lv1", "product_id")
        .agg(
            F.min("product_name").alias("product_name"),
            F.try_divide(F.sum("_sum"), F.sum("_rated")).alias("avg_rating"),
            F.sum("_n").alias("num_reviews"),
        )
        .filter(F.col("num_reviews") >= min_reviews)
    )


def category_profile(catalog: DataFrame, min_reviews: int = 5, low: float = 0.3) -> DataFrame:
    """Risk profile of each category: how many products can be recommended and
    how many of those score badly."""
    good = F.col("num_reviews") >= min_reviews
    return catalog.groupBy("site_category_lv1").agg(
        F.count(F.lit(1)).alias("products"),
        F.sum("num_reviews").alias("reviews"),
        F.count_if(good).alias("recommendable"),
        F.avg(F.when(good, F.col("sentiment_score"))).alias("mean_sentiment"),
        F.count_if(good & (F.col("sentiment_score") < low)).alias("low_sentiment"),
    )


def rating_recommendation_mismatch(reviews: DataFrame) -> DataFrame:
    """1a: high rating, not recommended. 1b: low rating, recommended."""
    rating = number(reviews, "overall_rating")
    answer = F.lower(F.col("recommend_to_a_friend"))
    case = F.when(rating.isin(4, 5) & (answer == "no"), "1a").when(rating.isin(1, 2) & (answer == "yes"), "1b")
    return reviews.withColumn("case", case).filter(F.col("case").isNotNull())


def prediction_rating_mismatch(reviews: DataFrame, label: str = "pred_label") -> DataFrame:
    """2a: predicted positive, low rating. 2b: predicted negative, high rating."""
    rating = number(reviews, "overall_rating")
    case = F.when((F.col(label) == 1) & rating.isin(1, 2), "2a").when((F.col(label) == 0) & rating.isin(4, 5), "2b")
    return reviews.withColumn("case", case).filter(F.col("case").isNotNull())


def case_examples(mismatches: DataFrame, n: int = 4, order: str = "review_id") -> DataFrame:
    """The first ``n`` rows of each case."""
    window = Window.partitionBy("case").orderBy(order)
    return mismatches.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def case_counts(mismatches: DataFrame) -> DataFrame:
    return mismatches.groupBy("case").agg(F.count(F.lit(1)).alias("reviews"))
