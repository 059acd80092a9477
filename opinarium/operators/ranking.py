"""Re-ranking of retrieved products and batch recommendation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinarium.functions.vectors import EncoderFactory, encode, query_text
from opinarium.operators.retrieval import TIE_DECIMALS, topk

# Retrieval and ranking defaults.
RETRIEVE_K = 50
MIN_REVIEWS = 5
TOP_N = 10
ALPHA = 0.7


def _check_alpha(alpha: float) -> None:
    if not 0.0 <= alpha <= 1.0:
        raise ValueError(f"alpha has to lie between 0 and 1: {alpha}")


def _ranked(candidates: DataFrame, keys: Sequence[str], top_n: int | None, exclude: Column | None) -> DataFrame:
    if exclude is not None:
        candidates = candidates.filter(~F.coalesce(F.col("product_id") == exclude, F.lit(False)))
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", TIE_DECIMALS)), F.asc("product_id"))
    ranked = candidates.withColumn("rank", F.row_number().over(order))
    return ranked if top_n is None else ranked.filter(F.col("rank") <= top_n)


def rerank(candidates: DataFrame, alpha: float = ALPHA, top_n: int | None = None, exclude: Column | None = None, query_id: str = "query_id") -> DataFrame:
    """Adds ``score`` and ``rank`` per query, best first, ties by product id.

    ``score`` blends similarity (``alpha``) with S(p); ``exclude`` names a product
    to leave out of a row's list.
    """
    _check_alpha(alpha)
    score = F.lit(alpha) * F.col("similarity") + F.lit(1.0 - alpha) * F.col("sentiment_score")
    return _ranked(candidates.withColumn("score", score), [query_id], top_n, exclude)


def alpha_sweep(candidates: DataFrame, alphas: Sequence[float], top_n: int | None = None, exclude: Column | None = None, query_id: str = "query_id") -> DataFrame:
    """The same candidates ranked under several values of alpha."""
    for alpha in alphas:
        _check_alpha(alpha)
    swept = candidates.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    score = F.col("alpha") * F.col("similarity") + (F.lit(1.0) - F.col("alpha")) * F.col("sentiment_score")
    return _ranked(swept.withColumn("score", score), [query_id, "alpha"], top_n, exclude)


def similarity_floor(candidates: DataFrame, floor: float) -> DataFrame:
    """Candidates that are similar enough; used before re-ranking."""
    return candidates.filter(F.col("similarity") >= floor)


def resolve_queries(
    queries: DataFrame, corpus: DataFrame, storefront: DataFrame | None = None, encoder: EncoderFactory | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(resolved, rejected)`` for rows of ``query_id``, ``product_id``, ``text``.

    A known product takes its storefront vector, else its corpus vector, and is
    excluded from its own list; without a product the text is encoded. The rest
    is rejected with a reason.
    """
    columns = queries.columns
    product = F.col("product_id") if "product_id" in columns else F.lit(None).cast("string")
    words = F.col("text") if "text" in columns else F.lit(None).cast("string")
    asked = queries.select("query_id", product.alias("product_id"), words.alias("text"))
    vector = F.col("_corpus")
    found = asked.join(corpus.select("product_id", F.col("embedding").alias("_corpus")), "product_id", "left")
    if storefront is not None:
        found = found.join(storefront.select("product_id", F.col("embedding").alias("_shop")), "product_id", "left")
        vector = F.coalesce("_shop", "_corpus")
    by_text = F.col("product_id").isNull() & (F.coalesce("text", F.lit("")) != "")
    known = found.withColumn("query_vector", F.when(F.col("product_id").isNotNull(), vector))
    resolved = known.filter(F.col("query_vector").isNotNull()).select(
        "query_id", "query_vector", F.col("product_id").alias("exclude_id")
    )
    if encoder is not None:
        spoken = known.filter(by_text).select(
            "query_id",
            encode(query_text(F.col("text")), encoder).alias("query_vector"),
            F.lit(None).cast("string").alias("exclude_id"),
        )
        resolved = resolved.unionByName(spoken)
        answered = by_text
    else:
        answered = F.lit(False)
    rejected = known.filter(F.col("query_vector").isNull() & ~answered).select(
        "query_id",
        F.when(F.col("product_id").isNotNull(), F.concat(F.lit("unknown product: "), F.col("product_id")))
        .when(by_text, F.lit("no encoder for text queries"))
        .otherwise(F.lit("neither product nor text given"))
        .alias("reason"),
    )
    return resolved, rejected


def candidates(
    queries: DataFrame, corpus: DataFrame, k: int = RETRIEVE_K, min_reviews: int = MIN_REVIEWS, search=topk, **options
) -> DataFrame:
    """Retrieved products with their catalog columns.

    The review minimum binds before K is taken; the query product is still among
    the K, so at most K - 1 others compete.
    """
    hits = search(queries, corpus, k=k, min_reviews=min_reviews, **options)
    details = corpus.filter(F.col("num_reviews") >= min_reviews).drop("embedding")
    found = hits.join(details, "product_id")
    if "exclude_id" in queries.columns:
        found = found.join(queries.select("query_id", "exclude_id"), "query_id")
    return found


def recommend(
    queries: DataFrame,
    corpus: DataFrame,
    alpha: float = ALPHA,
    top_n: int | None = TOP_N,
    k: int = RETRIEVE_K,
    min_reviews: int = MIN_REVIEWS,
    floor: float | None = None,
    search=topk,
    **options,
) -> DataFrame:
    """Ranked products for a batch of resolved queries."""
    _check_alpha(alpha)
    found = candidates(queries, corpus, k, min_reviews, search, **options)
    if floor is not None:
        found = similarity_floor(found, floor)
    exclude = F.col("exclude_id") if "exclude_id" in queries.columns else None
    return rerank(found, alpha, top_n, exclude).drop("exclude_id")
