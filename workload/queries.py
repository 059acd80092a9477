"""One entry per operator. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinarium.functions import labels, text, vectors
from opinarium.functions.scorers import label_scorer, rating_scorer
from opinarium.operators import (
    browse,
    catalog,
    classification_metrics as quality,
    exploration,
    features,
    ranking,
    ranking_metrics,
    retrieval,
    scoring,
    sentiment,
    splits,
    training,
)
from opinarium.plans import build, evaluation
from opinarium.plans import sentiment as sentiment_plan
from opinarium.session import broadcast_if_small, materialize, scratch_path
from opinarium.sources import artifacts
from opinarium.sources.reviews import load_reviews
from opinarium.streaming.scoring import score_arrivals
from workload import views

MIN_REVIEWS = 30
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def six(df: DataFrame, *columns: str) -> DataFrame:
    """Rounds doubles so that both engines print the same digits."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- per-product scores, catalog -------------------------------------------------


@query
def sp_hard(spark, d):
    return six(sentiment.sentiment_scores(views.reviews(spark, d, False, False)), "sentiment_score")


@query
def sp_valid(spark, d):
    return six(sentiment.product_scores(views.reviews(spark, d, False, False), label_scorer()), "sentiment_score")


@query
def sp_rating(spark, d):
    return six(sentiment.product_scores(views.reviews(spark, d, False, False), rating_scorer()), "sentiment_score")


@query
def catalog_min(spark, d):
    return six(views.catalog(spark, d, MIN_REVIEWS), "sentiment_score")


@query
def catalog_top(spark, d):
    return six(catalog.build_catalog(views.reviews(spark, d), rating_scorer(), limit=100), "sentiment_score")


@query
def product_stats(spark, d):
    return sentiment.product_stats(views.reviews(spark, d, False, False))


@query
def product_enriched(spark, d):
    stats = sentiment.product_stats(views.reviews(spark, d, False, False).filter(F.col("split") == "val"))
    return six(catalog.enrich_products(views.catalog(spark, d), stats), "sentiment_score")


@query
def build_counts(spark, d):
    """Products of the storefront that a build writes, and of its recommendable part."""
    path = scratch_path(spark, "build")
    build.build(views.reviews(spark, d), path, vectors.hashing_encoder(16), "hashed")
    return artifacts.load_corpus(spark, f"{artifacts.published(spark, path)}/storefront").agg(
        F.count(F.lit(1)).alias("storefront"),
        F.count_if(F.col("num_reviews") >= MIN_REVIEWS).alias("recommendable"),
        F.sum("num_reviews").alias("reviews"),
    )


@query
def reviews_csv(spark, d):
    """Documents written as CSV and read back by many tasks per file."""
    path = scratch_path(spark, "reviews-csv")
    docs = views.documents(spark, d)
    names = {"product_name": "review_title", "product_brand": "reviewer_id", "site_category_lv1": "product_id", "site_category_lv2": "product_id"}
    made = docs.select(views.text("doc_id").alias("product_id"), *[F.col(c).alias(n) for n, c in names.items()], "overall_rating", "review_text")
    artifacts.write_table(made, path, "csv")
    found = load_reviews(spark, [path], split=True)
    return found.select("product_id", "product_brand", "site_category_lv1", "overall_rating", F.md5("review_text").alias("text_md5"))


# --- exploration ------------------------------------------------------------------


@query
def category_ratings(spark, d):
    return six(exploration.category_ratings(views.reviews(spark, d, brands=False), MIN_REVIEWS), "avg_rating")


@query
def category_list(spark, d):
    return browse.category_list(views.catalog(spark, d))


@query
def subcategory_list(spark, d):
    return browse.subcategory_list(views.catalog(spark, d), "PROMO")


@query
def category_count(spark, d):
    return browse.count_products(views.catalog(spark, d), category="PROMO", query="RED|ring")


@query
def category_profile(spark, d):
    return six(exploration.category_profile(views.catalog(spark, d), MIN_REVIEWS), "mean_sentiment")


@query
def top_words(spark, d):
    return exploration.top_words(views.documents(spark, d))


@query
def top_words_funnel(spark, d):
    return exploration.top_words(views.documents(spark, d), stop_words=text.FUNNEL_STOP_WORDS)


@query
def words_by_class(spark, d):
    return exploration.words_by_class(views.documents(spark, d))


@query
def text_profile(spark, d):
    return exploration.corpus_profile(views.documents(spark, d))


@query
def missing_values(spark, d):
    names = ["product_brand", "review_text", "overall_rating", "reviewer_state", "pred_label"]
    return exploration.missing_values(views.reviews(spark, d, names=False), names)


@query
def length_by_polarity(spark, d):
    return six(exploration.length_by_polarity(views.documents(spark, d)), "avg_chars")


@query
def top_categories_products(spark, d):
    return exploration.top_categories_by_products(views.reviews(spark, d, brands=False))


@query
def best_categories(spark, d):
    return six(exploration.categories_by_rating(views.reviews(spark, d, brands=False)), "avg_rating")


@query
def worst_categories(spark, d):
    return six(exploration.categories_by_rating(views.reviews(spark, d, brands=False), best=False), "avg_rating")


@query
def product_volume(spark, d):
    return exploration.product_volume(views.reviews(spark, d, brands=False))


@query
def product_volume_top(spark, d):
    return exploration.product_volume(views.reviews(spark, d, brands=False), 50)


@query
def rating_hist(spark, d):
    return exploration.rating_histogram(views.reviews(spark, d, False, False))


@query
def pole_share(spark, d):
    return exploration.pole_share(views.reviews(spark, d, False, False))


@query
def strict_poles(spark, d):
    return exploration.strict_pole_counts(views.reviews(spark, d, False, False))


@query
def review_bins_wide(spark, d):
    return exploration.review_count_bins(views.reviews(spark, d, brands=False), "product_name", exploration.WIDE_BINS)


@query
def review_bins_dense(spark, d):
    return exploration.review_count_bins(views.reviews(spark, d, False, False))


@query
def top5_sentiment(spark, d):
    return exploration.top_categories_sentiment(views.reviews(spark, d, brands=False))


@query
def semi_join_categories(spark, d):
    """Reviews of the categories that have enough of them."""
    rows = views.reviews(spark, d, brands=False)
    large = rows.groupBy("site_category_lv1").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 50)
    large = broadcast_if_small(large.select("site_category_lv1"), F.col("site_category_lv1"))
    return rows.join(large, "site_category_lv1", "left_semi").select("review_id", "site_category_lv1", "overall_rating")


@query
def mismatch_rating(spark, d):
    cases = exploration.rating_recommendation_mismatch(views.reviews(spark, d, False, False))
    return exploration.case_examples(cases).select("case", "rank", "review_id", "overall_rating", "recommend_to_a_friend")


@query
def mismatch_rating_counts(spark, d):
    return exploration.case_counts(exploration.rating_recommendation_mismatch(views.reviews(spark, d, False, False)))


@query
def mismatch_pred(spark, d):
    cases = exploration.prediction_rating_mismatch(views.reviews(spark, d, False, False))
    return exploration.case_examples(cases).select("case", "rank", "review_id", "overall_rating", "pred_label", "pred_prob")


@query
def mismatch_pred_counts(spark, d):
    return exploration.case_counts(exploration.prediction_rating_mismatch(views.reviews(spark, d, False, False)))


# --- labels and review pages -------------------------------------------------------


@query
def polarity(spark, d):
    rating = F.col("overall_rating")
    return views.reviews(spark, d, False, False).select(
        "review_id",
        labels.polarity(rating).alias("polarity"),
        labels.strict_pole(rating).alias("strict_pole"),
        labels.two_pole(rating).alias("pole"),
    )


@query
def drop_neutral(spark, d):
    rows = views.reviews(spark, d, False, False)
    return rows.filter(labels.not_neutral(F.col("overall_rating"))).select("review_id", "overall_rating")


@query
def coerce_rating(spark, d):
    """Mixed texts as numbers: state names, stars with blanks, nothing."""
    rows = views.reviews(spark, d, False, False)
    mixed = rows.select(
        "review_id",
        F.coalesce(F.concat(F.lit(" "), F.col("overall_rating").cast("string"), F.lit(".5 ")), F.col("reviewer_state")).alias("raw"),
    )
    return mixed.select("review_id", labels.number(mixed, "raw").alias("value"))


@query
def review_view(spark, d):
    return browse.review_page(views.reviews(spark, d))


@query
def review_filters(spark, d):
    return browse.filter_reviews(views.reviews(spark, d, False, False), "yes", 4).select("review_id", "product_id")


@query
def parse_answers(spark, d):
    return views.answers(spark, d).select("event_id", labels.parse_answer(F.col("raw")).alias("a")).select("event_id", "a.*")


@query
def row_ids(spark, d):
    rows = splits.row_ids(views.reviews(spark, d, False, False), ["review_id", "product_id", "overall_rating"])
    return rows.select("row_id", "split", "review_id")


@query
def prompts(spark, d):
    prompt = scoring.Prompt("", 'Título: "{title}"\nTexto: "{text}"')
    rows = views.reviews(spark, d)
    body = prompt.render(text.clean_field(F.col("review_title")), text.clean_field(F.col("review_text")))
    return rows.select("review_id", body.alias("prompt"))


@query
def query_text(spark, d):
    return views.table(spark, d, "part").select(
        views.text("p_partkey").alias("product_id"), vectors.query_text(F.col("p_name")).alias("query")
    )


# --- text and term weights ----------------------------------------------------------


@query
def normalize_text(spark, d):
    return views.documents(spark, d).select("doc_id", text.normalize_text(F.col("review_text")).alias("text"))


@query
def normalize_light(spark, d):
    return views.documents(spark, d).select("doc_id", text.normalize_light(F.col("review_text")).alias("text"))


@query
def normalize_pages(spark, d):
    return views.pages(spark, d).select("page_id", text.normalize_text(F.col("html")).alias("text"))


@query
def text_input(spark, d):
    return views.documents(spark, d).select(
        "doc_id", text.text_input(F.col("review_title"), F.col("review_text")).alias("text")
    )


@query
def clean_fields(spark, d):
    return views.documents(spark, d).select("doc_id", text.clean_field(F.col("review_title")).alias("title"))


@query
def lemma_filter(spark, d):
    return features.lemmatize(
        views.documents(spark, d), "doc_id", "review_text", views.lemmas(spark, d), text.REPORT_STOP_WORDS
    )


@query
def ngrams(spark, d):
    grams = text.ngrams(text.analyzer_tokens(F.col("review_text")), 1, 2)
    return (
        views.documents(spark, d)
        .select("doc_id", F.sort_array(grams).alias("g"))
        .select("doc_id", F.size("g").cast("long").alias("n"), F.md5(F.array_join("g", "|")).alias("digest"))
    )


def _terms(spark: SparkSession, d: str, mode: str) -> DataFrame:
    return features.document_terms(views.documents(spark, d), "doc_id", "review_text", mode)


@query
def vocabulary(spark, d):
    return six(features.fit_vocabulary(_terms(spark, d, "both")), "idf")


@query
def vocabulary_bigrams(spark, d):
    return six(features.fit_vocabulary(_terms(spark, d, "bigrams")), "idf")


@query
def tfidf(spark, d):
    """Vocabulary from the labelled documents, weights for all of them."""
    labelled = views.documents(spark, d).filter(F.col("polarity").isNotNull())
    known = features.fit_vocabulary(features.document_terms(labelled, "doc_id", "review_text", "unigrams"))
    return six(features.tfidf(_terms(spark, d, "unigrams"), known, "doc_id"), "weight")


# --- splits ---------------------------------------------------------------------------


@query
def split_hash(spark, d):
    return splits.split_by_hash(views.documents(spark, d), "doc_id").select("doc_id", "split")


@query
def split_no_neutral(spark, d):
    rows = splits.split_without_neutrals(views.reviews(spark, d, False, False).drop("split"), "review_id")
    return rows.select("review_id", "overall_rating", "split")


@query
def split_stratified(spark, d):
    return splits.split_stratified(views.documents(spark, d), "doc_id", "reviewer_id").select("doc_id", "reviewer_id", "split")


@query
def folds(spark, d):
    rows = views.documents(spark, d).filter(F.col("polarity").isNotNull())
    return splits.stratified_folds(rows, "doc_id", "polarity").select("doc_id", "polarity", "fold")


@query
def sample_unique(spark, d):
    return splits.sample_unique(views.documents(spark, d), 50, "doc_id").select("doc_id", "review_text")


@query
def head_per_split(spark, d):
    rows = splits.split_by_hash(views.documents(spark, d), "doc_id")
    return splits.head_per_split(rows, 20, "doc_id").select("doc_id", "split")


@query
def union_splits(spark, d):
    rows = splits.split_by_hash(views.documents(spark, d), "doc_id")
    parts = [rows.filter(F.col("split") == name).select("doc_id", "split") for name in ("val", "test")]
    return splits.union_splits(*parts)


# --- retrieval and ranking -------------------------------------------------------------


@query
def cosine_topk(spark, d):
    queries = views.product_queries(spark, d)
    return six(retrieval.topk(queries, views.vectors(spark, d), k=10), "similarity")


@query
def filtered_topk(spark, d):
    return six(
        retrieval.topk(views.product_queries(spark, d), views.corpus(spark, d), k=10, min_reviews=MIN_REVIEWS), "similarity"
    )


@query
def blocked_topk(spark, d):
    """The search for many queries: both sides cut into blocks."""
    return six(
        retrieval.topk(
            views.product_queries(spark, d), views.vectors(spark, d), k=10, query_block=256, product_block=512
        ),
        "similarity",
    )


@query
def rescore(spark, d):
    """Hits of the search scored again from the stored vectors."""
    queries, rows = views.product_queries(spark, d), views.vectors(spark, d)
    return six(retrieval.rescore(retrieval.topk(queries, rows, k=10), queries, rows), "similarity")


@query
def rerank(spark, d):
    """Order lines as candidates of their order, the first line left out."""
    rows = views.reviews(spark, d, False, False).select(
        F.substring_index("review_id", "-", 1).alias("query_id"),
        F.col("review_id").alias("product_id"),
        F.col("pred_prob").alias("similarity"),
        F.coalesce("polarity", F.lit(0)).cast("double").alias("sentiment_score"),
        F.concat_ws("-", F.substring_index("review_id", "-", 1), F.lit("1")).alias("first_line"),
    )
    kept = rows.withColumn("leave_out", F.when(F.col("product_id").startswith(F.concat("first_line", F.lit("-"))), F.col("product_id")))
    ranked = ranking.rerank(kept, alpha=0.6, top_n=3, exclude=F.col("leave_out"))
    return six(ranked.select("query_id", "product_id", "score", "rank"), "score")


def _recommend(spark: SparkSession, d: str, **options) -> DataFrame:
    return ranking.recommend(views.product_queries(spark, d), views.corpus(spark, d), min_reviews=MIN_REVIEWS, **options)


@query
def recommend(spark, d):
    return six(_recommend(spark, d), "similarity", "sentiment_score", "score")


@query
def recommend_floor(spark, d):
    return six(_recommend(spark, d, floor=0.1), "similarity", "sentiment_score", "score")


@query
def recommend_enriched(spark, d):
    stats = sentiment.product_stats(views.reviews(spark, d, False, False))
    ranked = catalog.enrich_products(_recommend(spark, d, top_n=5), stats)
    return six(
        ranked.select("query_id", "rank", "product_id", "score", "avg_rating", "review_count", "description"), "score"
    )


@query
def alpha_sweep(spark, d):
    found = ranking.candidates(views.product_queries(spark, d), views.corpus(spark, d), k=20, min_reviews=MIN_REVIEWS)
    swept = ranking.alpha_sweep(found, (0.0, 0.3, 0.7, 1.0), top_n=3, exclude=F.col("exclude_id"))
    return six(swept.select("query_id", "alpha", "product_id", "rank", "score"), "score")


@query
def resolve_queries(spark, d):
    """Every part asked for by id; parts without a vector are rejected."""
    asked = views.table(spark, d, "part").select(
        F.concat(F.lit("q"), views.text("p_partkey")).alias("query_id"), views.text("p_partkey").alias("product_id")
    )
    resolved, rejected = ranking.resolve_queries(asked, views.vectors(spark, d))
    kept = resolved.select("query_id", "exclude_id", F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(rejected.select("query_id", F.lit(None).cast("string").alias("exclude_id"), "reason"))


@query
def catalog_page(spark, d):
    page = browse.catalog_page(views.catalog(spark, d), limit=24, offset=24, category="ECONOMY", query="E")
    return six(page, "sentiment_score")


@query
def product_lookup(spark, d):
    return six(browse.product(views.catalog(spark, d), "17"), "sentiment_score")


# --- classification quality --------------------------------------------------------------


@query
def confusion(spark, d):
    return quality.confusion(views.reviews(spark, d, False, False))


@query
def class_report(spark, d):
    return quality.class_report(quality.confusion(views.reviews(spark, d, False, False)), decimals=6)


@query
def auc_prob(spark, d):
    return six(quality.auc(views.reviews(spark, d, False, False)), "auc")


@query
def auc_raw(spark, d):
    """Scores with very many distinct values."""
    rows = views.reviews(spark, d, False, False).withColumn("raw", F.col("seconds") * F.col("tokens_in"))
    return six(quality.auc(rows, ("split",), score="raw"), "auc")


@query
def auc_hard(spark, d):
    matrix = quality.confusion(views.reviews(spark, d, False, False))
    return matrix.select("model", "split", F.round(quality.hard_auc(), 6).alias("auc"))


@query
def kappa(spark, d):
    return six(quality.cohens_kappa(views.reviews(spark, d, False, False), "polarity", "pred_label"), "po", "pe", "kappa")


@query
def class_weights(spark, d):
    return six(sentiment.class_weights(views.documents(spark, d), "polarity"), "class_weight")


@query
def prediction_counts(spark, d):
    return quality.prediction_counts(views.predictions(spark, d))


@query
def usage_stats(spark, d):
    return quality.usage_stats(views.predictions(spark, d))


@query
def eval_rollup(spark, d):
    return quality.evaluate_predictions(views.predictions(spark, d)).select(
        "split", "total", "ok", "failed", "f1_macro", "auc_hard", "accuracy", "avg_input_tokens"
    )


@query
def champion(spark, d):
    report = quality.class_report(quality.confusion(views.reviews(spark, d, False, False)), decimals=6)
    return training.champion(report).select("model", "split", "f1_macro")


@query
def champion_scores(spark, d):
    """S(p) from the reviews scored by the champion."""
    rows = views.reviews(spark, d, False, False)
    best = training.champion(quality.class_report(quality.confusion(rows), decimals=6)).select("model")
    return six(sentiment.sentiment_scores(rows.join(best, "model", "left_semi")), "sentiment_score")


@query
def resume_pending(spark, d):
    rows = views.reviews(spark, d, False, False).select(F.col("review_id").alias("row_id"), "split")
    return scoring.pending(rows, views.predictions(spark, d))


# --- ranking quality ------------------------------------------------------------------------


def _graded(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.graded_products(views.by_product(spark, d, brands=False), MIN_REVIEWS)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Every product vector as a query in the category of its product."""
    parts = views.table(spark, d, "part").select(views.text("p_partkey").alias("product_id"), F.col("p_type").alias("query_category"))
    return views.vectors(spark, d).join(parts, "product_id").select(
        F.col("product_id").alias("query_id"), F.col("product_id").alias("query_product"), "query_category"
    )


def _judged(spark: SparkSession, d: str, graded: DataFrame) -> DataFrame:
    return ranking_metrics.judge(_recommend(spark, d), graded, _asked(spark, d).select("query_id", "query_category"))


@query
def relevance(spark, d):
    return six(_graded(spark, d).select("site_category_lv1", "product_id", "relevance"), "relevance")


@query
def precision_recall_k(spark, d):
    graded = _graded(spark, d)
    totals = ranking_metrics.relevant_counts(graded, _asked(spark, d))
    found = ranking_metrics.precision_recall(_judged(spark, d, graded), totals)
    return six(found, "precision_at_5", "precision_at_10", "recall_at_5", "recall_at_10")


@query
def ndcg_k(spark, d):
    return six(ranking_metrics.ndcg(_judged(spark, d, _graded(spark, d))), "ndcg_at_5", "ndcg_at_10")


@query
def ndcg_exp_k(spark, d):
    judged = _judged(spark, d, _graded(spark, d))
    return six(ranking_metrics.ndcg(judged, exponential=True), "ndcg_at_5", "ndcg_at_10")


@query
def objective_eval(spark, d):
    found = evaluation.evaluate(_recommend(spark, d), _graded(spark, d), _asked(spark, d))
    return six(found, *[c for c in found.columns if "_at_" in c])


@query
def list_quality(spark, d):
    asked = _asked(spark, d).select("query_id", "query_category")
    return ranking_metrics.list_quality(_recommend(spark, d), asked)


# --- models, encoders, incremental scoring ---------------------------------------------------


def _fixed_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """A vocabulary with made coefficients, so that scoring can be checked."""
    known = features.fit_vocabulary(_terms(spark, d, "unigrams"))
    return known.select("term", "idf", (F.length("term") % 5 - 2).cast("double").alias("coefficient"))


@query
def linear_scores(spark, d):
    return scoring.score_terms(_terms(spark, d, "unigrams"), _fixed_coefficients(spark, d), 0.25, "doc_id")


@query
def lr_scores(spark, d):
    """Search, fit and score; training reads the labelled documents only."""
    docs = views.documents(spark, d)
    model = sentiment_plan.train_sparse(docs, "doc_id", "review_text", "polarity")
    return sentiment_plan.score(docs, model, "doc_id", "review_text")


@query
def dense_scores(spark, d):
    """The same classifier on dense vectors of the texts."""
    docs = views.documents(spark, d)
    dense = materialize(
        features.embed(docs, "review_text", vectors.hashing_encoder(64)).select("doc_id", "embedding", "polarity"), "dense"
    )
    labelled = dense.filter(F.col("polarity").isNotNull()).select("doc_id", F.col("polarity").alias("label"))
    rows = dense.select("doc_id", F.col("embedding").alias("features"))
    folded = splits.stratified_folds(labelled, "doc_id", "label", 3)
    table = training.training_table(rows, folded, "doc_id", sentiment.class_weights(labelled))
    return scoring.score_vectors(dense, training.grid_search(table).model).select("doc_id", "pred_label", "pred_prob")


ANN_CELLS = 16


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, retrieval.Cells, int]:
    """(queries, vectors, cells, calibrated probes) of the approximate search."""
    rows, queries = views.vectors(spark, d), views.product_queries(spark, d)
    cells = retrieval.sample_cells(rows, ANN_CELLS)
    return queries, rows, cells, retrieval.calibrate_probes(queries, rows, cells, k=10)


@query
def ann_topk(spark, d):
    """Probes chosen so that a sample of queries finds 95 % of its exact lists."""
    queries, rows, cells, probes = _index(spark, d)
    return six(retrieval.approximate_topk(queries, rows, cells, k=10, probes=probes), "similarity")


@query
def ann_all_cells(spark, d):
    """Probing every cell gives the exact list."""
    rows = views.vectors(spark, d)
    cells = retrieval.train_cells(rows, 8)
    found = retrieval.approximate_topk(
        views.product_queries(spark, d), rows, cells, k=10, probes=8, query_block=256, product_block=64
    )
    return six(found, "similarity")


@query
def ann_recall(spark, d):
    queries, rows, cells, probes = _index(spark, d)
    found = retrieval.approximate_topk(queries, rows, cells, k=10, probes=probes)
    return six(retrieval.recall(found, retrieval.topk(queries, rows, k=10)), "recall")


@query
def pruned_topk(spark, d):
    """The exact list, leaving out cells whose bound the K-th similarity beats."""
    rows = views.vectors(spark, d)
    cells = retrieval.sample_cells(rows, ANN_CELLS)
    return six(retrieval.pruned_topk(views.product_queries(spark, d), rows, cells, k=10), "similarity")


@query
def embed_titles(spark, d):
    rows = views.table(spark, d, "part").select(views.text("p_partkey").alias("product_id"), "p_name")
    found = features.embed(rows, "p_name", vectors.hashing_encoder(16))
    return found.select("product_id", *[F.round(F.col("embedding")[i], 4).alias(f"v{i:02d}") for i in range(16)])


@query
def embed_cache(spark, d):
    """Vectors of all documents when those of one language are known."""
    docs = views.documents(spark, d)
    encoder = vectors.hashing_encoder(16)
    empty = spark.createDataFrame([], "model string, digest string, embedding array<float>")
    known, _ = features.embed_or_reuse(docs.filter(F.col("reviewer_id") == "en"), "review_text", empty, encoder, "hashed")
    whole, fresh = features.embed_or_reuse(docs, "review_text", known, encoder, "hashed")
    new = fresh.select("digest", F.lit(True).alias("fresh"))
    return whole.join(new, "digest", "left").select("digest", F.coalesce("fresh", F.lit(False)).alias("fresh"))


@query
def recommend_text(spark, d):
    """Product names as free-text queries over encoded titles."""
    encoder = vectors.hashing_encoder(32)
    products = features.embed(views.catalog(spark, d), "product_name", encoder)
    asked = products.select(F.col("product_name").alias("text")).distinct().select(F.md5("text").alias("query_id"), "text")
    resolved, _ = ranking.resolve_queries(asked, products, encoder=encoder)
    return six(ranking.recommend(resolved, products, min_reviews=MIN_REVIEWS), "similarity", "sentiment_score", "score")


def stub_client():
    """Stands in for a model server: long bodies are positive, blank ones fail."""

    def answer(system, prompts):
        replies = []
        for prompt in prompts:
            body = prompt.partition("\n")[2]
            failed = len(body) <= 9
            replies.append({
                "raw": None if failed else '{"sentiment": "%s"}' % ("positive" if len(prompt) % 2 else "negative"),
                "error": "ValueError: blank text" if failed else None,
                "input_tokens": len(prompt),
                "output_tokens": 0 if failed else 7,
                "response_time_s": 0.0,
            })
        return replies

    return answer


PROMPT = scoring.Prompt("Classify the review.", 'Título: "{title}"\nTexto: "{text}"')


@query
def prompt_scores(spark, d):
    rows = views.reviews(spark, d)
    return scoring.ask(rows, "review_id", PROMPT, "review_title", "review_text", lambda: stub_client())


@query
def resumed_scores(spark, d):
    """Two runs over the same rows: the second retries what failed before."""
    path = scratch_path(spark, "predictions")
    rows = views.reviews(spark, d, names=False).select(F.col("review_id").alias("row_id"), "review_text", "split")
    titled = rows.withColumn("title", F.col("split"))
    once = lambda due: scoring.ask(due, "row_id", PROMPT, "title", "review_text", lambda: stub_client())
    full = lambda due: once(due.withColumn("review_text", F.coalesce("review_text", F.lit("retried"))))
    scoring.resume(titled, path, "run-1", once)
    scoring.resume(titled, path, "run-2", full)
    return scoring.latest(spark.read.parquet(path))


@query
def stream_scores(spark, d):
    """Documents scored by a linear model as they arrive; one pass over what is there."""
    base = scratch_path(spark, "stream")
    model = scoring.load_model(_fixed_coefficients(spark, d))
    schema = views.table(spark, d, "documents").schema

    def score(rows: DataFrame) -> DataFrame:
        return scoring.score_rows(features.document_terms(rows, "doc_id", "text", "unigrams"), model, 0.25, "doc_id")

    score_arrivals(spark, f"{d}/documents*.parquet", schema, score, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out")
