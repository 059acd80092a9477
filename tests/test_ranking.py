import os
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinarium.functions import vectors
from opinarium.functions.scorers import rating_scorer
from opinarium.operators import browse, ranking, ranking_metrics, retrieval
from opinarium.plans import build, evaluation
from opinarium.sources import artifacts
from tests.conftest import seeded_encoder

CANDIDATES = "query_id string, product_id string, similarity double, sentiment_score double"


def ids(df):
    return [r.product_id for r in df.orderBy("query_id", "rank").collect()]


def candidates(spark, *rows):
    return spark.createDataFrame([("q", *r) for r in rows], CANDIDATES)


def test_rerank_order_ties_caps_and_exclusion(spark):
    three = candidates(spark, ("a", 0.9, 0.0), ("b", 0.4, 1.0), ("c", 0.5, 0.5))
    ranked = ranking.rerank(three, 0.5)
    assert ids(ranked) == ["b", "c", "a"] and ranked.orderBy("rank").first().score == pytest.approx(0.70)
    two = candidates(spark, ("a", 0.9, 0.0), ("b", 0.1, 1.0))
    assert ids(ranking.rerank(two, 1.0)) == ["a", "b"] and ids(ranking.rerank(two, 0.0)) == ["b", "a"]
    assert ids(ranking.rerank(three, 0.5, exclude=F.lit("b"))) == ["c", "a"]
    assert len(ids(ranking.rerank(three, 0.5, top_n=2))) == 2
    assert ids(ranking.rerank(candidates(spark, ("b", 0.5, 0.5), ("a", 0.5, 0.5)), 0.5)) == ["a", "b"]
    with pytest.raises(ValueError, match="alpha"):
        ranking.rerank(three, 1.5)
    assert ids(ranking.rerank(three.repartition(3), 0.5)) == ids(ranking.rerank(three.coalesce(1), 0.5))


def test_published_score(spark):
    row = ranking.rerank(candidates(spark, ("p", 0.8618851900100708, 0.9473684210526316)), 0.7).first()
    assert row.score == pytest.approx(0.8875301593228391, abs=1e-15)


def test_alpha_sweep_ranks_each_alpha(spark):
    two = candidates(spark, ("a", 0.9, 0.0), ("b", 0.1, 1.0))
    got = {r.alpha: r.product_id for r in ranking.alpha_sweep(two, (0.0, 1.0), top_n=1).collect()}
    assert got == {0.0: "b", 1.0: "a"}


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((300, 8))
    base[100:200] = base[5]  # a third of all vectors are copies
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(f"p{i:03d}", [float(x) for x in np.float32(v)], i % 10) for i, v in enumerate(base)]
    corpus = spark.createDataFrame(rows, "product_id string, embedding array<float>, num_reviews long").repartition(5)
    queries = corpus.select(F.col("product_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return rows, corpus, queries


def brute(rows, k, minimum=0):
    matrix = np.array([r[1] for r in rows])
    kept = [(r[0], i) for i, r in enumerate(rows) if r[2] >= minimum]
    out = {}
    for name, vector, _ in rows:
        sims = sorted((-round(float(matrix[i] @ np.array(vector)), 9), p) for p, i in kept)
        out[name] = [p for _, p in sims[:k]]
    return out


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((-round(r.similarity, 9), r.product_id))
    return {q: [p for _, p in sorted(found)] for q, found in out.items()}


def test_exact_search_filters_before_k(points):
    rows, corpus, queries = points
    assert lists(retrieval.topk(queries, corpus, k=7)) == brute(rows, 7)
    assert lists(retrieval.topk(queries, corpus, k=7, min_reviews=6)) == brute(rows, 7, 6)
    assert all(len(v) == 30 for v in lists(retrieval.topk(queries, corpus, k=50, min_reviews=9)).values())


def test_blocked_search_gives_the_same(points):
    rows, corpus, queries = points
    found = retrieval.topk(queries, corpus, k=7, query_block=64, product_block=50)
    assert lists(found) == brute(rows, 7)


def test_blocks_do_not_change_what_travels(points):
    """Copies of a vector follow the tasks; block sizes only bound a matrix."""
    rows, corpus, queries = points
    plan = retrieval._tasks({0: 720_000}, {0: 720_000}, 12)
    assert plan == [(0, 0, 24, 1)]
    # A lone query is spread over its products, a cell without products is left out.
    assert retrieval._tasks({0: 1, 1: 5}, {0: 100_000}, 4) == [(0, 0, 1, 8)]
    assert retrieval._tasks({}, {}, 4) == []
    found = retrieval.topk(queries, corpus, k=7, query_block=5, product_block=3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionById") + found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert lists(found) == brute(rows, 7)


def test_equal_similarities_go_by_id(spark):
    rows = [(f"p{i:03d}", [1.0, 0.0], 1) for i in range(90)]
    corpus = spark.createDataFrame(rows, "product_id string, embedding array<float>, num_reviews long").repartition(3)
    queries = corpus.select(F.col("product_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = lists(retrieval.topk(queries, corpus, k=4, query_block=16, product_block=7))
    assert len(found) == 90 and all(f == ["p000", "p001", "p002", "p003"] for f in found.values())


def test_probing_every_cell_is_exact_and_few_cells_recall_well(points):
    rows, corpus, queries = points
    cells = retrieval.train_cells(corpus, 6)
    exact = retrieval.topk(queries, corpus, k=5)
    assert lists(retrieval.approximate_topk(queries, corpus, cells, k=5, probes=6, product_block=40)) == brute(rows, 5)
    some = retrieval.approximate_topk(queries, corpus, cells, k=5, probes=3)
    assert retrieval.recall(some, exact).agg(F.avg("recall")).first()[0] > 0.8


def test_pruned_search_is_exact_and_skips_cells(spark, points):
    rows, corpus, queries = points
    for cells in (retrieval.sample_cells(corpus, 6), retrieval.train_cells(corpus, 6)):
        effort = []
        assert lists(retrieval.pruned_topk(queries, corpus, cells, k=7, effort=effort, product_block=40)) == brute(rows, 7)
        assert effort[0] <= effort[1]
        assert lists(retrieval.pruned_topk(queries, corpus, cells, k=7, min_reviews=6)) == brute(rows, 7, 6)
    # Fewer products than k, no queries, no products.
    assert all(len(v) == 30 for v in lists(retrieval.pruned_topk(queries, corpus, cells, k=50, min_reviews=9)).values())
    assert retrieval.pruned_topk(queries.filter("false"), corpus, cells).count() == 0
    assert retrieval.pruned_topk(queries, corpus.filter("false"), cells).count() == 0
    assert retrieval.pruned_topk(queries, corpus, retrieval.sample_cells(corpus.filter("false"), 4)).count() == 0


def test_pruned_search_of_clusters_and_any_length(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((8, 16))
    base = np.repeat(centers, 40, axis=0) + 0.05 * rng.standard_normal((320, 16))
    base *= rng.uniform(0.5, 2.0, (320, 1))
    base[7] = 0.0
    rows = [(f"p{i:03d}", [float(x) for x in np.float32(v)], 1) for i, v in enumerate(base)]
    corpus = spark.createDataFrame(rows, "product_id string, embedding array<float>, num_reviews long")
    queries = corpus.select(F.col("product_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    effort = []
    found = retrieval.pruned_topk(queries, corpus, retrieval.train_cells(corpus.filter("product_id <> 'p007'"), 8), k=5, effort=effort)
    assert lists(found) == brute(rows, 5)
    assert effort[0] < 0.5 * effort[1]


def test_calibrated_probes_keep_the_recall_without_clusters(spark):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((600, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(f"p{i:03d}", [float(x) for x in np.float32(v)], 1) for i, v in enumerate(base)]
    corpus = spark.createDataFrame(rows, "product_id string, embedding array<float>, num_reviews long")
    queries = corpus.select(F.col("product_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    cells = retrieval.sample_cells(corpus, 12)
    probes = retrieval.calibrate_probes(queries, corpus, cells, k=10, sample=100)
    exact = retrieval.topk(queries, corpus, k=10)
    found = retrieval.approximate_topk(queries, corpus, cells, k=10, probes=probes)
    assert retrieval.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    fewer = retrieval.approximate_topk(queries, corpus, cells, k=10, probes=1)
    assert probes > 1 and retrieval.recall(fewer, exact).agg(F.avg("recall")).first()[0] < 0.9
    assert retrieval.calibrate_probes(queries.filter("false"), corpus, cells, k=10) == 1


def test_no_queries(spark, points):
    _, corpus, queries = points
    assert retrieval.topk(queries.filter("false"), corpus).count() == 0
    assert retrieval.topk_few(queries.filter("false"), corpus).count() == 0


def test_few_queries_travel_to_the_corpus(points):
    rows, corpus, queries = points
    assert lists(retrieval.topk_few(queries, corpus, k=7)) == brute(rows, 7)
    many = queries.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(retrieval.MAX_QUERIES))))
    with pytest.raises(ValueError):
        retrieval.topk_few(many, corpus)


def test_failed_build_keeps_the_old_one(spark, corpus_reviews, tmp_path):
    path = str(tmp_path)
    build.build(corpus_reviews, path, seeded_encoder(), "seeded", rating_scorer())
    with pytest.raises(ValueError):
        build.build(corpus_reviews, path, seeded_encoder(), "seeded", rating_scorer(), min_reviews=99)
    first = artifacts.published(spark, path)
    assert artifacts.load_corpus(spark, f"{first}/corpus").count() == 3
    record = spark.read.json(f"{first}/build").first().asDict()
    assert (record["dimension"], record["recommend_min_reviews"], record["positive_threshold"], record["label_sources"]) == (16, 5, 4, "")
    assert record["query_instruction"] == vectors.QUERY_INSTRUCTION and record["corpus_products"] == 3 and record["built_at"].endswith("Z")


def test_readers_see_whole_builds(spark, corpus_reviews, storefront_reviews, tmp_path, monkeypatch):
    path = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        artifacts.published(spark, path)
    build.build(corpus_reviews, path, seeded_encoder(), "one", rating_scorer())
    first = artifacts.published(spark, path)

    def stop(table, folder):
        if folder.endswith("storefront"):
            raise RuntimeError("stopped between two tables")
        write(table, folder)

    write = artifacts.write_corpus
    monkeypatch.setattr(artifacts, "write_corpus", stop)
    with pytest.raises(RuntimeError):
        build.build(storefront_reviews, path, seeded_encoder(), "two", rating_scorer())
    assert artifacts.published(spark, path) == first and artifacts.load_corpus(spark, f"{first}/corpus").count() == 3
    monkeypatch.setattr(artifacts, "write_corpus", write)
    build.build(storefront_reviews, path, seeded_encoder(), "three", rating_scorer())
    last = artifacts.published(spark, path)
    assert artifacts.load_corpus(spark, f"{last}/corpus").count() == 2 and artifacts.load_corpus(spark, f"{first}/corpus").count() == 3
    artifacts.remove_old_versions(spark, path)
    assert artifacts.load_corpus(spark, f"{last}/corpus").count() == 2 and not os.path.exists(first)


def test_nearest_first(spark):
    rows = [("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.9, 0.1, 0.0, 0.0]), ("c", [0.0, 0.0, 1.0, 0.0])]
    corpus = spark.createDataFrame(rows, "product_id string, v array<float>").select("product_id", vectors.unit(F.col("v")).alias("embedding"))
    query = spark.createDataFrame([("q", [1.0, 0.0, 0.0, 0.0])], "query_id string, query_vector array<float>")
    found = retrieval.topk(query, corpus, k=3).orderBy(F.desc("similarity")).collect()
    assert [r.product_id for r in found] == ["a", "b", "c"] and found[0].similarity == pytest.approx(1.0)


@pytest.fixture(scope="module")
def shop(spark, corpus_reviews, storefront_reviews, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("artifacts"))
    counts = build.build(corpus_reviews, path, seeded_encoder(), "seeded", rating_scorer(), storefront_reviews=storefront_reviews)
    assert counts == {"corpus": 3, "storefront": 2}
    version = artifacts.published(spark, path)
    return artifacts.load_corpus(spark, f"{version}/corpus"), artifacts.load_corpus(spark, f"{version}/storefront")


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, product_id string, text string")


def test_recommend_by_product_and_text(spark, shop):
    corpus, storefront = shop
    asked = ask(spark, ("s1", "S1", None), ("c1", "C1", None), ("t", None, "Smartphone Galaxy"), ("bad", "X", None), ("none", None, None))
    resolved, rejected = ranking.resolve_queries(asked, corpus, storefront, seeded_encoder())
    assert {r.query_id: r.reason for r in rejected.collect()} == {"bad": "unknown product: X", "none": "neither product nor text given"}
    got = ranking.recommend(resolved, corpus, min_reviews=1).collect()
    first = {r.query_id: r for r in got if r["rank"] == 1}
    assert first["s1"].product_id == "C1" and first["s1"].similarity > 0.99
    assert first["t"].product_id == "C1"
    assert "C1" not in {r.product_id for r in got if r.query_id == "c1"}
    scores = [r.score for r in sorted((r for r in got if r.query_id == "s1"), key=lambda r: r["rank"])]
    assert scores == sorted(scores, reverse=True)


def test_recommend_minimum_and_floor(spark, shop):
    corpus, storefront = shop
    resolved, _ = ranking.resolve_queries(ask(spark, ("s1", "S1", None)), corpus, storefront)
    assert {r.product_id for r in ranking.recommend(resolved, corpus, min_reviews=3).collect()} == {"C1", "C3"}
    assert {r.product_id for r in ranking.recommend(resolved, corpus, min_reviews=1, floor=0.99).collect()} == {"C1"}


def test_query_product_leaves_after_k(spark, shop):
    corpus, _ = shop
    resolved, _ = ranking.resolve_queries(ask(spark, ("c1", "C1", None)), corpus)
    assert ranking.recommend(resolved, corpus, k=2, min_reviews=1).count() == 1


def test_storefront_page(shop):
    assert {r.product_id for r in browse.catalog_page(shop[1]).collect()} == {"S1", "S2"}


GRADES = [0.868421, 0.819355, 0.775785, 0.844388, 0.65, 0.764286, 0.833333, 0.741071, 0.875, 0.787736]


def judged(spark, grades):
    return spark.createDataFrame([("q", i + 1, g) for i, g in enumerate(grades)], "query_id string, rank int, relevance double")


def test_published_list_metrics(spark):
    totals = spark.createDataFrame([("q", 126)], "query_id string, total_relevant long")
    row = ranking_metrics.list_metrics(judged(spark, GRADES), totals).first()
    assert (row.precision_at_5, row.precision_at_10) == (0.8, 0.9)
    assert (row.recall_at_5, row.recall_at_10) == pytest.approx((4 / 126, 9 / 126))
    assert (row.ndcg_at_5, row.ndcg_at_10) == pytest.approx((0.9474043254673, 0.9868126447451), abs=1e-5)


def test_short_lists_empty_lists_and_no_gain(spark):
    totals = spark.createDataFrame([("q", 0), ("empty", 3)], "query_id string, total_relevant long")
    rows = {r.query_id: r for r in ranking_metrics.list_metrics(judged(spark, [0.9, 0.0]), totals).collect()}
    assert (rows["q"].precision_at_5, rows["q"].recall_at_5, rows["q"].ndcg_at_5) == (0.2, 0.0, 1.0)
    assert (rows["empty"].precision_at_5, rows["empty"].ndcg_at_10) == (0.0, 0.0)
    assert ranking_metrics.ndcg(judged(spark, [0.0, 0.0])).first().ndcg_at_5 == 0.0


def test_exponential_gain(spark):
    got = ranking_metrics.ndcg(judged(spark, [0.2, 1.0]), exponential=True).first().ndcg_at_5
    gain = [2**0.2 - 1, 1.0]
    assert got == pytest.approx((gain[0] + gain[1] / math.log2(3)) / (gain[1] + gain[0] / math.log2(3)))


def test_relevance_and_objective_evaluation(spark):
    rows = [(i, p, p, c, r) for i, (p, c, r) in enumerate(
        [("A", "x", 5), ("A", "x", 5), ("B", "x", 1), ("B", "x", 1), ("C", "x", 4), ("C", "x", 4), ("D", "y", 3), ("D", "y", 3), ("E", "y", None), ("E", "y", None)]
    )]
    reviews = spark.createDataFrame(rows, "review_id int, product_id string, product_name string, site_category_lv1 string, overall_rating int")
    graded = evaluation.graded_products(reviews, 2)
    assert {r.product_id: r.relevance for r in graded.collect()} == {"A": 1.0, "B": 0.0, "C": 0.75, "D": 0.0, "E": 0.0}
    queries = spark.createDataFrame([("q", "A", "x"), ("u", "Z", "x")], "query_id string, query_product string, query_category string")
    recs = spark.createDataFrame([("q", "C", 1), ("q", "D", 2)], "query_id string, product_id string, rank int")
    row = evaluation.evaluate(recs, graded, queries, (2,)).collect()
    assert [(r.query_id, r.total_relevant, r.precision_at_2, r.recall_at_2, r.ndcg_at_2) for r in row] == [("q", 1, 0.5, 1.0, 1.0)]
    assert [r.query_id for r in evaluation.unknown(graded, queries).collect()] == ["u"]


def test_list_quality(spark):
    rows = [("q", "a", 0.4, 0.2, "x"), ("q", "b", 0.8, 0.9, "y")]
    recs = spark.createDataFrame(rows, "query_id string, product_id string, similarity double, sentiment_score double, site_category_lv1 string")
    category = spark.createDataFrame([("q", "y")], "query_id string, query_category string")
    row = ranking_metrics.list_quality(recs, category).first()
    assert tuple(row) == ("q", 0.6, 0.55, 0.2, 1, 1, 1, 1)


def test_query_prefix_and_unit_vectors(spark):
    df = spark.createDataFrame([("abc",), ("",)], "t string")
    assert df.select(vectors.query_text(F.col("t"), "Find")).first()[0] == "Instruct: Find\nQuery:abc"
    encoded = df.select(vectors.encode(F.col("t"), vectors.hashing_encoder(8)).alias("v")).collect()
    assert np.linalg.norm(encoded[0].v) == pytest.approx(1.0) and np.linalg.norm(encoded[1].v) == 0.0
