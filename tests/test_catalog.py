import pytest
from pyspark.sql import functions as F

from opinarium.functions.scorers import Share, label_scorer, rating_scorer
from opinarium.operators import browse, catalog, exploration, sentiment
from opinarium.plans import evaluation
from tests.conftest import REVIEW_SCHEMA
from workload import views


def by_id(df, *columns):
    return {r[0]: tuple(r[1:]) if len(columns) > 1 else r[1] for r in df.select("product_id", *columns).collect()}


def test_catalog_counts_scores_and_order(corpus_reviews):
    built = catalog.build_catalog(corpus_reviews, rating_scorer())
    assert by_id(built, "num_reviews", "sentiment_score") == {"C1": (3, 1.0), "C2": (2, 0.0), "C3": (4, 0.5)}
    assert set(by_id(catalog.build_catalog(corpus_reviews, rating_scorer(), 3), "num_reviews")) == {"C1", "C3"}
    top = catalog.build_catalog(corpus_reviews, rating_scorer(), limit=2).collect()
    assert [r.product_id for r in top] == ["C3", "C1"]


def test_catalog_mode_ties_nulls_and_hot_product(spark):
    rows = [("P", "b", "x", None, "l2", 5, None), ("P", "a", "y", None, "l2", 1, None), ("P", "a", None, None, "z", 1, None)]
    rows += [("P", "b", "y", None, "l2", 4, None)]
    rows += [("H", f"n{i % 7}", "same", "c", "d", 5, None) for i in range(3000)]
    built = {r.product_id: r for r in catalog.build_catalog(spark.createDataFrame(rows, REVIEW_SCHEMA), rating_scorer()).collect()}
    p, h = built["P"], built["H"]
    assert (p.product_name, p.product_brand, p.site_category_lv1, p.site_category_lv2) == ("a", "y", "", "l2")
    assert (h.product_name, h.num_reviews, h.sentiment_score) == ("n0", 3000, 1.0)


def test_null_product_ids_are_no_product(spark):
    rows = [(None, "n", "b", "c", "d", 5, None), ("P", "n", "b", "c", "d", 5, None)]
    built = catalog.build_catalog(spark.createDataFrame(rows, REVIEW_SCHEMA), rating_scorer()).collect()
    assert [r.product_id for r in built] == ["P"]


@pytest.mark.parametrize(
    "ratings, threshold, expected",
    [([5, 4, 1, 2], 4, 0.5), ([5, 5, 4], 4, 1.0), ([1, 2, 3], 4, 0.0), ([1, 2, 3], 3, 1 / 3), ([None], 4, 0.0), ([None, 5], 4, 1.0), ([None, 1, 2], 4, 0.0)],
)
def test_rating_scorer(spark, ratings, threshold, expected):
    df = spark.createDataFrame([("P", r) for r in ratings], "product_id string, overall_rating int")
    score = sentiment.product_scores(df, rating_scorer(threshold=threshold)).first().sentiment_score
    assert score == pytest.approx(expected)


@pytest.mark.parametrize("labels, expected", [([1, 1, 0, 1], 0.75), ([0, 0], 0.0), ([1, 1, 1], 1.0), ([None], 0.0), ([None, 1], 1.0), ([None, 0, 0], 0.0)])
def test_label_scorer_leaves_missing_labels_out(spark, labels, expected):
    df = spark.createDataFrame([("P", v) for v in labels], "product_id string, other int")
    assert sentiment.product_scores(df, label_scorer("other")).first().sentiment_score == pytest.approx(expected)


def test_missing_labels_count_as_reviews_in_the_score_table(spark):
    df = spark.createDataFrame([("P", 1), ("P", None), ("Q", 0)], "product_id string, pred_label int")
    got = {r.product_id: (r.num_reviews, r.num_positive, r.sentiment_score) for r in sentiment.sentiment_scores(df).collect()}
    assert got == {"P": (2, 1, 0.5), "Q": (1, 0, 0.0)}
    with pytest.raises(ValueError, match="no label column"):
        sentiment.sentiment_scores(df, "absent")


def test_any_scorer_can_be_plugged_in(corpus_reviews):
    def exact_five(df):
        return Share((F.col("overall_rating") == 5).cast("long"), F.lit(1).cast("long"))

    built = catalog.build_catalog(corpus_reviews, exact_five)
    assert by_id(built, "sentiment_score") == pytest.approx({"C1": 2 / 3, "C2": 0.0, "C3": 0.25})


def test_product_stats_without_ratings(spark):
    df = spark.createDataFrame([("P", "abc"), ("P", None), ("Q", "4"), ("Q", " 5 ")], "product_id string, overall_rating string")
    got = {r.product_id: (r.avg_rating, r.review_count) for r in sentiment.product_stats(df).collect()}
    assert got == {"P": (0.0, 2), "Q": (4.5, 2)}


def test_enrichment_and_description(spark, corpus_reviews):
    built = catalog.build_catalog(corpus_reviews, rating_scorer())
    stats = sentiment.product_stats(corpus_reviews.filter("product_id <> 'C2'"))
    got = {r.product_id: r for r in catalog.enrich_products(built, stats).collect()}
    assert got["C1"].description == "Marca: samsung. Categoria: Eletronicos › Diversos."
    assert (got["C2"].avg_rating, got["C2"].review_count) == (None, 2)
    texts = spark.createDataFrame([("", "a", "a"), (None, "a", None), ("b", "", "x"), ("", "", "")], "b string, x string, y string")
    shown = [r[0] for r in texts.select(catalog.describe_product(F.col("b"), F.col("x"), F.col("y"))).collect()]
    assert shown == ["Categoria: a.", "Categoria: a.", "Marca: b.", ""]


def test_pages_filter_before_they_are_cut(spark):
    rows = [(f"P{i}", f"Água {i}" if i % 2 else f"Fogo {i}", "b", "c", "even" if i % 4 < 2 else "odd", 10 - i, 0.5) for i in range(8)]
    table = spark.createDataFrame(rows, "product_id string, product_name string, product_brand string, site_category_lv1 string, site_category_lv2 string, num_reviews long, sentiment_score double")
    page = browse.catalog_page(table, limit=1, offset=1, query="ÁGUA", subcategory="even")
    assert [r.product_id for r in page.collect()] == ["P5"]
    assert browse.count_products(table, query="água").first().total == 4
    assert browse.product(table, "P3").count() == 1 and browse.product(table, "none").count() == 0


def test_bins_keep_empty_ones_and_drop_counts_above_the_last_edge(spark):
    rows = [("a",)] * 9 + [("b",)] * 10 + [("c",)] * 501
    df = spark.createDataFrame(rows, "product_name string")
    wide = {r.bin: r.products for r in exploration.review_count_bins(df, "product_name", exploration.WIDE_BINS).collect()}
    assert wide == {"1 a 9": 1, "10 a 99": 1, "100 a 299": 0, "300 a 399": 0, "400 a 500": 0}
    dense = {r.bin: r.products for r in exploration.review_count_bins(df, "product_name").collect()}
    assert dense["6 a 10"] == 2 and dense["301+"] == 1 and sum(dense.values()) == 3


def test_poles(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,), (5,)], "overall_rating int")
    assert [(r.pole, r.reviews, r.percentage) for r in exploration.pole_share(df).collect()] == [("Negativa (1-2)", 4, 80.0), ("Positiva (4-5)", 1, 20.0)]
    assert [r.reviews for r in exploration.strict_pole_counts(df).collect()] == [2, 1]


def test_mismatch_cases(spark):
    rows = [(1, 4, "Yes", 1), (2, 5, "No", 1), (3, 4, "no", 0), (4, 1, "YES", 1), (5, 2, "No", 0)]
    df = spark.createDataFrame(rows, "review_id int, overall_rating int, recommend_to_a_friend string, pred_label int")
    one = exploration.rating_recommendation_mismatch(df)
    assert sorted((r.case, r.review_id) for r in one.collect()) == [("1a", 2), ("1a", 3), ("1b", 4)]
    two = exploration.prediction_rating_mismatch(df)
    assert sorted((r.case, r.review_id) for r in two.collect()) == [("2a", 4), ("2b", 3)]
    assert [(r.case, r.review_id) for r in exploration.case_examples(one, 1).orderBy("case").collect()] == [("1a", 2), ("1b", 4)]


def test_review_page_projection(spark):
    rows = [("P", "abcdefghij", None, 3, "Yes", None, 1980.0, None, "SP", "2018-01-01 00:11:28", 0, 0.25)]
    df = spark.createDataFrame(rows, "product_id string, reviewer_id string, review_title string, overall_rating int, recommend_to_a_friend string, review_text string, reviewer_birth_year double, reviewer_gender string, reviewer_state string, submission_date string, pred_label int, pred_prob double")
    shown = browse.review_page(df, "P").first()
    assert (shown.reviewer_id, shown.review_title, shown.reviewer_birth_year) == ("abcdefgh...", "", 1980)
    assert (shown.submission_date, shown.sentiment_label, shown.sentiment_confidence) == ("2018-01-01", "negative", 0.75)
    assert browse.review_page(df.drop("pred_label", "pred_prob")).first().sentiment_label is None


def test_crowded_products(spark):
    ids = [("hot",)] * 40 + [(f"p{i}",) for i in range(30)] + [(None,)] * 50
    rows = spark.createDataFrame(ids, "product_id string")
    assert catalog.crowded_products(rows, 10) == (["hot"], 70)
    assert catalog.crowded_products(rows, 40) == ([], 70)
    assert catalog.crowded_products(rows.limit(0)) == ([], 0)


def test_catalog_of_dealt_lines(spark, tmp_path, monkeypatch):
    """Lines dealt by product give the catalog and the grades of spread ones, with one shuffle."""
    lines = [(i, 7 if i % 3 == 0 else i % 20, i % 4, i % 7 + 1, float(i % 50 + 1), i % 10 / 10, "ANR"[i % 3], "OF"[i % 2]) for i in range(600)]
    lines += [(900 + i, None, 1, 1, 5.0, 0.5, "A", "O") for i in range(5)]
    types = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"
    dates = F.lit("1995-01-01").cast("timestamp").alias("l_shipdate"), F.lit(1.0).alias("l_extendedprice")
    made = {
        "lineitem": spark.createDataFrame(lines, types).select("*", *dates),
        "part": spark.createDataFrame([(i, f"part {i % 6}", f"type {i % 3}", i % 5) for i in range(15)], "p_partkey long, p_name string, p_type string, p_size int"),
        "supplier": spark.createDataFrame([(i, f"maker {i}") for i in range(4)], "s_suppkey long, s_name string"),
    }
    for name, table in made.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(views, "TASK_LINES", 100)
    folder, scorer = str(tmp_path), label_scorer()
    whole = catalog.build_catalog(views.reviews(spark, folder), scorer)
    one, many = views.by_product(spark, folder), views.by_product(spark, folder, least=100)
    assert len(one) == 1 and len(many) == 2
    expected = sorted(map(tuple, whole.collect()))
    assert len(expected) == 15
    for tables in (one, many):
        found = [tuple(r) for rows in tables for r in catalog.build_catalog(rows, scorer).collect()]
        assert sorted(found) == expected
    assert sorted(map(tuple, views.catalog(spark, folder).collect())) == expected
    plan = catalog.build_catalog(one[0], scorer)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Exchange ") == plan.count("- Exchange hashpartitioning(product_id") == 1
    plain = sorted(map(tuple, evaluation.graded_products(views.reviews(spark, folder, brands=False), 5).collect()))
    assert sorted(map(tuple, evaluation.graded_products(many, 5).collect())) == plain
