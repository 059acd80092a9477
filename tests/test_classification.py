import pytest
from pyspark.sql import functions as F

from opinarium.operators import classification_metrics as quality
from opinarium.operators import scoring, training
from opinarium.operators.sentiment import class_weights
from opinarium.plans import sentiment
from opinarium.streaming.scoring import score_arrivals

SCORED = "model string, split string, polarity int, pred_label int, pred_prob double"


def scored(spark, rows):
    return spark.createDataFrame([("m", "test", *r) for r in rows], SCORED)


def test_report_and_hard_auc(spark):
    df = scored(spark, [(0, 0, 0.1)] * 3 + [(0, 1, 0.6)] + [(1, 1, 0.9)] * 4 + [(1, 0, 0.2)] * 2 + [(None, 1, 0.5)])
    row = quality.class_report(quality.confusion(df)).first()
    assert (row.precision_negative, row.recall_negative, row.f1_negative) == (0.6, 0.75, 0.6667)
    assert (row.precision_positive, row.recall_positive, row.f1_positive) == (0.8, 0.6667, 0.7273)
    assert (row.accuracy, row.support_negative, row.support_positive) == (0.7, 4, 6)
    assert row.auc_hard == pytest.approx((0.75 + 2 / 3) / 2, abs=1e-4)


def test_absent_class_scores_zero(spark):
    row = quality.class_report(quality.confusion(scored(spark, [(1, 1, 0.9), (1, 1, 0.8)]))).first()
    assert (row.precision_negative, row.f1_negative, row.f1_macro, row.auc_hard) == (0.0, 0.0, 0.5, None)


def test_auc_matches_pair_counting(spark):
    import random

    random.seed(3)
    rows = [(random.randint(0, 1), 0, random.choice([0.5, round(random.random(), 3)])) for _ in range(400)]
    pos = [p for y, _, p in rows if y == 1]
    neg = [p for y, _, p in rows if y == 0]
    expected = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert quality.auc(scored(spark, rows)).first().auc == pytest.approx(expected, abs=1e-12)
    assert quality.auc(scored(spark, rows), by=()).first().auc == pytest.approx(expected, abs=1e-12)
    assert quality.auc(scored(spark, [(1, 1, 0.4)])).first().auc is None


def test_published_kappa(spark):
    rows = [(0, 0)] * 48 + [(0, 1)] + [(1, 1)]
    row = quality.cohens_kappa(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    assert (row.po, row.pe, row.kappa) == pytest.approx((0.98, 0.9416, 0.65753), abs=1e-5)


PREDICTIONS = "row_id string, split string, true_polarity int, predicted_polarity int, error string, input_tokens long, output_tokens long, response_time_s double"


def test_evaluation_per_split_and_overall(spark):
    rows = [("a", "val", 1, 1, None, 10, 5, 0.5), ("b", "val", 0, 0, "", 20, 5, 1.5), ("c", "test", 1, 0, "", 30, 6, 1.0), ("d", "test", 1, None, "late", None, None, 9.0)]
    got = {r.split: r for r in quality.evaluate_predictions(spark.createDataFrame(rows, PREDICTIONS)).collect()}
    assert {k: (r.total, r.ok, r.failed) for k, r in got.items()} == {"val": (2, 2, 0), "test": (2, 1, 1), "overall": (4, 3, 1)}
    assert got["test"].failed_pct == 50.0 and got["val"].f1_macro == 1.0 and got["overall"].accuracy == 0.6667
    assert got["overall"].avg_input_tokens == 20.0 and got["overall"].total_response_time_s == 3.0


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 2 + [(1,)] * 6 + [(None,)], "label int")
    assert {r.label: r.class_weight for r in class_weights(df).collect()} == pytest.approx({0: 2.0, 1: 8 / 12})
    assert {r.label: r.class_weight for r in class_weights(df, fixed={0: 2.5, 1: 1.0}).collect()} == {0: 2.5, 1: 1.0}


@pytest.fixture(scope="module")
def reviews(spark):
    good, bad = ["otimo produto recomendo", "excelente entrega otimo", "recomendo muito excelente"], ["pessimo defeito", "defeito terrivel pessimo", "terrivel nao funciona"]
    rows = [(i, (good if i % 3 else bad)[i % 2] + f" item{i % 11}", 1 if i % 3 else 0) for i in range(240)]
    rows += [(1000, "zzz", None), (1001, None, None)]
    return spark.createDataFrame(rows, "doc long, body string, polarity int")


def test_train_score_save_load(spark, reviews, tmp_path):
    model = sentiment.train_sparse(reviews, "doc", "body", "polarity", "unigrams", grid=(0.1, 10.0), k=3, max_iter=30)
    assert model.cv_f1 > 0.95 and model.best_c in (0.1, 10.0)
    scores = sentiment.score(reviews, model, "doc", "body")
    got = {r.doc: r for r in scores.collect()}
    assert len(got) == 242
    truth = {r.doc: r.polarity for r in reviews.collect()}
    assert all(got[d].pred_label == y for d, y in truth.items() if y is not None)
    assert got[1000].pred_prob == got[1001].pred_prob
    sentiment.save(model, str(tmp_path / "m"))
    again = sentiment.load(spark, str(tmp_path / "m"))
    assert (again.mode, again.best_c, again.cv_f1) == ("unigrams", model.best_c, model.cv_f1)
    assert {r.doc: r.pred_prob for r in sentiment.score(reviews, again, "doc", "body").collect()} == {d: r.pred_prob for d, r in got.items()}


def test_relational_scores_equal_the_vector_model(spark, reviews):
    from opinarium.operators import features

    terms = features.document_terms(reviews, "doc", "body", "unigrams")
    vocabulary = features.index_vocabulary(features.fit_vocabulary(terms))
    labelled = reviews.select("doc", F.col("polarity").alias("label"))
    table = training.training_table(features.sparse_rows(terms, vocabulary, "doc"), labelled, "doc", class_weights(labelled))
    model = training.fit(table, 1.0, 50)
    direct = {r.doc: r.probability[1] for r in model.transform(table).collect()}
    mine = {r.doc: r.pred_prob for r in scoring.score_terms(terms, training.coefficients(model, vocabulary), model.intercept, "doc").collect()}
    assert all(mine[d] == pytest.approx(p, abs=1e-4) for d, p in direct.items())


def test_scores_in_the_row_equal_those_by_join_also_on_a_stream(spark, tmp_path, monkeypatch):
    from opinarium.operators import features

    docs = spark.createDataFrame([(1, "aa aa bb"), (2, "cc"), (3, None), (4, "zz"), (5, "bb cc aa")], "doc long, body string")
    terms = features.document_terms(docs, "doc", "body", "both")
    weights = spark.createDataFrame([("aa", 1.5, 2.0), ("bb", 1.0, -1.0), ("aa bb", 2.0, 0.5)], "term string, idf double, coefficient double")
    rows = sorted(scoring.score_terms(terms, weights, -0.25, "doc").collect())
    model = scoring.load_model(weights)
    monkeypatch.setattr(scoring, "load_model", lambda coefficients: None)
    assert rows == sorted(scoring.score_terms(terms, weights, -0.25, "doc").collect()) and len(rows) == 5

    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    score = lambda part: scoring.score_rows(features.document_terms(part, "doc", "body", "both"), model, -0.25, "doc")
    for part in (docs.filter("doc < 3"), docs.filter("doc >= 3")):  # the second run is a restart between files
        part.coalesce(1).write.mode("append").parquet(source)
        score_arrivals(spark, source, docs.schema, score, sink, check, 1).awaitTermination()
    assert sorted(spark.read.parquet(sink).select("doc", "pred_label", "pred_prob").collect()) == rows


def test_champion(spark):
    df = spark.createDataFrame([("a", "val", 0.99), ("a", "test", 0.9), ("c", "test", 0.95), ("b", "test", 0.95)], "model string, split string, f1_macro double")
    assert training.champion(df).first().model == "b"


def client():
    def answer(system, prompts):
        out = []
        for p in prompts:
            bad = "boom" in p
            out.append({"raw": None if bad else '{"sentiment": "positive"}', "error": "RuntimeError: boom" if bad else None, "input_tokens": len(p), "output_tokens": 1, "response_time_s": 0.1})
        return out

    return answer


PROMPT = scoring.Prompt("s", 'T: "{title}" B: "{text}" {other}')


def test_prompts_and_failed_rows(spark):
    df = spark.createDataFrame([("1", " a ", None), ("2", "boom", "{title}")], "row_id string, t string, b string")
    got = {r.row_id: r for r in scoring.ask(df, "row_id", PROMPT, "t", "b", client).collect()}
    assert got["1"].predicted_polarity == 1 and got["1"].error is None and got["1"].input_tokens == len('T: "a" B: "" {other}')
    assert got["2"].predicted_polarity is None and got["2"].error == "RuntimeError: boom"


def test_raising_client_costs_its_own_rows_only(spark):
    def factory():
        def answer(system, prompts):
            if any("bad" in p for p in prompts):
                raise TimeoutError("late")
            return [{"raw": '{"sentiment": "positive"}', "error": None, "input_tokens": 1, "output_tokens": 1, "response_time_s": 0.1} for _ in prompts]

        return answer

    df = spark.createDataFrame([(str(i), "bad" if i % 5 == 0 else "fine") for i in range(20)], "row_id string, t string")
    got = {r.row_id: r for r in scoring.ask(df, "row_id", PROMPT, "t", "t", factory, batch_size=3).collect()}
    assert {k for k, r in got.items() if r.error == "TimeoutError: late"} == {"0", "5", "10", "15"}
    assert sum(r.predicted_polarity == 1 for r in got.values()) == 16


def test_resume_retries_failures_only(spark, tmp_path):
    path = str(tmp_path / "predictions")
    rows = spark.createDataFrame([("1", "a"), ("2", "boom"), ("2", "boom"), ("3", "c")], "row_id string, t string")
    first = lambda due: scoring.ask(due, "row_id", PROMPT, "t", "t", client)
    fixed = lambda due: first(due.withColumn("t", F.lit("fine")))
    assert scoring.resume(rows, path, "r1", first) == 4
    more = rows.unionByName(spark.createDataFrame([("4", "d")], "row_id string, t string"))
    assert scoring.resume(more, path, "r2", fixed) == 3
    assert scoring.resume(more, path, "r3", fixed) == 0
    final = {r.row_id: r.error for r in scoring.latest(spark.read.parquet(path)).collect()}
    assert final == {"1": None, "2": None, "3": None, "4": None}


def test_stream_scores_each_file_once(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    df = spark.createDataFrame([(1, "aa bb"), (2, "cc")], "id long, t string")
    df.write.parquet(source)
    score = lambda rows: rows.select("id", F.length("t").alias("n"))
    score_arrivals(spark, source, df.schema, score, sink, check).awaitTermination()
    assert spark.read.parquet(sink).count() == 2
    spark.createDataFrame([(3, "d")], "id long, t string").write.mode("append").parquet(source)
    score_arrivals(spark, source, df.schema, score, sink, check, 1).awaitTermination()
    assert sorted((r.id, r.n) for r in spark.read.parquet(sink).collect()) == [(1, 5), (2, 2), (3, 1)]
