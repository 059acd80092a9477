import json

import pytest
from pyspark.sql import functions as F

from opinarium.sources import artifacts, predictions, records, reviews
from opinarium.schemas import CATALOG, REQUIRED_REVIEW_COLUMNS

def first_json(folder):
    return json.loads("".join(p.read_text(encoding="utf-8") for p in sorted(folder.glob("*.json"))).splitlines()[0])


HEADER = "product_id,product_name,product_brand,site_category_lv1,site_category_lv2,overall_rating,review_text\n"


@pytest.fixture
def csv(tmp_path):
    def write(name, body, header=HEADER):
        path = tmp_path / name
        path.write_text(header + body, encoding="utf-8")
        return str(path)

    return write


def test_reviews_from_csv(spark, csv):
    one = csv("a.csv", '1,"Nome ""x""",b,c,d,5,"linha 1\nlinha 2, fim"\n2,,b,c,d,4,sem nome\n,n,b,c,d,4,sem id\n3,n,b,c,d,abc,t\n4,n,b,c,d,4.0,t\n')
    two = csv("b.csv", "007,n,b,c,d,1,t\n")
    rows = {r.product_id: r for r in reviews.load_reviews(spark, [one, two]).collect()}
    assert set(rows) == {"1", "3", "4", "007"}
    assert rows["1"].product_name == 'Nome "x"' and rows["1"].review_text == "linha 1\nlinha 2, fim"
    assert (rows["1"].overall_rating, rows["3"].overall_rating, rows["4"].overall_rating) == (5, None, 4)


HOSTILE = (
    '1,"Nome ""x""",b,c,d,5,"linha 1\nlinha 2, fim"\n'
    '2,5" tela,b,c,d,4,"a ""b\n\n""\n"\n'
    "\n"
    '3,n,"b"x,c,d,abc,t\n'
    '4,n,b,"c,"",\n"",""\n",d,1," ,""é\n5,n,b"\n'
    '6,n,,"",d,2,"""\n"""\n'
    '7,n,b,c,d,3,sem "fim" aqui\n'
    '8,n,b,c,d,3,"ultima\nlinha"'
)


@pytest.mark.parametrize("size", [9, 41, 1 << 20])
def test_split_reading_equals_the_reader_of_whole_files(spark, csv, size):
    files = [csv("h.csv", HOSTILE), csv("plain.csv", "9,n,b,c,d,1,t\n" * 5), csv("open.csv", '10,n,b,c,d,1,"nunca\nfecha'), csv("none.csv", "")]
    expected = sorted(map(str, reviews.load_reviews(spark, files).collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = reviews.load_reviews(spark, files, split=True)
        assert sorted(map(str, got.collect())) == expected
        assert size > 9 or spark.read.text(files).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_split_reading_with_more_blocks_than_can_be_sent_out(spark, csv, monkeypatch):
    path = csv("h.csv", HOSTILE)
    expected = sorted(map(str, reviews.load_reviews(spark, [path]).collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 41)
    monkeypatch.setattr(records, "broadcast_if_small", lambda df: df)
    try:
        assert sorted(map(str, reviews.load_reviews(spark, [path], split=True).collect())) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_review_source_errors(spark, csv, tmp_path):
    with pytest.raises(ValueError, match="no review files"):
        reviews.load_reviews(spark, [])
    with pytest.raises(FileNotFoundError):
        reviews.load_reviews(spark, [str(tmp_path / "none.csv")])
    with pytest.raises(ValueError, match="columns are missing"):
        reviews.load_reviews(spark, [csv("c.csv", "1,n\n", "product_id,product_name\n")])


def test_fallback_has_null_labels(spark, csv, tmp_path):
    path = csv("v.csv", "1,n,b,c,d,5,t\n")
    got = reviews.reviews_or_fallback(spark, str(tmp_path / "absent"), [path])
    assert got.first().pred_label is None
    assert reviews.reviews_or_fallback(spark, str(tmp_path / "absent"), [path, str(tmp_path / "no-split")]).count() >= got.count()
    with pytest.raises(FileNotFoundError):
        reviews.reviews_or_fallback(spark, str(tmp_path / "absent"), [str(tmp_path / "no-split")])
    got.withColumn("pred_label", F.lit(1)).write.parquet(str(tmp_path / "scored"))
    assert reviews.reviews_or_fallback(spark, str(tmp_path / "scored"), [path]).first().pred_label == 1


def test_pruned_scan(spark, csv, tmp_path, capsys):
    path = str(tmp_path / "r")
    spark.range(3).select("id", F.lit("x").alias("product_id"), F.lit(1).alias("wide")).write.parquet(path)
    reviews.load_review_table(spark, path, ["product_id"]).explain()
    assert "ReadSchema: struct<product_id:string>" in capsys.readouterr().out


def test_tables_round_trip(spark, tmp_path):
    rows = [("1", "ção", None, "c", None, 3, 0.5)]
    table = spark.createDataFrame(rows, CATALOG)
    path = str(tmp_path / "catalog")
    artifacts.write_table(table, path)
    again = artifacts.load_catalog(spark, path).first()
    assert (again.product_brand, again.site_category_lv2, again.num_reviews) == ("", "", 3)
    artifacts.write_table(table, str(tmp_path / "json"), "json")
    record = first_json(tmp_path / "json")
    assert record["product_name"] == "ção" and record["product_brand"] is None
    artifacts.write_table(table, str(tmp_path / "csv"), "csv", ["product_id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    with pytest.raises(ValueError):
        artifacts.write_table(table, path, "xml")


def test_score_table_is_skipped_without_labels(spark, tmp_path):
    df = spark.createDataFrame([("P", 1)], "product_id string, pred_label int")
    assert artifacts.write_sentiment_scores(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).first().sentiment_score == 1.0
    assert not artifacts.write_sentiment_scores(df.drop("pred_label"), str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()


def test_records_and_metrics(spark, tmp_path):
    artifacts.write_record(spark, {"model": "m", "products": 3}, str(tmp_path / "meta"))
    record = first_json(tmp_path / "meta")
    assert record["model"] == "m" and record["products"] == 3 and record["built_at"].endswith("Z")
    report = spark.createDataFrame([("m", "test", 0.9, 0.8, 0.7)], "model string, split string, f1_macro double, precision_negative double, precision_positive double")
    artifacts.write_metrics(report, str(tmp_path / "metrics"))
    nested = first_json(tmp_path / "metrics")
    assert nested["classes"] == {"negative": {"precision": 0.8}, "positive": {"precision": 0.7}} and nested["f1_macro"] == 0.9


def test_prediction_loader(spark, tmp_path):
    rows = [("a", "val", None, "r1"), ("b", "val", "late", "r1"), ("b", "val", "late", "r2"), ("c", "test", "", "r1")]
    spark.createDataFrame(rows, "row_id string, split string, error string, run_id string").write.parquet(str(tmp_path / "p"))
    ok, counts = predictions.load_predictions(spark, str(tmp_path / "p"))
    assert {r.row_id for r in ok.collect()} == {"a", "c"}
    assert {r.split: (r.total, r.ok) for r in counts.collect()} == {"val": (2, 1), "test": (1, 1), "overall": (3, 2)}


def test_required_columns_are_part_of_the_schema():
    from opinarium.schemas import REVIEWS

    assert set(REQUIRED_REVIEW_COLUMNS) <= set(REVIEWS.fieldNames())
