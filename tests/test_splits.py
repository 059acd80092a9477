from collections import Counter

import pytest
from pyspark.sql import functions as F

from opinarium.operators import splits


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(5000).select(
        F.col("id").cast("string").alias("key"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 4, None).otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("group"),
        (F.col("id") % 5 + 1).cast("int").alias("overall_rating"),
    )


def test_ratios_must_sum_to_one(rows):
    with pytest.raises(ValueError, match="add up"):
        splits.split_by_hash(rows, "key", 0.5, 0.2, 0.2)


def test_hash_split_is_complete_and_independent_of_partitions(rows):
    one = {r.key: r.split for r in splits.split_by_hash(rows, "key").collect()}
    two = {r.key: r.split for r in splits.split_by_hash(rows.repartition(7), "key").collect()}
    assert one == two and len(one) == 5000
    shares = Counter(one.values())
    assert abs(shares["train"] / 5000 - 0.6) < 0.03 and abs(shares["val"] / 5000 - 0.2) < 0.03


def test_published_split_sizes(spark):
    rows = spark.range(116058).withColumnRenamed("id", "key")
    got = {r.split: r["count"] for r in splits.split_stratified(rows, "key").groupBy("split").count().collect()}
    assert got == {"train": 69634, "val": 23212, "test": 23212}


def test_stratified_split_is_exact_per_stratum(rows):
    done = splits.split_stratified(rows, "key", "group")
    assert done.count() == 5000 and done.columns == rows.columns + ["split"]
    sizes = {}
    for r in done.groupBy("group", "split").count().collect():
        sizes.setdefault(r.group, {})[r.split] = r["count"]
    for parts in sizes.values():
        n = sum(parts.values())
        rest = -(-n * 2 // 5)
        assert parts.get("train", 0) == n - rest
        assert parts.get("test", 0) == -(-rest // 2)


def test_one_row_strata(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, g string")
    assert {r.split for r in splits.split_stratified(rows, "key", "g").collect()} == {"test"}


def test_folds_are_balanced_per_class(rows):
    sizes = Counter((r.group, r.fold) for r in splits.stratified_folds(rows, "key", "group", 3).collect())
    assert sum(sizes.values()) == 5000
    for group in {g for g, _ in sizes}:
        counts = [sizes[(group, f)] for f in range(3)]
        assert max(counts) - min(counts) <= 1


def test_sample_collapses_copies_and_keeps_missing_ratings(spark):
    rows = [(i, "copy", 5) for i in range(1000)] + [(1000, "x", None), (1001, "y", 3), (1002, None, 4), (1003, None, 4), (1004, "", 1)]
    df = spark.createDataFrame(rows, "id long, review_text string, overall_rating int")
    got = {r.id for r in splits.sample_unique(df, 10, "id").collect()}
    assert got == {0, 1000, 1002, 1004}
    assert splits.sample_unique(df, 2, "id").count() == 2
    whole = splits.sample_unique(df.withColumnRenamed("review_text", "body"), 10, "id")
    assert {r.id for r in whole.collect()} == {0, 1000, 1002, 1004}


def test_head_and_union(rows):
    done = splits.split_by_hash(rows, "key")
    assert Counter(r.split for r in splits.head_per_split(done, 3, "key").collect()) == {"train": 3, "val": 3, "test": 3}
    val, test = (done.filter(F.col("split") == s) for s in ("val", "test"))
    assert splits.union_splits(val, test).count() == val.count() + test.count()
    ids = splits.row_ids(done, ["key", "group"])
    assert ids.select("row_id").distinct().count() == 5000


def test_neutral_assertion(spark):
    splits.assert_no_neutrals(spark.createDataFrame([(1,)], "true_polarity int"))
    with pytest.raises(ValueError):
        splits.assert_no_neutrals(spark.createDataFrame([(1,), (None,)], "true_polarity int"))
