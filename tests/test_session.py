from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from opinarium import session


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_shared_folder_comes_from_the_session():
    assert session.shared_dir(fake("yarn", "hdfs://x/c/")) == "hdfs://x/c"
    assert session.shared_dir(fake("local[2]")) == session.shared_dir(fake("local[2]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake("yarn"))


def test_written_tables_read_back(spark):
    df = spark.range(5).select("id", F.array(F.lit(1.5)).alias("v"))
    again = session.materialize(df, "t")
    assert again.columns == df.columns and again.count() == 5


def test_broadcast_needs_a_measured_size(spark):
    df = spark.createDataFrame([("a", "b")], "form string, lemma string")
    assert session.payload_bytes(df, F.col("form"), F.col("lemma")) == 18
    small = session.broadcast_if_small(df, F.col("form"))
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString()
    assert session.broadcast_if_small(df, F.col("form"), limit=3) is df
