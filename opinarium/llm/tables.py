"""Relational helpers shared by the operators: bounded prefilters and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinarium.session import materialize

# A prefilter broadcasts at most this many bucket numbers (8 bytes each).
FILTER_BUCKETS = 1 << 20


def bucket(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BUCKETS))


def prefilter(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``df`` whose key falls into a bucket used by ``keys``.

    A superset of the semi join, sent out as at most ``FILTER_BUCKETS`` numbers
    whatever the sizes are; the exact join that follows moves fewer rows.
    """
    used = keys.select(bucket(*[F.col(c) for c in columns]).alias("_bucket")).distinct()
    return df.withColumn("_bucket", bucket(*[F.col(c) for c in columns])).join(F.broadcast(used), "_bucket", "left_semi").drop("_bucket")


def components(edges: DataFrame, name: str) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``; the root is the
    smallest node of its component.

    Alternates large-star and small-star steps until nothing changes. A node with
    many edges is met by partial minima and by joins that adaptive execution can
    split, and every step is written to the shared folder.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    current = materialize(edges.filter("a <> b").select(high.alias("u"), low.alias("v")).distinct(), name)
    state = _digest(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        current = materialize(small.distinct(), name)
        before, state = state, _digest(current)
        if state == before:
            break
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _digest(edges: DataFrame) -> tuple:
    """Row count and an order-free digest of the edges."""
    code = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(code.bitwiseAND(F.lit(0xFFFFF))), F.bit_xor(code)).first())
