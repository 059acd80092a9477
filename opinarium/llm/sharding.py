"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard draws a number for a key from an MD5 of both; the shard of the largest
weighted draw gets the record. A draw depends on the key and the shard alone, so
another shard takes records only into itself, and a changed weight moves only the
records that shard gains or loses.

``with_slots`` numbers the records of a shard without gaps. The light columns are
written first, so every record keeps its input partition; counts per (shard,
partition) give offsets, and records are numbered inside (shard, partition),
which is bounded by an input partition whatever a key's share of the rows is.

Defined cases. Null keys are one key. Equal keys share a shard. A null text has
size 8 and CRC 0. Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from opinarium.session import materialize

OVERHEAD = 8
LAW = "key"
_DRAW_BITS = 52


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the key and the shard."""
    code = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("\0null")), F.lit(f"\0{shard}")))
    return (F.conv(F.substring(code, 1, _DRAW_BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << _DRAW_BITS)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of largest ``-weight / ln(draw)``; ties go to the lowest number.
    Shards of weight 0 get nothing."""
    usable = [(number, weight) for number, weight in enumerate(weights) if weight > 0]
    if not usable:
        raise ValueError("no shard has a weight")
    entries = [F.struct((-weight / F.log(draw(key, number))).alias("rank"), F.lit(-number).alias("number")) for number, weight in usable]
    best = F.array_max(F.array(*entries))
    return (-best["number"]).cast("int")


def with_slots(placed: DataFrame, name: str = "shards") -> DataFrame:
    """``placed`` (with a ``shard``) written and numbered from 0 in every shard."""
    order, part = F.monotonically_increasing_id(), F.spark_partition_id()
    stored = materialize(placed.withColumns({"_order": order, "_part": part}), name)
    counts = stored.groupBy("shard", "_part").agg(F.count("*").alias("_rows"))
    ahead = F.sum("_rows").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_rows")
    offsets = counts.select("shard", "_part", ahead.alias("_ahead"))
    within = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_order")) - 1
    numbered = stored.withColumn("_within", within).join(offsets, ["shard", "_part"])
    return numbered.withColumn("slot", F.col("_ahead") + F.col("_within")).drop("_order", "_part", "_within", "_ahead")


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, CRC, shard and slot of every record, and its shard under ``grown`` weights."""
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        shard_of(F.col(key), weights).alias("shard"),
        shard_of(F.col(key), grown).alias("grown_shard"),
    )
    return with_slots(placed).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, weights: Sequence[float], path: str, key: str = "doc_id") -> None:
    """Writes the records as one folder per shard (``shard=<n>``), without a shuffle."""
    docs.withColumn("shard", shard_of(F.col(key), weights)).write.partitionBy("shard").parquet(path)
