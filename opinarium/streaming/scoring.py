"""Incremental scoring of arriving reviews."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def score_arrivals(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    score: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    max_files: int | None = None,
) -> StreamingQuery:
    """Scores the files not seen before and stops when none is left.

    The checkpoint records which files are done, so a restart continues after
    the last finished batch and the file sink holds each row once. ``score``
    works on single rows and keeps no state.
    """
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (
        score(reader.parquet(source))
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
