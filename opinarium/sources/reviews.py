"""Review tables from CSV or parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinarium.schemas import REQUIRED_REVIEW_COLUMNS, REVIEWS
from opinarium.sources.records import csv_records

# Quoted fields may hold line breaks and doubled quotes.
_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "enforceSchema": "false"}


def _csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV; every value is text here, so nothing is inferred
    and only the head of the first file is read."""
    return spark.read.options(header="true", quote='"', escape='"', inferSchema="false").csv(path).columns


def _check_columns(columns: Sequence[str]) -> None:
    missing = [name for name in REQUIRED_REVIEW_COLUMNS if name not in columns]
    if missing:
        raise ValueError(f"review columns are missing: {missing}")


def load_reviews(
    spark: SparkSession,
    paths: Sequence[str],
    schema: T.StructType = REVIEWS,
    required: Sequence[str] = ("product_id", "product_name"),
    skip_absent: bool = False,
    split: bool = False,
) -> DataFrame:
    """The union of CSV files, product ids as text; rows without one of the
    ``required`` values drop. Columns outside ``schema`` are read as text.

    Files with the same header are one reader. With ``skip_absent``, files that
    do not exist are left out, unless none does. With ``split``, many tasks read
    each file although quoted fields hold line breaks, and the records are written
    to the shared folder; otherwise a file is one task.
    """
    if not paths:
        raise ValueError("no review files given")
    known = {f.name: f for f in schema.fields}
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        try:
            names = _csv_header(spark, path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            if skip_absent:
                continue
            raise FileNotFoundError(f"no such review file: {path}") from error
        _check_columns(names)
        groups.setdefault(tuple(names), []).append(path)
    if not groups:
        raise FileNotFoundError(f"no such review file: {paths[0]}")
    frames = []
    for names, files in groups.items():
        # Numbers arrive as text and are coerced, so a bad value is a null.
        text = T.StructType([T.StructField(n, T.StringType()) for n in names])
        if split:
            row = F.from_csv("record", text.simpleString(), {"multiLine": "true", "quote": '"', "escape": '"'})
            raw = csv_records(spark, files).select(row.alias("row")).select("row.*")
        else:
            raw = spark.read.options(**_CSV).schema(text).csv(files)
        frames.append(raw.select(*[_coerce(n, known[n].dataType if n in known else None) for n in names]))
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole.dropna(subset=list(required))


def _coerce(name: str, kind: T.DataType | None):
    column = F.col(f"`{name}`")
    if kind is None or isinstance(kind, T.StringType):
        return column.alias(name)
    if isinstance(kind, T.IntegerType):
        return column.try_cast("double").try_cast(kind).alias(name)
    return column.try_cast(kind).alias(name)


def load_review_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Reviews from parquet; only the named columns are read."""
    table = spark.read.parquet(path)
    return table if columns is None else table.select(*columns)


def reviews_or_fallback(spark: SparkSession, scored: str, splits: Sequence[str]) -> DataFrame:
    """Scored reviews when that table exists, else the splits without labels.

    Absent splits are left out; only rows without a product id drop.
    """
    try:
        return load_review_table(spark, scored)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return load_reviews(spark, splits, required=("product_id",), skip_absent=True).withColumns(
        {"pred_label": F.lit(None).cast("int"), "pred_prob": F.lit(None).cast("double")}
    )
