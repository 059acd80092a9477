"""Tables and records a build leaves behind."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinarium.operators.catalog import catalog_columns
from opinarium.operators.sentiment import sentiment_scores


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Parquet, CSV with a header, or one JSON object per line."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "parquet":
        writer.parquet(path)
    elif kind == "csv":
        writer.options(header="true", quote='"', escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    elif kind == "json":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        raise ValueError(f"no such table kind: {kind}")


def write_sentiment_scores(reviews: DataFrame, path: str, label_column: str = "pred_label") -> bool:
    """Writes the S(p) table; skipped when the reviews carry no such label."""
    if label_column not in reviews.columns:
        return False
    write_table(sentiment_scores(reviews, label_column), path)
    return True


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Catalog and vectors as one table keyed by product, sorted inside files by
    review count so that the review minimum skips row groups."""
    corpus.sortWithinPartitions(F.desc("num_reviews")).write.mode("overwrite").parquet(path)


_PUBLISHED = "version string, sequence long"


def new_version(path: str) -> str:
    """A folder under ``path`` that no reader knows of before it is published."""
    return f"{path}/versions/{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Makes ``version``, a folder from ``new_version`` whose tables are complete,
    the one readers get. The switch is one appended record, in one file."""
    last = _publications(spark, path).agg(F.max("sequence")).first()[0] or 0
    name = version.rpartition("/")[2]
    record = spark.range(1).select(F.lit(name).alias("version"), F.lit(last + 1).cast("long").alias("sequence"))
    record.coalesce(1).write.mode("append").json(f"{path}/published")


def published(spark: SparkSession, path: str) -> str:
    """The folder of the version published last; of two published at once the
    larger name."""
    last = _publications(spark, path).agg(F.max(F.struct("sequence", "version"))["version"]).first()[0]
    if last is None:
        raise FileNotFoundError(f"no published build: {path}")
    return f"{path}/versions/{last}"


def remove_old_versions(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Removes all published versions but the last ``keep``; unpublished ones may
    be in the making and stay."""
    if keep < 1:
        raise ValueError("at least one version must stay")
    old = _publications(spark, path).orderBy(F.desc("sequence"), F.desc("version")).offset(keep)
    for row in old.select("version").toLocalIterator():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{row.version}")
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def _publications(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_PUBLISHED).json(f"{path}/published")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _PUBLISHED)


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog table with blanks for missing texts."""
    return catalog_columns(spark.read.parquet(path))


def write_record(spark: SparkSession, record: Mapping[str, str | int | float], path: str) -> None:
    """One row of build facts with the time it was written."""
    row = spark.range(1).select(
        *[F.lit(value).alias(name) for name, value in record.items()],
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("built_at"),
    )
    write_table(row, path, "json")


def write_metrics(report: DataFrame, path: str, by: Sequence[str] = ("model", "split")) -> None:
    """Metrics as one nested JSON object per model and split."""
    names = [c for c in report.columns if c not in by]

    def part(suffix: str):
        return F.struct(*[F.col(n).alias(n.removesuffix(suffix)) for n in names if n.endswith(suffix)])

    classes = [s for s in ("_negative", "_positive") if any(n.endswith(s) for n in names)]
    plain = [n for n in names if not n.endswith(tuple(classes) or ("\0",))]
    nested = [F.struct(*[part(s).alias(s[1:]) for s in classes]).alias("classes")] if classes else []
    write_table(report.select(*by, *plain, *nested), path, "json")
