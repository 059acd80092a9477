"""The corpus pipeline: five stages over the documents.

Quality, contamination and secrets are decided by the text of a row alone. In the
similarity join one row of each group of linked rows stays, the smallest id first and
null ids last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinarium.llm import bpe, decontamination, jaccard, quality, secrets
from opinarium.llm.columns import unused
from opinarium.llm.queries import TOKENIZER
from opinarium.session import broadcast_if_small, materialize

# Near duplicates: shingles of five words, a similarity of 0.8 or more.
NEAR = jaccard.Rule(5, 80)


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents predicted to be of quality 1."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).filter("predicted = 1").select(*docs.columns)


def keep_one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, of the smallest id, of every group of documents linked by five-word shingles."""
    return jaccard.keep_representatives(docs, NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    # A text decides for itself: equal texts hold equal windows, so the digest names the verdict whatever the ids are.
    texts = docs.select(text_digest().alias("_digest"), "text")
    found = decontamination.report(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="_digest")
    hit = materialize(found.filter("contaminated").select("_digest").distinct(), "contaminated")
    hit = broadcast_if_small(hit, F.col("_digest"))
    return docs.join(hit, text_digest() == hit["_digest"], "left_anti")


def text_digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; every document stays."""
    redacted = unused(docs, "redacted")
    whole = unused(docs, "whole")
    # The other columns travel in one, so that none can clash with the results of the scan.
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias(whole)
    found = secrets.find_secrets(docs.select("text", others), redact=redacted)
    text = F.col(redacted)
    n_chars = F.when(F.col("spans") != "", F.char_length(text).cast("long")).otherwise(F.col(f"{whole}.n_chars"))
    changed = {"text": text, "n_chars": n_chars}
    return found.select(*[changed.get(c, F.col(f"{whole}.`{c}`")).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, ids and digests of every document left."""
    coded = bpe.encode_documents(docs.select("doc_id", "text"), TOKENIZER, ids="ids")
    return coded.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", reject_low_quality),
    ("n-gram Jaccard join", keep_one_per_group),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("BPE encoding and decoding", encode),
]

# Fitted models, set similarity and byte-pair merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
