"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinarium.llm import alignment, bpe, decontamination, jaccard, language, licenses, linerules, quality, secrets, sharding, simhash, spelling, suffixes
from opinarium.llm.columns import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
OTHER_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
SHARDS = 24


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_decontamination(spark, d):
    return decontamination.report(table(spark, d, "documents"), table(spark, d, "benchmark"), slop=decontamination.SLOP).drop("items")


@query
def op2_language_id(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return language.identify(rows, language.fit(docs)).drop("text")


@query
def op3_quality_classifier(spark, d):
    docs = table(spark, d, "documents")
    model = quality.fit(docs, table(spark, d, "labels"))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return quality.score(rows, model).drop("text")


@query
def op4_secret_scan(spark, d):
    return secrets.find_secrets(table(spark, d, "documents").select("doc_id", "text")).drop("text")


@query
def op5_sharding(spark, d):
    return sharding.assign(table(spark, d, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


@query
def op6_line_rules(spark, d):
    return linerules.apply_rules(table(spark, d, "documents").select("doc_id", "text")).drop("text")


@query
def op7_byte_pairs(spark, d):
    return bpe.encode_documents(table(spark, d, "documents").select("doc_id", "text"), TOKENIZER).drop("text")


@query
def op8_license_scan(spark, d):
    return licenses.report(table(spark, d, "documents"), licenses.templates(spark))


@query
def op9_suffix_dedup(spark, d):
    return suffixes.report(table(spark, d, "documents"))


@query
def op10_jaccard_join(spark, d):
    return jaccard.linked_components(table(spark, d, "documents"))


@query
def op11_simhash(spark, d):
    return simhash.linked_components(table(spark, d, "documents"))


@query
def op12_token_alignment(spark, d):
    return alignment.align(table(spark, d, "documents"), TOKENIZER, OTHER_TOKENIZER)


@query
def op13_spelling_variants(spark, d):
    return spelling.variants(table(spark, d, "documents"), noise=True)


def oracle_sql() -> dict[str, str]:
    return {}
