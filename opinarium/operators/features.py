"""Sparse term weights and dense vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinarium.functions import text
from opinarium.functions.dictionary import count_ngrams, load_if_small, numbered_weights, one_per_key, partial_counts, replace, unit_weights
from opinarium.functions.vectors import EncoderFactory, encode
from opinarium.session import materialize

MAX_FEATURES = 50_000


def lemmatize(docs: DataFrame, key: str, column: str, lemmas: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """Adds ``lemmas``: alphabetic tokens replaced by their lemma from the
    ``(form, lemma)`` table, in text order, without those whose lowercased lemma
    is a stop word; of several lemmas of a form the smallest counts.

    Null and empty texts give an empty one. Tokens stay in their row: the table,
    if its measured size allows, goes to the documents. ``key`` need not be unique then.
    """
    stops = [word.lower() for word in stop_words]
    lemmas = one_per_key(lemmas.select("form", "lemma"), "form", "lemma", "lemmas")
    table = load_if_small(lemmas, "form", ["lemma"])
    if table is None:
        return _lemmatize_by_join(docs, key, column, lemmas, stops)
    tokens = docs.select(F.col(key), text.alphabetic_tokens(F.col(column)).alias("_tokens"))
    found = replace(tokens, key, "_tokens", table, "form", "lemma", "lemmas")
    return found.select(key, F.array_join(F.filter("lemmas", lambda word: ~F.lower(word).isin(stops)), " ").alias("lemmas"))


def _lemmatize_by_join(docs: DataFrame, key: str, column: str, lemmas: DataFrame, stops: Sequence[str]) -> DataFrame:
    """For a lemma table too large to send out: tokens meet it in a join."""
    tokens = docs.select(F.col(key), F.posexplode_outer(text.alphabetic_tokens(F.col(column))).alias("_at", "form"))
    lemma = F.coalesce("lemma", "form")
    kept = F.when(F.col("form").isNotNull() & ~F.lower(lemma).isin(stops), F.struct("_at", lemma.alias("lemma")))
    return (
        tokens.join(lemmas, "form", "left")
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(kept)).alias("_kept"))
        .select(key, F.array_join(F.col("_kept.lemma"), " ").alias("lemmas"))
    )


def document_terms(docs: DataFrame, key: str, column: str, mode: str = "both") -> DataFrame:
    """``(key, terms)`` with the ``(term, tf)`` pairs of each document, counted
    inside its row."""
    low, high = text.NGRAM_MODES[mode]
    tokens = docs.select(F.col(key), text.analyzer_tokens(F.coalesce(F.col(column), F.lit(""))).alias("_tokens"))
    return count_ngrams(tokens, key, "_tokens", low, high, "terms")


def fit_vocabulary(terms: DataFrame, min_df: int = 2, max_features: int | None = MAX_FEATURES) -> DataFrame:
    """``(term, df, tf, idf)`` of the terms in at least ``min_df`` documents, the
    ``max_features`` most frequent ones (ties by term).

    One pass over the documents and one shuffle, on the term, after a map-side
    sum; the number of documents comes out of the same sums as the count of a
    null term, and the counts are written. ``terms`` are the training documents
    only.
    """
    counts = (
        partial_counts(terms, "terms")
        .groupBy("term")
        .agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
        .filter((F.col("df") >= min_df) | F.col("term").isNull())
    )
    counts = materialize(counts, "term-counts")
    row = counts.filter(F.col("term").isNull()).first()
    documents = row["df"] if row else 0
    counts = counts.filter(F.col("term").isNotNull())
    if max_features is not None:
        counts = most_frequent(counts, max_features)
    return counts.withColumn("idf", F.log(F.lit(1.0 + documents) / (F.lit(1.0) + F.col("df"))) + 1.0)


def most_frequent(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows ``(term, tf, ...)`` of largest ``tf``, ties by term.

    A histogram of ``tf`` finds the value at which the cut falls; rows above it
    stay without being ordered and only rows at the cut are ranked. The driver
    sees at most ``n`` distinct values.
    """
    sizes = counts.groupBy("tf").agg(F.count(F.lit(1)).alias("terms")).orderBy(F.desc("tf")).limit(max(n, 1)).collect()
    above = 0
    for row in sizes:
        if above + row["terms"] > n:
            at_cut = counts.filter(F.col("tf") == row["tf"]).orderBy("term").limit(n - above)
            return counts.filter(F.col("tf") > row["tf"]).unionByName(at_cut)
        above += row["terms"]
        if above == n:
            return counts.filter(F.col("tf") >= row["tf"])
    return counts


def index_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """Adds ``term_id``, 0-based in term order; for a vocabulary that was cut to
    ``max_features``, since one task numbers it."""
    return vocabulary.withColumn("term_id", F.row_number().over(Window.orderBy("term")) - 1)


def raw_weight(tf: Column, idf: Column) -> Column:
    return (F.lit(1.0) + F.log(tf.cast("double"))) * idf


def tfidf(terms: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """``(key, term, weight)`` with sublinear tf, smoothed idf and rows of unit
    length. Terms outside the vocabulary drop out.

    A vocabulary of small measured size goes to the documents and nothing is
    shuffled; a larger one is joined and the cells meet again by document.
    """
    table = load_if_small(vocabulary, "term", ["idf"])
    if table is not None:
        weights = unit_weights(terms, key, "terms", table, "_cells")
        return weights.select(key, F.inline_outer("_cells")).filter(F.col("term").isNotNull())
    return _tfidf_by_join(terms, vocabulary, key)


def _tfidf_by_join(terms: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    weighted = (
        terms.select(key, F.inline_outer("terms"))
        .join(vocabulary.select("term", "idf"), "term")
        .select(key, "term", raw_weight(F.col("tf"), F.col("idf")).alias("raw"))
    )
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("raw") / length).alias("weight"))


def sparse_rows(terms: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """``(key, features)`` with the struct layout of an ML sparse vector. Documents
    without a known term get an empty vector.

    A vocabulary of small measured size goes to the documents, and only known
    terms are exchanged; a larger one is joined. Per-document arrays are bounded by
    the vocabulary.
    """
    table = load_if_small(vocabulary, "term", ["idf", "term_id"])
    if table is None:
        weights = _numbered_by_join(terms, vocabulary, key)
    else:
        cells = numbered_weights(terms, key, "terms", table, "cells")
        square = F.aggregate("cells", F.lit(0.0), lambda sum_, cell: sum_ + cell.getField("raw") * cell.getField("raw"))
        weights = (
            cells.withColumn("square", square)
            .groupBy(key)
            .agg(F.sort_array(F.flatten(F.collect_list("cells"))).alias("cells"), F.sqrt(F.sum("square")).alias("length"))
        )
    size = vocabulary.select(F.count(F.lit(1))).scalar().cast("int")
    return weights.select(
        key,
        F.struct(
            F.lit(0).cast("byte").alias("type"),
            size.alias("size"),
            F.col("cells.term_id").alias("indices"),
            F.transform("cells", lambda cell: cell.getField("raw") / F.col("length")).alias("values"),
        ).alias("features"),
    )


def _numbered_by_join(terms: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """``(key, cells, length)``: known terms in the order of their numbers and the length of their weights."""
    return (
        terms.select(key, F.inline_outer("terms"))
        .join(vocabulary.select("term", "idf", "term_id"), "term", "left")
        .select(key, "term_id", raw_weight(F.col("tf"), F.col("idf")).alias("raw"))
        .groupBy(key)
        .agg(
            F.sort_array(
                F.collect_list(F.when(F.col("term_id").isNotNull(), F.struct("term_id", "raw")))
            ).alias("cells"),
            F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"),
        )
    )


def embed(rows: DataFrame, column: str, factory: EncoderFactory, batch_size: int = 32, output: str = "embedding") -> DataFrame:
    """Adds the unit vector of a text column under a user encoder."""
    return rows.withColumn(output, encode(F.col(column), factory, batch_size))


def embed_or_reuse(
    texts: DataFrame, column: str, cache: DataFrame, factory: EncoderFactory, model: str, batch_size: int = 32
) -> tuple[DataFrame, DataFrame]:
    """``(all vectors, new vectors)`` keyed by ``(model, digest)``.

    Each distinct text is encoded at most once: copies collapse on their digest
    and digests already in ``cache`` are left out before the encoder runs.
    Append the second table to the cache.
    """
    wanted = texts.groupBy(F.sha2(F.coalesce(F.col(column), F.lit("")), 256).alias("digest")).agg(
        F.min(F.coalesce(F.col(column), F.lit(""))).alias("_text")
    )
    known = cache.filter(F.col("model") == model).select("digest", "embedding")
    fresh = wanted.join(known, "digest", "left_anti").select(
        "digest", encode(F.col("_text"), factory, batch_size).alias("embedding")
    )
    reused = known.join(wanted.select("digest"), "digest", "left_semi")
    tag = F.lit(model).alias("model")
    return (
        reused.unionByName(fresh).select(tag, "digest", "embedding"),
        fresh.select(tag, "digest", "embedding"),
    )
