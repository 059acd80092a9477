"""License scans: MinHash bands over overlapping text windows, exact containment.

Templates and documents are cut into overlapping windows of word shingles. A
window's signature holds the least hash of its shingles under several hash
functions; one band is one or more of these minima. Windows that share a band
with a template window retrieve the template, and the shingles of the template
found around that place are counted exactly: a hit needs ``containment`` of the
template's shingles within a stretch of its length.

Template windows have ``span`` shingles, document windows twice as many at every
``span`` steps, so every place of a template lies whole inside a document window.
Such a window then has similarity 1/2 at least where the text is verbatim; with
one minimum per band and b bands it is missed with probability ``2 ** -b`` per
template window. Templates of at most ``span`` shingles are met by their shingles.

Templates are whole license texts and short notices (``license_texts``). A hit must
hold the marks of its template, the words that tell it from near ones. Of the hits
at one place of a document the one with the most shingles found stays, of equal
ones that of the shorter template.

Only DataFrame functions are used. Windows without any shingle of a template are
left out before hashing: they contain nothing of it.

Defined cases. Null and empty texts have no hits. Templates shorter than a shingle
are one shorter shingle and match as such only if ``shingle`` is that short;
they are refused. Repeated rows, also with equal or null ids, are separate rows.
Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinarium.llm import license_texts
from opinarium.session import broadcast_if_small, materialize

SHINGLE, SPAN, BANDS, CONTAINMENT = 3, 4, 24, 0.8
WORD = r"[^a-z0-9.+]+"
# Short notices of common public licenses, beside those of license_texts.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


# Words that a hit of these templates must hold.
MARKS = {
    "apache-2.0": ["license version 2.0"],
    "gpl-3.0": ["gnu general public", "license version 3"],
    "gpl-notice": ["gnu general public"],
    "cc-by-4.0": ["commons attribution 4.0"],
    "mpl-2.0": ["license v 2.0"],
}


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """``(license, text, marks)`` of the given texts, or of all known ones."""
    rows = [(name, text, MARKS.get(name, [])) for name, text in sorted((TEMPLATES if texts is None else texts).items())]
    if texts is None:
        rows += [(name, text, list(marks)) for name, text, marks in license_texts.entries()]
    return spark.createDataFrame(rows, "license string, text string, marks array<string>")


def words(text: Column) -> Column:
    """Lower-case words of letters, digits, dots and plus signs; final dots go."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), WORD)
    return F.filter(F.transform(parts, lambda w: F.rtrim(w, F.lit("."))), lambda w: w != "")


def _shingles(column: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order. The words are named outside of
    any lambda: an optimizer that inlines them must not split a text once a word."""
    runs = F.greatest(F.size(column) - size + 1, F.lit(0))
    return F.transform(F.arrays_zip(*[F.slice(column, k + 1, runs) for k in range(size)]), lambda run: F.xxhash64(run))


def template_shingles(known: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(template, license, place, shingle, shingles, marked)`` of every template;
    ``marked`` is whether a hit must hold the shingle."""
    marks = F.col("marks") if "marks" in known.columns else F.array().cast("array<string>")
    named = known.select(F.xxhash64("license", "text").alias("template"), "license", words(F.col("text")).alias("_w"), marks.alias("_marks")).distinct()
    named = materialize(named, "template-words")
    cut = named.withColumn("_s", _shingles(F.col("_w"), size)).withColumn("_m", F.flatten(F.transform("_marks", lambda m: _shingles(words(m), size))))
    placed = cut.select("template", "license", F.size("_s").alias("shingles"), "_m", F.posexplode("_s").alias("place", "shingle"))
    return materialize(placed.withColumn("marked", F.array_contains("_m", F.col("shingle"))).drop("_m"), "templates")


def _minima(column: str, bands: int) -> Column:
    """One struct per band: its number and its least hash over a group."""
    return F.array(*[F.struct(F.lit(b).alias("band"), F.min(F.xxhash64(F.col(column), F.lit(b))).alias("least")) for b in range(bands)])


def _bands(cells: DataFrame, keys: list[str], bands: int) -> DataFrame:
    return cells.groupBy(*keys).agg(_minima("shingle", bands).alias("_bands")).select(*keys, F.explode("_bands").alias("_band")).select(*keys, "_band.*")


def find_licenses(
    docs: DataFrame,
    known: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    span: int = SPAN,
    bands: int = BANDS,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """``(row, id, license, start, found, shingles)``: hits with their first word
    and the number of the template's shingles found there."""
    pattern = template_shingles(known, size)
    wanted = pattern.select("shingle").distinct()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), words(F.col(text)).alias("_w"))
    first = broadcast_if_small(wanted.withColumn("_known", F.lit(True)))
    cells = rows.select("row", "id", F.posexplode(_shingles(F.col("_w"), size)).alias("pos", "shingle")).join(first, "shingle").drop("_known")
    cells = materialize(cells, "license-shingles")
    # Document windows [k * span, k * span + 2 * span) hold every template window whole.
    block = F.floor(F.col("pos") / span)
    doc_windows = cells.select("row", "shingle", F.explode(F.array(block - 1, block)).alias("window"))
    sizes = pattern.select("template", "shingles").distinct()
    template_windows = pattern.select("template", "shingle", F.explode(F.sequence(F.greatest(F.col("place") - span + 1, F.lit(0)), F.col("place"))).alias("window"))
    whole = template_windows.join(sizes.filter(F.col("shingles") > span), "template").filter(F.col("window") <= F.col("shingles") - span)
    asked = broadcast_if_small(_bands(whole, ["template", "window"], bands).select("template", "band", "least").distinct())
    met = _bands(doc_windows, ["row", "window"], bands).join(asked, ["band", "least"])
    short = broadcast_if_small(pattern.filter(F.col("shingles") <= span).select("template", "shingle").distinct())
    retrieved = met.select("row", "template").unionByName(cells.join(short, "shingle").select("row", "template")).distinct()
    # Exact check: shingles of the template on their places, per start in the document.
    placed = cells.join(broadcast_if_small(pattern), "shingle").join(retrieved, ["row", "template"])
    starts = placed.withColumn("start", F.col("pos") - F.col("place"))
    # Inserted or missing words shift places: neighbouring starts count together.
    near = starts.withColumn("_start", F.floor(F.col("start") / F.col("shingles")))
    near = near.withColumn("_start", F.explode(F.array(F.col("_start"), F.col("_start") + 1)))
    hits = near.groupBy("row", "id", "template", "license", "shingles", "_start").agg(
        F.count_distinct("place").alias("found"),
        F.min("pos").alias("start"),
        F.percentile_approx("start", 0.5).alias("_begin"),
        F.count_distinct(F.when(F.col("marked"), F.col("shingle"))).alias("_marked"),
    )
    marks = broadcast_if_small(pattern.groupBy("template").agg(F.count_distinct(F.when(F.col("marked"), F.col("shingle"))).alias("_marks")))
    hits = hits.filter(F.col("found") >= containment * F.col("shingles")).join(marks, "template").filter("_marked = _marks")
    return _best(hits).select("row", "id", "license", "start", "found", "shingles").distinct()


def _best(hits: DataFrame) -> DataFrame:
    """Hits of a document without those whose middle lies in a better one."""
    hit = F.struct((-F.col("found")).alias("_lost"), "shingles", "license", "start", "_begin", "found")
    lists = hits.groupBy("row", "id").agg(F.sort_array(F.collect_set(hit)).alias("_hits"))
    inside = lambda one, other: (one["_begin"] + one["shingles"] / 2).between(other["_begin"], other["_begin"] + other["shingles"])
    none = F.filter("_hits", lambda h: F.lit(False))
    kept = F.aggregate("_hits", none, lambda done, h: F.when(F.exists(done, lambda better: inside(h, better)), done).otherwise(F.concat(done, F.array(h))))
    return lists.select("row", "id", F.explode(kept).alias("_hit")).select("row", "id", "_hit.*")


def report(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, license, n_hits, found, shingles)`` of every document and license it holds."""
    hits = find_licenses(docs, known, doc_id, text).groupBy("row", "id", "license").agg(
        F.count_distinct("start").alias("n_hits"), F.max(F.struct("found", "shingles")).alias("_best")
    )
    found, shingles = [F.col(f"_best.{name}").cast("long").alias(name) for name in ("found", "shingles")]
    return hits.select(F.col("id").alias(doc_id), "license", "n_hits", found, shingles)
