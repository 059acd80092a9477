"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores a posting ``(term, document row, position)`` for every
token of the training texts that is a term of the test items; postings stay in
the file of the input split they come from, so storing the index moves nothing.
``phrase_hits`` intersects offset-adjusted posting lists: a test window asks for
its rarest term first, its second rarest list is met on (item, document,
diagonal), where diagonal = position - offset, and only the surviving
diagonals meet the remaining lists. ``proximity_hits`` accepts terms near their
expected place; ``report`` lists the items it finds beside those of exact windows,
without a say in ``contaminated``.

Only DataFrame functions are used.

Defined cases. Null and empty texts have no words; they are returned with zero
counts. Items without words never match. Repeated document rows, also with equal
or null ids, are separate rows. An item id given twice is one item per row, and
listed once. Extra columns are ignored. Empty tables give empty results or
uncontaminated documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from opinarium.llm.tables import prefilter
from opinarium.session import broadcast_if_small, materialize

WINDOW = 10
# Words that a term of a near window may be off its place.
SLOP = 2
# A-Z are folded, every other ASCII byte outside 0-9 and a-z separates words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The posting that carries a document's row; no word is empty.
HEADER, HEADER_TERM = "", -1


def words(text: Column) -> Column:
    """Words of a text, A-Z folded to a-z; null has none."""
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(F.coalesce(folded, F.lit("")), SEPARATORS), lambda w: w != "")


def test_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, item_id, size, offset, term, word)``, one row per word of an item."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), words(F.col(text)).alias("_words"))
    placed = rows.select("item", "item_id", F.size("_words").alias("size"), F.posexplode("_words").alias("offset", "word"))
    placed = materialize(placed, "test-words")
    terms = materialize(placed.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")), "test-terms")
    return materialize(placed.join(terms, "word"), "test-offsets")


def build_index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored postings ``(term, row, doc_id, n_words, pos)`` of the terms of the items.

    Every document has one header posting, so documents without any test term
    are in the index too. The vocabulary is sent out after its size is measured.
    """
    header = terms.sparkSession.range(1).select(F.lit(HEADER).alias("word"), F.lit(HEADER_TERM).cast("long").alias("term"))
    vocabulary = broadcast_if_small(terms.select("word", "term").distinct().unionByName(header), F.col("word"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("_words"))
    tokens = rows.select(
        "row", "doc_id", F.size("_words").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(HEADER)), "_words")).alias("pos", "word")
    )
    return materialize(tokens.join(vocabulary, "word").select("term", "row", "doc_id", "n_words", (F.col("pos") - 1).alias("pos")), "postings")


def documents(index: DataFrame) -> DataFrame:
    """``(row, doc_id, n_words)`` of every indexed document."""
    return index.filter(F.col("term") == HEADER_TERM).select("row", "doc_id", "n_words")


def windows(terms: DataFrame, length: int = WINDOW) -> DataFrame:
    """``(item, begin, size, offset, term)``: the words of every window of an item."""
    size = F.least(F.col("size"), F.lit(length))
    first, last = F.greatest(F.col("offset") - size + 1, F.lit(0)), F.least(F.col("offset"), F.col("size") - size)
    return terms.select("item", "offset", "term", size.alias("length"), F.explode(F.sequence(first, last)).alias("begin"))


def ranked_terms(index: DataFrame, terms: DataFrame, length: int = WINDOW) -> DataFrame:
    """Window terms with their rank by corpus frequency, the rarest first.

    Windows with a term that the corpus lacks cannot match and are left out.
    """
    frequency = index.groupBy("term").agg(F.count("*").alias("n"))
    counted = windows(terms, length).join(F.broadcast(frequency), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    window = Window.partitionBy("item", "begin")
    ranked = counted.withColumn("least", F.min("n").over(window)).withColumn("rank", F.row_number().over(window.orderBy("n", "offset")))
    return materialize(ranked.filter("least > 0").drop("least"), "ranked-terms")


def _lists(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Offset-adjusted postings ``(item, row, diagonal, offset)`` of the wanted ``(item, offset, term)``."""
    hits = index.join(broadcast_if_small(wanted), "term")
    return hits.select("item", "row", (F.col("pos") - F.col("offset")).alias("diagonal"), "offset").filter("diagonal + offset >= 0")


def phrase_hits(index: DataFrame, terms: DataFrame, length: int = WINDOW) -> DataFrame:
    """``(item, row, diagonal, start, stop)``: maximal document word ranges made of
    whole matching windows of one item on one diagonal."""
    ranked = ranked_terms(index, terms, length)
    pick = lambda rank: ranked.filter(F.col("rank") == rank).select("item", "offset", "term").distinct()
    # A window of one word has no second list: its only list decides.
    rarest = _lists(index, pick(1))
    single = terms.filter("size = 1").select("item").distinct()
    keys = ["item", "row", "diagonal"]
    second = prefilter(_lists(index, pick(2)), rarest, *keys)
    met = rarest.select(*keys).distinct().join(second.select(*keys).distinct(), keys)
    lone = rarest.join(broadcast_if_small(single), "item").select(*keys)
    survivors = materialize(met.unionByName(lone).distinct(), "diagonals")
    # The remaining lists, read only where a diagonal survived.
    expected = survivors.join(broadcast_if_small(terms.select("item", "offset", "term")), "item")
    expected = expected.select(*keys, "offset", "term", (F.col("diagonal") + F.col("offset")).alias("pos")).filter("pos >= 0")
    postings = prefilter(index.filter(F.col("term") != HEADER_TERM).select("term", "row", "pos"), survivors, "row")
    found = postings.join(expected, ["row", "pos", "term"]).select(*keys, "offset")
    sizes = broadcast_if_small(terms.select("item", F.least("size", F.lit(length)).alias("length")).distinct())
    along = Window.partitionBy(*keys).orderBy("offset")
    runs = found.withColumn("_run", F.col("offset") - F.row_number().over(along)).groupBy(*keys, "_run")
    ranges = runs.agg(F.min("offset").alias("_first"), F.max("offset").alias("_last")).join(sizes, "item")
    ranges = ranges.filter(F.col("_last") - F.col("_first") + 1 >= F.col("length"))
    return ranges.select(*keys, (F.col("diagonal") + F.col("_first")).alias("start"), (F.col("diagonal") + F.col("_last") + 1).alias("stop"))


def proximity_hits(index: DataFrame, terms: DataFrame, slop: int, length: int = WINDOW) -> DataFrame:
    """``(item, begin, row, diagonal)``: windows whose terms all occur within
    ``slop`` words of their place relative to an occurrence of the rarest term.

    Candidates come from the rarest list and meet the second rarest, only what is
    left meets the other terms. Each term is met in blocks of positions, so a
    posting meets the candidates of two or three blocks only.
    """
    ranked = ranked_terms(index, terms, length)
    anchors = ranked.filter("rank = 1").select("item", "begin", "length", "offset", "term")
    at = index.join(broadcast_if_small(anchors), "term").select("item", "begin", "length", "row", (F.col("pos") - F.col("offset")).alias("diagonal"))
    keys = ["item", "begin", "row", "diagonal"]
    width = max(slop, 1)
    postings = index.select("term", "row", "pos", F.floor(F.col("pos") / width).alias("_block"))

    def near(candidates: DataFrame, ranks: Column) -> DataFrame:
        others = ranked.filter(ranks).select("item", "begin", "offset", "term")
        block = F.floor((F.col("diagonal") + F.col("offset")) / width)
        asked = candidates.join(broadcast_if_small(others), ["item", "begin"]).withColumn("_block", F.explode(F.array(block - 1, block, block + 1)))
        met = asked.join(prefilter(postings, candidates, "row"), ["term", "row", "_block"])
        met = met.filter(F.abs(F.col("pos") - F.col("diagonal") - F.col("offset")) <= slop)
        return met.select(*keys, "length", "offset").distinct()

    single = at.filter("length = 1").select(*keys).distinct()
    pairs = materialize(near(at, F.col("rank") == 2).select(*keys, "length"), "near-pairs")
    rest = near(pairs, F.col("rank") > 2).groupBy(*keys, "length").agg(F.count("*").alias("_n"))
    whole = rest.filter(F.col("_n") == F.col("length") - 2).select(*keys)
    return whole.unionByName(pairs.filter("length = 2").select(*keys)).unionByName(single)


def covered(ranges: Column) -> Column:
    """Number of words in the union of sorted ``(start, stop)`` ranges."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        ranges,
        zero,
        lambda state, r: F.struct(
            F.greatest(state["end"], r["stop"]).alias("end"),
            (state["n"] + F.greatest(r["stop"] - F.greatest(r["start"], state["end"]), F.lit(0))).alias("n"),
        ),
        lambda state: state["n"],
    )


def report(docs: DataFrame, items: DataFrame, length: int = WINDOW, doc_id: str = "doc_id", text: str = "text", slop: int | None = None) -> DataFrame:
    """Per document: words, words inside matching windows and the items they come from.

    With a ``slop``, ``n_near_items`` and ``near_items`` follow: the items with
    a window whose terms all lie within ``slop`` words of their place, exact ones too.
    """
    terms = test_terms(items, "item_id", "text")
    index = build_index(docs, terms, doc_id, text)
    names = broadcast_if_small(terms.select("item", "item_id").distinct())
    hits = phrase_hits(index, terms, length).join(names, "item")
    found = hits.groupBy("row").agg(
        covered(F.sort_array(F.collect_set(F.struct("start", "stop")))).alias("n_hit"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    joined = documents(index).join(found, "row", "left")
    columns = [
        F.col("doc_id").alias(doc_id),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"),
        items_of.alias("items"),
    ]
    if slop is None:
        return joined.select(*columns)
    close = proximity_hits(index, terms, slop, length).select("row", "item").distinct().join(names, "item")
    close = close.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("_near"))
    near_items = F.coalesce("_near", F.array().cast("array<string>"))
    return joined.join(close, "row", "left").select(*columns, F.size(near_items).cast("long").alias("n_near_items"), near_items.alias("near_items"))
