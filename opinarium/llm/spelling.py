"""Spelling variants grouped through pairs of trie nodes.

Words are runs of letters counted over all documents. Two words are near if one
inserted, deleted or replaced code point turns one into the other. All words are
paths in two tries, of the words and of the words read backwards. A node is numbered
by a 64-bit code of its path, so that every task gives a path the same number without
any exchange; the exact check at the end drops what equal numbers of different paths
would add. The dictionary maps a pair (prefix node, suffix node) to words:

* a word of length L has L pairs that skip one position: prefix of length i, suffix
  from i + 1, and L + 1 pairs that skip none: prefix of length i, suffix from i;
* words that differ in one replaced code point share the pair that skips it;
* a word with one code point more has, skipping it, the pair of the shorter word at
  the place where the code point is inserted. Of a run of equal code points only the first
  is skipped for this, so each pair of words is found once.

Words that share a pair differ in one code point at most, so a pair never holds more words
than the alphabet has letters, and one; collecting them is bounded for any input.

The form of a word is its near word of largest count (ties: smallest in code-point
order) if that count is at least ``FACTOR`` times its own. Counts grow by that factor
along forms, so roots are reached after a few doublings of the distance.

Defined cases. Null and empty texts have no words; a null id enters the draw of the
test noise as an empty string. Repeated rows count again. Extra columns are ignored; an empty
table gives an empty result. A word of any length costs its length, not its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinarium.llm import textscan
from opinarium.session import materialize

LEAST_LETTERS, LEAST_COUNT, FACTOR = 7, 2, 10
# The letters of a run, and one in how many (document, run) loses a letter.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ONE_IN = 31
# Kinds of pairs: skips nothing, skips a repeated code point, skips the first of a run.
WHOLE, SKIPS, SKIPS_FIRST = 0, 1, 2

_BASE = 0xD6E8FEB86659FD93
# Letters of the words whose pairs are made at once.
_TOGETHER = 1 << 16


def noisy(run: Column, doc_id: Column) -> Column:
    """The run without the code point that the contract's draw deletes."""
    drawn = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(drawn, F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(drawn % ONE_IN == 0, shorter).otherwise(run)


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", noise: bool = False) -> DataFrame:
    """``(word, n)`` of the words with enough letters and occurrences."""
    folded = F.translate(F.col(text_column), UPPER, LOWER)
    # Shorter runs cannot become words: the noise only deletes.
    runs = F.regexp_extract_all(folded, F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}+"), F.lit(0))
    found = docs.select(F.col(id_column).alias("id"), F.explode(runs).alias("run"))
    words = found.select((noisy(F.col("run"), F.col("id")) if noise else F.col("run")).alias("word"))
    words = words.filter(F.char_length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def node_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, prefix node, suffix node, kind) of all pairs of the words."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    row = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - first[row]
    factors = textscan.powers(_BASE, int(sizes.max()) + 1)
    codes = textscan.mix(points + np.uint64(0x5851F42D4C957F2D))
    ahead = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * factors[place])))
    behind = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * factors[sizes[row] - 1 - place])))

    def prefix(rows, at):
        return textscan.mix((ahead[first[rows] + at] - ahead[first[rows]]) ^ (at.astype(np.uint64) << np.uint64(40)))

    def suffix(rows, at):
        return textscan.mix((behind[first[rows + 1]] - behind[first[rows] + at]) + ((sizes[rows] - at).astype(np.uint64) << np.uint64(40)))

    repeated = np.concatenate(([False], points[1:] == points[:-1])) & (place > 0)
    ends = np.arange(len(words))
    rows = np.concatenate((row, row, ends))
    start = np.concatenate((place, place, sizes))
    after = np.concatenate((place + 1, place, sizes))
    kinds = np.concatenate((np.where(repeated, SKIPS, SKIPS_FIRST), np.zeros(len(row) + len(ends), dtype=np.int64)))
    return rows, prefix(rows, start).view(np.int64), suffix(rows, after).view(np.int64), kinds


def dictionary(words: DataFrame) -> DataFrame:
    """``(prefix, suffix, kind, w)``: all pairs of trie nodes of ``(w, word)``."""

    def run(batches):
        for batch in batches:
            values = batch.column(1).to_pylist()
            edges = np.concatenate(([0], np.cumsum([len(w) for w in values])))
            at = 0
            while at < len(values):
                to = min(max(int(np.searchsorted(edges, edges[at] + _TOGETHER, side="right")) - 1, at + 1), len(values))
                rows, prefix, suffix, kinds = node_pairs(values[at:to])
                columns = [pa.array(prefix), pa.array(suffix), pa.array(kinds.astype(np.int8)), batch.column(0).take(pa.array(rows + at))]
                yield pa.RecordBatch.from_arrays(columns, ["prefix", "suffix", "kind", "w"])
                at = to

    return words.select("w", "word").mapInArrow(run, "prefix long, suffix long, kind byte, w long")


def near_words(words: DataFrame) -> DataFrame:
    """``(word, near, near_n)`` of all near words of ``(w, word, n)``, in both directions."""
    groups = dictionary(words).groupBy("prefix", "suffix").agg(F.collect_list(F.struct("w", "kind")).alias("held"))
    groups = groups.filter((F.size("held") > 1) & F.exists("held", lambda x: x["kind"] != WHOLE)).select("held")
    ones = groups.select("held", F.explode("held").alias("x")).select("x", F.explode("held").alias("y"))
    skips = [F.col(f"{side}.kind") != WHOLE for side in "xy"]
    firsts = [F.col(f"{side}.kind") == SKIPS_FIRST for side in "xy"]
    met = (skips[0] & skips[1]) | (firsts[0] & ~skips[1]) | (firsts[1] & ~skips[0])
    pairs = ones.filter(F.col("x.w") < F.col("y.w")).filter(met).select(F.col("x.w").alias("x"), F.col("y.w").alias("y"))
    side = lambda name: words.select(F.col("w").alias(name), F.struct("word", "n").alias(f"of_{name}"))
    found = pairs.join(side("x"), "x").join(side("y"), "y").filter(F.levenshtein("of_x.word", "of_y.word", 1) == 1)
    turned = F.array(F.struct(F.col("of_x").alias("a"), F.col("of_y").alias("b")), F.struct(F.col("of_y").alias("a"), F.col("of_x").alias("b")))
    both = found.select(F.explode(turned).alias("p"))
    return both.select(F.col("p.a.word").alias("word"), F.col("p.b.word").alias("near"), F.col("p.b.n").alias("near_n"))


def forms(words: DataFrame) -> DataFrame:
    """``(word, n, n_near, form, form_n)`` of every word."""
    # The binary order of UTF-8 is the order of code points: the largest negated bytes are the smallest word.
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    found = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(found, "word", "left")
    formed = -F.col("best.minus") >= FACTOR * F.col("n")
    return known.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, F.col("best.near")).alias("form"),
        F.when(formed, -F.col("best.minus")).alias("form_n"),
    )


def roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` of all words with a form, from ``(word, form)``."""
    current = materialize(links.select("word", F.col("form").alias("root")), "word-roots")
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        stepped = current.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        stepped = materialize(stepped, "word-roots")
        current = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            return current


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", noise: bool = False) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of the documents;
    with ``noise``, one in ``ONE_IN`` of the runs of a document loses a letter first."""
    counted = count_words(docs, id_column, text_column, noise)
    words = materialize(counted.withColumn("w", F.monotonically_increasing_id()), "words")
    formed = materialize(forms(words), "forms")
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
