"""SimHash near duplicates found through Golay-code keys.

A fingerprint has 64 bits; bit b is set where more than half of the hashes of a
text's word shingles, repeats included, have it. Texts whose fingerprints differ in
at most ``ERRORS`` = 4 bits are linked.

Keys. The bits are cut into three segments of 22, 21 and 21 bits, each of two
halves. The perfect (23, 12) Golay code puts every 23-bit word within 3 bits of
exactly one codeword, and the codewords to which a segment and all its one-bit
neighbours decode (1 or 6 of them) are shared by any two segments that differ in
at most 2 bits: the word between them decodes to one. Of 4 errors in three
segments one can always choose a segment with at most 2 of them such that at
least two of the four halves of the others have none:

* a segment has 3 or 4 errors: take one of the others, the last one is clean or,
  if it holds the fourth error, it is the one to take;
* else take the segment with most errors: at most 2 are left for four halves.

So a key is (segment, two halves of the others, codeword), 18 choices with 1 or 6
codewords each, about 33 bits wide and exact. Linked fingerprints share one at least.

Verification. Keys are grouped by partial aggregates alone: a count and the least and
the greatest member, which are all members of most groups. Members of groups of 3 to
``CROWD`` fingerprints are compared with each other. In larger groups they are
not: two words are at most 4 bits apart exactly if the balls of radius 2 around them
meet, and words that reach one point are all linked with each other. Every fingerprint of
a larger group therefore names the 2 081 points of its ball and is joined to the least one
at each point, which costs a fixed number of rows whatever the size of the group.

Only distinct fingerprints take part; equal texts and equal fingerprints are met by
one aggregate before that.

Defined cases. Null and empty texts and texts without words have the fingerprint
zero and link like any other. Texts with fewer words than a shingle are one shingle.
Repeated rows are separate rows of one fingerprint. The component id is the smallest id
reachable; null ids are ignored by it unless a component has no other. Extra columns
are kept by ``fingerprints``; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinarium.llm.columns import append
from opinarium.llm.tables import components, prefilter
from opinarium.session import materialize

SHINGLE = 4
SEED = 42
ERRORS = 4
# Groups of more fingerprints than this meet in points between them, not in pairs.
CROWD = 64

# Fixed value: the generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b101011100011
# First bit and width of the halves; a segment is two of them.
HALVES = ((0, 11), (11, 11), (22, 11), (33, 10), (43, 11), (54, 10))


def _remainders(values: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words divided by the generator."""
    out = values.copy()
    for place in range(22, 10, -1):
        out = np.where(out >> place & 1, out ^ (GENERATOR << (place - 11)), out)
    return out


def _error_table() -> np.ndarray:
    """The error of at most three bits for every remainder."""
    table = np.zeros(1 << 11, dtype=np.int64)
    for weight in (1, 2, 3):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], dtype=np.int64)
        table[_remainders(errors)] = errors
    return table


class Golay:
    """Indices of the codewords nearest to 23-bit words."""

    def __init__(self):
        self.errors = _error_table()
        self.low, self.high = _remainders(np.arange(1 << 12)), _remainders(np.arange(1 << 11) << 12)

    def index(self, words: np.ndarray) -> np.ndarray:
        remainder = self.low[words & 0xFFF] ^ self.high[words >> 12]
        return (words ^ self.errors[remainder]) >> 11

    def nearby(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``words``, index): the distinct indices of every word and its
        neighbours that differ in one of ``width`` bits."""
        flips = np.concatenate(([0], 1 << np.arange(width, dtype=np.int64)))
        found = np.sort(self.index(words[:, None] ^ flips), axis=1)
        new = np.concatenate((np.ones((len(words), 1), bool), found[:, 1:] != found[:, :-1]), axis=1)
        return np.nonzero(new)[0], found[new]


def keys(fingerprints: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints (uint64)."""
    half = [((fingerprints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in HALVES]
    rows, out, kind = [], [], 0
    for segment in range(3):
        low, high = 2 * segment, 2 * segment + 1
        word = half[low] | half[high] << HALVES[low][1]
        row, index = golay.nearby(word, HALVES[low][1] + HALVES[high][1])
        for one, two in combinations([h for h in range(6) if h not in (low, high)], 2):
            exact = (half[one] << 11 | half[two])[row]
            rows.append(row)
            out.append((kind << 22 | exact) << 12 | index)
            kind += 1
    return np.concatenate(rows), np.concatenate(out)


def fingerprint(text: str, hasher) -> int:
    """The fingerprint of one text; ``hasher(bytes, seed)`` gives 64-bit integers."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    length = min(SHINGLE, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - length + 1]
    spans = zip(starts.tolist(), ends[length - 1 :].tolist())
    total, counts = len(starts), np.zeros(64, dtype=np.int64)
    for _ in range(0, total, _TOGETHER):
        hashes = np.array([hasher(body[a:b], SEED) for (a, b), _ in zip(spans, range(_TOGETHER))], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


# Shingles of a text whose bits are counted at once.
_TOGETHER = 1 << 16


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprints of the texts as signed longs in column ``out``."""

    def start():
        import xxhash

        def compute(column):
            made = [fingerprint(value.as_py() or "", xxhash.xxh64_intdigest) for value in column]
            return [pa.array(np.array(made, dtype=np.uint64).view(np.int64), pa.int64())]

        return compute

    return append(docs, text, {out: "long"}, start)


def _entries(found: DataFrame) -> DataFrame:
    """``(key, fp)`` of all keys of the distinct fingerprints ``fp``."""

    def run(batches):
        golay = Golay()
        for batch in batches:
            for at in range(0, batch.num_rows, _KEYED):
                part = batch.column(0).slice(at, _KEYED).to_numpy(zero_copy_only=False)
                rows, made = keys(part.view(np.uint64), golay)
                yield pa.RecordBatch.from_arrays([pa.array(made), pa.array(part[rows])], ["key", "fp"])

    return found.mapInArrow(run, "key long, fp long")


def _ball(found: DataFrame) -> DataFrame:
    """``(point, fp)`` of all words at most two bits from ``fp``."""

    def run(batches):
        single = np.uint64(1) << np.arange(64, dtype=np.uint64)
        one, two = np.triu_indices(64, 1)
        offsets = np.concatenate((np.zeros(1, np.uint64), single, single[one] | single[two]))
        for batch in batches:
            for at in range(0, batch.num_rows, _KEYED):
                part = batch.column(0).slice(at, _KEYED).to_numpy(zero_copy_only=False)
                points = (part.view(np.uint64)[:, None] ^ offsets).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(np.repeat(part, len(offsets)))], ["point", "fp"])

    return found.mapInArrow(run, "point long, fp long")


# Fingerprints of one output batch of keys or points.
_KEYED = 256


def _differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _unsent(made: DataFrame) -> DataFrame:
    """``made``, neither it nor what it is joined with being broadcast: Spark takes the
    size of what Python makes for that of the rows it was made from, 96 keys or 2 081 points each."""
    return made.hint("merge")


def links(found: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between the distinct values of ``found.fp``. Their components
    are those of all linked pairs, and every edge is a linked pair."""
    groups = _entries(found).groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    groups = materialize(groups.filter("n > 1"), "code-groups")
    alone = groups.filter(F.col("n") == 2).filter(_differing("a", "b") <= ERRORS).select("a", "b")
    larger = groups.filter("n > 2").select("key", "n")
    members = materialize(_unsent(prefilter(_entries(found), larger, "key")).join(larger, "key"), "code-members")
    small = members.filter(F.col("n") <= CROWD)
    ones, others = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    met = ones.join(others, (ones["key"] == others["key"]) & (F.col("a") < F.col("b")) & (_differing("a", "b") <= ERRORS)).select("a", "b")
    crowd = materialize(members.filter(F.col("n") > CROWD).select("fp").distinct(), "crowd")
    points = _ball(crowd)
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("point", "a")
    reached = _unsent(points).join(least, "point").filter("fp <> a").select("a", F.col("fp").alias("b"))
    return alone.unionByName(met).unionByName(reached).distinct()


def linked_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row of ``docs``."""
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("body"))
    found = materialize(fingerprints(source, "body", "fp").select("id", "fp"), "fingerprints")
    classes = materialize(found.groupBy("fp").agg(F.min("id").alias("least_id")), "fingerprint-classes")
    roots = components(links(classes.select("fp")), "fingerprint-roots")
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    members = rooted.join(least, "root").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.join(members, "fp").select(F.col("id").alias(id_column), shown, "component_id")
