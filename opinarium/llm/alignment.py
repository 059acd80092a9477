"""Token alignment between two tokenizers by interval coalescing.

Both tokenizers cut the bytes of `` `` + text into tokens. The tokens of a chunk of
texts, laid one after the other, are intervals on one line: both lists are sorted together by
start (lexsort), the running maximum of their ends (maximum.accumulate) is taken, and
a group ends where the next start reaches it, that is where tokens of both
end at one byte. Within a group the overlaps expand: a token of A meets the tokens of B from
the first that ends behind its start to the last that starts before its end.

How many documents hold a pair of ids linked is a count over the corpus, needed by
every document that holds it. Texts are tokenised once. A task stores, per
chunk of about ``CHUNK`` bytes of text, the distinct pairs with the number of its documents, and
per document its distinct pairs as gaps between their numbers in the chunk. Pairs are
then counted, and met again with their counts, as one row per chunk and pair, never
per document; a very frequent pair has as many rows as there are chunks. Each chunk gets its
counts back and sums them for its documents. What is sent to all tasks is the highest
count per id of A, at most one number per vocabulary entry.

A is a byte-level file of the ``tokenizers`` library, B a ``sentencepiece`` model; their
paths must be readable where tasks run. Strings of special tokens are plain text.

Defined cases. Null and empty texts, and texts that the bytes of either token list do
not give back (B may normalise), have no tokens: all counts are 0 and the digest
is the empty string. Repeated rows are separate documents. Very long texts are a chunk of their
own. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinarium.llm import textscan
from opinarium.llm.bpe import Encoder
from opinarium.session import materialize

# Bytes of text whose pairs are numbered together.
CHUNK = 4 << 20
_SHIFT = 32


class Tokens(NamedTuple):
    """Ids of texts one after the other, the first of each text (one more entry)
    and the byte length of every token."""

    ids: np.ndarray
    first: np.ndarray
    size: np.ndarray

    def of(self, keep: np.ndarray) -> Tokens:
        """The tokens of the texts kept."""
        inside = np.repeat(keep, np.diff(self.first))
        first = np.concatenate(([0], np.cumsum(np.diff(self.first)[keep])))
        return Tokens(self.ids[inside], first, self.size[inside])


class Table(NamedTuple):
    """The bytes of every id, one after the other, and where they start."""

    data: np.ndarray
    start: np.ndarray

    def tokens(self, rows: list) -> Tokens:
        first = np.concatenate(([0], np.cumsum([len(row) for row in rows], dtype=np.int64)))
        if rows and isinstance(rows[0], np.ndarray):
            ids = np.concatenate(rows).astype(np.int64)
        else:
            ids = np.fromiter(itertools.chain.from_iterable(rows), dtype=np.int64, count=int(first[-1]))
        return Tokens(ids, first, self.start[ids + 1] - self.start[ids])

    def joined(self, tokens: Tokens) -> np.ndarray:
        ends = np.cumsum(tokens.size)
        inner = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - tokens.size, tokens.size)
        return self.data[inner + np.repeat(self.start[tokens.ids], tokens.size)]


def _table(pieces: list[bytes]) -> Table:
    return Table(np.frombuffer(b"".join(pieces), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in pieces]))))


class Pair:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, self.b = Encoder(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        # Strings of special tokens are plain text.
        self.a.special = None
        self.table_a = Table(self.a.vocabulary.token_bytes, self.a.vocabulary.token_start)
        self.table_b = _table([self._piece(i) for i in range(self.b.get_piece_size())])

    def _piece(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace("▁", " ").encode("utf-8")

    def encode(self, texts: list[str]) -> tuple[Tokens, Tokens]:
        """The tokens of A and B; none where they do not give back the text."""
        raw = [f" {text}" if text else "" for text in texts]
        a = self.table_a.tokens(self.a.encode(raw))
        b = self.table_b.tokens(self.b.encode(texts, num_threads=1))
        bodies = [text.encode("utf-8", "surrogatepass") for text in raw]
        sizes = np.array([len(body) for body in bodies], dtype=np.int64)
        whole = sizes > 0
        for tokens in (a, b):
            ends = np.concatenate(([0], np.cumsum(tokens.size)))
            whole &= ends[tokens.first[1:]] - ends[tokens.first[:-1]] == sizes
        a, b = a.of(whole), b.of(whole)
        want = np.frombuffer(b"".join([body for body, kept in zip(bodies, whole) if kept]), dtype=np.uint8)
        ends = np.cumsum(sizes[whole])
        # A's pieces are cut from these bytes, so its lengths are enough.
        wrong = np.flatnonzero(self.table_b.joined(b) != want)
        same = np.ones(len(ends), dtype=bool)
        same[np.searchsorted(ends, wrong, side="right")] = False
        a, b = a.of(same), b.of(same)
        kept = np.flatnonzero(whole)[same]
        return _spread(a, kept, len(texts)), _spread(b, kept, len(texts))


def _spread(tokens: Tokens, rows: np.ndarray, count: int) -> Tokens:
    """The tokens of the texts ``rows`` among ``count`` texts."""
    sizes = np.zeros(count, dtype=np.int64)
    sizes[rows] = np.diff(tokens.first)
    return Tokens(tokens.ids, np.concatenate(([0], np.cumsum(sizes))), tokens.size)


class Alignment(NamedTuple):
    """Tokens of both lists in the order of their groups (A before B in each):
    token number (B's behind A's), whether it opens a group; and the linked tokens."""

    order: np.ndarray
    opens: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def coalesce(a: np.ndarray, b: np.ndarray) -> Alignment:
    """Aligns two lists of token sizes that cover the same bytes."""
    end = np.concatenate((np.cumsum(a), np.cumsum(b)))
    start = end - np.concatenate((a, b))
    kind = np.repeat([0, 1], [len(a), len(b)])
    order = np.lexsort((kind, start))
    reach = np.maximum.accumulate(end[order])
    opens = np.concatenate((np.ones(min(1, len(order)), dtype=bool), start[order][1:] >= reach[:-1]))
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(opens)
    # By start already: within a group only the lists change places.
    order = order[np.argsort(2 * group[order] + kind[order], kind="stable")]
    sorted_group = group[order]
    opens = np.concatenate((np.ones(min(1, len(order)), dtype=bool), sorted_group[1:] != sorted_group[:-1]))
    start_b, end_b = start[len(a) :], end[len(a) :]
    low = np.searchsorted(end_b, start[: len(a)], side="right")
    count = np.searchsorted(start_b, end[: len(a)], side="left") - low
    link_a = np.repeat(np.arange(len(a)), count)
    ahead = np.cumsum(count)
    link_b = np.arange(len(link_a)) - np.repeat(ahead - count, count) + np.repeat(low, count)
    return Alignment(order, opens, link_a, link_b)


class Names:
    """Ids as text behind the separators of the written groups."""

    def __init__(self, size_a: int, size_b: int):
        self.a, self.b = size_a, size_b
        numbers = [str(i) for i in range(max(size_a, size_b))]
        make = lambda mark, size: [mark + n for n in numbers[:size]]
        self.table = np.array(make(",", size_a) + make(",", size_b) + make(";", size_a) + make("|", size_b), dtype=object)

    def written(self, a: Tokens, b: Tokens, found: Alignment) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every text."""
        is_b = found.order >= len(a.ids)
        turns = np.concatenate(([False], is_b[1:] & ~is_b[:-1])) if len(is_b) else is_b
        code = np.concatenate((a.ids, b.ids + self.a))[found.order] + (self.a + self.b) * (found.opens | turns)
        parts, edges = self.table[code].tolist(), a.first + b.first
        return ["".join(parts[edges[i] : edges[i + 1]])[1:] for i in range(len(edges) - 1)]


def _per_text(first: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """How many of the sorted token numbers belong to each text."""
    return np.diff(np.searchsorted(tokens, first))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values.astype(np.int32)))


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _chunk(texts: list[str], pair: Pair, names: Names) -> tuple[list[pa.Array], list[str], np.ndarray, np.ndarray]:
    """Per text the counts, gaps and times of its pairs, and the written groups;
    per distinct pair of the chunk its code and its number of texts."""
    a, b = pair.encode(texts)
    found = coalesce(a.size, b.size)
    codes, number, uses = np.unique(a.ids[found.link_a] << _SHIFT | b.ids[found.link_b], return_inverse=True, return_counts=True)
    # Frequent pairs get small numbers, so that gaps are small.
    by_use = np.argsort(-uses, kind="stable")
    rank = np.empty(len(codes), dtype=np.int64)
    rank[by_use] = np.arange(len(codes))
    text = np.searchsorted(a.first, found.link_a, side="right") - 1
    held, times = np.unique(text * max(len(codes), 1) + rank[number], return_counts=True)
    holder, held = np.divmod(held, max(len(codes), 1))
    same = np.concatenate(([False], holder[1:] == holder[:-1])) if len(holder) else np.zeros(0, bool)
    gaps = np.where(same, held - np.concatenate(([0], held[:-1])) if len(held) else held, held)
    per_text = np.bincount(holder, minlength=len(texts))
    n_groups = np.diff(np.concatenate(([0], np.cumsum(found.opens)))[a.first + b.first])
    columns = [np.diff(a.first), np.diff(b.first), n_groups, _per_text(a.first, found.link_a)]
    made = [pa.array(c.astype(np.int64)) for c in columns] + [_lists(gaps, per_text), _lists(times, per_text)]
    return made, names.written(a, b, found), codes[by_use], np.bincount(held, minlength=len(codes))


def _digest(written: str) -> str:
    return hashlib.sha256(written.encode()).hexdigest() if written else ""


def tokenise(docs: DataFrame, path_a: str, path_b: str, id_column: str, text_column: str, groups: bool) -> DataFrame:
    """Stored rows of documents, and of chunks with their distinct pairs (column ``pairs``)."""
    kind = docs.schema[id_column].dataType.simpleString()
    fields = f"chunk long, id {kind}, n_a long, n_b long, n_groups long, n_links long, gaps array<int>, times array<int>, groups_sha256 string"
    schema = f"{fields}, groups string, pairs array<struct<pair: long, held: long>>"

    def run(batches):
        from pyspark import TaskContext

        pair = Pair(path_a, path_b)
        names = Names(len(pair.table_a.start) - 1, len(pair.table_b.start) - 1)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for row, last, _, _ in textscan.chunks(batch.column(1), CHUNK):
                texts = [value or "" for value in batch.column(1).slice(row, last - row).to_pylist()]
                made, written, codes, held = _chunk(texts, pair, names)
                shown = pa.array(written if groups else [None] * len(written), pa.string())
                ids, count = batch.column(0).slice(row, last - row), len(texts)
                pairs = pa.StructArray.from_arrays([pa.array(codes), pa.array(held)], ["pair", "held"])
                own = [pa.array([chunk] * count), ids, *made, pa.array([_digest(w) for w in written]), shown]
                types = [column.type for column in own]
                listed = pa.list_(pairs.type)
                yield pa.RecordBatch.from_arrays([*own, pa.nulls(count, listed)], _NAMES)
                dictionary = pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs)
                blank = [pa.nulls(1, kind) for kind in types[1:]]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), *blank, dictionary], _NAMES)
                chunk += 1

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("body"))
    return materialize(source.mapInArrow(run, schema), "aligned")


_NAMES = ["chunk", "id", *_COUNTS, "gaps", "times", "groups_sha256", "groups", "pairs"]


def _sums(docs: pa.Table, counted: pa.Table) -> pa.Table:
    """Sums the counts of its pairs for every document of a chunk."""
    size = counted.num_rows
    number = counted["number"].to_numpy()
    n, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    n[number], best[number] = counted["n"].to_numpy(), counted["best"].to_numpy(zero_copy_only=False)
    gaps, times = docs["gaps"].combine_chunks(), docs["times"].combine_chunks()
    count = np.diff(gaps.offsets.to_numpy())
    held = np.cumsum(gaps.flatten().to_numpy().astype(np.int64))
    # The first gap of every document starts from 0 again.
    starts = np.cumsum(count) - count
    held -= np.repeat(np.concatenate(([0], held))[starts], count)
    uses, row = times.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(count)), count)
    add = lambda values: _summed(row, values, len(count))
    kept = [docs[name] for name in ("id", *_COUNTS)]
    sums = [pa.array(add(best[held] * uses)), pa.array(add(n[held] * uses))]
    return pa.Table.from_arrays([*kept, *sums, docs["groups_sha256"], docs["groups"]], ["id", *_COUNTS, "n_best", "count_sum", "groups_sha256", "groups"])


def _summed(row: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    out = np.zeros(count, dtype=np.int64)
    np.add.at(out, row, values)
    return out


def align(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text", groups: str | None = None) -> DataFrame:
    """Per document: token, group and link counts, ``n_best``, ``count_sum`` and the
    digest of its groups; with ``groups``, also a column of that name with the groups."""
    stored = tokenise(docs, path_a, path_b, id_column, text_column, groups is not None)
    entries = stored.filter("pairs is not null").select("chunk", F.posexplode("pairs").alias("number", "_pair")).select("chunk", "number", "_pair.*")
    totals = entries.groupBy("pair").agg(F.sum("held").alias("n"))
    totals = materialize(totals.withColumn("a", F.shiftrightunsigned("pair", _SHIFT)), "pair-counts")
    # At most one row per id of A.
    most = totals.groupBy("a").agg(F.max("n").alias("most"))
    counted = totals.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    counted = entries.select(F.col("chunk").alias("of"), "number", "pair").join(counted, "pair").select("of", "number", "n", "best")
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
    own = stored.filter("pairs is null").drop("pairs")
    found = own.groupBy("chunk").cogroup(counted.groupBy("of")).applyInArrow(_sums, schema)
    shown = [F.col("groups").alias(groups)] if groups else []
    return found.select(F.col("id").alias(id_column), *_COUNTS, "n_best", "count_sum", "groups_sha256", *shown)
