"""Row-local lookups in a dictionary of measured size.

The dictionary travels to the workers once; every batch of arrays is looked up as
one flat column with vectorised operations, so nothing is grouped or shuffled and
all of it also works on streams in append mode.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinarium.session import MAX_BROADCAST_BYTES, materialize, payload_bytes

# Entries of a list column looked up at once.
PIECE = 1 << 18


def load_if_small(table: DataFrame, key: str, columns: Sequence[str], limit: int = MAX_BROADCAST_BYTES) -> pa.Table | None:
    """The rows of ``(key, *columns)`` in key order if their measured payload fits
    into ``limit`` bytes, else None. Sorted, so equal tables give equal results.

    A caller passes a table that is cheap to read twice, such as a written one."""
    words = [F.col(c) for c in (key, *columns) if dict(table.dtypes)[c] == "string"]
    if payload_bytes(table, *words) > limit:
        return None
    found = table.select(key, *columns).toArrow().combine_chunks()
    return found.take(pc.sort_indices(found, [(key, "ascending")])) if found.num_rows else found


def one_per_key(table: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Stored ``(key, value)`` with the smallest value of every non-null key."""
    return materialize(table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value)), name)


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.array([], column.type) if not column.num_chunks else column.combine_chunks()


def _offsets(lists: pa.Array) -> np.ndarray:
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(lengths)))


def pieces(batch: pa.RecordBatch, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with at most ``most`` entries (default ``PIECE``) of the list
    column 1, or a single row."""
    ends, at = _offsets(batch.column(1)), 0
    while at < len(batch):
        to = max(int(np.searchsorted(ends, ends[at] + (most or PIECE), side="right")) - 1, at + 1)
        yield batch.slice(at, to - at)
        at = to


def _map(rows: DataFrame, key: str, lists: str, output: str, kind: str, shared: tuple, look_up) -> DataFrame:
    """``(key, output)`` with ``look_up(lists, *shared)`` of every batch, cut into pieces of
    about ``PIECE`` entries, so that memory does not follow the length of the texts."""
    values = rows.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        for whole in batches:
            for batch in pieces(whole):
                found = look_up(batch.column(1), *values.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), found], [key, output])

    schema = T.StructType([rows.schema[key], *T.StructType.fromDDL(f"{output} {kind}").fields])
    return rows.select(key, lists).mapInArrow(run, schema)


def replace(rows: DataFrame, key: str, words: str, table: pa.Table, word: str, value: str, output: str) -> DataFrame:
    """``(key, output)``: the array ``words`` with every word of the table replaced by
    its value; an empty array for a null one."""

    def look_up(lists, words, values):
        flat = lists.flatten()
        found = values.take(pc.index_in(flat, value_set=words.cast(flat.type))).cast(flat.type)
        return pa.ListArray.from_arrays(pa.array(_offsets(lists), pa.int32()), pc.coalesce(found, flat))

    return _map(rows, key, words, output, "array<string>", (_column(table, word), _column(table, value)), look_up)


def count_ngrams(rows: DataFrame, key: str, tokens: str, low: int, high: int, output: str) -> DataFrame:
    """``(key, output)`` with the sorted ``array<struct<term, tf>>`` of the n-grams of
    ``low`` to ``high`` (at most 2) tokens, joined by a blank, counted inside the row.

    Tokens hold no sign below a letter or digit, so the order of (first, second) is that
    of the joined texts and only distinct tokens are sorted as texts."""

    def count(lists):
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        words, place = coded.dictionary.take(pa.array(order)), np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        at, base = place[coded.indices.to_numpy()], len(order) + 1
        row = np.repeat(np.arange(len(lists)), np.diff(_offsets(lists)))
        found = []
        if low == 1:
            found.append((row * base + at) * base)
        if high == 2:
            pair = np.flatnonzero(row[1:] == row[:-1])
            found.append((row[pair] * base + at[pair]) * base + at[pair + 1] + 1)
        codes, counts = np.unique(np.concatenate(found), return_counts=True)
        first, second = codes // base % base, codes % base - 1
        heads, tails = words.take(pa.array(first)), words.take(pa.array(second, mask=second < 0))
        terms = pc.binary_join_element_wise(heads, tails, pa.scalar(" ", words.type), null_handling="skip")
        cells = pa.StructArray.from_arrays([terms, pa.array(counts, pa.int64())], ["term", "tf"])
        ends = np.concatenate(([0], np.cumsum(np.bincount(codes // base // base, minlength=len(lists)))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)

    if not 1 <= low <= high <= 2:
        raise ValueError(f"n-gram range must satisfy 1 <= low <= high <= 2, got ({low}, {high})")
    return _map(rows, key, tokens, output, "array<struct<term: string, tf: bigint>>", (), count)


def partial_counts(rows: DataFrame, terms: str) -> DataFrame:
    """``(term, df, tf)`` summed over runs of rows with ``(term, tf)`` pairs; a null term has
    the number of rows as ``df``. Sums by term are left to the caller."""

    def run(batches):
        for whole in batches:
            yield _counts(None, [len(whole)], [0])
            for batch in pieces(pa.RecordBatch.from_arrays([whole.column(0), whole.column(0)], ["_", terms]), _SUMMED):
                words, counts = batch.column(1).flatten().flatten()
                sums = pa.table([words, counts], ["term", "tf"]).group_by("term").aggregate([("tf", "count"), ("tf", "sum")])
                if len(sums):
                    sums = sums.combine_chunks()
                    yield _counts(_column(sums, "term"), _column(sums, "tf_count"), _column(sums, "tf_sum"))

    return rows.select(terms).mapInArrow(run, "term string, df long, tf long")


# Entries of term lists summed at once.
_SUMMED = 1 << 20


def _counts(terms: pa.Array | None, df, tf) -> pa.RecordBatch:
    terms = pa.array([None], pa.string()) if terms is None else terms.cast(pa.string())
    return pa.RecordBatch.from_arrays([terms, pa.array(df, pa.int64()), pa.array(tf, pa.int64())], ["term", "df", "tf"])


def _raw_weights(lists: pa.Array, terms: pa.Array, idf: np.ndarray):
    """(row, place in the dictionary, raw weight, word) of all known terms of a batch."""
    words, counts = lists.flatten().flatten()
    at = pc.fill_null(pc.index_in(words, value_set=terms.cast(words.type)), -1).to_numpy(zero_copy_only=False)
    known = at >= 0
    row = np.repeat(np.arange(len(lists)), np.diff(_offsets(lists)))[known]
    tf = counts.to_numpy(zero_copy_only=False)[known].astype(np.float64)
    return row, at[known], (1.0 + np.log(tf)) * idf[at[known]], words.filter(pa.array(known))


def unit_weights(rows: DataFrame, key: str, terms: str, vocabulary: pa.Table, output: str) -> DataFrame:
    """``(key, output)`` with an ``array<struct<term, weight>>`` of the known terms of
    ``(term, tf)`` pairs: sublinear tf times idf, scaled to unit length inside the row."""

    def weigh(lists, words, idf):
        row, _, raw, found = _raw_weights(lists, words, idf)
        length = np.sqrt(np.bincount(row, raw * raw, len(lists)))
        cells = pa.StructArray.from_arrays([found, pa.array(raw / length[row])], ["term", "weight"])
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(lists)))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)

    shared = (_column(vocabulary, "term"), _column(vocabulary, "idf").to_numpy())
    return _map(rows, key, terms, output, "array<struct<term: string, weight: double>>", shared, weigh)


def numbered_weights(rows: DataFrame, key: str, terms: str, vocabulary: pa.Table, output: str) -> DataFrame:
    """``(key, output)`` with an ``array<struct<term_id, raw>>`` of the known terms of
    ``(term, tf)`` pairs: their numbers and sublinear tf times idf."""

    def weigh(lists, words, idf, numbers):
        row, at, raw, _ = _raw_weights(lists, words, idf)
        cells = pa.StructArray.from_arrays([pa.array(numbers[at], pa.int32()), pa.array(raw)], ["term_id", "raw"])
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(lists)))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)

    shared = (_column(vocabulary, "term"), *(_column(vocabulary, c).to_numpy() for c in ("idf", "term_id")))
    return _map(rows, key, terms, output, "array<struct<term_id: int, raw: double>>", shared, weigh)


def linear_margins(rows: DataFrame, key: str, terms: str, model: pa.Table, output: str) -> DataFrame:
    """``(key, output)``: the sum of coefficient times unit weight over the known terms;
    0 without any."""

    def margin(lists, words, idf, coefficient):
        row, at, raw, _ = _raw_weights(lists, words, idf)
        total = np.bincount(row, raw * coefficient[at], len(lists))
        length = np.sqrt(np.bincount(row, raw * raw, len(lists)))
        return pa.array(np.divide(total, length, out=np.zeros(len(lists)), where=length > 0))

    shared = (_column(model, "term"), _column(model, "idf").to_numpy(), _column(model, "coefficient").to_numpy())
    return _map(rows, key, terms, output, "double", shared, margin)
