"""Repeated passages with sparse suffix arrays.

Suffixes are kept only at content-selected places: the minimisers of word k-grams
in windows of ``window`` k-grams, so equal passages of ``window + k - 1`` words
keep equal places. A suffix is ordered by the hashes of the following blocks of
``k`` words. Suffixes that share their first block somewhere get a context, the
hashes of ``least`` words to each side. Contexts equal as a whole are counted
by a code with partial aggregation; of each code one place alone gets its context
written. These are sorted over the cluster and each is compared with its
neighbours, extending the match word by word to the right and to the left.
Neighbours across the borders of sorted partitions are compared from the borders
alone. Contexts are sorted once from the place to the right and once, within their
first block, to the left, so the longest extension either way is met: ``ahead`` and ``behind`` of the best
neighbours bound what any context of the same first block shares with a place.

A neighbour with a longer match to one side can hide a partner that reaches
``least`` words over both. Every passage holds a place with its whole first block,
so what is left are windows of ``least`` words that hold it and lie within both
bounds without lying in a match already found. Places with such open windows meet
all places of their block by the hashes of the windows within the bounds, which
are counted with partial aggregation; windows that two contexts have are matches.

A passage is reported where a place and a neighbour agree on at least ``least``
words. Passages are ranges of words of a document.

Defined cases. Null and empty texts have no places. Repeated rows, also with equal
or null ids, are separate rows and repeat each other. Repeats inside one document
count. Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinarium.llm import textscan
from opinarium.session import materialize

GRAM, WINDOW, LEAST = 8, 40, 50


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of every ``window`` consecutive k-grams, the
    rightmost of equal ones; short texts have one window."""
    count = len(grams)
    if not count:
        return np.zeros(0, dtype=np.int64)
    if count <= window:
        return np.array([count - 1 - int(np.argmin(grams[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.concatenate([at + window - 1 - np.argmin(part[:, ::-1], axis=1) for at, part in _slices(views)]))


def _slices(views: np.ndarray, size: int = 1 << 14):
    for low in range(0, len(views), size):
        part = views[low : low + size]
        yield np.arange(low, low + len(part)), part


def _texts(batch: pa.RecordBatch):
    """(row of the batch, word hashes) of every text."""
    for row, last, data, offsets in textscan.chunks(batch.column(batch.schema.get_field_index("_text"))):
        found = textscan.split_words(data, offsets, textscan.BLANK_SEPARATED)
        hashes = textscan.span_hashes(data, found.start, found.end)
        for i in range(last - row):
            yield row + i, hashes[found.first[i] : found.first[i + 1]]


def _padded(hashes: np.ndarray, least: int) -> np.ndarray:
    """Words as 32-bit codes with ``least`` zeros behind the end."""
    return np.concatenate(((hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.zeros(least, np.uint32)))


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of bytes as one binary value."""
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


# Places of one output batch, so that memory does not follow the length of a text.
_PLACES = 4096


def _contexts(least: int, choose, packed):
    """Arrow function over texts: ``choose(batch, i, hashes)`` gives the places of
    text i and their keys, ``packed`` turns places with both sides into a batch."""

    def run(batches):
        along = np.arange(least)
        for batch in batches:
            rows, parts, held = batch.column(batch.schema.get_field_index("row")).to_numpy(), [], 0
            for i, hashes in _texts(batch):
                places, keys = choose(batch, i, hashes)
                onward, back = _padded(hashes, least), _padded(hashes[::-1], least)
                for low in range(0, len(places), _PLACES):
                    pos = places[low : low + _PLACES]
                    right, left = onward[pos[:, None] + along], back[len(hashes) - pos[:, None] + along]
                    parts.append((np.full(len(pos), rows[i]), pos, keys[low : low + _PLACES], right, left))
                    held += len(pos)
                    if held >= _PLACES:
                        yield packed(*map(np.concatenate, zip(*parts)))
                        parts, held = [], 0
            if parts:
                yield packed(*map(np.concatenate, zip(*parts)))

    return run


def _codes(right: np.ndarray, left: np.ndarray) -> tuple[pa.Array, list[np.ndarray]]:
    """A digest of each context, and both sides as bytes that sort like the words."""
    sides = [side.astype(">u4").view(np.uint8) for side in (right, left)]
    return pa.array([hashlib.md5(line).digest() for line in np.concatenate(sides, axis=1)], pa.binary()), sides


def _places(rows: DataFrame, gram: int, window: int, least: int) -> DataFrame:
    """Every minimiser place with its first block, the digest of its context and
    how many words the context has to each side."""

    def choose(batch, i, hashes):
        grams = textscan.run_hashes(hashes, gram)
        at = minimisers(grams, window)
        return at, grams[at].view(np.int64)

    def packed(row, pos, key, right, left):
        reach = [np.count_nonzero(side, axis=1).astype(np.int64) for side in (right, left)]
        columns = [pa.array(row), pa.array(pos), pa.array(key), _codes(right, left)[0], *map(pa.array, reach)]
        return pa.RecordBatch.from_arrays(columns, ["row", "pos", "key", "code", "ahead", "behind"])

    return rows.mapInArrow(_contexts(least, choose, packed), "row long, pos long, key long, code binary, ahead long, behind long")


def _contexts_at(rows: DataFrame, places: DataFrame, least: int) -> DataFrame:
    """The contexts of the places ``(row, pos)``, made from the texts again."""

    def choose(batch, i, hashes):
        at = np.sort(batch.column(batch.schema.get_field_index("places"))[i].values.to_numpy())
        return at, at

    def packed(row, pos, key, right, left):
        code, sides = _codes(right, left)
        return pa.RecordBatch.from_arrays([code, *map(_binary, sides)], ["code", "right", "left"])

    marked = places.groupBy("row").agg(F.collect_list("pos").alias("places"))
    return rows.select("row", "_text").join(marked, "row").mapInArrow(_contexts(least, choose, packed), "code binary, right binary, left binary")


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each pair of rows; 0 never agrees."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), same.shape[1], np.argmin(same, axis=1))


MATCH = "code binary, ahead long, behind long, right binary, left binary"


def _compare(least: int, gram: int, ends: bool):
    """Neighbours in a sorted run of contexts that share their first block: both get
    the length of their match, whether or not it makes a passage. With ``ends``, the first and the last context
    follow, marked by ``ahead = -1``."""
    kinds = pa.schema([("code", pa.binary()), ("ahead", pa.int64()), ("behind", pa.int64()), ("right", pa.binary()), ("left", pa.binary())])

    def run(batches):
        first = last = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            first = table.slice(0, 1) if first is None else first
            table = table if last is None else pa.concat_tables([last, table])
            sides = [np.frombuffer(b"".join(table[name].to_pylist()), dtype=">u4").reshape(-1, least) for name in ("right", "left")]
            reach = [_agree(side[:-1], side[1:]) for side in sides]
            hit = np.flatnonzero(reach[0] >= gram)
            for shift in (0, 1):
                code = table["code"].combine_chunks().take(pa.array(hit + shift))
                empty = pa.nulls(len(hit), pa.binary())
                yield pa.RecordBatch.from_arrays([code, pa.array(reach[0][hit]), pa.array(reach[1][hit]), empty, empty], schema=kinds)
            last = table.slice(len(table) - 1)
        if ends and first is not None:
            edge = pa.concat_tables([first, last]).combine_chunks()
            mark = pa.array([-1, -1], pa.int64())
            columns = [edge[name].combine_chunks() for name in ("code", "right", "left")]
            yield pa.RecordBatch.from_arrays([columns[0], mark, mark, *columns[1:]], schema=kinds)

    return run


def _neighbour_matches(contexts: DataFrame, order: list, least: int, gram: int, name: str) -> DataFrame:
    """``(code, ahead, behind)``: what contexts share with a neighbour in the order."""
    ordered = contexts.repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialize(ordered.mapInArrow(_compare(least, gram, True), MATCH), name)
    # Borders: two contexts per sorted partition, whatever the number of rows.
    borders = found.filter("ahead < 0").select("code", "right", "left").coalesce(1).sortWithinPartitions(*order)
    across = borders.mapInArrow(_compare(least, gram, False), MATCH)
    return found.filter("ahead >= 0").unionByName(across).select("code", "ahead", "behind")


def _window_hashes(least: int, gram: int):
    """Arrow function: the windows of ``least`` words within the bounds of a context
    that hold its first block, as their words before the place and their hash."""

    def run(batches):
        for batch in batches:
            sides = [np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=">u4").reshape(-1, least) for i in (1, 2)]
            reach = [batch.column(i).to_numpy() for i in (3, 4)]
            for low in range(0, len(batch), _PLACES):
                right, left = [side[low : low + _PLACES] for side in sides]
                ahead, behind = [side[low : low + _PLACES] for side in reach]
                words = textscan.mix(np.concatenate((left[:, ::-1], right), axis=1).astype(np.uint64))
                flat = textscan.run_hashes(words.ravel(), least)
                begin = np.arange(len(right)) * 2 * least + least
                for back in range(least - gram + 1):
                    at = np.flatnonzero((back <= behind) & (least - back <= ahead))
                    if len(at):
                        code = batch.column(0).take(pa.array(low + at))
                        columns = [code, pa.array(np.full(len(at), back)), pa.array(flat[begin[at] - back].view(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, ["code", "back", "hash"])

    return run


def _block(gram: int) -> Column:
    """The first block of a context."""
    return F.substring("right", 1, 4 * gram)


def _widest(reach: DataFrame) -> DataFrame:
    """The longest reach of every context to each side."""
    return reach.groupBy("code").agg(F.max("ahead").alias("ahead"), F.max("behind").alias("behind"))


def _open_matches(contexts: DataFrame, bounds: DataFrame, matches: DataFrame, least: int, gram: int) -> DataFrame:
    """``(code, ahead, behind)`` of the windows that a better neighbour to one side hides."""
    known = matches.select("code", F.col("ahead").alias("_ahead"), F.col("behind").alias("_behind"))
    bounds = bounds.filter(F.col("ahead") + F.col("behind") >= least).join(known, "code", "left")
    widens = (F.coalesce("_ahead", F.lit(0)) < F.col("ahead")) | (F.coalesce("_behind", F.lit(0)) < F.least("behind", F.lit(least - gram)))
    bounded = materialize(bounds.select("code", "ahead", "behind", widens.alias("open")), "bounds")
    # Windows hold the whole first block, so that the contexts of a window share it.
    wanted = contexts.join(bounded.filter("open"), "code").select(_block(gram).alias("block")).distinct()
    wanted = materialize(wanted, "open-blocks")
    asked = contexts.join(bounded, "code").withColumn("block", _block(gram)).join(wanted, "block", "left_semi")
    windows = asked.select("code", "right", "left", "ahead", "behind").mapInArrow(_window_hashes(least, gram), "code binary, back long, hash long")
    windows = materialize(windows, "open-windows")
    shared = windows.groupBy("back", "hash").agg(F.count("*").alias("n")).filter("n > 1").select("back", "hash")
    met = windows.join(materialize(shared, "met-windows"), ["back", "hash"])
    return met.select("code", (F.lit(least) - F.col("back")).alias("ahead"), F.col("back").alias("behind"))


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``(row, id, start, stop)``: word ranges of passages that occur elsewhere."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("_text"))
    rows = materialize(rows, "numbered")
    places = materialize(_places(rows, gram, window, least), "places")
    # Written, so that the join has an exchange of its own and a frequent key can be split.
    shared = materialize(places.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared-keys")
    found = materialize(places.join(shared, "key").drop("key"), "shared-places")
    groups = found.groupBy("code").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("one"), F.max("ahead").alias("ahead"), F.max("behind").alias("behind"))
    groups = materialize(groups, "context-groups")
    equal = groups.filter((F.col("n") > 1) & (F.col("ahead") + F.col("behind") >= least)).select("code", "ahead", "behind")
    contexts = materialize(_contexts_at(rows, groups.select("one.row", "one.pos"), least), "contexts")
    ahead = _neighbour_matches(contexts, ["right", "left"], least, gram, "sorted-right")
    behind = _neighbour_matches(contexts, [_block(gram), "left", "right"], least, gram, "sorted-left")
    near = ahead.unionByName(behind)
    matches = equal.unionByName(near.filter(F.col("ahead") + F.col("behind") >= least))
    matches = materialize(_widest(matches), "matches")
    # All matches of a context hold its place, so their union is one range.
    matches = _widest(matches.unionByName(_open_matches(contexts, _widest(near), matches, least, gram)))
    # Written, so that the join has an exchange of its own and a frequent context can be split.
    matches = materialize(matches, "widest")
    ranges = found.select("row", "pos", "code").join(matches, "code")
    ranges = ranges.select("row", (F.col("pos") - F.col("behind")).alias("start"), (F.col("pos") + F.col("ahead")).alias("stop")).distinct()
    return _merged(ranges).join(rows.select("row", "id"), "row")


def _merged(ranges: DataFrame) -> DataFrame:
    """Unions of overlapping or touching ranges, per row."""
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def step(done, r):
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], r["stop"]).alias("stop"))))
        added = F.concat(done, F.array(F.struct(r["start"].alias("start"), r["stop"].alias("stop"))))
        return F.when(F.size(done) == 0, added).when(last["stop"] >= r["start"], grown).otherwise(added)

    lists = ranges.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_r"))
    return lists.select("row", F.explode(F.aggregate("_r", empty, step)).alias("_one")).select("row", "_one.start", "_one.stop")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``(doc_id, n_passages, n_repeated, spans)`` of documents with repeated passages."""
    found = repeated_passages(docs, doc_id, text, least)
    span = F.concat_ws(":", "start", "stop")
    lists = found.groupBy("row", "id").agg(
        F.count("*").alias("n_passages"), F.sum(F.col("stop") - F.col("start")).alias("n_repeated"), F.sort_array(F.collect_list(F.struct("start", span.alias("s")))).alias("_s")
    )
    return lists.select(F.col("id").alias(doc_id), "n_passages", "n_repeated", F.array_join("_s.s", ",").alias("spans"))
