"""Quality scores by Bradley-Terry pairwise ranking.

The model is one weight per text feature. It is learned from preference pairs, a
document labelled 1 against one labelled 0, by the logistic loss of
``w . (features of the better - features of the worse)``. The documents are then
ordered by ``w . features`` and cut at a score quantile: the share of label 0
among all training labels. ``score`` is a sigmoid of the distance to that cut,
placed so that the cut is at ``CUT``.

Center, spread, weights and cut come from every labelled document that is not held out.
For the pairs the rarer class is dealt by a hash of the id into groups of about
``GROUP``, and each meets the part of the other class that has its hash, cut into parts of
about that size; within a group all pairs count. Each Newton step is one pass that sums the
pairs of all groups, and the cut is found by histograms of the scores, so neither a task nor
the driver holds more than a group or a matrix of features.

Defined cases. Null and empty texts have features of zero words and are scored
like any other. Without labels of both classes every score is 0.5. Labels for
absent documents and null labels are ignored; a document with several labels
counts once per label. Extra columns are ignored by the fit and kept by the scorer.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinarium.llm import textscan
from opinarium.llm.columns import append, held_out
from opinarium.session import broadcast_if_small, materialize

GROUP, RIDGE, CUT = 64, 1e-3, 0.3
# Bins of one histogram of scores, and rows of a class whose pairs are met at once.
_BINS, _BLOCK = 1024, 512
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Byte classes whose shares are features, then the statistics of words and lines.
_CLASS = np.zeros(256, dtype=np.int64)
for _low, _high, _number in ((0x30, 0x39, 1), (0x41, 0x5A, 2), (0x61, 0x7A, 3), (0x80, 0xFF, 4), (0x20, 0x20, 5), (0x09, 0x0D, 6)):
    _CLASS[_low : _high + 1] = _number
for _place, _mark in enumerate(MARKS):
    _CLASS[_mark] = 7 + _place
_CLASSES = 7 + len(MARKS)
STATISTICS = 9


class Model(NamedTuple):
    weights: np.ndarray
    center: np.ndarray
    spread: np.ndarray
    cut: float


def features(column: pa.Array) -> np.ndarray:
    """One row of features per text."""
    out = np.zeros((len(column), _CLASSES + STATISTICS))
    for row, last, data, offsets in textscan.chunks(column):
        found = textscan.split_words(data, offsets, textscan.BLANK_SEPARATED)
        hashes = textscan.span_hashes(data, found.start, found.end)
        pairs = textscan.run_hashes(hashes, 2)
        lengths = found.end - found.start
        kinds = _CLASS[data]
        capital = (kinds[found.start] == 2) if len(found.start) else np.zeros(0, dtype=bool)
        for i in range(last - row):
            here = kinds[offsets[i] : offsets[i + 1]]
            shares = np.bincount(here, minlength=_CLASSES) / max(len(here), 1)
            a, b = int(found.first[i]), int(found.first[i + 1])
            words = b - a
            own, size = hashes[a:b], lengths[a:b]
            lines = shares[6] * len(here) + 1
            statistics = np.zeros(STATISTICS)
            if words:
                statistics[:6] = (
                    len(np.unique(own)) / words,
                    np.count_nonzero(own[1:] == own[:-1]) / words,
                    (len(np.unique(pairs[a : b - 1])) / (words - 1)) if words > 1 else 1.0,
                    size.mean() / 20,
                    min(size.max(), 100) / 100,
                    np.count_nonzero(capital[a:b]) / words,
                )
            statistics[6:] = np.log1p(words) / 10, np.log1p(words / lines) / 10, np.log1p(words) ** 2 / 100
            out[row + i, :_CLASSES] = np.sqrt(shares)
            out[row + i, _CLASSES:] = statistics
    return out


def _pair_sums(better: np.ndarray, worse: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums over all pairs of both sides: slope, curvature and the number of pairs, in a row."""
    size = len(weights)
    slope, curve = np.zeros(size), np.zeros((size, size))
    for i in range(0, len(better), _BLOCK):
        for j in range(0, len(worse), _BLOCK):
            high, low = better[i : i + _BLOCK], worse[j : j + _BLOCK]
            wrong = 1 / (1 + np.exp(np.clip((high @ weights)[:, None] - low @ weights, -30, 30)))
            slope += wrong.sum(axis=0) @ low - wrong.sum(axis=1) @ high
            bend = wrong * (1 - wrong)
            cross = high.T @ bend @ low
            curve += (high.T * bend.sum(axis=1)) @ high + (low.T * bend.sum(axis=0)) @ low - cross - cross.T
    return np.concatenate((slope, curve.ravel(), [len(better) * len(worse)]))


def _newton(sums: Callable[[np.ndarray], np.ndarray], size: int, ridge: float, steps: int) -> np.ndarray:
    weights = np.zeros(size)
    for _ in range(steps):
        found = sums(weights)
        mean = found[:-1] / found[-1]
        slope, curve = mean[:size] + ridge * weights, mean[size:].reshape(size, size) + ridge * np.eye(size)
        step = np.linalg.solve(curve, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def ranking_weights(better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Minimises the mean logistic loss of the preference pairs, row by row, by Newton steps."""
    apart = better - worse

    def sums(weights):
        wrong = 1 / (1 + np.exp(np.clip(apart @ weights, -30, 30)))
        return np.concatenate((-wrong @ apart, ((apart.T * (wrong * (1 - wrong))) @ apart).ravel(), [len(apart)]))

    return _newton(sums, apart.shape[1], ridge, steps)


def quantile_cut(scores: np.ndarray, weight: np.ndarray, share: float) -> float:
    """The value below which ``share`` of the weight lies, midway between neighbours; for
    scores at hand, :func:`cut_at` finds that of a table."""
    order = np.argsort(scores, kind="stable")
    ahead = np.cumsum(weight[order]) / weight.sum()
    k = min(max(int(np.searchsorted(ahead, share - 1e-12)) + 1, 1), len(scores) - 1)
    return float((scores[order[k - 1]] + scores[order[k]]) / 2)


def cut_at(scores: DataFrame, below: int) -> float:
    """The value midway between the ``below``-th smallest ``score`` and the next, exactly.

    Histograms narrow the range until both lie in different bins or are equal.
    """
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while low < high:
        place = F.least(F.floor((F.col("score") - low) / (high - low) * _BINS), F.lit(_BINS - 1))
        bins = scores.filter(F.col("score").between(low, high)).groupBy(place.alias("bin"))
        rows = bins.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most")).orderBy("bin").collect()
        at = 0
        while below > rows[at]["n"]:
            below -= rows[at]["n"]
            at += 1
        if below == rows[at]["n"]:
            return (rows[at]["most"] + rows[at + 1]["least"]) / 2
        low, high = rows[at]["least"], rows[at]["most"]
    return float(low)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _sums(rows: DataFrame, columns: list[str], add: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum of ``add(*columns of a batch)`` over the table, one pass."""

    def run(batches):
        total = None
        for batch in batches:
            if len(batch):
                own = add(*batch.columns)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "value"])

    found = rows.select(*columns).mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(found))
    for place, value in found:
        out[place] = value
    return out


def _grouped(rows: DataFrame, counts: dict[int, int], center: np.ndarray, spread: np.ndarray, group: int, seed: int) -> DataFrame:
    """``(better, worse)``: the scaled features of both classes of every group, in one row."""
    rare = int(counts[1] < counts[0])
    groups, parts = max(1, counts[rare] // group), -(-counts[1 - rare] // counts[rare])
    number = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)) * parts
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(parts))
    every = F.when(F.col("quality") == rare, F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")).otherwise(F.array(part))
    dealt = rows.select(number.alias("_first"), F.explode(every).alias("_part"), "quality", "f").select((F.col("_first") + F.col("_part")).alias("_group"), "quality", "f")

    def pack(table: pa.Table) -> pa.Table:
        scaled = (_matrix(table.column("f").combine_chunks()) - center) / spread
        good = table.column("quality").to_numpy() == 1
        return pa.table({"better": pa.array([scaled[good].tobytes()]), "worse": pa.array([scaled[~good].tobytes()])})

    return dealt.groupBy("_group").applyInArrow(pack, "better binary, worse binary")


def fit(docs: DataFrame, labels: DataFrame, group: int = GROUP, seed: int = 7) -> Model | None:
    """Learns from all labelled rows that are not held out; None without both classes."""
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    texts = docs.select("doc_id", F.col("text").alias("_text")).join(broadcast_if_small(usable), "doc_id")
    rows = append(texts.select("doc_id", "quality", "_text"), "_text", {"f": "array<double>"}, lambda: _as_lists)
    rows = materialize(rows.select("doc_id", "quality", "f"), "quality-features")
    counts = {int(row["quality"]): row["n"] for row in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not (counts.get(0) and counts.get(1)):
        return None
    total = counts[0] + counts[1]
    center = _sums(rows, ["f"], lambda f: _matrix(f).sum(axis=0)) / total
    spread = np.sqrt(_sums(rows, ["f"], lambda f: ((_matrix(f) - center) ** 2).sum(axis=0)) / total)
    spread[spread < 1e-9] = 1.0
    size = len(center)
    met = materialize(_grouped(rows, counts, center, spread, group, seed), "quality-groups")

    def sums(weights):
        def add(better, worse):
            sides = ([np.frombuffer(row.as_buffer()).reshape(-1, size) for row in column] for column in (better, worse))
            return sum(_pair_sums(high, low, weights) for high, low in zip(*sides))

        return _sums(met, ["better", "worse"], add)

    weights = _newton(sums, size, RIDGE, 25)

    def margins(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(((_matrix(batch.column(0)) - center) / spread) @ weights)], ["score"])

    scores = materialize(rows.select("f").mapInArrow(margins, "score double"), "quality-scores")
    return Model(weights, center, spread, cut_at(scores, counts[0]))


def _as_lists(column: pa.Array) -> list:
    rows = features(column)
    values = pa.array(rows.ravel())
    return [pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), values)]


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the cut on)."""

    def start():
        def compute(column):
            if model is None:
                scores = np.full(len(column), 0.5)
            else:
                margin = ((features(column) - model.center) / model.spread) @ model.weights - model.cut
                scores = 1 / (1 + np.exp(-np.clip(margin + np.log(CUT / (1 - CUT)), -700, 700)))
            return [pa.array(scores), pa.array((scores >= CUT).astype(np.int32))]

        return compute

    return append(docs, text, {"score": "double", "predicted": "int"}, start)
