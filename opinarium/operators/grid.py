"""Many logistic regressions over one table, fitted together.

Models of a search differ in the fold they leave out and in their penalty, not in
the rows they read. Each step is therefore one pass over the table for all models that
are not done yet: a task multiplies blocks of rows with a matrix of coefficient
columns, weighs the residuals with the fold mask of each model, and adds up its part of all
gradients. Parts are cut into ranges of features and summed in one exchange, so
neither a task nor the driver gets more than features x models numbers. The driver
holds the state of a limited-memory quasi-Newton method per model; the number of passes is that
of the slowest model, trial steps included.

The objective is Spark's: the weighted mean of the logistic loss plus
``ridge / 2`` times the squared coefficients, the intercept free.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Non-zero values multiplied at once, and features of one range of a gradient.
_BLOCK, _RANGE = 1 << 18, 4096
_HISTORY = 10


@dataclass(frozen=True)
class Problem:
    """A model that leaves out one fold (None: no row) and its penalty."""

    left_out: int | None
    ridge: float


@dataclass
class _State:
    """A model on its way: point, value, gradient, steps behind it and the trial ahead."""

    x: np.ndarray
    value: float = np.inf
    gradient: np.ndarray | None = None
    steps: list = field(default_factory=list)
    direction: np.ndarray | None = None
    length: float = 1.0
    iterations: int = 0
    done: bool = False

    def trial(self) -> np.ndarray:
        return self.x if self.direction is None else self.x + self.length * self.direction

    def take(self, value: float, gradient: np.ndarray, tolerance: float, most: int) -> None:
        """Accepts or shortens the trial step and chooses the next direction."""
        if self.direction is not None:
            slope = float(self.gradient @ self.direction)
            if value > self.value + 1e-4 * self.length * slope:
                curve = value - self.value - self.length * slope
                self.length *= float(np.clip(-self.length * slope / (2 * curve), 0.1, 0.5))
                self.done = self.length < 1e-12
                return
            step, change = self.length * self.direction, gradient - self.gradient
            if step @ change > 0:
                self.steps = [*self.steps, (step, change, 1.0 / (step @ change))][-_HISTORY:]
            small = self.value - value <= tolerance * max(abs(value), 1e-12)
            self.x = self.x + step
            self.iterations += 1
        else:
            small = False
        self.value, self.gradient = value, gradient
        flat = np.abs(gradient).max() <= tolerance * max(1.0, np.abs(self.x).max()) * 1e-2
        self.done = small or flat or self.iterations >= most
        self.direction = self._toward()
        self.length = 1.0 if self.steps else min(1.0, 1.0 / max(np.abs(gradient).sum(), 1e-12))

    def _toward(self) -> np.ndarray:
        out, factors = -self.gradient, []
        for step, change, scale in reversed(self.steps):
            factors.append(scale * (step @ out))
            out = out - factors[-1] * change
        if self.steps:
            step, change, scale = self.steps[-1]
            out = out / (scale * (change @ change))
        for (step, change, scale), factor in zip(self.steps, reversed(factors)):
            out = out + (factor - scale * (change @ out)) * step
        return out


def _rows(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first value of each row, feature, value, label, weight, fold) of blocks of whole rows."""
    vectors = batch.column(0)
    dense = vectors.field("type").to_numpy(zero_copy_only=False) == 1
    values = vectors.field("values")
    label, weight, fold = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
    at = 0
    widths = np.where(dense, size, values.value_lengths().to_numpy(zero_copy_only=False))
    ends = np.cumsum(widths)
    while at < len(widths):
        start = ends[at] - widths[at]
        to = max(int(np.searchsorted(ends, start + _BLOCK, side="right")), at + 1)
        part = vectors.slice(at, to - at)
        number = part.field("values").flatten().to_numpy()
        if dense[at:to].all():
            place = np.tile(np.arange(size), to - at)
        elif dense[at:to].any():
            lists = part.field("indices").to_pylist()
            place = np.concatenate([np.arange(size) if row is None else np.array(row, dtype=np.int64) for row in lists])
        else:
            place = part.field("indices").flatten().to_numpy()
        edges = np.concatenate(([0], np.cumsum(widths[at:to])))
        yield edges, place, number, label[at:to], weight[at:to], fold[at:to]
        at = to


def _margins(edges: np.ndarray, place: np.ndarray, number: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Rows x models products with the coefficient columns, intercepts added.

    One model at a time: its column stays in the processor's cache (``points`` in column order)."""
    out = np.tile(points[-1], (len(edges) - 1, 1))
    full = np.flatnonzero(edges[:-1] < edges[1:])
    if len(full):
        place = place.astype(np.intp, copy=False)
        for model in range(points.shape[1]):
            values = points[:, model].take(place)
            values *= number
            out[full, model] += np.add.reduceat(values, edges[:-1][full])
    return out


def _mask(fold: np.ndarray, left_out: np.ndarray) -> np.ndarray:
    return (fold[:, None] != left_out[None, :]).astype(float)


def _add_gradient(out: np.ndarray, edges: np.ndarray, place: np.ndarray, number: np.ndarray, rest: np.ndarray) -> None:
    """Adds value times residual of every value to the row of its feature, one model at a time."""
    place, widths = place.astype(np.intp, copy=False), np.diff(edges)
    for model in range(rest.shape[1]):
        values = np.repeat(rest[:, model], widths)
        values *= number
        sums = np.bincount(place, values)
        out[: len(sums), model] += sums


def _part(batches, points: np.ndarray, left_out: np.ndarray) -> np.ndarray:
    """Rows of the task's sums: gradient per feature, of the intercept, the loss, the weight."""
    size = len(points) - 1
    points, out = np.asfortranarray(points), np.zeros((size + 3, points.shape[1]), order="F")
    for batch in batches:
        for edges, place, number, label, weight, fold in _rows(batch, size):
            margin = _margins(edges, place, number, points)
            own = weight[:, None] * _mask(fold, left_out)
            rest = own * (1 / (1 + np.exp(-np.clip(margin, -700, 700))) - label[:, None])
            if len(place):
                _add_gradient(out, edges, place, number, rest)
            out[size] += rest.sum(axis=0)
            signed = np.where(label[:, None] > 0.5, -margin, margin)
            out[size + 1] += (own * np.logaddexp(0, signed)).sum(axis=0)
            out[size + 2] += own.sum(axis=0)
    return out


def _summed(table: DataFrame, points: np.ndarray, left_out: np.ndarray) -> np.ndarray:
    """The sums of all tasks: one pass over the table and one exchange of ranges."""
    context = table.sparkSession.sparkContext
    shared = context.broadcast((points, left_out))
    rows, models = len(points) + 2, points.shape[1]

    def passed(batches):
        out = _part(batches, *shared.value)
        ranges = range(0, rows, _RANGE)
        yield pa.RecordBatch.from_arrays([pa.array(list(ranges), pa.int32()), pa.array([out[at : at + _RANGE].tobytes() for at in ranges], pa.binary())], ["at", "part"])

    def summed(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[at] = sums.get(at, 0) + np.frombuffer(part.as_buffer(), dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["at", "part"])

    parts = table.select("features", "label", "class_weight", "fold").mapInArrow(passed, "at int, part binary")
    found = parts.repartition("at").mapInArrow(summed, "at int, part binary").collect()
    shared.unpersist()
    out = np.zeros((rows, models))
    for at, part in found:
        out[at : at + _RANGE] += np.frombuffer(part, dtype=np.float64).reshape(-1, models)
    return out


def _left_out(problems: Sequence[Problem]) -> np.ndarray:
    return np.array([-1 if p.left_out is None else p.left_out for p in problems])


def fit_together(table: DataFrame, problems: Sequence[Problem], size: int, max_iter: int = 1000, tolerance: float = 1e-6) -> tuple[np.ndarray, int]:
    """(features + intercept) x models coefficients of ``(features, label,
    class_weight, fold)`` and the number of passes; folds count from 0."""
    states, passes = [_State(np.zeros(size + 1)) for _ in problems], 0
    while open_ := [i for i, state in enumerate(states) if not state.done]:
        points = np.stack([states[i].trial() for i in open_], axis=1)
        sums = _summed(table, points, _left_out([problems[i] for i in open_]))
        passes += 1
        for column, i in enumerate(open_):
            total = sums[-1, column]
            if not total:
                states[i].done = True
                continue
            free = points[:, column].copy()
            free[-1] = 0.0
            ridge = problems[i].ridge
            value = sums[-2, column] / total + ridge / 2 * float(free @ free)
            states[i].take(value, sums[:-2, column] / total + ridge * free, tolerance, max_iter)
    return np.stack([state.x for state in states], axis=1), passes


def held_out_counts(table: DataFrame, problems: Sequence[Problem], points: np.ndarray) -> np.ndarray:
    """(tp, fp, fn, tn) x models over the rows each model left out: one pass."""
    left_out = _left_out(problems)
    shared = table.sparkSession.sparkContext.broadcast((points, left_out))

    def passed(batches):
        points, left_out = shared.value
        points = np.asfortranarray(points)
        out = np.zeros((4, points.shape[1]), dtype=np.int64)
        for batch in batches:
            for edges, place, number, label, _, fold in _rows(batch, len(points) - 1):
                guess, good = _margins(edges, place, number, points) > 0, label[:, None] > 0.5
                out += np.stack([((a & b) & (_mask(fold, left_out) == 0)).sum(axis=0) for a, b in ((guess, good), (guess, ~good), (~guess, good), (~guess, ~good))])
        model = np.arange(out.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(model), *map(pa.array, out)], ["model", "tp", "fp", "fn", "tn"])

    parts = table.select("features", "label", "class_weight", "fold").mapInArrow(passed, "model long, tp long, fp long, fn long, tn long")
    rows = parts.groupBy("model").sum("tp", "fp", "fn", "tn").collect()
    out = np.zeros((4, len(problems)), dtype=np.int64)
    for model, *counts in rows:
        out[:, model] = counts
    return out
