"""Models of a search fitted together against the same fits one by one."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from opinarium.operators import grid, training

SIZE = 9


@pytest.fixture(scope="module")
def table(spark):
    pick = np.random.default_rng(4)
    truth, rows = pick.standard_normal(SIZE), []
    for i in range(300):
        values = np.where(pick.random(SIZE) < 0.4, pick.standard_normal(SIZE), 0.0)
        if i % 50 == 0:
            values[:] = 0.0
        label = float(values @ truth + pick.standard_normal() > 0.3)
        vector = Vectors.dense(values) if i % 3 == 0 else Vectors.sparse(SIZE, [(j, float(v)) for j, v in enumerate(values) if v])
        rows.append((vector, label, 2.5 if label == 0 else 1.0, i % 4))
    return spark.createDataFrame(rows, ["features", "label", "class_weight", "fold"]).repartition(5).cache()


def alone(rows, ridge):
    found = LogisticRegression(weightCol="class_weight", regParam=ridge, elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-12).fit(rows)
    return np.append(found.coefficients.toArray(), found.intercept)


@pytest.mark.parametrize("limits", [(1 << 15, 4096), (7, 3)])
def test_fits_equal_single_fits(table, monkeypatch, limits):
    monkeypatch.setattr(grid, "_BLOCK", limits[0])
    monkeypatch.setattr(grid, "_RANGE", limits[1])
    problems = [grid.Problem(fold, ridge) for fold in (None, 0, 3) for ridge in (0.5, 0.003)]
    points, passes = grid.fit_together(table, problems, SIZE, tolerance=1e-11)
    for column, problem in enumerate(problems):
        rows = table if problem.left_out is None else table.filter(F.col("fold") != problem.left_out)
        assert points[:, column] == pytest.approx(alone(rows, problem.ridge), abs=1e-4)
    slowest = max(grid.fit_together(table, [problem], SIZE, tolerance=1e-11)[1] for problem in problems[:2])
    assert passes <= 3 * slowest


def test_default_tolerance_is_close(table):
    points, _ = grid.fit_together(table, [grid.Problem(1, 0.01)], SIZE)
    assert points[:, 0] == pytest.approx(alone(table.filter("fold <> 1"), 0.01), abs=5e-3)


def test_held_out_counts(table):
    problems = [grid.Problem(fold, 0.1) for fold in range(4)]
    points, _ = grid.fit_together(table, problems, SIZE)
    counts = grid.held_out_counts(table, problems, points)
    rows = table.collect()
    for fold in range(4):
        want = [0, 0, 0, 0]
        for row in rows:
            if row["fold"] == fold:
                guess = row["features"].toArray() @ points[:-1, fold] + points[-1, fold] > 0
                want[(0 if row["label"] else 1) if guess else (2 if row["label"] else 3)] += 1
        assert counts[:, fold].tolist() == want
        assert training.macro_f1(*counts[:, fold]) == pytest.approx(sum(2 * h / max(2 * h + want[1] + want[2], 1) for h in (want[0], want[3])) / 2)
    assert training.macro_f1(0, 0, 0, 0) == 0.0


def test_search(table):
    found = training.grid_search(table, (0.01, 1.0), 200)
    assert set(found.scores) == {0.01, 1.0} and found.best_f1 == max(found.scores.values())
    assert found.passes < 60 and math.isfinite(found.model.intercept)


@pytest.mark.parametrize("twice", [False, True])
@pytest.mark.parametrize("width", [0, 3, 40])
def test_sums_of_a_block(width, twice):
    """Long rows, short ones, and rows that hold a feature twice give the plain sums."""
    draw = np.random.default_rng(width)
    size, models, rows = 60, 3, 7
    widths = [width, 0, width, width, 2, width, width]
    edges = np.concatenate(([0], np.cumsum(widths)))
    place = np.concatenate([np.sort(draw.choice(size, n, replace=False)) for n in widths]).astype(np.int64)
    if twice and width:
        place[1] = place[0]
    number, points, rest = draw.random(edges[-1]), draw.random((size + 1, models)), draw.random((rows, models))
    table, gradient = np.zeros((rows, size)), np.zeros((size + 3, models))
    np.add.at(table, (np.repeat(np.arange(rows), widths), place), number)
    assert np.allclose(grid._margins(edges, place, number, points), table @ points[:-1] + points[-1])
    grid._add_gradient(gradient, edges, place, number, rest)
    assert np.allclose(gradient[:size], table.T @ rest) and not gradient[size:].any()
