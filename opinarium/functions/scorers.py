"""Pluggable product scorers.

A scorer takes the review table and returns a :class:`Share`: two row-level
numbers whose sums give S(p). Sums merge, so any scorer is combined on the map
side and never needs a product's reviews in one place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinarium.functions.labels import number


@dataclass(frozen=True)
class Share:
    """``hits`` over ``base``; a product without a base scores 0."""

    hits: Column
    base: Column

    @staticmethod
    def ratio(hits: Column, base: Column) -> Column:
        return F.coalesce(F.try_divide(hits.cast("double"), base.cast("double")), F.lit(0.0))


Scorer = Callable[[DataFrame], Share]


def rating_scorer(column: str = "overall_rating", threshold: float = 4) -> Scorer:
    """Share of ratings at or above ``threshold`` among the numeric ratings."""

    def score(df: DataFrame) -> Share:
        rating = number(df, column)
        return Share((F.coalesce(rating >= threshold, F.lit(False))).cast("long"), rating.isNotNull().cast("long"))

    return score


def label_scorer(column: str = "pred_label", positive: int = 1, count_missing: bool = False) -> Scorer:
    """Share of the positive label; missing labels count only on request."""

    def score(df: DataFrame) -> Share:
        if column not in df.columns:
            raise ValueError(f"no label column named {column}")
        label = number(df, column)
        base = F.lit(1).cast("long") if count_missing else label.isNotNull().cast("long")
        return Share(F.coalesce(label == positive, F.lit(False)).cast("long"), base)

    return score
