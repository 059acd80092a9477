"""Labels, poles and answer parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Pole names of the report and their output order.
STRICT_POLES = ("Polo Negativo (1 e 2)", "Polo Positivo (4 e 5)")
OTHER_POLE = "Outros"
TWO_POLES = ("Negativa (1-2)", "Positiva (4-5)")

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(df: DataFrame, name: str) -> Column:
    """The column as a double; what is not a number becomes null."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.when(column.rlike(_NUMBER), column.try_cast("double"))
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def polarity(rating: Column) -> Column:
    """1 and 2 are negative (0), 4 and 5 positive (1), the rest null."""
    return F.when(rating.isin(1, 2), 0).when(rating.isin(4, 5), 1)


def not_neutral(rating: Column) -> Column:
    """Everything but a rating of 3; a missing rating stays."""
    return ~rating.eqNullSafe(F.lit(3))


def strict_pole(rating: Column) -> Column:
    return (
        F.when(rating.isin(1, 2), STRICT_POLES[0])
        .when(rating.isin(4, 5), STRICT_POLES[1])
        .otherwise(OTHER_POLE)
    )


def two_pole(rating: Column) -> Column:
    """4 and up is positive; all else, missing ratings included, negative."""
    return F.when(F.coalesce(rating >= 4, F.lit(False)), TWO_POLES[1]).otherwise(TWO_POLES[0])


def sentiment_label(label: Column) -> Column:
    return F.when(label.isNotNull(), F.when(label == 1, "positive").otherwise("negative"))


def sentiment_confidence(label: Column, probability: Column) -> Column:
    """Probability of the predicted class, 4 decimals."""
    shown = F.when(label == 1, probability).otherwise(F.lit(1.0) - probability)
    return F.when(label.isNotNull(), F.round(shown, 4))


def row_digest(*columns: Column) -> Column:
    """A row id that does not depend on position or partitioning."""
    return F.sha2(F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def parse_answer(raw: Column) -> Column:
    """Struct ``(sentiment, polarity, error)`` of a JSON answer.

    Only an object whose ``sentiment`` is positive or negative is accepted.
    """
    sentiment = F.from_json(raw, "sentiment string").getField("sentiment")
    known = F.coalesce(sentiment.isin("positive", "negative"), F.lit(False))
    return F.struct(
        F.when(known, sentiment).alias("sentiment"),
        F.when(known, (sentiment == "positive").cast("int")).alias("polarity"),
        F.when(
            ~known,
            F.concat(F.lit("malformed_response: "), F.coalesce(sentiment, F.lit("no sentiment"))),
        ).alias("error"),
    )
