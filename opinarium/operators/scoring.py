"""Batch scoring with linear models and with external prompt answerers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinarium.functions.dictionary import linear_margins, load_if_small
from opinarium.functions.labels import parse_answer
from opinarium.functions.text import clean_field
from opinarium.operators.features import raw_weight
from opinarium.session import materialize


def score_terms(terms: DataFrame, coefficients: DataFrame, intercept: float, key: str) -> DataFrame:
    """``(key, pred_label, pred_prob)`` of every document under a linear model
    ``(term, idf, coefficient)``. Documents without a known term score the intercept.

    A model of small measured size is looked up inside the row. For a larger one
    the sums of numerator and squared length meet by document, finished on the
    map side, so the shuffle carries one row per document.
    """
    # Written first: it is measured and then read again.
    coefficients = materialize(coefficients.select("term", "idf", F.col("coefficient").cast("double").alias("coefficient")), "coefficients")
    model = load_model(coefficients)
    if model is not None:
        return score_rows(terms, model, intercept, key)
    raw = raw_weight(F.col("tf"), F.col("idf"))
    sums = (
        terms.select(key, F.inline_outer("terms"))
        .join(coefficients, "term", "left")
        .groupBy(key)
        .agg(F.sum(raw * F.col("coefficient")).alias("s"), F.sum(raw * raw).alias("q"))
    )
    margin = F.coalesce(F.try_divide(F.col("s"), F.sqrt("q")), F.lit(0.0))
    return _decide(sums.select(key, margin.alias("margin")), intercept, key)


def load_model(coefficients: DataFrame) -> pa.Table | None:
    """A linear model for :func:`score_rows`, or None if it is too large to send out."""
    return load_if_small(coefficients, "term", ["idf", "coefficient"])


def score_rows(terms: DataFrame, model: pa.Table, intercept: float, key: str) -> DataFrame:
    """:func:`score_terms` of a loaded model: every row by itself, so it also runs
    on a stream in append mode."""
    return _decide(linear_margins(terms, key, "terms", model, "margin"), intercept, key)


def _decide(margins: DataFrame, intercept: float, key: str) -> DataFrame:
    margin = F.col("margin") + F.lit(float(intercept))
    return margins.select(
        key,
        (margin > 0).cast("int").alias("pred_label"),
        F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)), 4).alias("pred_prob"),
    )


def score_vectors(rows: DataFrame, model: LogisticRegressionModel, column: str = "embedding") -> DataFrame:
    """Adds label and probability to rows carrying a dense array column."""
    scored = model.transform(rows.withColumn("features", array_to_vector(F.col(column).cast("array<double>"))))
    return scored.select(
        *[F.col(c) for c in rows.columns],
        F.col("prediction").cast("int").alias("pred_label"),
        F.round(vector_to_array("probability")[1], 4).alias("pred_prob"),
    )


@dataclass(frozen=True)
class Prompt:
    """System text and a user template holding ``{title}`` and ``{text}``."""

    system: str
    user: str

    def render(self, title: Column, body: Column) -> Column:
        """The template with both fields filled in, as one expression."""
        out, rest = [], self.user
        fields = {"{title}": title, "{text}": body}
        while rest:
            at, name = min(((rest.find(n), n) for n in fields if n in rest), default=(len(rest), ""))
            if at:
                out.append(F.lit(rest[:at]))
            if name:
                out.append(fields[name])
            rest = rest[at + len(name):]
        return F.concat(*out) if out else F.lit("")


# A client takes (system text, user texts) and returns one dict per text with
# ``raw``, ``error``, ``input_tokens``, ``output_tokens`` and ``response_time_s``.
Client = Callable[[str, Sequence[str]], Sequence[dict]]

_ANSWER = "raw_response string, client_error string, input_tokens bigint, output_tokens bigint, response_time_s double"


_REPLY = ["raw", "error", "input_tokens", "output_tokens", "response_time_s"]


def _replies(client: Client, system: str, prompts: list[str]) -> list[dict]:
    """Replies of one call; if the call fails, each prompt is asked by itself and
    one that fails again is an error row with type and message."""
    start = time.monotonic()
    try:
        return list(client(system, prompts))
    except Exception as error:  # noqa: BLE001 - whatever a client raises belongs to its rows
        if len(prompts) > 1:
            return [reply for one in prompts for reply in _replies(client, system, [one])]
        return [dict.fromkeys(_REPLY) | {"error": f"{type(error).__name__}: {error}", "response_time_s": time.monotonic() - start}]


def ask(
    rows: DataFrame, key: str, prompt: Prompt, title: str, body: str, client_factory: Callable[[], Client], batch_size: int = 256
) -> DataFrame:
    """One independent prompt per row, answered by a user client on the workers.
    Both fields are trimmed and a missing one is blank.

    Failed rows stay, with a message and no prediction, so that a later run can
    retry them. A client call gets at most ``batch_size`` prompts. Only the key
    and the prompt enter the Python worker.
    """
    system = prompt.system
    prompts = rows.select(F.col(key), prompt.render(clean_field(F.col(title)), clean_field(F.col(body))).alias("_prompt"))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        for batch in batches:
            prompts = batch["_prompt"].tolist()
            replies = [r for at in range(0, len(prompts), batch_size) for r in _replies(client, system, prompts[at : at + batch_size])]
            out = pd.DataFrame(replies, columns=_REPLY)
            out["response_time_s"] = out["response_time_s"].astype(float)
            out = out.rename(columns={"raw": "raw_response", "error": "client_error"})
            out["input_tokens"] = out["input_tokens"].astype("Int64")
            out["output_tokens"] = out["output_tokens"].astype("Int64")
            out.insert(0, key, batch[key].to_numpy())
            yield out

    kind = rows.schema[key].dataType.simpleString()
    answers = prompts.mapInPandas(answer, f"`{key}` {kind}, {_ANSWER}")
    parsed = parse_answer(F.col("raw_response"))
    failed = F.coalesce(F.col("client_error"), F.lit("")) != ""
    return answers.withColumn("_parsed", parsed).select(
        key,
        "raw_response",
        F.when(~failed, F.col("_parsed.polarity")).alias("predicted_polarity"),
        F.when(failed, F.col("client_error")).otherwise(F.col("_parsed.error")).alias("error"),
        "input_tokens",
        "output_tokens",
        "response_time_s",
    )


def succeeded(predictions: DataFrame, error: str = "error") -> DataFrame:
    """Predictions without an error; null and blank both mean none."""
    return predictions.filter(F.coalesce(F.col(error), F.lit("")) == "")


def pending(rows: DataFrame, done: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows without a finished prediction; failed ones are due again."""
    return rows.join(succeeded(done).select(key), key, "left_anti")


def resume(rows: DataFrame, path: str, run_id: str, score: Callable[[DataFrame], DataFrame], key: str = "row_id", commits: int = 4) -> int:
    """Scores what the predictions at ``path`` still lack and appends it.

    The due rows are cut by a hash of the key into ``commits`` parts, each
    appended when it is done: a run that stops keeps the parts before. Rows carry the run that wrote them; :func:`latest` drops superseded failures
    when reading. Returns the number of rows appended.
    """
    from pyspark.errors import AnalysisException

    try:
        due = pending(rows, rows.sparkSession.read.parquet(path), key)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        due = rows
    due, appended = materialize(due, "due"), 0
    for part in range(commits):
        own = due.filter(F.pmod(F.xxhash64(key), F.lit(commits)) == part)
        result = materialize(score(own).withColumn("run_id", F.lit(run_id)), "answers")
        appended += result.count()
        result.write.mode("append").parquet(path)
    return appended


def latest(predictions: DataFrame, key: str = "row_id") -> DataFrame:
    """One row per key: a success if there is one, else the newest failure.

    The winner is a map-side minimum over a small struct."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    rest = [c for c in predictions.columns if c != key]
    first = F.max(F.struct((~failed).alias("_ok"), F.col("run_id").alias("_run"), F.struct(*rest).alias("_row")))
    return predictions.groupBy(key).agg(first.alias("_best")).select(key, "_best._row.*")
