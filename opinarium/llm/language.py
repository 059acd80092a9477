"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are folded (A-Z to a-z, other ASCII outside letters to blanks) and cut into
character n-grams of 1 to 3, hashed into ``2 ** BITS`` buckets. Tasks count
buckets per language and Spark adds the counts up; the log-probability matrix of
languages x buckets is broadcast. Its size is bounded by the number of languages,
never by the corpus. Tasks score whole batches with gathers and segment sums.

Priors are counted over all training rows. Bucket counts come from about
``per_language`` documents of each language, chosen by a hash of their id.

Defined cases. Null texts and texts without a letter are ``und`` with score 0, as
is every text if nothing was learned. Null languages are not learned. Ties go to
the first language in sorted order. Repeated rows are separate rows, and count
again when learned. Extra columns are kept, those named like results are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinarium.llm import textscan
from opinarium.llm.columns import append, held_out
from opinarium.session import broadcast_if_small

BITS, LONGEST, PER_LANGUAGE, UNKNOWN = 16, 3, 5_000, "und"
SMOOTHING = 0.5
# Languages scored at once: bounds the memory of a chunk.
_BLOCK = 8

_FOLD = textscan.LOWER.copy()
_FOLD[:0x61] = np.where((np.arange(0x61) >= ord("A")) & (np.arange(0x61) <= ord("Z")), textscan.LOWER[:0x61], 0x20)
_FOLD[0x7B:0x80] = 0x20


class Model(NamedTuple):
    languages: list[str]
    prior: np.ndarray
    table: np.ndarray  # buckets x languages


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, their text offsets, buckets of the n-grams by length and start);
    n-grams that would cross a text's end get the bucket -1."""
    points = np.frombuffer(_FOLD[data].tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    room = np.repeat(first[1:], np.diff(first)) - np.arange(len(points))
    out = np.full((LONGEST, len(points)), -1, dtype=np.int64)
    for size in range(1, LONGEST + 1):
        runs = textscan.run_hashes(points + np.uint64(size), size) >> np.uint64(64 - BITS)
        fits = room[: len(runs)] >= size
        out[size - 1, : len(runs)][fits] = runs[fits].astype(np.int64)
    return points, first, out


def count_grams(docs: DataFrame, text: str, language: str) -> DataFrame:
    """``(lang, bucket, n)`` over all texts of ``docs``."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            for row, last, data, offsets in textscan.chunks(batch.column(batch.schema.get_field_index("_text"))):
                _, first, buckets = grams(data, offsets)
                for i, name in enumerate(names[row:last]):
                    own = buckets[:, first[i] : first[i + 1]]
                    counts.setdefault(name, np.zeros(1 << BITS, dtype=np.int64))
                    counts[name] += np.bincount(own[own >= 0], minlength=1 << BITS)
        for name, n in counts.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(n[used])], ["lang", "bucket", "n"])

    parts = docs.select(F.col(language).alias("lang"), F.col(text).alias("_text")).mapInArrow(run, "lang string, bucket long, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 11) -> Model | None:
    """Learns from the rows that are not held out; None if there are none."""
    usable = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("rows"))
    priors = {row["lang"]: row["rows"] for row in sizes.collect()}
    if not priors:
        return None
    languages = sorted(priors)
    rates = docs.sparkSession.createDataFrame([(name, per_language / priors[name]) for name in languages], "lang string, rate double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.join(broadcast_if_small(rates, F.col("lang")), "lang").filter(draw < F.col("rate"))
    counts = np.zeros((1 << BITS, len(languages)))
    found = count_grams(sample, "text", "lang").toPandas()
    places = {name: i for i, name in enumerate(languages)}
    counts[found["bucket"].to_numpy(dtype=np.int64), found["lang"].map(places).to_numpy(dtype=np.int64)] = found["n"]
    counts += SMOOTHING
    prior = np.log(np.array([priors[name] for name in languages], dtype=float))
    return Model(languages, prior, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def log_scores(model: Model, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages log scores, whether a text has a letter) of a chunk."""
    points, first, buckets = grams(data, offsets)
    count = len(offsets) - 1
    out, lettered = np.tile(model.prior, (count, 1)), np.zeros(count, dtype=bool)
    full = np.flatnonzero(first[:-1] < first[1:])
    if not len(full):
        return out, lettered
    starts = first[:-1][full]
    lettered[full] = np.logical_or.reduceat(letters[points.astype(np.int64)], starts)
    for low in range(0, len(model.languages), _BLOCK):
        part = model.table[:, low : low + _BLOCK]
        part = np.vstack((part, np.zeros((1, part.shape[1]), dtype=part.dtype)))  # the bucket -1
        for row in buckets:
            out[full, low : low + _BLOCK] += np.add.reduceat(part[row], starts, axis=0, dtype=np.float64)
    return out, lettered


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of that language."""
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else tuple(model))

    def start():
        learned, letters = None if shared.value is None else Model(*shared.value), _letters()

        def compute(column):
            names, scores = [UNKNOWN] * len(column), np.zeros(len(column))
            if learned is not None:
                for row, last, data, offsets in textscan.chunks(column):
                    logs, lettered = log_scores(learned, data, offsets, letters)
                    best = logs.argmax(axis=1)
                    share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                    for i in np.flatnonzero(lettered):
                        names[row + i], scores[row + i] = learned.languages[best[i]], share[i]
            return [pa.array(names, pa.string()), pa.array(scores)]

        return compute

    return append(docs, text, {"lang_pred": "string", "score": "double"}, start)
