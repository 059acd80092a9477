"""Vector expressions and the encoder seam."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# An encoder factory takes no argument and returns ``texts -> matrix``; it runs
# once per Python worker, so a model is loaded there and never on the driver.
EncoderFactory = Callable[[], Callable[[Sequence[str]], np.ndarray]]

# Fixed value: the task sentence put before query texts.
QUERY_INSTRUCTION = "Given a retail product title, retrieve titles of similar products"


def dot(left: Column, right: Column) -> Column:
    """Dot product in double precision; the cosine of unit vectors."""
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def unit(vector: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    length = F.sqrt(dot(vector, vector))
    divisor = F.when(length == 0, F.lit(1.0)).otherwise(length)
    return F.transform(vector, lambda x: (x / divisor).cast("float"))


def query_text(text: Column, instruction: str = QUERY_INSTRUCTION) -> Column:
    """Queries carry the instruction; documents are encoded bare."""
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery:"), text)


def hashing_encoder(dim: int = 64) -> EncoderFactory:
    """Offline encoder: signed hashed word and word-pair counts."""

    def factory():
        import re
        from zlib import crc32

        words = re.compile(r"\w+")

        def encode(texts):
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for row, text in enumerate(texts):
                tokens = words.findall((text or "").lower())
                for gram in tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]:
                    code = crc32(gram.encode("utf-8"))
                    out[row, (code >> 1) % dim] += 1.0 if code & 1 else -1.0
            return out

        return encode

    return factory


def encode(text: Column, factory: EncoderFactory, batch_size: int = 32) -> Column:
    """Unit vectors of ``text`` from a user encoder, run batch by batch."""
    run = predict_batch_udf(
        lambda: _as_float_rows(factory()),
        return_type=T.ArrayType(T.FloatType()),
        batch_size=batch_size,
    )
    return run(F.coalesce(text, F.lit("")))


def _as_float_rows(run):
    def predict(texts):
        rows = np.asarray(run(list(texts)), dtype=np.float32)
        length = np.linalg.norm(rows, axis=1, keepdims=True)
        return rows / np.where(length == 0.0, np.float32(1.0), length)

    return predict
