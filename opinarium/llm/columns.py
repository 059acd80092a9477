"""Columns computed from a text column in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append(df: DataFrame, text: str, fields: Mapping[str, str], start: Callable[[], Callable[[pa.Array], list]]) -> DataFrame:
    """All columns of ``df`` with ``fields`` (name to DDL type) behind them.

    ``start()`` runs once per task and returns ``texts -> arrays``, one array per
    field. Columns of ``df`` that clash with a field are replaced, all others are
    kept whatever their names are.
    """
    replaced = text.lower() in {name.lower() for name in fields}
    source = unused(df, "texts") if replaced else text
    kept = (df.withColumn(source, F.col(f"`{text}`")) if replaced else df).drop(*fields)
    added = T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in fields.items()))
    schema = T.StructType([*kept.schema.fields, *added.fields])

    def run(batches):
        compute = start()
        for batch in batches:
            made = compute(batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *fields])

    place = [name.lower() for name in kept.columns].index(source.lower())
    out = kept.mapInArrow(run, schema)
    return out.drop(source) if replaced else out


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {name.lower() for name in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of the id as text is a
    multiple of 5. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 5 == 0
