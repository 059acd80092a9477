"""Records of CSV files whose quoted fields hold line breaks, read by many tasks per file.

A file is read as lines, in the blocks Spark cuts it into. At the start of a line
the parser is either between records or inside quotes, so a line is a map of two
states, known from the line alone; a block's map is the composition of its lines'.
The maps of a file's blocks, one small row each, give the state every block starts
in, and each block then joins its lines to records by itself. Only the parts of
records that cross a block's end are shuffled.

Defined cases: a quote inside an unquoted field is a plain character; after text
behind a closing quote the field goes on to the next comma or line end; a quote
that is never closed makes the rest of the file one record, without the line break
the file ends with; empty lines are no records; an empty file has none; bytes that
are no UTF-8 become replacement characters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinarium.session import broadcast_if_small, materialize

_CLOSED = r'"[^"]*+(?:""[^"]*+)*+"(?!")[^,]*+'
_FIELDS = rf'(?:(?:{_CLOSED}|[^",][^,]*+)?+,)*+'
# Possessive throughout: each line is read once and nothing is stacked.
_UNCLOSED = r'[^"]*+(?:""[^"]*+)*+'
OPENS = rf'(?s)\A{_FIELDS}"{_UNCLOSED}\z'
STAYS = rf'(?s)\A{_UNCLOSED}(?:"(?!")[^,]*+,{_FIELDS}"{_UNCLOSED})?+\z'

# The file's blocks must be the same in both readings, whatever executors are lost between them.
_CUT = "spark.sql.files.minPartitionNum"

WHOLE, BEGUN, CONTINUED = 0, 1, 2


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(file, block, line, opens, stays)`` in file order inside a block. ``opens``: a line
    that starts between records ends inside quotes; ``stays``: one that starts inside ends there."""
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    return lines.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.make_valid_utf8("value").alias("line"),
        F.col("value").rlike(OPENS).alias("opens"),
        F.col("value").rlike(STAYS).alias("stays"),
    )


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(column.to_pylist() for column in batch.columns))


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: lines to one ``(file, block, outside, inside)`` per block."""
    ends: dict[tuple[int, int], tuple[bool, bool]] = {}
    for batch in batches:
        for file, block, opens, stays in _rows(batch):
            outside, inside = ends.get((file, block), (False, True))
            ends[file, block] = (stays if outside else opens, stays if inside else opens)
    rows = [(*key, *value) for key, value in ends.items()]
    yield pa.RecordBatch.from_pylist([dict(zip(_MAP.names, row)) for row in rows], schema=_MAP)


_MAP = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_())])
_PART = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()), ("record", pa.string())])
_OUT_ROWS = 4096


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: lines and the state their block starts in to whole records
    and the parts of those that cross a block's end."""
    key, inside, kind, first, held, out = None, False, WHOLE, False, [], []

    def emit(kind):
        out.append((*key, kind, first, "\n".join(held)))

    def flush():
        columns = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PART)], schema=_PART)

    for batch in batches:
        for file, block, line, opens, stays, start in _rows(batch):
            if (file, block) != key:
                if held:
                    emit(kind or BEGUN)
                key, inside, held, first = (file, block), start, [], block == 0
                kind = CONTINUED if start else WHOLE
            held.append(line)
            inside = stays if inside else opens
            if not inside:
                emit(kind)
                kind, first, held = WHOLE, False, []
        if len(out) >= _OUT_ROWS:
            yield flush()
            out.clear()
    if held:
        emit(kind or BEGUN)
    if out:
        yield flush()


def _starts(lines: DataFrame) -> DataFrame:
    """Stored ``(file, block, start)``: whether a block starts inside quotes. A file has one row per block."""
    maps = lines.select("file", "block", "opens", "stays").mapInArrow(_maps, "file long, block long, outside boolean, inside boolean")
    maps = materialize(maps, "block-maps")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    fixed = F.col("outside") == F.col("inside")
    turns = F.count_if(F.col("outside") & ~F.col("inside")).over(through)
    known = maps.withColumn("turns", turns)
    # The last block whose end does not depend on its start, and the turns since.
    base = F.max(F.when(fixed, F.struct("block", "outside", "turns"))).over(before)
    since = F.coalesce(F.max("turns").over(before), F.lit(0)) - F.coalesce(base["turns"], F.lit(0))
    odd = since % 2 == 1
    start = F.coalesce(base["outside"], F.lit(False)) != odd
    return materialize(known.select("file", "block", start.alias("start")), "block-starts")


def csv_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Stored ``(record)``: the text of every record of the files but their header records."""
    before = spark.conf.get(_CUT, None)
    spark.conf.set(_CUT, before or str(spark.sparkContext.defaultParallelism))
    try:
        lines = _lines(spark, paths)
        starts = _starts(lines)
        small = broadcast_if_small(starts)
        placed = lines.join(small, ["file", "block"]).select("file", "block", "line", "opens", "stays", "start")
        if small is starts:
            # Too many blocks to send out: the lines meet them in a shuffle and are put in order again.
            numbered = lines.withColumn("_at", F.monotonically_increasing_id())
            placed = numbered.join(starts, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "_at")
            placed = placed.select("file", "block", "line", "opens", "stays", "start")
        schema = "file long, block long, kind int, first boolean, record string"
        parts = materialize(placed.mapInArrow(_parts, schema), "csv-parts")
    finally:
        if before is None:
            spark.conf.unset(_CUT)
        else:
            spark.conf.set(_CUT, before)
    whole = parts.filter((F.col("kind") == WHOLE) & ~F.col("first")).select("record")
    # A block ends with at most one begun record and starts with at most one continued.
    order = Window.partitionBy("file").orderBy("block", F.desc("kind"))
    broken = parts.filter(F.col("kind") != WHOLE).withColumn("begun", F.count_if(F.col("kind") == BEGUN).over(order))
    joined = broken.groupBy("file", "begun").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "record"))), lambda p: p["record"]), "\n").alias("record"),
        F.max("first").alias("first"),
    )
    records = whole.unionByName(joined.filter(~F.col("first")).select("record"))
    return records.select(F.regexp_replace("record", r"\r\z", "").alias("record")).filter("record <> ''")
