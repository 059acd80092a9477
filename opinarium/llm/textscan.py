"""Vectorised words and hashes of Arrow text columns, shared by the operators.

Everything works on UTF-8 bytes of whole texts. A batch is cut into chunks of
whole documents of about ``CHUNK_BYTES``, so memory follows the chunk, or the
longest single text, and never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LETTER_BASE = 0xD6E8FEB86659FD93


class Words(NamedTuple):
    """Words of a chunk in reading order: byte starts and ends in ``data`` and,
    per document, the index of its first word (``first`` has one more entry)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: False inside the closed byte ranges, True elsewhere."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


# The separators of the two word rules of the contracts.
BLANK_SEPARATED = byte_class((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        last = min(max(last, row + 1), len(column))
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def split_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Maximal runs of word bytes that do not cross a document's end."""
    inside = is_word[data]
    before = np.empty_like(inside)
    before[1:], before[:1] = inside[:-1], False
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[:-1], after[-1:] = inside[1:], False
    after[(offsets[1:] - 1)[offsets[1:] > 0]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(max(count, 1), np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal spans have equal hashes."""
    out = np.zeros(len(start), dtype=np.uint64)
    lengths = end - start
    total = np.concatenate(([0], np.cumsum(lengths)))
    at = 0
    while at < len(start):
        to = min(max(int(np.searchsorted(total, total[at] + CHUNK_BYTES, side="right")) - 1, at + 1), len(start))
        size = lengths[at:to]
        begins = total[at:to] - total[at]
        inner = np.arange(int(total[to] - total[at])) - np.repeat(begins, size)
        codes = _BYTE_CODES[data[inner + np.repeat(start[at:to], size)]]
        codes *= powers(_LETTER_BASE, int(size.max()))[inner]
        out[at:to] = np.add.reduceat(codes, begins)
        at = to
    return mix(out + lengths.astype(np.uint64) * np.uint64(_MULTIPLIER))


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every run of ``length`` consecutive values."""
    count = len(values) - length + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for place, factor in enumerate(powers(_MULTIPLIER, length)):
        out += values[place : place + count] * factor
    return mix(out)
