"""Byte-pair encoding and decoding with a pair occurrence index.

The distinct pieces of a batch of texts are encoded together. An index maps
every mergeable pair to all its positions in them; a heap holds the ranks that
have positions. The lowest rank is applied at all its positions at once, and only
the lists of the pairs that this creates or that lie next to it change. Texts are
then put together from their pieces.

The vocabulary is a file of the ``tokenizers`` library (byte-level BPE); its path
is a parameter that must be readable where tasks run.

Defined cases. Null is an empty text: no tokens, digests of the empty string.
The strings of special tokens in a text are those tokens, as the library has it.
Repeated rows are separate. Extra columns are kept, those named like results are
replaced. Pieces of any length work: cost grows with the piece, not its square.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from opinarium.llm import textscan
from opinarium.llm.columns import append

# How byte-level vocabularies cut texts into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
# Codes of pieces kept by one task before they are dropped and found anew.
REMEMBERED = 300_000
# Bytes of text whose pieces are encoded together.
TOGETHER = 8 << 20
_GONE, _END = -2, -1


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the
    next free code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return [chr(hidden.get(b, b)) for b in range(256)]


class Vocabulary:
    """Merges as sorted arrays and the bytes of every token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids, letters = spec["model"]["vocab"], byte_letters()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.byte_ids = np.array([ids[letter] for letter in letters], dtype=np.int64)
        self.special = {token["content"]: token["id"] for token in spec.get("added_tokens", [])}
        size = 1 + max([*ids.values(), *self.special.values()])
        born = np.full(size, -1)
        born[self.made] = np.arange(len(pairs))
        if len(pairs) and (np.maximum(born[self.left], born[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge uses a token that a later merge makes")
        self.base = size
        keys = self.left * size + self.right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]
        back = {letter: bytes([b]) for b, letter in enumerate(letters)}
        tokens = [b""] * size
        for token, number in ids.items():
            tokens[number] = b"".join(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, number in self.special.items():
            tokens[number] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.token_start = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of the pairs, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(left), -1)
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.rank_of[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces and where each piece's ids start (one more entry)."""
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        count = len(flat)
        edges = np.concatenate(([0], np.cumsum([len(p) for p in pieces], dtype=np.int64)))
        symbol = np.append(self.byte_ids[flat], _END)
        after, before = np.arange(1, count + 2), np.arange(-1, count)
        full = edges[:-1] < edges[1:]
        after[edges[1:][full] - 1] = count
        before[edges[:-1][full]] = count
        positions: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            ranks = self.ranks(symbol[at], symbol[after[at]])
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            starts = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1]))) if len(ranks) else []
            for rank, group in zip(ranks[starts].tolist(), np.split(at, starts[1:])) if len(ranks) else ():
                if rank not in positions:
                    positions[rank] = []
                    heapq.heappush(active, rank)
                positions[rank].append(group)

        add(np.arange(count))
        while active:
            rank = heapq.heappop(active)
            lists = positions.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            nearby = after[at]
            live = (symbol[at] == self.left[rank]) & (symbol[nearby] == self.right[rank])
            at, nearby = at[live], nearby[live]
            if self.left[rank] == self.right[rank] and len(at) > 1:
                at = _leftmost(at, nearby)
                nearby = after[at]
            if not len(at):
                continue
            symbol[at], symbol[nearby] = self.made[rank], _GONE
            after[at] = after[nearby]
            before[after[nearby]] = at
            lefts = before[at]
            add(np.unique(np.concatenate((lefts[lefts < count], at))))
        live = symbol[:count] != _GONE
        return symbol[:count][live], np.concatenate(([0], np.cumsum(live)))[edges]

    def decode(self, ids: np.ndarray) -> str:
        start, size = self.token_start[ids], self.token_start[ids + 1] - self.token_start[ids]
        total = np.cumsum(size)
        inner = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - size, size)
        return self.token_bytes[inner + np.repeat(start, size)].tobytes().decode("utf-8", "replace")


def _leftmost(at: np.ndarray, nearby: np.ndarray) -> np.ndarray:
    """Of overlapping occurrences of a doubled symbol, every other one from the left."""
    joined = np.concatenate(([False], at[1:] == nearby[:-1]))
    run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
    return at[(np.arange(len(at)) - run) % 2 == 0]


class Encoder:
    """Texts to token ids; pieces met before are remembered."""

    def __init__(self, path: str):
        import re

        import regex

        self.vocabulary = Vocabulary(path)
        self.cut = regex.compile(PIECES).findall
        self.cut_ascii = re.compile(ASCII_PIECES, re.ASCII).findall
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = _Numbering()
        self.flat, self.edges = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def pieces(self, text: str) -> list[int]:
        """Numbers of the pieces of a text; special tokens are numbers below zero."""
        if self.special is None or not self.special.search(text):
            return list(map(self.numbers.__getitem__, (self.cut_ascii if text.isascii() else self.cut)(text)))
        out: list[int] = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                out.append(-1 - self.vocabulary.special[part])
            else:
                out += map(self.numbers.__getitem__, self.cut(part))
        return out

    def encode(self, texts) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(self.numbers) > REMEMBERED:
            self.forget()
        cut = [np.array(self.pieces(text), dtype=np.int32) for text in texts]
        new = list(itertools.islice(self.numbers, len(self.edges) - 1, None))
        if new:
            ids, edges = self.vocabulary.encode_pieces([piece.encode("utf-8") for piece in new])
            self.edges = np.concatenate((self.edges, self.edges[-1] + edges[1:]))
            self.flat = np.concatenate((self.flat, ids.astype(np.int32)))
        return [self._join(row) for row in cut]

    def _join(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the numbered pieces, one after the other."""
        special = numbers < 0
        known = np.where(special, 0, numbers)
        start = self.edges[known] if len(self.edges) > 1 else np.zeros(len(numbers), dtype=np.int64)
        size = np.where(special, 1, self.edges[known + 1] - start) if len(self.edges) > 1 else np.ones(len(numbers), dtype=np.int64)
        total = np.cumsum(size)
        count = int(total[-1]) if len(total) else 0
        at = np.arange(count) - np.repeat(total - size, size) + np.repeat(start, size)
        out = self.flat[np.minimum(at, max(len(self.flat) - 1, 0))] if len(self.flat) else np.zeros(count, dtype=np.int32)
        out[(total - size)[special]] = -1 - numbers[special]
        return out


class _Numbering(dict):
    """Gives every new key the next number."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


RESULT = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str | None = None) -> DataFrame:
    """``docs`` with token counts and digests of the ids and of the decoded text;
    with ``ids``, also a column of that name with the ids."""
    fields = RESULT | ({ids: "array<int>"} if ids else {})

    def start():
        encoder = Encoder(path)
        names = np.arange(encoder.vocabulary.base).astype(str).astype(object)

        def compute(column):
            counts, digests, decoded, lists = [], [], [], []
            for first, last, _, _ in textscan.chunks(column, TOGETHER):
                for row in encoder.encode([value.as_py() or "" for value in column.slice(first, last - first)]):
                    counts.append(len(row))
                    digests.append(_sha256(",".join(names[row])))
                    decoded.append(_sha256(encoder.vocabulary.decode(row)))
                    if ids:
                        lists.append(row)
            made = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            return made + ([pa.array(lists, pa.list_(pa.int32()))] if ids else [])

        return compute

    return append(docs, text, fields, start)


def decode_documents(docs: DataFrame, path: str, ids: str, out: str = "decoded") -> DataFrame:
    """``docs`` with the text of the token ids; null ids give null."""

    def start():
        vocabulary = Vocabulary(path)

        def compute(column):
            rows = column.to_pylist()
            return [pa.array([None if row is None else vocabulary.decode(np.array(row, dtype=np.int64)) for row in rows], pa.string())]

        return compute

    return append(docs, ids, {out: "string"}, start)
