"""Secret scans: keyword automaton, anchored patterns near its hits, checksums.

An Aho-Corasick automaton finds all keywords in one pass over a text. Only at a
hit is the pattern of its kind tried, anchored at the hit, and hits inside an
earlier match of the kind are skipped, which gives the leftmost non-overlapping
matches of an unanchored search. Long hexadecimal runs have no keyword: a run of
n or more characters covers every n-th position, so only those are probed.

Kinds: ``assign``, ``access`` and ``hex`` (the base), and tokens with an embedded
checksum: ``github`` and ``npm`` (a prefix, 30 base-62 characters and their
CRC-32 as 6 base-62 digits) and ``jwt`` (three base64url parts of which the first
decodes to a JSON object with ``alg``). Tokens whose check fails are not secrets
of that kind.

Spans are ``(kind, start, end)`` in code points, end exclusive.

Defined cases. Null is an empty text and has no spans. Repeated rows are separate.
Extra columns are kept, those named like results are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from opinarium.llm.columns import append

# The base patterns and their least lengths.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
# Prefixes of tokens that end in a CRC-32, and their digits.
GITHUB_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "jwt")
PLACEHOLDER = "[SECRET]"

Span = tuple[str, int, int]


def base62_crc(body: bytes) -> bytes:
    """CRC-32 of ``body`` as six base-62 digits."""
    value, digits = zlib.crc32(body), []
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits.append(BASE62[digit])
    return "".join(reversed(digits)).encode()


def _checked(match: re.Match) -> bool:
    return base62_crc(match[1]) == match[2]


def _signed(match: re.Match) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(match[1] + b"=" * (-len(match[1]) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head


# Keyword, kind, pattern, test of a match; assignment keywords are met in either case.
RULES: tuple[tuple[tuple[str, ...], str, re.Pattern, Callable[[re.Match], bool]], ...] = (
    (KEYWORDS, "assign", ASSIGN, lambda m: m.end(1) - m.start(1) >= ASSIGN_LEAST),
    (("AKIA",), "access", ACCESS, lambda m: m.end() - m.start() >= ACCESS_LEAST),
    (GITHUB_PREFIXES, "github", CHECKED, _checked),
    (("npm_",), "npm", CHECKED, _checked),
    (("eyJ",), "jwt", JWT, _signed),
)


def automaton():
    """All keywords in lower case, with the rules they lead to."""
    import ahocorasick

    found: dict[str, list] = {}
    for words, kind, pattern, passes in RULES:
        for word in words:
            found.setdefault(word.lower(), []).append((kind, pattern, passes))
    out = ahocorasick.Automaton()
    for word, rules in found.items():
        out.add_word(word, (len(word), rules))
    out.make_automaton()
    return out


def hex_runs(data: bytes) -> list[tuple[int, int]]:
    """Maximal runs of at least ``HEX_LEAST`` hexadecimal characters."""
    out, done = [], 0
    for at in range(HEX_LEAST - 1, len(data), HEX_LEAST):
        if at < done or data[at] not in b"0123456789abcdef":
            continue
        start = at
        while start > done and data[start - 1] in b"0123456789abcdef":
            start -= 1
        done = HEX.match(data, start).end()
        if done - start >= HEX_LEAST:
            out.append((start, done))
    return out


def scan(text: str, keywords) -> list[Span]:
    """All spans of a text by start, then by kind."""
    data = text.encode("utf-8", "surrogatepass")
    found = [("hex", start, end) for start, end in hex_runs(data)]
    reached: dict[str, int] = {}
    hits = sorted((last + 1 - size, rules) for last, (size, rules) in keywords.iter(data.lower().decode("latin-1"))) if data else []
    for start, rules in hits:
        for kind, pattern, passes in rules:
            if start < reached.get(kind, 0) or not (match := pattern.match(data, start)):
                continue
            reached[kind] = match.end()
            if passes(match):
                found.append((kind, match.start(), match.end()))
    if found and len(data) != len(text):
        found = _in_code_points(data, found)
    return sorted(found, key=lambda span: (span[1], KINDS.index(span[0])))


def _in_code_points(data: bytes, found: list[Span]) -> list[Span]:
    """The spans counted in code points: one pass over the text, as spans are ASCII."""
    out, at, points = [], 0, 0
    for kind, start, end in sorted(found, key=lambda span: span[1]):
        points += len(data[at:start].decode("utf-8", "surrogatepass"))
        at = start
        out.append((kind, points, points + end - start))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every union of overlapping spans replaced."""
    out, done = [], 0
    last = -1
    for _, start, end in spans:
        if start >= last:
            out += [text[done:start], PLACEHOLDER] if start >= done else []
            done = end
        done = last = max(done, end)
    return "".join(out) + text[done:]


RESULT = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string"}


def find_secrets(docs: DataFrame, text: str = "text", redact: str | None = None) -> DataFrame:
    """``docs`` with counts, a digest of the base spans and all spans; with
    ``redact``, also a column of that name without the secrets."""
    fields = RESULT | ({redact: "string"} if redact else {})

    def start():
        keywords = automaton()

        def compute(column):
            rows = []
            for value in column:
                body = value.as_py() or ""
                spans = scan(body, keywords)
                base = [s for s in spans if s[0] in BASE_KINDS]
                counts = [sum(s[0] == kind for s in base) for kind in BASE_KINDS]
                row = (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))
                rows.append((*row, None if not value.is_valid else redacted(body, spans)) if redact else row)
            made = list(zip(*rows)) if rows else [()] * len(fields)
            kinds = [pa.int64()] * 3 + [pa.string()] * (len(fields) - 3)
            return [pa.array(values, kind) for values, kind in zip(made, kinds)]

        return compute

    return append(docs, text, fields, start)
