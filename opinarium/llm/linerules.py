"""Quality rules, lines first.

Every line of a text is judged by itself: punctuation (symbols, or a stub without
a sentence end), navigation (menus and link lists) and boilerplate (legal and
cookie notices). Failing lines are removed; a document that loses more than
``most_lost`` of its words is rejected. Document rules on the whole text come
first: too few words, or too many words in repeated five-word windows.

Defined cases. Null is a text without words: not kept, its clean text is null.
Blank lines are kept and cost nothing. Repeated rows are separate rows. Extra
columns are kept, those named like results are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from opinarium.llm import textscan
from opinarium.llm.columns import append

WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
MOST_LOST = 0.5
# Symbol characters of the document rule.
SYMBOLS = b"#*$%&|<>"
# A line fails with more than this share of symbols, or as a stub of fewer words without a sentence end.
SYMBOL_SHARE, STUB_WORDS = 0.1, 3
SENTENCE_END = tuple(".!?:;,\"')]}»”’…。！？")
SEPARATORS = re.compile(r"[|»›•·>]")
MENU = frozenset("home about contact login logout register search menu help faq sitemap next previous back share print".split())
BOILERPLATE = re.compile(
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|(?:uses?|accept) cookies"
    r"|enable javascript|subscribe to our newsletter|click here to|lorem ipsum|^copyright\b|©",
    re.IGNORECASE,
)
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def line_fails(line: str) -> str | None:
    """The rule a line with words fails, or None."""
    words = _WORD.findall(line)
    letters = sum(map(len, words))
    if sum(line.count(chr(c)) for c in SYMBOLS) > SYMBOL_SHARE * letters:
        return "punctuation"
    stripped = line.rstrip()
    if len(words) < STUB_WORDS and not stripped.endswith(SENTENCE_END):
        return "punctuation"
    if len(SEPARATORS.findall(line)) >= 2 and len(words) <= 4 * len(SEPARATORS.findall(line)) + 4:
        return "navigation"
    if 2 * sum(word.strip(".,:|").lower() in MENU for word in words) > len(words):
        return "navigation"
    return "boilerplate" if BOILERPLATE.search(line) else None


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside windows of five that occur twice or more."""
    runs = textscan.run_hashes(hashes, WINDOW)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    ranked = runs[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(runs), dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    edge[: len(runs)] += again
    edge[WINDOW : WINDOW + len(runs)] -= again
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def judge_lines(text: str) -> tuple[str, int, int]:
    """(text without failing lines, words kept, lines equal to an earlier line)."""
    seen, clean, words, doubles = set(), [], 0, 0
    for line in text.split("\n"):
        count = len(_WORD.findall(line))
        if count:
            doubles += line in seen
            seen.add(line)
            if line_fails(line):
                continue
        words += count
        clean.append(line)
    return "\n".join(clean), words, doubles


RESULT = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean"}


def apply_rules(docs: DataFrame, text: str = "text", clean: str | None = None, most_lost: float = MOST_LOST) -> DataFrame:
    """``docs`` with the counts and verdicts; with ``clean``, also the text left."""
    fields = RESULT | ({clean: "string"} if clean else {})

    def start():
        def compute(column):
            rows = []
            for row, last, data, offsets in textscan.chunks(column):
                found = textscan.split_words(data, offsets, textscan.BLANK_SEPARATED)
                hashes = textscan.span_hashes(data, found.start, found.end)
                inside = np.concatenate(([0], np.cumsum(textscan.BLANK_SEPARATED[data] & ((data & 0xC0) != 0x80))))
                symbols = np.concatenate(([0], np.cumsum(_IS_SYMBOL[data])))
                for i in range(last - row):
                    a, b = int(found.first[i]), int(found.first[i + 1])
                    low, high = int(offsets[i]), int(offsets[i + 1])
                    left, words, doubles = judge_lines(data[low:high].tobytes().decode("utf-8"))
                    again = repeated_words(hashes[a:b])
                    failed = b - a < LEAST_WORDS or 100 * again > MOST_REPEATED * (b - a)
                    kept = not failed and (b - a) - words <= most_lost * (b - a)
                    made = (b - a, int(inside[high] - inside[low]), int(symbols[high] - symbols[low]), doubles, again, failed, kept)
                    rows.append((*made, left if column[row + i].is_valid else None) if clean else made)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()] * (len(fields) - 7)
            columns = list(zip(*rows)) if rows else [()] * len(fields)
            return [pa.array(values, kind) for values, kind in zip(columns, kinds)]

        return compute

    return append(docs, text, fields, start)
