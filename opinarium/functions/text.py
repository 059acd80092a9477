"""Text expressions. Everything stays in the JVM except Unicode composition,
which Spark lacks and which only texts holding composable characters reach."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the word-frequency report and of its second chart.
REPORT_STOP_WORDS = tuple(
    """
    o a os as um uma uns umas de do da dos das em no na nos nas por para com como que se e é
    ao aos me mim comigo te ti contigo ele ela eles elas não sim mais menos muito pouco já tudo nada
    este esta estes estas isto esse essa esses essas isso aquele aquela aqueles aquelas aquilo
    meu minha meus minhas seu sua seus suas foi foram ser ter bem mas também está
    """.split()
)
FUNNEL_STOP_WORDS = REPORT_STOP_WORDS + ("vou", "veio", "pra")

# Letters kept by the normaliser and letters of a report word.
NORMAL_LETTERS = "a-záàâãéèêíïóôõöúüçñ"
REPORT_LETTERS = "a-záâãéêíóôõúç"

# Java's Unicode white space lacks the four separators U+001C..U+001F.
_SPACE = r"\s\x1c-\x1f"
_WORD = r"\p{L}\p{N}_"
_TAG = r"<[^>]++>"
_URL = rf"(?U)https?://[^{_SPACE}]+|www\.[^{_SPACE}]+"


# Characters that NFC may change, alone or with what precedes them, all lie
# outside these blocks: up to U+02FF, common punctuation, pictographs.
_COMPOSABLE = r"[^\x{0}-\x{2FF}\x{2010}-\x{2027}\x{1F300}-\x{1FAFF}]"


def _compose(raw: Column, text: Column) -> Column:
    """NFC of ``text``; rows whose ``raw`` text cannot change skip the worker."""

    @F.pandas_udf("string")
    def nfc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")

    return F.coalesce(nfc(F.when(raw.rlike(_COMPOSABLE), text)), text)


def _strip_markup(text: Column) -> Column:
    text = F.regexp_replace(text, _TAG, " ")
    return F.regexp_replace(text, _URL, " ")


def _collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"(?U)[{_SPACE}]+", " "))


def normalize_text(raw: Column) -> Column:
    """Lowercase, drop tags and links, compose, keep letters and digits, collapse."""
    raw = F.coalesce(raw, F.lit(""))
    text = _compose(raw, _strip_markup(F.lower(raw)))
    return _collapse(F.regexp_replace(text, rf"(?U)[^{NORMAL_LETTERS}0-9{_SPACE}]", " "))


def normalize_light(raw: Column) -> Column:
    """Drop tags and links, compose and collapse; case and signs stay."""
    raw = F.coalesce(raw, F.lit(""))
    return _collapse(_compose(raw, _strip_markup(raw)))


def clean_field(raw: Column) -> Column:
    """Null becomes blank and outer white space goes."""
    text = F.coalesce(raw, F.lit(""))
    return F.regexp_replace(text, rf"(?U)^[{_SPACE}]+|[{_SPACE}]+$", "")


def join_title_body(title: Column, body: Column) -> Column:
    return clean_field(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))


def text_input(title: Column, body: Column, light: bool = False) -> Column:
    """One normalised text per review out of its title and body."""
    joined = join_title_body(title, body)
    return normalize_light(joined) if light else normalize_text(joined)


def report_words(text: Column, stop_words: Sequence[str] = REPORT_STOP_WORDS) -> Column:
    """Whole words over the report's letters, longer than two, no stop words.

    A word holding any other letter vanishes whole, as no boundary falls inside.
    """
    found = F.regexp_extract_all(
        F.lower(text), F.lit(rf"(?<![{_WORD}])([{REPORT_LETTERS}]{{3,}}+)(?![{_WORD}])"), F.lit(1)
    )
    return F.filter(found, lambda word: ~word.isin(*stop_words))


def analyzer_tokens(text: Column) -> Column:
    """Lowercased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"([{_WORD}]{{2,}}+)"), F.lit(1))


def alphabetic_tokens(text: Column) -> Column:
    """Runs of word characters made of letters only, in text order."""
    runs = F.regexp_extract_all(text, F.lit(rf"([{_WORD}]++)"), F.lit(1))
    return F.filter(runs, lambda token: token.rlike(r"^\p{L}+$"))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` refers to
    it from inside a lambda, which would evaluate it per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams of ``low``..``high`` tokens, joined by a blank."""
    if not 1 <= low <= high:
        raise ValueError(f"n-gram range must satisfy 1 <= low <= high, got ({low}, {high})")

    def build(words: Column) -> Column:
        grams, parts = words, [words] if low == 1 else []
        for n in range(2, high + 1):
            width = F.greatest(F.size(words) - F.lit(n - 1), F.lit(0))
            grams = F.zip_with(
                F.slice(grams, F.lit(1), width),
                F.slice(words, F.lit(n), width),
                lambda head, tail: F.concat_ws(" ", head, tail),
            )
            if n >= low:
                parts.append(grams)
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return tokens if high == 1 else _bind(tokens, build)


# The named analyser modes.
NGRAM_MODES = {"unigrams": (1, 1), "bigrams": (2, 2), "both": (1, 2)}


def term_frequencies(terms: Column) -> Column:
    """Array of ``(term, tf)`` counted inside the row, so no shuffle is needed.

    The terms are sorted once; each run of equal terms is one entry.
    """

    def runs(ordered: Column) -> Column:
        size = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(0), size),
            lambda i: (i < size) & ((i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))),
        )
        return _bind(starts, lambda at: entries(ordered, at))

    def entries(ordered: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda start, j: F.struct(
                F.get(ordered, start).alias("term"),
                (F.coalesce(F.get(starts, j + 1), F.size(ordered)) - start).cast("long").alias("tf"),
            ),
        )

    return _bind(F.sort_array(terms), runs)
