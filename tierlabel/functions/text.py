"""Text columns: cleansing, Unicode cleaning, tokens and n-grams, product documents, confidence levels."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What cleansing deletes, and what it turns into one space. Punctuation is ASCII punctuation and
# includes the joiners - _ / \ |.
DIGIT_RUNS = r"[0-9]+"
SEPARATOR_RUNS = r"[\p{Punct}\s]+"
ANY_SPACES = r"(?U)\s+"

# A word token is one or more letters, digits or underscores (one is enough).
WORD = r"([\p{L}\p{N}_]+)"

# Upper bounds, in percent, of the confidence levels.
LOW_UP_TO, MEDIUM_UP_TO, HIGH_UP_TO = 50, 75, 100


TEXT_SLICE = 1 << 20  # bytes of text worked on at once


def cleanse(text: Column) -> Column:
    """Drop digits, turn runs of punctuation and white space into one space, trim, lower-case."""
    without_digits = F.regexp_replace(text, DIGIT_RUNS, "")
    return F.lower(F.trim(F.regexp_replace(without_digits, SEPARATOR_RUNS, " ")))


def _in_slices(text: pa.Array, form: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """A form of the texts, made for about ``TEXT_SLICE`` bytes at a time, at least one text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    parts, at = [], 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TEXT_SLICE, side="right")))
        parts.append(form(text.slice(at, to - at)))
        at = to
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    # pyarrow's NFKC leaves characters decomposed
    return _in_slices(text, lambda part: pa.array([t and unicodedata.normalize("NFKC", t) for t in part.to_pylist()], pa.string()))


@F.arrow_udf(T.StringType())
def _nfkd(text: pa.Array) -> pa.Array:
    return _in_slices(text, lambda part: pc.utf8_normalize(part.cast(pa.string()), form="NFKD"))


@cache
def _marks() -> str:
    """A pattern of all characters with a combining class, as ranges."""
    found = [c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    starts = [c for c, before in zip(found, [-1, *found]) if c != before + 1]
    ends = [c for c, after in zip(found, [*found[1:], -1]) if c + 1 != after]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends)) + "]+"


def _without_marks(text: Column) -> Column:
    return F.regexp_replace(_nfkd(text), _marks(), "")


def unicode_clean(text: Column) -> Column:
    """NFKC form without any control, format, surrogate or unassigned character, stripped at both ends."""
    visible = F.regexp_replace(_nfkc(text), r"\p{C}", "")
    return F.regexp_replace(visible, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def product_document(*parts: Column | str) -> Column:
    """The parts joined by one space; null as soon as one part is null."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    spaced = [cols[0]]
    for c in cols[1:]:
        spaced += [F.lit(" "), c]
    return F.concat(*spaced)


def confidence_level(rate: Column) -> Column:
    """Low, Medium or High for a rate in [0, 1]; null outside of it."""
    percent = rate * F.lit(100.0)
    return (
        F.when((percent >= 0) & (percent <= LOW_UP_TO), "Low")
        .when((percent > LOW_UP_TO) & (percent <= MEDIUM_UP_TO), "Medium")
        .when((percent > MEDIUM_UP_TO) & (percent <= HIGH_UP_TO), "High")
    )


def char_ngrams(text: Column, n: int, avoid: str = "") -> Column:
    """All overlapping substrings of ``n`` code points, except those that contain ``avoid``.

    One regular expression whose look-ahead matches at every position, so the text is evaluated once and
    the expression holds no lambda. A match must not start inside a surrogate pair.
    """
    unit = f"(?:(?!{avoid}).){{{n - 1}}}." if avoid and n > 1 else f".{{{n}}}"
    pattern = r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(" + unit + "))"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _word_ngrams(words: Column, lo: int, hi: int) -> Column:
    grams = [words] if lo == 1 else []
    joined = F.array_join(words, " ")
    for n in range(max(lo, 2), hi + 1):
        # from each start of a word on, n words
        pattern = r"(?<![^ ])(?=([^ ]+(?: [^ ]+){" + str(n - 1) + "}))"
        grams.append(F.regexp_extract_all(joined, F.lit(pattern), F.lit(1)))
    return grams[0] if len(grams) == 1 else F.concat(*grams)


def _char_ngrams(text: Column, lo: int, hi: int, avoid: str = "") -> Column:
    grams = [char_ngrams(text, n, avoid) for n in range(lo, hi + 1)]
    return grams[0] if len(grams) == 1 else F.concat(*grams)


def _padded_ngrams(text: Column, lo: int, hi: int) -> Column:
    """n-grams within each word, the word padded by one space at each side.

    The padded words are joined, so that only an n-gram across two words holds two spaces in a row. A padded
    word shorter than the smallest n counts once as it is.
    """
    single = F.trim(F.regexp_replace(text, ANY_SPACES, " "))
    spaced = F.regexp_replace(F.regexp_replace(single, " ", "  "), r"(?s)^(.+)$", " $1 ")
    grams = _char_ngrams(spaced, lo, hi, avoid="  ")
    if lo <= 3:  # a padded word has at least three characters
        return grams
    words = F.filter(F.split(single, " "), lambda w: (w != "") & (F.char_length(w) + 2 < lo))
    return F.concat(F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), grams)


def tokens(
    text: Column,
    analyzer: str = "word",
    ngram_range: tuple[int, int] = (1, 1),
    lowercase: bool = True,
    strip_accents: bool = False,
    stop_words: Iterable[str] = (),
) -> Column:
    """The array of tokens of a text: word n-grams, character n-grams, or character n-grams within words.

    Stop words are removed before word n-grams are built and have no effect on character n-grams.
    A null text gives null, so it adds no row when exploded.
    """
    lo, hi = ngram_range
    if not 1 <= lo <= hi:
        raise ValueError("ngram_range must be (a, b) with 1 <= a <= b")
    if lowercase:
        text = F.lower(text)
    if strip_accents:
        text = _without_marks(text)
    if analyzer == "word":
        words = F.regexp_extract_all(text, F.lit(WORD), 1)
        stop = list(stop_words)
        if stop:
            words = F.filter(words, lambda w: ~w.isin(stop))
        return _word_ngrams(words, lo, hi)
    squeezed = F.regexp_replace(text, r"(?U)\s\s+", " ")
    if analyzer == "char":
        return _char_ngrams(squeezed, lo, hi)
    if analyzer == "char_wb":
        return _padded_ngrams(squeezed, lo, hi)
    raise ValueError("analyzer must be 'word', 'char' or 'char_wb'")
