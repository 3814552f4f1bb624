"""Text columns on rows that the given tables lack."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tierlabel.functions import text as X


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.coalesce(1).orderBy("i").select(make(F.col("t"))).collect()]


def test_cleanse(spark):
    texts = ["ab12cd 3", "a-b_c/d\\e|f", "x\t\ty!", "  Café (No. 5)  ", "مرحبا ١٢", "", None]
    want = ["abcd", "a b c d e f", "x y", "café no", "مرحبا ١٢", "", None]
    assert column(spark, texts, X.cleanse) == want


def test_unicode_clean(spark):
    texts = ["½", "ＡＢ", "a​b", "a\tb\nc", "  x　", None]
    assert column(spark, texts, X.unicode_clean) == ["1⁄2", "AB", "ab", "abc", "x", None]


def test_confidence_level(spark):
    rates = [0.0, 1 / 3, 0.5, 0.5001, 0.75, 2 / 3, 1.0, 1.2, -0.1, None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rates)], "i int, r double")
    got = [r[0] for r in df.orderBy("i").select(X.confidence_level(F.col("r"))).collect()]
    assert got == ["Low", "Low", "Low", "Medium", "Medium", "Medium", "High", None, None, None]


def tokens_of(text, analyzer, lo, hi):
    text = text.lower()
    if analyzer == "word":
        words = re.findall(r"(?u)\b\w+\b", text)
        return sorted(" ".join(words[i : i + n]) for n in range(lo, hi + 1) for i in range(len(words) - n + 1))
    text = re.sub(r"\s\s+", " ", text)
    if analyzer == "char":
        return sorted(text[i : i + n] for n in range(lo, hi + 1) for i in range(len(text) - n + 1))
    grams = []
    for word in text.split():
        word = f" {word} "
        for n in range(lo, hi + 1):
            grams += [word[i : i + n] for i in range(max(1, len(word) - n + 1))]
            if len(word) <= n:
                break
    return sorted(grams)


TEXTS = ["Brand#2  small ring", "a", "", "  x yz\tabcd\nq ", "Été \U0001f600\U0001f600a b_c 12", "a-b a-b", "one two three four"]


@pytest.mark.parametrize("analyzer", ["word", "char", "char_wb"])
@pytest.mark.parametrize("span", [(1, 1), (1, 2), (2, 2), (3, 3), (2, 4), (4, 5), (5, 6)])
def test_tokens(spark, analyzer, span):
    got = column(spark, TEXTS, lambda c: X.tokens(c, analyzer, span))
    assert [sorted(g) for g in got] == [tokens_of(t, analyzer, *span) for t in TEXTS]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abcd éß\U0001f600_-1.,", max_size=12), min_size=1, max_size=20))
def test_tokens_of_any_text(spark, texts):
    for analyzer in ("word", "char", "char_wb"):
        got = column(spark, texts, lambda c: X.tokens(c, analyzer, (1, 3)))
        assert [sorted(g) for g in got] == [tokens_of(t, analyzer, 1, 3) for t in texts]


def test_stop_words_and_accents(spark):
    got = column(spark, ["The café of the town", None], lambda c: X.tokens(c, ngram_range=(1, 2), strip_accents=True, stop_words=["the", "of"]))
    assert got == [["cafe", "town", "cafe town"], None]


def test_wrong_options():
    with pytest.raises(ValueError):
        X.tokens(None, ngram_range=(2, 1))


def test_normal_forms_are_made_in_slices(monkeypatch):
    import pyarrow as pa

    from tierlabel.functions import text

    monkeypatch.setattr(text, "TEXT_SLICE", 5, raising=False)
    seen = []
    given = pa.array(["abc", "de", None, "a long one", "", "f"])
    assert text._in_slices(given, lambda part: seen.append(part.to_pylist()) or part).equals(given)
    assert seen == [["abc", "de", None], ["a long one"], ["", "f"]]
    assert text._in_slices(given[:0], lambda part: part).to_pylist() == []
