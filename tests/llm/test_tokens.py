import random

import pytest
import tokenizers

from llm_helpers import some_text
from tierlabel.llm.tokens import Counter, sentencepiece_vocabulary, token_counts
from tierlabel.llm.tokens_queries import VOCABULARY


def library(pieces, byte_fallback):
    t = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", max([s for _, s in pieces], default=0.0)), *pieces], 0, byte_fallback))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(prepend_scheme="always")
    return t


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece_vocabulary(VOCABULARY)


def test_real_vocabulary_equals_the_library(spark, documents, vocabulary):
    r = random.Random(3)
    bits = ["<s>", "<0x0A>", " ", "  ", "\n", "é", "世", "😀", "the", "▁", "x́", "\U0001f9ff", "\x00", "\U000f0000", "\U000f0001", "ing"]
    texts = ["".join(r.choices(bits, k=r.randrange(14))) for _ in range(300)] + [some_text(r, 200), None, "", " ", "a" * 50_000]
    want = library(vocabulary, True)
    out = {x["doc_id"]: x for x in token_counts(documents(list(enumerate(texts))), vocabulary).collect()}
    for i, t in enumerate(texts):
        assert (out[i]["n_chars"], out[i]["n_tokens"]) == (len(t or ""), len(want.encode(t or "").ids))


def test_ties_equal_the_library():
    r = random.Random(4)
    for trial in range(40):
        pieces = {"".join(r.choices("ab▁c", k=r.randint(1, 3))): float(r.choice([-1, -2, -3])) for _ in range(12)}
        counter, want = Counter(list(pieces.items()), remembered=5), library(list(pieces.items()), False)
        for _ in range(60):
            text = "".join(r.choices("abc dé", k=r.randrange(15)))
            assert counter.count(text) == len(want.encode(text).ids)


def test_empty_vocabulary_and_table(documents, vocabulary):
    assert Counter([]).count("ab cd") == 2
    assert token_counts(documents([]), vocabulary).collect() == []
    with pytest.raises(ValueError):
        token_counts(documents([]), vocabulary, max_pieces=10)
