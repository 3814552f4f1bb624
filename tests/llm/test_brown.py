import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import LOWER, WORD
from tierlabel.llm.brown import BrownSettings, exchange, score_documents

SMALL = BrownSettings(classes=4, class_words=20, head_words=60, sample_rows=50)


def language(r, name, n):
    """Texts of two languages with alternating kinds of words."""
    kinds = [[f"{name}{k}{i}" for i in range(12)] for k in "ab"]
    return " ".join(r.choice(kinds[i % 2]) if r.random() > 0.1 else f"rare{r.randrange(300)}" for i in range(n))


def held_out():
    return F.col("doc_id") % 5 == 2


def test_base_scores_equal_brute_force(documents):
    r = random.Random(6)
    rows = [(i, language(r, "xy"[i % 2], r.randrange(50)).title()) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, "only here and NEVER trained"), (1005, "é É \x1c"), (7, rows[7][1]), (None, "null id")]
    tokens = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t in rows]
    train = [t for (i, _), t in zip(rows, tokens) if i is None or i % 5 != 2]
    counts = collections.Counter(itertools.chain(*train))
    n, v = sum(counts.values()), len(counts)
    out = score_documents(documents(rows).repartition(5), held_out(), SMALL).collect()
    assert len(out) == len(rows)
    by_id = {}
    for x in out:
        by_id.setdefault(x["doc_id"], x)
    for (i, _), own in zip(rows, tokens):
        x = by_id[i]
        assert (x["held_out"], x["n_tokens"], x["train_tokens"]) == (i is not None and i % 5 == 2, len(own), n)
        assert x["n_known"] == sum(counts[w] > 0 for w in own)
        assert x["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert x["score"] < 0
    held = [x for x in out if x["held_out"]]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held)


def test_no_training_documents_and_no_documents(documents):
    out = score_documents(documents([(2, "a b"), (7, None)]), F.lit(True), SMALL).collect()
    assert all(x["train_tokens"] == 0 and x["n_known"] == 0 and math.isfinite(x["score"]) and x["base_score"] == 0 for x in out)
    assert score_documents(documents([]), held_out(), SMALL).collect() == []


def test_model_is_a_distribution(documents):
    """Over the next token, after any first word: known words, one unknown word, and the end sum to one."""
    r = random.Random(9)
    texts = [language(r, "xy"[i % 2], 12) for i in range(40)]
    known = sorted({w for t in texts for w in t.split()})
    rows = [(10 * i, t) for i, t in enumerate(texts)]
    first = known[0]
    rows += [(2 + 5 * i, f"{first} {w}") for i, w in enumerate([*known, "unknown"])] + [(100_002, first)]
    # each text also pays for its end; what matters is the part of the second token, so ends are taken out
    out = {x["doc_id"]: x["score"] for x in score_documents(documents(rows), held_out(), SMALL).collect()}
    assert all(math.isfinite(s) for s in out.values())
    assert 10 ** out[100_002] + sum(10 ** out[2 + 5 * i] for i in range(len(known) + 1)) <= 1


def likelihood(bigrams, own, total):
    member = np.eye(total)[own]
    grid = member.T @ bigrams @ member

    def h(x):
        return (x * np.log(np.maximum(x, 1))).sum()

    return h(grid) - h(grid.sum(axis=0)) - h(grid.sum(axis=1))


def test_exchange_reaches_a_local_optimum():
    rng = np.random.default_rng(1)
    n, classes = 12, 3
    bigrams = rng.poisson(3, (n + 2, n + 2)).astype(float)
    own = exchange(bigrams, n, classes, 50)
    best = likelihood(bigrams, own, classes + 2)
    for w in range(n):
        for c in range(classes):
            moved = own.copy()
            moved[w] = c
            assert likelihood(bigrams, moved, classes + 2) <= best + 1e-6
    assert own[n:].tolist() == [classes, classes + 1]


def brute_scores(rows, core_words, classes, passes, min_count, smoothing):
    """Scores by dictionaries and whole likelihoods; only the exchange itself is the library's."""
    texts = {i: (t or "").translate(LOWER) for i, t in rows}
    tokens = {i: WORD.findall(t) for i, t in texts.items()}
    train = [w for i, w in tokens.items() if i % 5 != 2]
    counts = collections.Counter(itertools.chain(*train))
    core = [w for w, _ in sorted(counts.items(), key=lambda x: -x[1])][:core_words]
    total, end = classes + 2, classes + 1
    number = {w: k for k, w in enumerate(core)}

    def pairs(kind_of, closing):
        for text in train:
            kinds = [closing, *map(kind_of, text), closing]
            yield from zip(kinds, kinds[1:])

    table = np.zeros((core_words + 2, core_words + 2))
    for a, b in pairs(lambda w: number.get(w, core_words), core_words + 1):
        table[a, b] += 1
    own = exchange(table, core_words, classes, passes)
    first = {w: int(own[k]) for w, k in number.items()}
    grid = np.zeros((total, total))
    for a, b in pairs(lambda w: first.get(w, classes), end):
        grid[a, b] += 1

    def gain(w, k):
        moved = grid.copy()
        for text in train:
            kinds = [end, *(first.get(x, classes) for x in text), end]
            for at, x in enumerate(text):
                if x == w:
                    moved[kinds[at], k] += 1
                    moved[k, kinds[at + 2]] += 1
        return round(likelihood(moved, np.arange(total), total), 6)

    final = dict(first)
    for w in counts.keys() - first.keys():
        gains = [gain(w, k) for k in range(classes)]
        final[w] = gains.index(max(gains)) if counts[w] >= min_count else classes
    last = np.zeros((total, total))
    for a, b in pairs(lambda w: final.get(w, classes), end):
        last[a, b] += 1
    transitions = np.log10((last + smoothing) / (last.sum(axis=1, keepdims=True) + smoothing * total))
    size, rare = collections.Counter(), [w for w in counts if final[w] == classes]
    for w, n in counts.items():
        size[final[w]] += n

    def score(text):
        kinds = [end, *(final.get(w, classes) for w in text), end]
        value = sum(transitions[a, b] for a, b in zip(kinds, kinds[1:]))
        for w in text:
            k = final.get(w, classes)
            value += math.log10((counts[w] + 1) / (size[classes] + len(rare) + 1) if k == classes else counts[w] / size[k])
        return value

    return {i: (score(t), sum(final.get(w, classes) != classes for w in t) + 1) for i, t in tokens.items()}


@pytest.mark.parametrize("head_words,parts", [(60, 5), (4, 2)])
def test_scores_equal_brute_force(documents, head_words, parts):
    """With a head list that holds all core words, and with one so small that most of them come from the other words."""
    r = random.Random(12)
    rows = [(i, language(r, "xy"[i % 2], r.randrange(40)).title()) for i in range(150)]
    rows += [(200 + i, " ".join([f"core{i}"] * 3 + ["yb1", f"core{(i + 1) % 9}"]) + " ") for i in range(9)]
    rows += [(300 + 5 * i, f"core{i} " * (200 + 10 * i)) for i in range(9)]  # their counts differ, so no tie decides
    rows += [(1002, None), (1007, ""), (1012, "never seen Xa1 core3 xa1"), (2000, "long " + "xb2 ya3 " * 20_000)]
    settings = BrownSettings(classes=3, class_words=6, head_words=head_words, sample_rows=5000, min_count=3, block_tokens=head_words)
    want = brute_scores(rows, 6, 3, settings.passes, 3, settings.smoothing)
    out = {x["doc_id"]: x for x in score_documents(documents(rows).repartition(parts), held_out(), settings).collect()}
    assert out.keys() == want.keys()
    for i, (score, classed) in want.items():
        assert out[i]["n_classed"] == classed
        assert out[i]["score"] == pytest.approx(score, rel=1e-9)


def test_words_with_a_class_grow_with_the_corpus(documents):
    def classed(texts):
        r = random.Random(2)
        rows = [(10 * i, " ".join(f"w{r.randrange(texts)}" for _ in range(20))) for i in range(texts)]
        out = score_documents(documents(rows), held_out(), SMALL).collect()
        return sum(x["n_classed"] for x in out) / sum(x["n_tokens"] for x in out)

    assert classed(100) > 0.95 and classed(1000) > 0.95
