import random

import numpy as np
import pytest

from llm_helpers import LOWER, WORD, some_text
from tierlabel.llm.components import components
from tierlabel.llm.minhash import NearSettings, drop_near_duplicates, fewest_matches, near_duplicates


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows, percent=85):
    """(id) -> (n_shingles of its rows, smallest id reachable)."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for at, (i, a) in enumerate(sets):
        for j, b in sets[at + 1 :]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((repr(i), len(s), repr(None if i is None else find(i))) for i, s in sets)


def got(frame):
    return sorted((repr(x["doc_id"]), x["n_shingles"], repr(x["component_id"])) for x in frame.collect())


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("small", [1, 4])
def test_components_equal_brute_force(documents, small):
    r = random.Random(small)
    rows = []
    for base in range(4):  # clouds of near copies, most of them just not linked
        words = some_text(r, 150, 10**6).split()
        rows += [edited(r, words, r.randrange(7)) for _ in range(45)]
    boiler = some_text(r, 60, 10**6)
    rows += [f"{boiler} {some_text(r, r.randrange(4, 90), 10**6)}" for _ in range(60)]
    rows += ["Same TEXT again here now"] * 9 + ["same text AGAIN here\nnow"] * 3 + ["a b", "A  b", "a", None, "", "\x1c", "é É"]
    r.shuffle(rows)
    rows = list(enumerate(rows)) + [(None, rows[0]), (5, rows[6]), (5, rows[6])]
    assert got(near_duplicates(documents(rows).repartition(6), NearSettings(small=small))) == brute(rows)


def test_chains_across_the_threshold(documents):
    """Each text shares 85 % with the next one only; all are one component."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 60])) for i in range(40)]
    out = near_duplicates(documents(rows)).collect()
    assert {x["component_id"] for x in out} == {0}
    assert [x["doc_id"] for x in out if x["kept"]] == [0]


def test_empty_and_unlinked(documents):
    assert near_duplicates(documents([])).collect() == []
    rows = [(2, "one two three four five six"), (7, "seven eight nine ten eleven"), (9, None)]
    assert got(near_duplicates(documents(rows))) == brute(rows)
    docs = documents([(4, "same words in both of these"), (3, "same words in both of these"), (8, "")])
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == [3, 8]


def test_pruning_bound_follows_the_posterior():
    """The posterior that a uniform prior gives, by numerical integration."""
    settings = NearSettings()
    s = np.linspace(0, 1, 200_001)
    for n, m in zip(range(settings.bands, settings.hashes + 1, settings.bands), fewest_matches(settings)):
        for matches, pruned in ((m - 1, True), (m, False)):
            density = np.exp(matches * np.log(np.maximum(s, 1e-300)) + (n - matches) * np.log(np.maximum(1 - s, 1e-300)))
            above = density[s >= settings.percent / 100].sum() / density.sum()
            assert (above < settings.prune) == pruned


def test_connected_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, 8), (8, 9), (None, 3)]
    r.shuffle(links)
    out = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 560)}, 8: 8, 9: 8}
    assert out == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_row_of_each_group_stays_without_usable_ids(spark, documents):
    same, other = "a b c d e f g h", "one two three four five six seven"
    docs = documents([(1, same), (1, same), (2, same), (None, same), (None, same), (3, other), (None, ""), (None, None), (4, "")])
    left = drop_near_duplicates(docs).collect()
    assert sorted(repr(r.text) for r in left) == sorted(map(repr, [same, other, "", None, ""]))
    assert left[0].asDict().keys() == docs.first().asDict().keys()
    unique = documents([(5, same), (3, same), (9, other)])
    assert sorted(r.doc_id for r in drop_near_duplicates(unique).collect()) == [3, 9]
