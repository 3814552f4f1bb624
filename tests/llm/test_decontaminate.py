import random

import numpy as np
import pytest

from llm_helpers import some_text
from tierlabel.llm.decontaminate import LeakSettings, common_words, drop_leaking, find_leaks, searchers

ITEMS = "item_id long, text string, answer string"


@pytest.fixture(scope="module")
def planted(spark, documents):
    r = random.Random(8)
    items = [(i, ". ".join(some_text(r, r.randrange(6, 14), 50_000) for _ in range(r.randrange(2, 9))), None) for i in range(30)]
    items += [(100, None, None), (101, "", None), (102, "too short to search", None), (103, some_text(r, 300, 50_000), None)]
    rows, want = [], set()
    for i in range(240):
        text = some_text(r, r.randrange(0, 300), 3000).split()
        if i % 4 == 0:
            item, copy, _ = items[(i // 4) % 30]
            words = copy.upper().replace(".", " ;").split() if i % 8 else copy.split()
            if i % 12 == 0:  # a paraphrase: one word of ten is another one
                words = [f"q{r.randrange(10**6)}" if k % 10 == 4 else w for k, w in enumerate(words)]
            at = r.randrange(len(text) + 1)
            text[at:at] = words
            want.add((i, item))
        rows.append((i, " ".join(text)))
    long_item = items[-1][1].split()
    rows += [(900, " ".join(long_item[100:200])), (901, None), (902, ""), (903, items[0][1]), (903, items[0][1])]
    want |= {(900, 103), (903, 0)}
    return documents(rows), spark.createDataFrame(items, ITEMS), want


@pytest.mark.parametrize("block_items", [5000, 9])
def test_finds_copies_and_paraphrases_and_nothing_else(planted, block_items):
    docs, items, want = planted
    out = find_leaks(docs, items, LeakSettings(block_items=block_items)).collect()
    assert {(x["doc_id"], x["item_id"]) for x in out} == want
    assert all(x["coverage"] >= 0.6 for x in out)


def test_clean_documents_stay(planted):
    docs, items, want = planted
    kept = drop_leaking(docs, items)
    assert kept.columns == docs.columns
    gone = {d for d, _ in want}
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(x["doc_id"] for x in docs.collect() if x["doc_id"] not in gone)


def test_answers(spark, documents):
    r = random.Random(3)
    words = some_text(r, 30, 10**6).split()
    changed = [w if i % 3 else f"x{i}" for i, w in enumerate(words)]  # two thirds are left
    docs = documents([(1, " ".join(changed) + " the answer is forty two"), (2, " ".join(changed) + " the answer is thirteen")])
    items = spark.createDataFrame([(1, " ".join(words), "the answer is forty two")], ITEMS)
    out = find_leaks(docs, items, answer_col="answer").collect()
    assert [(x["doc_id"], x["answer_found"]) for x in out] == [(1, True)]


def test_empty_sides(spark, documents):
    nothing = spark.createDataFrame([], ITEMS)
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine", None)], ITEMS)
    docs = documents([(1, "one two three")])
    assert find_leaks(docs, nothing).collect() == [] and find_leaks(documents([]), items).collect() == []
    assert drop_leaking(docs, nothing).count() == 1 and drop_leaking(documents([]), items).count() == 0


def test_common_subsequence():
    r = random.Random(2)
    for _ in range(200):
        a, b = [tuple(r.randrange(6) for _ in range(r.randrange(1, 20))) for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common_words(a, list(b)) == table[-1][-1]


def test_excerpts_across_stretches_of_long_items(spark, documents):
    r = random.Random(12)
    long_item = some_text(r, 300, 50_000).split()
    items = spark.createDataFrame([(1, " ".join(long_item), None), (2, some_text(r, 40, 50_000), None)], ITEMS)
    rows = []
    for i, (start, n) in enumerate([(13, 102), (77, 102), (30, 66), (100, 60), (7, 60), (199, 60), (240, 60)]):
        rows.append((i, f"{some_text(r, r.randrange(90), 3000)} {' '.join(long_item[start : start + n])} {some_text(r, 50, 3000)}"))
    rows += [(100 + i, some_text(r, 200, 3000)) for i in range(40)]
    docs = documents(rows)
    assert sorted(x["doc_id"] for x in find_leaks(docs, items).collect()) == list(range(7))
    assert sorted(x["doc_id"] for x in drop_leaking(docs, items).collect()) == list(range(100, 140))


@pytest.mark.parametrize("long_items", [0, 1])
def test_short_items_are_searched_by_exact_sequence(spark, documents, long_items):
    r = random.Random(13)
    items = [(1, "Who painted the yellow house?", None), (2, "Name: zyx", None), (3, "", None), (4, "...", None)]
    items += [(9, some_text(r, 20, 50_000), None)] * long_items
    rows = [(1, "they asked who painted; the Yellow house"), (2, "who painted the house yellow"), (3, "who painted"), (4, "the yellow house")]
    rows += [(5, "a name zyx name"), (6, "zyx name"), (7, None), (8, "who painted the yellow house " * 2), (9, "name"), (10, "zyx")]
    items = spark.createDataFrame(items, ITEMS)
    out = find_leaks(documents(rows).coalesce(1), items).collect()
    assert sorted((x["doc_id"], x["item_id"], x["coverage"], x["answer_found"]) for x in out) == [
        (1, 1, 1.0, True), (5, 2, 1.0, False), (8, 1, 1.0, True)
    ]
    assert sorted(x["doc_id"] for x in drop_leaking(documents(rows), items).collect()) == [2, 3, 4, 6, 7, 9, 10]


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_types_of_item_ids(spark, documents, kind):
    r = random.Random(3)
    items = [some_text(r, 40, 10**6) for _ in range(3)]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    benchmark = benchmark.withColumn("item_id", benchmark.item_id.cast(kind))
    docs = documents([(7, some_text(r, 50) + " " + items[1]), (8, some_text(r, 50))])
    found = find_leaks(docs, benchmark)
    assert found.schema["item_id"].dataType == benchmark.schema["item_id"].dataType
    assert [(x.doc_id, str(x.item_id)) for x in found.collect()] == [(7, "1")]


def test_the_latent_space_does_not_depend_on_a_sample(planted):
    """The same documents in other partitions and another order give the same space."""
    docs, items, _ = planted
    docs = docs.union(docs).union(docs)  # more than a sample once took
    first, other = (next(iter(searchers(d, items)))[1] for d in (docs.coalesce(1), docs.orderBy(docs.text.desc()).repartition(3)))
    assert (first.weights == other.weights).all() and np.allclose(first.basis, other.basis, atol=1e-5)


def test_recall_against_brute_force(spark, documents):
    """Of all document and item pairs whose words cover a passage, at least nine of ten are found (here: all)."""
    r = random.Random(31)
    items = [(i, some_text(r, r.randrange(12, 60), 3000), None) for i in range(40)]
    rows = []
    for i in range(300):
        text = some_text(r, r.randrange(20, 200), 3000).split()
        if i % 3:
            words = [w for w in items[r.randrange(40)][1].split() if r.random() > (0.0, 0.1, 0.18)[i % 3]]
            at = r.randrange(len(text) + 1)
            text[at:at] = words
        rows.append((i, " ".join(text)))
    want = set()
    for i, text in rows:
        own = text.split()
        for j, item, _ in items:
            passage = tuple(item.split())
            for at in range(0, max(1, len(own) - len(passage)) + 1, 2):
                if common_words(passage, own[at : at + len(passage)]) >= 0.8 * len(passage):
                    want.add((i, j))
                    break
    got = {(x["doc_id"], x["item_id"]) for x in find_leaks(documents(rows), spark.createDataFrame(items, ITEMS)).collect()}
    assert len(want) > 100 and len(got & want) >= 0.9 * len(want)
