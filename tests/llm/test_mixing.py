import random

import pytest
from pyspark.sql import functions as F

from tierlabel.llm.mixing import MixSettings, apply_plan, cycled_weights, mix, mixing_plan, sized
from tierlabel.llm.common import n_words

from llm_helpers import some_text


def taken(docs, share=1.5, settings=MixSettings(), cut_last=True):
    sizes = sized(docs, settings)
    plan = mixing_plan(sizes, cycled_weights(sizes), share, settings, cut_last)
    return apply_plan(docs, plan, n_words("text"), settings).collect()


def water(caps, weights, total):
    """By bisection of the level."""
    low, high = 0.0, max(c / w for c, w in zip(caps, weights))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, mid * w) for c, w in zip(caps, weights)) < total else (low, mid)
    return [min(c, high * w) for c, w in zip(caps, weights)]


def test_targets_and_taken_words(documents):
    r = random.Random(1)
    rows = [(i, some_text(r, r.randrange(1, 80)), f"s{min(r.randrange(12), 5)}") for i in range(400)]
    out = taken(documents(rows))
    sizes = {}
    for x in out:
        sizes[x["source"]] = sizes.get(x["source"], 0) + x["mix_size"]
    names = sorted(sizes)
    want = water([2 * sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()))
    for s, t in zip(names, want):
        own = [x for x in out if x["source"] == s]
        assert own[0]["mix_target"] == pytest.approx(t)
        assert abs(sum(x["mix_taken"] for x in own) - t) <= 1
        assert all(x["mix_taken"] <= 2 * x["mix_size"] for x in own)
    again = taken(documents(rows[::-1]).repartition(7))
    assert {(x["doc_id"], x["mix_taken"]) for x in out} == {(x["doc_id"], x["mix_taken"]) for x in again}


def test_edge_rows(documents):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (3, "one two", None), (None, "x", "b"), (4, "y " * 50, "é"), (5, "\x85", "z")]
    out = taken(documents(rows))
    assert len(out) == len(rows)
    assert all(x["mix_taken"] == 0 for x in out if x["doc_id"] in (1, 2))
    assert {x["mix_taken"] for x in out if x["doc_id"] == 3} != {None}
    assert taken(documents([])) == []
    assert all(x["mix_taken"] == 0 for x in taken(documents([(1, None, "a"), (2, "", None)])))


def test_all_capped_and_unweighted(spark, documents):
    docs = documents([(i, "a b c", "s" if i % 2 else "t") for i in range(10)])
    sizes = sized(docs)
    weights = spark.createDataFrame([("s", 1.0)], "source string, weight double")
    plan = mixing_plan(sizes, weights, 9.0)
    out = apply_plan(docs, plan, n_words("text")).collect()
    assert {x["mix_taken"] for x in out if x["source"] == "s"} == {6}
    assert {x["mix_taken"] for x in out if x["source"] == "t"} == {0}


def test_mixed_documents_are_whole(documents):
    r = random.Random(2)
    rows = [(i, some_text(r, r.randrange(5, 40)), f"s{i % 4}") for i in range(200)]
    docs = documents(rows)
    out = mix(docs)
    assert out.columns == docs.columns
    texts = dict(row[:2] for row in rows)
    got = out.collect()
    assert all(texts[x["doc_id"]] == x["text"] for x in got)
    words = sum(len(t.split()) for t in texts.values())
    total = sum(len(x["text"].split()) for x in got)
    assert abs(total - 1.5 * words) <= 4 * 20
    assert max(r["count"] for r in out.groupBy("doc_id").count().collect()) <= 2


def test_hot_source(spark, documents):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("source")
    )
    out = taken(rows)
    # "cold" weighs 3 and stops at its cap; "hot" takes the rest
    assert sum(x["mix_taken"] for x in out if x["source"] == "hot") == 18000 - 8000
