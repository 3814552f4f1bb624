"""The pipeline against a brute-force version of its stages, on a small planted corpus."""

import random

import pytest

import corpus_pipeline
from llm_helpers import some_text
from test_minhash import edited
from test_quality import brute as base_counts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    r = random.Random(12)
    items = [(i, some_text(r, 30, 10**6)) for i in range(5)]
    rows = []
    for i in range(150):
        words = some_text(r, r.randrange(60, 160), 5000).split()
        if i % 10 == 3:
            words[20:20] = items[i % 5][1].split()
        rows.append((i, " ".join(words), f"s{i % 3}"))
        if i % 10 == 5:
            rows.append((1000 + i, edited(r, words, 1), "s0"))
        if i % 10 == 6:
            rows.append((2000 + i, " ".join(words), "s1"))
    rows += [(5000, None, "s0"), (5001, "too short", "s1"), (5002, "### %%% " * 40 + some_text(r, 40), None)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    documents(rows).select(*COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_stages(spark, folder, tmp_path):
    path, rows = folder
    texts = {i: t for i, t, _ in rows}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
        if name != "sharding":
            assert docs.columns == COLUMNS
            assert all(texts[x["doc_id"]] == x["text"] for x in kept[-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing_sources", "sharding"]

    def ids(k):
        return [x["doc_id"] for x in kept[k]]

    failed = {i for i, t, _ in rows if base_counts(t)[0] < 10 or 100 * base_counts(t)[4] > 20 * base_counts(t)[0]} | {5002}
    assert sorted(ids(0)) == sorted(set(texts) - failed)
    assert sorted(ids(1)) == [i for i in range(150)]
    assert sorted(ids(2)) == [i for i in range(150) if i % 10 != 3]
    assert set(ids(3)) <= set(ids(2)) and max(map(ids(3).count, ids(3))) <= 2
    words = {i: len(t.split()) for i, t, _ in rows if t}
    share = sum(words[i] for i in ids(3)) / sum(words[i] for i in ids(2))
    assert 1.4 < share < 1.6
    assert sorted(ids(4)) == sorted(ids(3))
    assert {x["shard"] for x in kept[4]} == set(range(8))


def test_run_is_the_stages(spark, folder):
    path, _ = folder
    a = sorted(map(tuple, corpus_pipeline.run(spark, path).collect()), key=repr)
    b = sorted(map(tuple, corpus_pipeline.run(spark, path).collect()), key=repr)
    assert a == b and a


def test_no_documents(spark, documents, folder, tmp_path):
    path, _ = folder
    docs = documents([]).select(*COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert docs.count() == 0
