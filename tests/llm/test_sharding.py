import random
import zlib

import pytest

from tierlabel.llm import sharding
from tierlabel.llm.sharding import shard_documents, shard_plan

from llm_helpers import some_text


def smallest(sizes, n):
    def fits(c):
        shards, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                shards, room = shards + 1, c
            room -= s
        return shards <= n

    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def texts(seed, n):
    r = random.Random(seed)
    rows = [(i, some_text(r, r.randrange(1, 60))) for i in range(n)]
    rows += [(n + i, "the same text") for i in range(n // 3)] + [(2 * n, None), (2 * n + 1, ""), (2 * n + 2, "again"), (2 * n + 2, "again")]
    return rows


@pytest.mark.parametrize(("n_shards", "local"), [(1, 0), (3, 20_000), (8, 0)])
def test_smallest_capacity(documents, monkeypatch, n_shards, local):
    monkeypatch.setattr(sharding, "_LOCAL", local)
    rows = texts(n_shards, 120)
    out = shard_documents(documents(rows).repartition(5), n_shards).collect()
    assert len(out) == len(rows)
    by_text = {}
    text = {}
    for i, t in rows:
        text.setdefault(i, t)
    by_shard = {}
    for x in out:
        by_shard.setdefault(x["shard"], []).append(x)
        by_text.setdefault(text[x["doc_id"]] or "", set()).add(x["shard"])
        data = (text[x["doc_id"]] or "").encode()
        assert (x["size"], x["text_crc32"], x["law"], x["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(x["slot"] for x in own) == list(range(len(own))) for own in by_shard.values())
    # the same groups in the same order, by brute force
    plan = shard_plan(documents(rows), n_shards)
    ends = [r["at"] for r in plan.rows.filter("is_end").orderBy("at").collect()]
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert plan.capacity == smallest(sizes, n_shards) == max(sum(x["size"] for x in own) for own in by_shard.values())


def test_few_groups_and_none(documents):
    out = shard_documents(documents([(i, "same") for i in range(20)])).collect()
    assert {x["shard"] for x in out} == {out[0]["shard"]} and sorted(x["slot"] for x in out) == list(range(20))
    assert shard_documents(documents([])).collect() == []


def test_reruns_agree(documents):
    rows = texts(9, 80)
    a = {tuple(x) for x in shard_documents(documents(rows)).collect()}
    b = {tuple(x) for x in shard_documents(documents(rows[::-1]).repartition(9)).collect()}
    assert {x[:6] for x in a } == {x[:6] for x in b }


def test_no_python_in_the_plan(documents):
    plan = shard_documents(documents(texts(1, 30)))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
