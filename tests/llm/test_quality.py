import random
import re

import pyarrow as pa
import pytest

from llm_helpers import WORD, some_text
from tierlabel.llm import quality
from tierlabel.llm.quality import BASE, RULES, Batch, Estimate, assess, estimate_rules, keep_documents, plan_rules, run_cascade

EDGE = [
    None,
    "",
    " \n\t\x0b\x0c\r",
    "a b c\n\na b c\n a b c",
    "   é\x85 ü\x1c # $ <>",
    "a a a a a a a",
    "x" * 2_500_000 + " y " + "x" * 2_500_000,
    "one two three four five six one two three four five",
    "z\n" * 40,
]


def brute(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_equal_brute_force(documents):
    r = random.Random(4)
    texts = EDGE + [some_text(r, r.randrange(120), 12).replace(" ", r.choice(" \n"), 9) for _ in range(150)]
    out = {x["doc_id"]: x for x in assess(documents(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        x = out[i]
        want = brute(t)
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert x["base_failed"] == failed
        assert not (x["kept"] and failed)
        assert x["kept"] == (x["rejected_by"] is None)


def test_order_never_changes_the_verdict():
    r = random.Random(5)
    batch = Batch(pa.array([some_text(r, r.randrange(60), 30) + r.choice(["", " !!! ||| ###" * 9, " A B C" * 30]) for _ in range(200)]))
    want = run_cascade(batch, RULES)[0].tolist()
    for _ in range(5):
        assert run_cascade(batch, r.sample(RULES, len(RULES)))[0].tolist() == want


def test_cheap_selective_rules_come_first():
    a, b, c = BASE[0], BASE[1], RULES[2]
    ordered = plan_rules([a, b, c], [Estimate(a.name, 1.0, 0.1), Estimate(b.name, 0.1, 0.1), Estimate(c.name, 0.1, 0.5)])
    assert ordered == [c, b, a]


def test_a_rule_sees_only_survivors():
    seen = []

    def trait(batch):
        seen.append(len(batch))
        return quality.n_words(batch)

    texts = pa.array(["a b", "a b c d", "", "a b c d e f"])
    rules = [quality.Rule("first", quality.n_words, low=3), quality.Rule("second", trait, low=5)]
    kept, reason = run_cascade(Batch(texts), rules)
    assert kept.tolist() == [False, False, False, True] and reason == ["first", "second", "first", None]
    assert seen == [2]


def test_estimates_and_empty_table(documents):
    docs = documents([(i, "x " * (i % 20)) for i in range(300)])
    found = {e.rule: e for e in estimate_rules(docs, sample_rows=10_000)}
    assert found["words"].selectivity == pytest.approx(0.5)
    assert all(e.cost > 0 for e in found.values())
    assert assess(documents([])).collect() == [] and keep_documents(documents([])).collect() == []


def test_kept_documents_are_whole(documents):
    rows = [(1, "these are ten plain words of one clean short text"), (2, "bad"), (3, None)] * 2
    docs = documents(rows)
    out = keep_documents(docs)
    assert out.schema == docs.schema and [x["text"] for x in out.collect()] == [rows[0][1]] * 2
