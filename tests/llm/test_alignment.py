import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import tokenizers as library

from llm_helpers import some_text
from tierlabel.llm import alignment
from tierlabel.llm.alignment import Tokenizers, Vocabularies, aligned_groups, alignment_digests, count_pairs, encode_pairs
from tierlabel.llm.alignment_queries import BYTE_PIECES, SPACE_PIECES


@pytest.fixture(scope="module")
def both():
    return Tokenizers.read(BYTE_PIECES, SPACE_PIECES)


def character_bytes():
    """GPT-2's table, as the tokenizers library names its alphabet: checked against that below."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute_force(texts):
    """Token by token: ends as sets, links as all pairs of a group, counts over documents."""
    a = library.Tokenizer.from_file(BYTE_PIECES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=SPACE_PIECES)
    of = character_bytes()
    assert set(of) == set(library.pre_tokenizers.ByteLevel.alphabet())

    def bytes_a(i):
        piece = a.id_to_token(i)
        return bytes(of[c] for c in piece) if set(piece) <= set(of) else piece.encode()

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("\u2581", " ").encode()

    groups = []
    for t in texts:
        side = []
        if t:
            ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t))
            spans = ([bytes_a(i) for i in ids[0]], [bytes_b(i) for i in ids[1]])
            if all(b"".join(s) == (" " + t).encode() for s in spans):
                ends = [[sum(map(len, s[: i + 1])) for i in range(len(s))] for s in spans]
                start = 0
                for end in sorted(set(ends[0]) & set(ends[1])):
                    side.append(tuple([i for i, e in zip(x, y) if start < e <= end] for x, y in zip(ids, ends)))
                    start = end
        groups.append(side)
    linked = [Counter((x, y) for g in side for x in g[0] for y in g[1]) for side in groups]
    counts = Counter(p for each in linked for p in each)
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    rows = []
    for side, each in zip(groups, linked):
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in side)
        best = sum(n for p, n in each.items() if counts[p] == highest[p[0]])
        total = sum(n * counts[p] for p, n in each.items())
        digest = hashlib.sha256(text.encode()).hexdigest() if side else ""
        rows.append((sum(len(g[0]) for g in side), sum(len(g[1]) for g in side), len(side), sum(each.values()), best, total, digest))
    return rows, groups, counts


def texts(seed):
    r = random.Random(seed)
    bits = ["<s>", "</s>", "<|endoftext|>", "<0x0A>", "<unk>", " ", "  ", "\n", "\t", "é", "世界", "😀", "the", "x́", "\x00", "ing", "'s", "12", "aaaa", "¼", "\u00a0"]
    made = ["".join(r.choices(bits, k=r.randrange(12))) for _ in range(120)]
    made += [some_text(r, r.randrange(60)) + r.choice(["", "!", " über naïve"]) for _ in range(60)]
    return made + [None, "", " ", "\u2581", made[0], made[0], "ababab" * 300, "a" * 3000]


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, documents, both, seed):
    given = texts(seed)
    want, groups, counts = brute_force(given)
    docs = documents(list(enumerate(given))).repartition(3)
    for block in (alignment.BLOCK_PAIRS, 150):  # one block, and many
        found = alignment_digests(docs, both, block_pairs=block).collect()
        assert sorted(tuple(r) for r in found) == [(i, *w) for i, w in enumerate(want)]
    assert sum(w[0] > 0 for w in want) > 60
    vocabularies = Vocabularies.of(both)
    encoded = encode_pairs(docs, both)
    cut = {r.id: [(list(g.a), list(g.b)) for g in r.groups] for r in aligned_groups(encoded, vocabularies).collect()}
    assert cut == {i: [tuple(map(list, g)) for g in side] for i, side in enumerate(groups)}
    pairs = count_pairs(encoded, vocabularies)
    own = {(r.a, r.b): r.n for r in pairs.pairs.collect()}
    fast = {(i, int(vocabularies.same[i])): int(n) for i, n in enumerate(pairs.vector) if n}
    assert not set(own) & set(fast) and own | fast == counts


def test_small_slices(spark, documents, both, monkeypatch):
    given = texts(5)[-60:]
    want, _, _ = brute_force(given)
    for name in ("SLICE", "KEPT_PAIRS"):
        monkeypatch.setattr(alignment, name, 7)
    groups = []
    vocabularies = Vocabularies.of(both)
    a, b = ([np.frombuffer(x, both.kind) for x in side] for side in both.encode(given))
    for i in range(len(given)):
        cut = alignment.Groups.cut([a[i]], [b[i]], vocabularies.length_a, vocabularies.length_b)
        groups.append(int(cut.links(vocabularies.same, vocabularies.width)[2].sum()))
    assert groups == [w[3] for w in want]


def test_texts_in_stretches_equal_whole_texts(both):
    r = random.Random(8)
    bits = ["a", "The", " b", "  c", " ", "\t", "\n", ".", ",", "'s", "1", " 2", "é", " é", "<s>", "\u00a0", "世", "x" * 70, "\u2581", "\u0301", " Z"]
    assert both.splits_at_spaces and both.by_rank
    for _ in range(400):
        text = "".join(r.choices(bits, k=r.randrange(1, 40)))
        (whole,) = both._encode_whole([text])
        (a,), (b,) = both.encode([text])
        assert (a, b) == (whole or (b"", b""))


def test_words_by_rank_equal_the_merges(both):
    r = random.Random(9)
    letters = [chr(c) for c in [*range(33, 127), *range(0xC0, 0x100)]]
    words = ["".join(r.choices(letters, k=r.randrange(1, 9))) for _ in range(3000)] + ["".join(r.choices("thesanding", k=r.randrange(3, 30))) for _ in range(3000)]
    assert both._encode_words(words) == both._encode_whole(words)
    merges = json.loads(both.file_a)
    merges["model"]["merges"][300:302] = merges["model"]["merges"][301:299:-1]
    assert not Tokenizers(json.dumps(merges).encode(), both.file_b).by_rank


def test_same_bytes_prefers_plain_pieces(both):
    stored = json.loads(both.file_a)["model"]["vocab"]
    same = both.same_bytes
    assert both.bytes_b[same[stored["a"]]] == b"a" and not both._b.is_byte(int(same[stored["a"]]))
    assert all(s < 0 or both.bytes_a[i] == both.bytes_b[s] for i, s in enumerate(same))


def test_repeated_null_ids_and_no_rows(spark, documents, both):
    found = alignment_digests(documents([(None, "some text"), (None, "some text"), (4, "some"), (4, None)]), both).collect()
    by_n = sorted((r.doc_id or -1, r.n_a, r.count_sum) for r in found)
    assert by_n == [(-1, 2, 5), (-1, 2, 5), (4, 0, 0), (4, 1, 3)]
    assert alignment_digests(documents([]), both).collect() == []
