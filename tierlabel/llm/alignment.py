"""How the tokens of two tokenizers lie on each other, and how often their ids are linked.

Tokenizer A (byte-level pieces) gets a space and the text, tokenizer B (pieces that mark a space, with byte pieces) the text, to which it
adds the space itself. Both cover the same bytes. Offsets where a token of A and one of B end together cut them into
groups; every token of A is linked with every token of B of its group. The count of a pair of ids is the number of documents that hold it linked.

Most groups are one token on each side, with equal bytes. An array made beforehand gives, for each id of A, the id of B
with the same bytes (the plain piece before the byte piece). One-to-one groups that agree with it need no pair: they are counted in a
vector as long as A's vocabulary. Only the pairs of the other groups are counted as pairs, first within a task and then by
a shuffle; a pair of them that the array has too goes to the vector.

What it does at scale. Texts are tokenized once, and the ids are written to the shared folder. Counting moves at most one
row per distinct pair and task, whatever the number of links; no pair of a document is ever shuffled. The counts of
pairs then pass by in blocks of at most ``block_pairs``, each of which is broadcast, and a document's sums grow by what a block
has; this is one pass over the ids a block, and the number of blocks is bounded by the two vocabularies, not by the data.
A group's distinct ids are expanded, in slices, so a long run of repeated tokens is no square.

Edge cases. A text that is null or empty, or that one of the tokenizers changes (its tokens' bytes are not those of space and
text), has no tokens, zeros, and an empty digest. Very long texts are tokenized whole; they bound the memory of their task only. Repeated rows, with equal
or null ids, are documents of their own. Ties of the highest count all count as best. An empty table gives an empty
result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tierlabel.llm.common import store

BLOCK_PAIRS = 4_000_000  # pairs with their counts in one broadcast: 64 MB
SLICE = 1 << 20  # links or tokens worked on at once
REMEMBERED = 500_000  # stretches of text of which a worker remembers the ids
KEPT_PAIRS = 4_000_000  # distinct pairs a task holds before it gives them out

_VISIBLE = frozenset(map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]))  # no engine takes these for white space
# Fixed value: the pattern by which byte-level pieces are kept inside words.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_character() -> dict[str, int]:
    """The characters of byte-level vocabularies: visible Latin-1 stands for itself, other bytes follow from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Tokenizers:
    """Both tokenizers from the bytes of their files, with the bytes of all their tokens."""

    file_a: bytes
    file_b: bytes

    @classmethod
    def read(cls, path_a: str, path_b: str) -> Tokenizers:
        with open(path_a, "rb") as a, open(path_b, "rb") as b:
            return cls(a.read(), b.read())

    def __getstate__(self):
        return {name: self.__dict__[name] for name in ("file_a", "file_b", "by_rank", "splits_at_spaces") if name in self.__dict__}

    @cached_property
    def bytes_a(self) -> list[bytes]:
        of = _byte_of_character()
        stored = json.loads(self.file_a)
        ids = dict(stored["model"]["vocab"])
        found = [b""] * (1 + max(ids.values()))
        for piece, i in ids.items():
            found[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()
        return found

    @cached_property
    def bytes_b(self) -> list[bytes]:
        model = self._b
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    @cached_property
    def _a(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_str(self.file_a.decode())
        loaded.encode_special_tokens = True  # their strings inside texts are plain text
        return loaded

    @cached_property
    def _b(self):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_proto=self.file_b)

    @cached_property
    def same_bytes(self) -> np.ndarray:
        """For each id of A the id of B with the same bytes, or -1."""
        of: dict[bytes, int] = {}
        for i, b in enumerate(self.bytes_b):
            if b and not (self._b.is_control(i) or self._b.is_unknown(i)):
                if b not in of or self._b.is_byte(of[b]):
                    of[b] = i
        return np.array([of.get(b, -1) if b else -1 for b in self.bytes_a], np.int64)

    def _encode_whole(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of texts; None where the bytes of the tokens are not those of space and text."""
        side_a = self._a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        side_b = self._b.encode(texts, num_threads=1)
        bytes_a, bytes_b, found = self.bytes_a, self.bytes_b, []
        for text, a, b in zip(texts, (e.ids for e in side_a), side_b):
            whole = b" " + text.encode()
            same = b"".join([bytes_a[x] for x in a]) == whole and b"".join([bytes_b[x] for x in b]) == whole
            found.append((np.array(a, self.kind).tobytes(), np.array(b, self.kind).tobytes()) if same else None)
        return found

    def _encode_words(self, words: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The same for words between visible characters, many in one text: tokens start with each of them."""
        text = " ".join(words)
        whole, found = b" " + text.encode(), []
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        by_rank = self.by_rank and _VISIBLE.issuperset(text.replace(" ", ""))
        side_a = self._ranked.encode_ordinary(" " + text) if by_rank else self._a.encode(" " + text, add_special_tokens=False).ids
        for ids, pieces, lengths in zip((side_a, self._b.encode(text)), (self.bytes_a, self.bytes_b), self._lengths):
            last = np.searchsorted(token_ends := np.cumsum(lengths[ids]), ends)
            if b"".join([pieces[x] for x in ids]) != whole or not np.array_equal(token_ends[last], ends):
                return self._encode_whole(words)
            packed, size = np.array(ids, self.kind).tobytes(), self.kind.itemsize
            cuts = [0, *((last + 1) * size).tolist()]
            found.append([packed[x:y] for x, y in zip(cuts, cuts[1:])])
        return list(zip(*found))

    @cached_property
    def _ranked(self):
        """Tokenizer A by ranks, for words of visible characters: much faster, and equal if ``by_rank``."""
        import tiktoken

        return tiktoken.Encoding("a", pat_str=_WORDS, mergeable_ranks=self._ranks, special_tokens={})

    @cached_property
    def _ranks(self) -> dict[bytes, int]:
        named = {x["id"] for x in json.loads(self.file_a)["added_tokens"]}
        return {b: i for i, b in enumerate(self.bytes_a) if b and i not in named}

    @cached_property
    def by_rank(self) -> bool:
        """Whether merging the neighbours that form the piece of lowest id is what the file's merges do.

        It is if ids rise with the merges, and each piece, built from its bytes with the pieces before it, is at
        last the two parts that its merge names: then no other two neighbours ever form it, whatever stands around
        them, as neither a merge across its ends nor another order inside can have happened.
        """
        model, of = json.loads(self.file_a)["model"], _byte_of_character()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            return False
        last = -1
        for pair in merges:
            left, right = (bytes(of[c] for c in x) for x in pair)
            rank = self._ranks.get(left + right, -1)
            if rank <= last or _parts(left + right, self._ranks, rank) != [left, right]:
                return False
            last = rank
        return len(merges) + 256 == len(self._ranks)

    @cached_property
    def _lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))

    @cached_property
    def splits_at_spaces(self) -> bool:
        """Whether a space between two visible characters always starts a token on both sides.

        A: words by the byte-level pattern, in which a space is only ever the first of other characters, and no normalizer. B:
        no piece has a space after another character, and a probe comes back as it was.
        """
        stored = json.loads(self.file_a)
        words = stored["pre_tokenizer"] or {}
        by_pattern = words.get("type") == "ByteLevel" and words.get("use_regex") is True and stored["normalizer"] is None
        inner = any(" " in p.lstrip(b" ").decode(errors="replace") for p in self.bytes_b)
        probe = "a  \u00bc\t\ufb01 b\u00a0"
        kept = b"".join(self.bytes_b[i] for i in self._b.encode(probe)) == b" " + probe.encode()
        return by_pattern and not inner and kept

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Ids of both tokenizers per text; none where the bytes of the tokens are not those of space and text.

        Texts are cut where a token of both must start, and the ids of the stretches are remembered.
        """
        known, split, plain, odd = self._known, [], set(), set()
        for text in texts:
            words = (text.split(" ") if self.splits_at_spaces else [text]) if text else []
            ids = list(map(known.get, words))
            if None in ids:
                unknown = [w for w, i in zip(words, ids) if i is None]
                if not all(map(_regular, unknown)):
                    words = _stretches(words)
                    ids = list(map(known.get, words))
                    unknown = [w for w, i in zip(words, ids) if i is None]
                for w in unknown:
                    (plain if _VISIBLE.issuperset(w) else odd).add(w)
            split.append((words, ids))
        here = {}
        if odd:
            here.update(zip(odd, self._encode_whole(list(odd))))
        fresh = list(plain)
        for at in range(0, len(fresh), 1000):
            here.update(zip(fresh[at : at + 1000], self._encode_words(fresh[at : at + 1000])))
        side_a, side_b = [], []
        for words, ids in split:
            if None in ids:
                ids = [here[w] if i is None else i for w, i in zip(words, ids)]
                if None in ids:  # a stretch that a tokenizer changes
                    ids = []
            side_a.append(b"".join([x for x, _ in ids]))
            side_b.append(b"".join([x for _, x in ids]))
        if len(known) > REMEMBERED:
            known.clear()
        known.update((w, ids) for w, ids in here.items() if ids is not None and len(w) <= 64)
        return side_a, side_b

    @cached_property
    def _known(self) -> dict[str, tuple[bytes, bytes] | None]:
        return {}

    @cached_property
    def kind(self) -> np.dtype:
        """The smallest type that holds all ids."""
        return np.min_scalar_type(max(len(self.bytes_a), len(self.bytes_b)))


def _parts(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """A piece from its bytes up, merging the neighbours of lowest rank, the first if equal, while one is below a rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(x + y, below), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _regular(word: str) -> bool:
    return word != "" and word[0] in _VISIBLE and word[-1] in _VISIBLE


def _stretches(words: list[str]) -> list[str]:
    """Words put together again wherever the space between them lacks a visible character on either side."""
    found = [words[0]]
    for w in words[1:]:
        if w and w[0] in _VISIBLE and found[-1] and found[-1][-1] in _VISIBLE:
            found.append(w)
        else:
            found[-1] += " " + w
    return found


@dataclass
class Groups:
    """The tokens of some documents, one after the other, cut into groups."""

    a: np.ndarray  # ids
    b: np.ndarray
    group_a: np.ndarray  # the group of each token
    group_b: np.ndarray
    size_a: np.ndarray  # tokens per group
    size_b: np.ndarray
    doc: np.ndarray  # the document of each group

    @classmethod
    def cut(cls, side_a: list[np.ndarray], side_b: list[np.ndarray], length_a: np.ndarray, length_b: np.ndarray) -> Groups:
        """Both sides of a document have the same number of bytes, so a document ends where a group ends."""
        a, b = (np.concatenate([np.empty(0, np.uint8), *side]).astype(np.int64) for side in (side_a, side_b))
        end_a, end_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])

        def ends_with(own: np.ndarray, other: np.ndarray) -> np.ndarray:
            at = np.searchsorted(other, own)
            return other[np.minimum(at, len(other) - 1)] == own if len(other) else np.zeros(len(own), bool)

        last_a, last_b = ends_with(end_a, end_b), ends_with(end_b, end_a)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n = int(last_a.sum())
        doc_a = np.repeat(np.arange(len(side_a)), [len(x) for x in side_a])
        return cls(a, b, group_a, group_b, np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n), doc_a[last_a])

    def links(self, same: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(doc, pair, n)``: each distinct linked pair of a document, as ``a * width + b``, and its links.

        One-to-one groups with the ids that ``same`` names are not expanded at all.
        """
        first_a, first_b = np.cumsum(self.size_a) - self.size_a, np.cumsum(self.size_b) - self.size_b
        single = np.flatnonzero((self.size_a == 1) & (self.size_b == 1))
        fast = single[same[self.a[first_a[single]]] == self.b[first_b[single]]]
        n_pairs = len(same) * width
        ids = self.a[first_a[fast]]
        keys, counts = np.unique(self.doc[fast] * n_pairs + ids * width + same[ids], return_counts=True)
        found = [(keys, counts)]

        slow = np.ones(len(self.size_a), bool)
        slow[fast] = False
        left, right = np.flatnonzero(slow[self.group_a]), np.flatnonzero(slow[self.group_b])
        # an id that a group has twice is expanded once, with its number
        (group, id_a, n_a), (group_b, id_b, n_b) = (
            _distinct(self.group_a[left], self.a[left], len(same)),
            _distinct(self.group_b[right], self.b[right], width),
        )
        size_b = np.bincount(group_b, minlength=len(self.size_a))
        first_b = np.cumsum(size_b) - size_b
        times = size_b[group]
        upto = np.cumsum(times)
        at = 0
        while at < len(group):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, side="right")))
            g, n = group[at:to], times[at:to]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            other = np.repeat(first_b[g], n) + inner
            key = np.repeat(self.doc[g] * n_pairs + id_a[at:to] * width, n) + id_b[other]
            found.append(_merged([(key, np.repeat(n_a[at:to], n) * n_b[other])]))
            if len(found) > 8:
                found = [_merged(found)]
            at = to
        keys, counts = _merged(found)
        return keys // n_pairs, keys % n_pairs, counts

    def digests(self, text_a: np.ndarray, text_b: np.ndarray, n_docs: int) -> list[str]:
        """Per document the SHA-256 of ``a1,a2|b1;a3|b2``; empty without tokens.

        ``text_a`` and ``text_b`` hold each id followed by the sign inside a group, then each id followed by that at its end.
        """
        rows = np.empty(len(self.a) + len(self.b), object)
        end_a, end_b = np.cumsum(self.size_a), np.cumsum(self.size_b)
        start_b = end_b - self.size_b
        place_a, place_b = np.arange(len(self.a)), np.arange(len(self.b))
        is_last = place_a == end_a[self.group_a] - 1
        rows[place_a + start_b[self.group_a]] = text_a[self.a + is_last * (len(text_a) // 2)]
        is_last = place_b == end_b[self.group_b] - 1
        rows[place_b + end_a[self.group_b]] = text_b[self.b + is_last * (len(text_b) // 2)]
        ends = np.cumsum(np.bincount(self.doc, weights=self.size_a + self.size_b, minlength=n_docs).astype(np.int64))
        digests, at = [], 0
        for end in ends.tolist():
            digests.append(hashlib.sha256(b"".join(rows[at:end].tolist())[:-1]).hexdigest() if end > at else "")
            at = end
        return digests


def _distinct(group: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids of each group with their numbers, groups in rising order."""
    keys, n = np.unique(group * width + ids, return_counts=True)
    return keys // width, keys % width, n


def _sums(place: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
    """Whole numbers added up by place."""
    total = np.zeros(n, np.int64)
    np.add.at(total, place, numbers)
    return total


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums per key, keys in rising order."""
    keys, counts = (np.concatenate([np.empty(0, np.int64), *side]) for side in zip(*parts))
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, _sums(place, counts, len(distinct))


@dataclass
class Vocabularies:
    """What a task needs to know of both vocabularies once texts are encoded; it does not grow with the data."""

    length_a: np.ndarray  # bytes per id
    length_b: np.ndarray
    same: np.ndarray  # for each id of A the id of B with the same bytes, or -1
    kind: np.dtype

    @classmethod
    def of(cls, both: Tokenizers) -> Vocabularies:
        return cls(*both._lengths, both.same_bytes, both.kind)

    @property
    def width(self) -> int:
        return len(self.length_b)

    def parts(self, batch: pa.RecordBatch, a: int, b: int) -> Iterator[tuple[int, int, Groups]]:
        """The documents of a batch, whole ones of about ``SLICE`` tokens at a time: first row, end, groups."""
        sides = [[np.frombuffer(x.as_buffer(), self.kind) for x in batch.column(c)] for c in (a, b)]
        n = np.cumsum([len(x) + len(y) for x, y in zip(*sides)])
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + SLICE, side="right")))
            yield at, to, Groups.cut(sides[0][at:to], sides[1][at:to], self.length_a, self.length_b)
            at = to


def encode_pairs(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, row long, a binary, b binary)``: per document a unique row number and the ids of both tokenizers as little-endian numbers, stored."""
    _ = tokenizers.by_rank, tokenizers.splits_at_spaces  # found out once, here
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)
    given = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    kinds = [docs.schema[id_col].dataType, T.LongType(), T.BinaryType(), T.BinaryType()]
    names = ["id", "row", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = shared.value
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                encoded = [pa.array(side, pa.binary()) for side in both.encode(part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *encoded], names)

    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    return store(given.mapInArrow(run, schema), "encoded", "zstd")


def aligned_groups(encoded: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """``(id, row, groups)``: the groups of each document as an array of ``(a array<int>, b array<int>)``."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabularies)
    kind = T.ArrayType(T.StructType([T.StructField(c, T.ArrayType(T.IntegerType())) for c in "ab"]))
    schema = T.StructType([encoded.schema["id"], encoded.schema["row"], T.StructField("groups", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value

        def lists(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(ids.astype(np.int32)))

        for batch in batches:
            for at, to, groups in known.parts(batch, 2, 3):
                each = pa.StructArray.from_arrays([lists(groups.a, groups.size_a), lists(groups.b, groups.size_b)], ["a", "b"])
                ends = np.append(0, np.cumsum(np.bincount(groups.doc, minlength=to - at)))
                column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), each)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], batch.column(1)[at:to], column.cast(arrow.field(2).type)], arrow.names)

    arrow = to_arrow_schema(schema)
    return encoded.mapInArrow(run, schema)


@dataclass
class PairCounts:
    """In how many documents pairs of ids are linked.

    ``vector[a]`` is the count of a and the id of B with the same bytes, ``pairs(a, b, n)`` has all other pairs, and
    ``highest[a]`` is the highest count of any pair of a.
    """

    vector: np.ndarray
    highest: np.ndarray
    pairs: DataFrame


def count_pairs(encoded: DataFrame, vocabularies: Vocabularies) -> PairCounts:
    """Count the linked pairs of all documents of ``encode_pairs``."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabularies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        vector = np.zeros(len(known.same), np.int64)
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def out(a: np.ndarray, b: np.ndarray | None, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(a), 100_000):
                cut = slice(at, at + 100_000)
                right = pa.nulls(len(a[cut]), pa.int32()) if b is None else pa.array(b[cut].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(a[cut].astype(np.int32)), right, pa.array(n[cut])], ["a", "b", "n"])

        for batch in batches:
            for _, _, groups in known.parts(batch, 0, 1):
                _, pair, _ = groups.links(known.same, known.width)
                plain = known.same[pair // known.width] == pair % known.width
                vector += np.bincount(pair[plain] // known.width, minlength=len(vector))
                kept.append(np.unique(pair[~plain], return_counts=True))
                if sum(len(k) for k, _ in kept) > 2 * KEPT_PAIRS:
                    kept = [_merged(kept)]
                    if len(kept[0][0]) > KEPT_PAIRS:
                        yield from out(kept[0][0] // known.width, kept[0][0] % known.width, kept[0][1])
                        kept = []
        if kept:
            keys, counts = _merged(kept)
            yield from out(keys // known.width, keys % known.width, counts)
        met = np.flatnonzero(vector)
        yield from out(met, None, vector[met])  # no id of B: an entry of the vector

    parts = encoded.select("a", "b").mapInArrow(run, "a int, b int, n long")
    counted = store(parts.groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts")

    def vector(df: DataFrame) -> np.ndarray:
        """At most one row per id of A."""
        found, table = np.zeros(len(vocabularies.same), np.int64), df.toArrow()
        found[table["a"].to_numpy()] = table["n"].to_numpy()
        return found

    counts = vector(counted.filter("b IS NULL").select("a", "n"))
    highest = vector(counted.groupBy("a").agg(F.max("n").alias("n")))
    return PairCounts(counts, highest, counted.filter("b IS NOT NULL"))


def _blocks(pairs: DataFrame, width: int, block_pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys in rising order and counts, about ``block_pairs`` at a time; one empty block if there are none."""
    n = max(1, math.ceil(pairs.count() / block_pairs))
    for i in range(n):
        table = pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(n)) == i).toArrow()
        keys = table["a"].to_numpy().astype(np.int64) * width + table["b"].to_numpy()
        order = np.argsort(keys)
        yield keys[order], table["n"].to_numpy()[order]


def alignment_digests(
    docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text", block_pairs: int = BLOCK_PAIRS
) -> DataFrame:
    """Per document: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` (long) and ``groups_sha256``.

    ``n_best`` counts the links whose pair has the highest count of all pairs of its id of A; ``count_sum`` adds the counts of
    the pairs of all links.
    """
    vocabularies = Vocabularies.of(tokenizers)
    encoded = encode_pairs(docs, tokenizers, id_col, text_col)
    counts = count_pairs(encoded, vocabularies)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((vocabularies, counts.highest, counts.vector))
    whole = T.StructType(
        [encoded.schema["id"], encoded.schema["row"]]
        + [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
        + [T.StructField("groups_sha256", T.StringType())]
    )
    added = T.StructType([whole[c] for c in ("row", "n_best", "count_sum")])
    first, more = None, None
    for block in _blocks(counts.pairs, vocabularies.width, block_pairs):
        held = context.broadcast(block)
        is_first = first is None

        def run(batches: Iterator[pa.RecordBatch], held=held, is_first=is_first) -> Iterator[pa.RecordBatch]:
            (known, highest, vector), (keys, totals) = shared.value, held.value
            signs = [[f"{i}{s}".encode() for s in marks for i in range(len(side))] for side, marks in ((known.length_a, ",|"), (known.length_b, ",;"))]
            text_a, text_b = (np.array(x, object) for x in signs)
            for batch in batches:
                for at, to, groups in known.parts(batch, 2, 3):
                    n_docs = to - at
                    doc, pair, n = groups.links(known.same, known.width)
                    a = pair // known.width
                    place = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
                    count = np.where(keys[place] == pair, totals[place], 0) if len(keys) else np.zeros(len(pair), np.int64)
                    if is_first:
                        count = np.where(known.same[a] == pair % known.width, vector[a], count)
                    best = (count > 0) & (count == highest[a])

                    def per_doc(docs: np.ndarray, numbers: np.ndarray) -> pa.Array:
                        return pa.array(_sums(docs, numbers, n_docs))

                    row = batch.column(1)[at:to]
                    sums = [per_doc(doc[best], n[best]), per_doc(doc, n * count)]
                    if not is_first:
                        yield pa.RecordBatch.from_arrays([row, *sums], added.names)
                        continue
                    sizes = [per_doc(groups.doc, x) for x in (groups.size_a, groups.size_b, np.ones_like(groups.doc))]
                    digests = pa.array(groups.digests(text_a, text_b, n_docs), pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], row, *sizes, per_doc(doc, n), *sums, digests], whole.names)

        found = encoded.mapInArrow(run, whole if is_first else added)
        if is_first:
            first = found
        else:
            more = found if more is None else more.unionByName(found)
    if more is not None:  # one row per document and block
        more = more.groupBy("row").agg(F.sum("n_best").alias("__best"), F.sum("count_sum").alias("__sum"))
        first = first.join(more, "row").withColumns({"n_best": F.col("n_best") + F.col("__best"), "count_sum": F.col("count_sum") + F.col("__sum")})
    return first.select(F.col("id").alias(id_col), *whole.names[2:])
