"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut into passages of at most 64 words, which start every 16 words, so that any 60 words in a row
   of an item hold ``coverage`` of a passage. Their words are the features; document frequencies of
   these are counted over all documents. Words in more than a tenth of all documents (and more than 20) are left out,
   unless a passage would have fewer than four words left.
2. A randomised SVD, spread over Spark tasks, of the TF-IDF matrix of all passages of the block of items gives the latent
   space: nothing is sampled, and of the corpus it takes the frequencies, which are counted over all documents.
3. Every document is read in overlapping windows of 16, 32 and 64 words. A window's latent vector is compared with those
   of the passages of its length: their cosine must reach ``cosine``, and the window must hold ``contained`` of the
   passage's latent weight. Windows whose own weight is too small for any passage are skipped.
4. Candidates are checked on words: the longest common subsequence of passage and window must cover ``coverage`` of the
   passage, or ``paraphrase`` of it if the item's answer (its last sentence, where no answer column is given) also
   occurs in the window.

Words are runs without white space and ASCII punctuation, in lower case. Items are processed in blocks of
``block_items``, each with one pass over the documents, so what the driver and the tasks hold of a benchmark is bounded:
at most 16,384 features (more are folded together) times 128 dimensions, 8 MB. Documents are never shuffled or joined.

An item with fewer than ``min_words`` words is a leak where all its words follow each other in a document.

Edge cases: null and empty texts match nothing; repeated documents and items are reported each; an empty benchmark or table
gives an empty result; columns other than id and text are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tierlabel.llm.common import store
from tierlabel.llm.words import Pieces, _pieces, blocks, windows

_STEP = 4  # words in a block; windows start at block borders
_LENGTHS = (16, 32, 64)
_STRIDE = 16  # words between the starts of an item's passages
_PAD = _LENGTHS[-1] // _STEP
_FEATURES = 16_384
_SEPARATORS = b" \t\n\r\x0b\x0c" + bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


@dataclass(frozen=True)
class LeakSettings:
    cosine: float = 0.5
    contained: float = 0.4
    coverage: float = 0.8
    paraphrase: float = 0.6
    min_words: int = 8
    dimensions: int = 128
    block_items: int = 5000
    max_df: float = 0.1  # share of all documents, and number of documents, beyond which a word is common
    least_df: int = 20
    seed: int = 11


def plain_words(texts: pa.Array) -> Pieces:
    return _pieces(pc.utf8_lower(texts), _SEPARATORS, False)


def _hash_words(text: str) -> list[int]:
    return plain_words(pa.array([text], pa.string())).hashes.tolist()


@dataclass(frozen=True)
class Passage:
    item: int  # place of the item in its block
    words: tuple[int, ...]
    answer: tuple[int, ...]

    @property
    def length(self) -> int:
        return next(x for x in _LENGTHS if len(self.words) <= x)


def passages_of(item: int, text: str | None, answer: str | None) -> list[Passage]:
    """The passages of an item: overlapping stretches of at most 64 words, the last one at the item's end."""
    own = _hash_words(text or "")
    if not own:
        return []
    if answer is None:
        sentences = [s for s in re.split(r"[.!?\n]+", text) if s.strip()]
        answer = sentences[-1] if sentences else ""
    told = tuple(_hash_words(answer))
    told = told if len(told) >= 3 else ()
    size = _LENGTHS[-1]
    last = max(0, len(own) - size)
    return [Passage(item, tuple(own[s : s + size]), told) for s in [*range(0, last, _STRIDE), last]]


class Vocabulary:
    """Finds the features of words by a table of hash prefixes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.width = min(len(self.hashes), _FEATURES)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of known words and their features."""
        if not len(self.hashes) or not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self._marks[words >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.hashes, words[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == words[maybe]
        return maybe[hit], at[hit] % self.width

    @property
    def _marks(self) -> np.ndarray:
        if "_table" not in self.__dict__:
            table = np.zeros(1 << 20, bool)
            table[self.hashes >> np.uint64(44)] = True
            self.__dict__["_table"] = table
        return self.__dict__["_table"]


def _frequencies(docs: DataFrame, vocabulary: Vocabulary, text_col: str) -> tuple[np.ndarray, int]:
    """In how many of all documents each feature occurs, and how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(shared.value)
        totals, n = np.zeros(own.width + 1, np.int64), 0
        for table in batches:
            for _, texts in blocks(table.column(0)):
                found = plain_words(texts)
                at, feature = own.find(found.hashes)
                pairs = np.unique(found.owner[at] * own.width + feature)
                totals[:-1] += np.bincount(pairs % own.width, minlength=own.width)
                n += len(texts)
        totals[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(totals))), pa.array(totals)], ["feature", "n"])

    rows = docs.select(text_col).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(vocabulary.width + 1, np.int64)
    counts[rows["feature"].to_numpy()] = rows["n"].to_numpy()
    return counts[:-1], int(counts[-1])


class Space:
    """Weights and latent coordinates of the features."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, basis: np.ndarray):
        self.weights, self.basis = weights, basis
        self.vocabulary = Vocabulary(hashes)

    def vector(self, words: tuple[int, ...]) -> np.ndarray:
        """The latent vector of a passage."""
        _, feature = self.vocabulary.find(np.array(words, np.uint64))
        return (self.basis[feature] * self.weights[feature][:, None]).sum(axis=0)


def randomised_svd(rows: DataFrame, hashes: np.ndarray, weights: np.ndarray, settings: LeakSettings, rounds: int = 3) -> np.ndarray:
    """The leading right singular vectors (features x dimensions) of the TF-IDF matrix of ``rows`` (words binary).

    Subspace iteration: each round, tasks multiply their rows A with the current basis and its transpose, A'(A B), and
    the driver orthonormalises the sum, a matrix of features times dimensions.
    """
    width, extra = len(weights), 8
    size = min(settings.dimensions + extra, width)
    basis = np.linalg.qr(np.random.default_rng(settings.seed).standard_normal((width, size)))[0].astype(np.float32)
    context = rows.sparkSession.sparkContext

    for _ in range(rounds):
        shared = context.broadcast((hashes, weights.astype(np.float32), basis))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, weights, basis = shared.value
            own, total = Vocabulary(hashes), np.zeros_like(basis)
            for table in batches:
                for row in table.column(0):
                    _, feature = own.find(np.frombuffer(row.as_buffer(), np.uint64))
                    if not len(feature):
                        continue
                    value = weights[feature]
                    value = value / max(float(np.sqrt((value**2).sum())), 1e-9)
                    latent = value @ basis[feature]
                    np.add.at(total, feature, value[:, None] * latent)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        parts = rows.mapInArrow(run, "total binary").toArrow()["total"]
        total = sum(np.frombuffer(p.as_buffer(), np.float32).reshape(basis.shape).astype(np.float64) for p in parts)
        basis = np.linalg.qr(total)[0].astype(np.float32)
        shared.destroy()
    # order within the subspace: the last product is close to diagonal in the singular vectors
    u, _, _ = np.linalg.svd(total, full_matrices=False)
    return np.ascontiguousarray(u[:, : settings.dimensions].astype(np.float32))


def common_words(a: tuple[int, ...], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit per word of ``a``."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        mask = masks.get(w)
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _contains(words: list[int], run: tuple[int, ...]) -> bool:
    n = len(run)
    return n > 0 and any(words[i] == run[0] and tuple(words[i : i + n]) == run for i in range(len(words) - n + 1))


def _sequence(own: tuple[int, ...]) -> int:
    """The hash that ``windows`` gives to these words."""
    none = np.zeros(0, np.int64)
    return int(windows(Pieces(np.array(own, np.uint64), np.array([0, len(own)]), none, none, none, none), len(own))[0][0])


class Searcher:
    """Finds the passages of one block of items in batches of texts."""

    def __init__(self, space: Space | None, passages: list[Passage], settings: LeakSettings):
        self.space, self.settings = space, settings
        self.short: dict[int, dict[int, list[Passage]]] = {}  # by number of words and hash of their sequence
        for p in passages:
            if len(p.words) < settings.min_words:
                self.short.setdefault(len(p.words), {}).setdefault(_sequence(p.words), []).append(p)
        self.marks = {n: Vocabulary(np.array(list(own), np.uint64)) for n, own in self.short.items()}
        passages = [p for p in passages if len(p.words) >= settings.min_words]
        self.by_length: dict[int, tuple[list[Passage], np.ndarray, np.ndarray]] = {}
        for length in _LENGTHS:
            own = [p for p in passages if p.length == length]
            if own:
                vectors = np.stack([self.space.vector(p.words) for p in own])
                norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9).astype(np.float32)
                self.by_length[length] = own, (vectors / norms[:, None]).astype(np.float32), norms
        if space:
            self.table = (space.basis * space.weights[:, None]).astype(np.float32)

    def _windows(self, found: Pieces, first_block: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(length, blocks per stride, latent vectors) of all windows of each length."""
        counts = found.counts
        place = np.arange(len(found.hashes)) - np.repeat(found.bounds[:-1], counts)
        block = np.repeat(first_block[:-1], counts) + place // _STEP
        at, feature = self.space.vocabulary.find(found.hashes)
        used = self.space.weights[feature] > 0
        at, feature = at[used], feature[used]
        vectors = np.zeros((int(first_block[-1]), self.table.shape[1]), np.float32)
        if len(at):
            own = block[at]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            vectors[own[starts]] = np.add.reduceat(self.table[feature], starts, axis=0)
        # A window is four strides long. The next length joins two windows, and takes every second one.
        n = len(vectors) - 3
        vectors = sum(vectors[i : n + i] for i in range(4))
        for level, length in enumerate(_LENGTHS):
            if level:
                vectors = vectors[:-4:2] + vectors[4::2]
            yield length, 1 << level, vectors

    def candidates(self, found: Pieces, first_block: np.ndarray) -> Iterator[tuple[int, int, Passage, float]]:
        """(first block, length, passage, cosine) of the windows that are near a passage of their length."""
        for length, stride, vectors in self._windows(found, first_block):
            if length not in self.by_length:
                continue
            passages, queries, norms = self.by_length[length]
            size = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            rows = np.flatnonzero(size >= self.settings.contained * norms.min())
            for part in range(0, len(rows), 4096):
                some = rows[part : part + 4096]
                along = vectors[some] @ queries.T
                near = (along >= self.settings.cosine * size[some, None]) & (along >= self.settings.contained * norms)
                for i, j in zip(*np.nonzero(near)):
                    yield int(some[i]) * stride, length, passages[j], float(along[i, j] / size[some[i]])

    def exact(self, found: Pieces, leaks: dict[tuple[int, int], tuple[float, float, bool]]) -> None:
        """Add the leaks of short items."""
        for n, own in self.short.items():
            hashes, first = windows(found, n)
            at, _ = self.marks[n].find(hashes)
            texts = np.searchsorted(found.bounds, first[at], side="right") - 1
            for sequence, start, text in zip(hashes[at].tolist(), first[at].tolist(), texts.tolist()):
                for p in own[sequence]:
                    old = leaks.get((text, p.item))
                    if old is None or (p.answer and not old[2]):
                        a, b = max(int(found.bounds[text]), start - 32), min(int(found.bounds[text + 1]), start + n + 32)
                        leaks[text, p.item] = 1.0, 1.0, _contains(found.hashes[a:b].tolist(), p.answer)

    def find(self, texts: pa.Array) -> dict[tuple[int, int], tuple[float, float, bool]]:
        """(text, item) -> (cosine, coverage, answer found) of the leaks."""
        leaks: dict[tuple[int, int], tuple[float, float, bool]] = {}
        found = plain_words(texts)
        if not len(found.hashes):
            return leaks
        self.exact(found, leaks)
        if not self.by_length:
            return leaks
        # blocks of four words from the start of each text, and as many empty ones as a window has between texts
        first_block = np.concatenate([[0], np.cumsum(-(-found.counts // _STEP) + _PAD)])
        checked: dict[tuple, tuple[float, bool]] = {}
        for block, length, passage, cosine in self.candidates(found, first_block):
            ends = (block, block + length // _STEP - 1)
            for text in {min(int(np.searchsorted(first_block, b, side="right")) - 1, len(texts) - 1) for b in ends}:
                start = found.bounds[text] + (block - int(first_block[text])) * _STEP
                a = max(found.bounds[text], start - length // 2)
                b = min(found.bounds[text + 1], start + length + length // 2)
                if b <= a:
                    continue
                key = (int(a), int(b), passage)
                if key not in checked:
                    window = found.hashes[a:b].tolist()
                    checked[key] = common_words(passage.words, window) / len(passage.words), _contains(window, passage.answer)
                coverage, answered = checked[key]
                if coverage >= self.settings.coverage or (answered and coverage >= self.settings.paraphrase):
                    old = leaks.get((text, passage.item), (0.0, 0.0, False))
                    leaks[text, passage.item] = (max(old[0], cosine), max(old[1], coverage), old[2] or answered)
        return leaks


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None, n: int) -> Iterator[list]:
    """The benchmark in blocks of at most ``n`` items; a block at a time comes to the driver."""
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), answer.alias("answer"))
    total = rows.count()
    if total <= n:
        yield rows.collect()
        return
    parts = -(-total * 5 // (n * 4))
    dealt = store(rows.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts))), "benchmark")
    for part in range(parts):
        yield dealt.filter(F.col("part") == part).collect()


def searchers(
    docs: DataFrame,
    benchmark: DataFrame,
    settings: LeakSettings = LeakSettings(),
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    answer_col: str | None = None,
) -> Iterator[tuple[list, "Space | None", list[Passage]]]:
    """For each block of items: their ids, the fitted space (none if all are short) and the passages."""
    n_docs = docs.count()
    for items in _item_blocks(benchmark, item_id, item_text, answer_col, settings.block_items):
        own = [p for i, r in enumerate(items) for p in passages_of(i, r["text"], r["answer"])]
        if not own or not n_docs:
            continue
        cut = [p for p in own if len(p.words) >= settings.min_words]
        short = [p for p in own if len(p.words) < settings.min_words]
        if not cut:
            yield [r["id"] for r in items], None, short
            continue
        vocabulary = Vocabulary(np.array([w for p in cut for w in p.words], np.uint64))
        df, n_docs = _frequencies(docs, vocabulary, text_col)
        idf = np.log((n_docs + 1) / (df + 1)) + 0.1
        common = (df > max(settings.max_df * n_docs, settings.least_df)) | (df == 0)  # what no document has cannot match
        for p in cut:  # a passage keeps at least four of its words that documents have
            _, feature = vocabulary.find(np.array(p.words, np.uint64))
            feature = feature[df[feature] > 0]
            if (~common[feature]).sum() < 4:
                common[feature[np.argsort(df[feature], kind="stable")[:4]]] = False
        weights = np.where(common, 0.0, idf)
        schema = "words binary"
        own = docs.sparkSession.createDataFrame([(np.array(p.words, np.uint64).tobytes(),) for p in cut], schema)
        rows = store(own.coalesce(8), "passages")
        basis = randomised_svd(rows, vocabulary.hashes, weights, settings)
        yield [r["id"] for r in items], Space(vocabulary.hashes, weights, basis), cut + short


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings = LeakSettings(), **names) -> DataFrame:
    """(doc_id, item_id, cosine, coverage, answer_found): every document and item of which it holds a passage."""
    doc_id, item_id = names.pop("doc_id", "doc_id"), names.get("item_id", "item_id")
    text_col = names.get("text_col", "text")
    kinds = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, cosine double, coverage double, answer_found boolean"
    kind = to_arrow_type(benchmark.schema[item_id].dataType)
    result = docs.sparkSession.createDataFrame([], schema)
    for ids, space, passages in searchers(docs, benchmark, settings, **names):
        shared = docs.sparkSession.sparkContext.broadcast((ids, space, passages))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, space, passages = shared.value
            searcher = Searcher(space, passages, settings)
            for table in batches:
                for first, texts in blocks(table.column(1), 1 << 20):
                    leaks = searcher.find(texts)
                    if not leaks:
                        continue
                    own = table.column(0).slice(first, len(texts)).take(pa.array([t for t, _ in leaks]))
                    items = pa.array([ids[i] for _, i in leaks], kind)
                    columns = [pa.array(list(c)) for c in zip(*leaks.values())]
                    yield pa.RecordBatch.from_arrays([own, items, *columns], ["doc_id", "item_id", "cosine", "coverage", "answer_found"])

        result = result.union(docs.select(doc_id, text_col).mapInArrow(run, schema))
    return result


def drop_leaking(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings = LeakSettings(), **names) -> DataFrame:
    """The documents that hold no benchmark passage, columns unchanged; nothing is shuffled."""
    at = docs.columns.index(names.get("text_col", "text"))
    result = docs
    for ids, space, passages in searchers(docs, benchmark, settings, **names):
        shared = docs.sparkSession.sparkContext.broadcast((ids, space, passages))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            _, space, passages = shared.value
            searcher = Searcher(space, passages, settings)
            for table in batches:
                for first, texts in blocks(table.column(at), 1 << 20):
                    clean = np.ones(len(texts), bool)
                    clean[np.array([t for t, _ in searcher.find(texts)], np.int64)] = False
                    yield table.slice(first, len(texts)).filter(pa.array(clean))

        result = result.mapInArrow(run, docs.schema)
    return result
