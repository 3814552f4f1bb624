"""Language-model scores with Brown classes.

The ``class_words`` most frequent words of the training documents are put into ``classes`` classes by exchange
clustering: word after word moves to the class that raises the likelihood of class bigrams most, until none moves. Every
further word that occurs ``min_count`` times joins the class to which adding its bigrams raises that likelihood most; its
neighbours count by the classes that the exchange gave them. So the words that have a class grow with the corpus. Rarer
and unknown words form one class of their own, the end of a text another. A word's probability is that of its class
after the class before (smoothed counts of class bigrams over all training documents, with all words in their classes)
times that of the word in its class; in the class of the rare words, words have add-one probabilities, one share being
left for all unknown ones. Each row also gets an add-one unigram score as a base line. To score other documents with a
corpus, give both, the others as held out.

Scale. Words are 64-bit hashes. Texts are split once; a row keeps its words as places in a bounded head list (drawn
from a sample; it decides only where a word is counted, never what its count is) or among the row's own other words. Head
words are counted in place; other words go through shuffles by word: counts, neighbours, and classes on their way back
to their rows. Hot words are in the head, so no task of these shuffles gets a word that fills it, and a word's
neighbours are counts of at most (classes + 2)^2 codes. The driver sees head words, ``class_words`` and their bigrams, and
class bigrams, all bounded by the settings; exchange clustering works on these.

Edge cases: null and empty texts are a lone end token; a null id belongs to the training documents; equal rows get equal
rows; words of equal counts are ordered by their hashes, classes of equal gain by their numbers; a very long text is one
row; without training documents all probabilities are those of nothing seen; columns other than id and text are not
touched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlabel.llm.common import store
from tierlabel.llm.words import blocks, words


@dataclass(frozen=True)
class BrownSettings:
    classes: int = 50
    class_words: int = 1000  # the most frequent words, which the exchange clusters
    min_count: int = 2  # further words of this count join a class
    head_words: int = 131_072
    sample_rows: int = 4000  # rows that the head list is drawn from
    passes: int = 12
    smoothing: float = 0.5
    block_tokens: int = 1 << 17  # tokens that a task works on at once, or one row
    seed: int = 5
    id_col: str = "doc_id"
    text_col: str = "text"


class Head:
    """A sorted list of word hashes, looked up by a table of prefixes first."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.marks = np.zeros(1 << 20, bool)
        self.marks[self.hashes >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place in the list, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.hashes):
            maybe = np.flatnonzero(self.marks[hashes >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes[maybe]
            out[maybe[hit]] = at[hit]
        return out


def _sums(text: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums per text; of floats also if there are none."""
    return np.bincount(text, values, minlength=n).astype(np.float64)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Bounds of the rows of a list column, and its values."""
    offsets = column.offsets.to_numpy()
    return (offsets - offsets[0]).astype(np.int64), column.values.slice(offsets[0], offsets[-1] - offsets[0])


def _blocks(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with at most ``limit`` values in a list column, or one row."""
    for table in batches:
        offsets, first = table.column(column).offsets.to_numpy(), 0
        while first < table.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
            yield table.slice(first, last - first)
            first = last


def neighbours(bounds: np.ndarray, kinds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, kind before, kind) of all tokens: each text starts after an end and closes with one."""
    n, counts = len(bounds) - 1, np.diff(bounds)
    at = np.arange(len(kinds)) + np.repeat(np.arange(n), counts)
    stream = np.full(len(kinds) + n, end, np.int64)
    stream[at] = kinds
    before = np.empty_like(stream)
    before[:1], before[1:] = end, stream[:-1]
    return np.repeat(np.arange(n), counts + 1), before, stream


def h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, n_words: int, classes: int, passes: int) -> np.ndarray:
    """Classes 0.. for the first ``n_words`` kinds of a square table of bigram counts; other kinds have fixed classes.

    A step takes a word out of its class and puts it where the sum of n log n over class bigrams, less that over class
    counts, is largest.
    """
    kinds = len(bigrams)
    own = np.concatenate([np.arange(n_words) % classes, classes + np.arange(kinds - n_words)])
    total = classes + kinds - n_words
    member = np.zeros((kinds, total))
    member[np.arange(kinds), own] = 1
    grid = member.T @ bigrams @ member
    right_of, left_of = bigrams @ member, member.T @ bigrams  # kind x class, class x kind
    for _ in range(passes if n_words > 1 else 0):
        moved = 0
        for w in range(n_words):
            a, self_count = own[w], bigrams[w, w]
            right, left = right_of[w].copy(), left_of[:, w].copy()
            right[a] -= self_count
            left[a] -= self_count
            grid[a] -= right
            grid[:, a] -= left
            grid[a, a] -= self_count
            rows, columns = grid[:classes], grid[:, :classes].T
            gain = (h(rows + right) - h(rows)).sum(axis=1) + (h(columns + left) - h(columns)).sum(axis=1)
            k = np.arange(classes)
            corner = grid[k, k]
            gain += h(corner + right[k] + left[k] + self_count) - h(corner + right[k]) - h(corner + left[k]) + h(corner)
            out, into = (grid.sum(axis=1) + left)[:classes], (grid.sum(axis=0) + right)[:classes]
            gain -= h(out + right.sum() + self_count) - h(out) + h(into + left.sum() + self_count) - h(into)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            grid[b] += right
            grid[:, b] += left
            grid[b, b] += self_count
            if b != a:
                own[w], moved = b, moved + 1
                right_of[:, a] -= bigrams[:, w]
                right_of[:, b] += bigrams[:, w]
                left_of[a] -= bigrams[w]
                left_of[b] += bigrams[w]
        if not moved:
            break
    return own


def best_classes(grid: np.ndarray, classes: int, owner: np.ndarray, codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` words the class whose likelihood of class bigrams gains most by the word's bigrams.

    ``grid`` has the class bigrams so far. ``codes`` are those of :func:`_neighbour_counts`, ``owner`` their words.
    """
    total = len(grid)
    pair = codes >= 2 * total
    both = codes[pair] - 2 * total
    owner = np.concatenate([owner[~pair], owner[pair], owner[pair]])
    codes = np.concatenate([codes[~pair], both // total, total + both % total])
    counts = np.concatenate([counts[~pair], counts[pair], counts[pair]])
    base = np.vstack([grid[:, :classes], grid[:classes].T])  # class before, then class after, by class of the word
    known = h(base)
    diagonal = np.diagonal(grid)[:classes]
    best = np.zeros(n, np.int64)
    order = np.argsort(owner, kind="stable")
    owner, codes, counts = owner[order], codes[order], counts[order]
    for first in range(0, n, 250):
        m = min(250, n - first)
        part = slice(*np.searchsorted(owner, [first, first + m]))
        vectors = np.bincount((owner[part] - first) * 2 * total + codes[part], counts[part], minlength=m * 2 * total).reshape(m, 2 * total)
        word, code = np.nonzero(vectors)  # by word, then by code
        terms = h(base[code] + vectors[word, code][:, None]) - known[code]
        gain = np.zeros((m, classes))
        starts = np.searchsorted(word, np.arange(m))
        some = np.flatnonzero(np.diff(np.append(starts, len(word))))
        gain[some] = np.add.reduceat(terms, starts[some]) if len(some) else 0
        left, right = vectors[:, :classes], vectors[:, total : total + classes]
        size = vectors[:, :total].sum(axis=1, keepdims=True)
        gain += h(diagonal + left + right) - h(diagonal + left) - h(diagonal + right) + h(diagonal)
        out, into = grid.sum(axis=1)[:classes] + left, grid.sum(axis=0)[:classes] + right
        gain -= h(out + size) - h(out) + h(into + size) - h(into)
        best[first : first + m] = np.argmax(np.round(gain, 6), axis=1)
    return best


def _head_list(docs: DataFrame, settings: BrownSettings) -> np.ndarray:
    """Frequent words of about ``sample_rows`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            for _, texts in blocks(table.column(0)):
                found, counts = np.unique(words(texts, lower=True).hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], ["word", "n"])

    total = docs.count()
    sample = docs.select(settings.text_col).sample(min(1.0, settings.sample_rows / max(total, 1)), settings.seed)
    counted = sample.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(settings.head_words).toArrow()
    return np.sort(top["word"].to_numpy().astype(np.int64).view(np.uint64))


def _tokens(docs: DataFrame, held_out: Column, head: np.ndarray, settings: BrownSettings) -> DataFrame:
    """Per row: its words as places in the head list, or below zero in the row's own list of other words."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = Head(shared.value), TaskContext.get().partitionId() << 40
        for table in batches:
            for first, texts in blocks(table.column(1)):
                found, n = words(texts, lower=True), len(texts)
                places = own.find(found.hashes)
                other = np.flatnonzero(places < 0)
                other = other[np.lexsort((found.hashes[other], found.owner[other]))]
                owner, hashes = found.owner[other], found.hashes[other]
                new = np.ones(len(other), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
                at = np.flatnonzero(new)
                bounds = np.searchsorted(owner[at], np.arange(n + 1))
                places[other] = -1 - (np.cumsum(new) - 1 - bounds[owner])
                bounds = pa.array(bounds.astype(np.int32))
                columns = [
                    pa.array(row + np.arange(n)),
                    table.column(0).slice(first, n),
                    table.column(2).slice(first, n),
                    pa.ListArray.from_arrays(pa.array(found.bounds.astype(np.int32)), pa.array(places.astype(np.int32))),
                    pa.ListArray.from_arrays(bounds, pa.array(hashes[at].view(np.int64))),
                    pa.ListArray.from_arrays(bounds, pa.array(np.diff(np.append(at, len(other))).astype(np.int32))),
                ]
                row += n
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[settings.id_col].dataType.simpleString()
    schema = f"row long, id {kind}, held_out boolean, places array<int>, words array<long>, tfs array<int>"
    names = [x.split()[0] for x in schema.split(", ")]
    rows = docs.select(F.col(settings.id_col), F.col(settings.text_col), F.coalesce(held_out, F.lit(False)))
    return store(rows.mapInArrow(run, schema), "lm-tokens")


def _summed(rows: DataFrame, of_batch, size: int, settings: BrownSettings) -> np.ndarray:
    """Sums over all tasks of an array of a fixed size that ``of_batch`` makes of each block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for table in _blocks(batches, 0, settings.block_tokens):
            counts += of_batch(table)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "n"])

    found = rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[found["at"].to_numpy()] = found["n"].to_numpy()
    return counts


def _head_counts(train: DataFrame, n_head: int, settings: BrownSettings) -> tuple[np.ndarray, int, int]:
    """Counts of the head words, number of words, number of documents."""

    def of_batch(table: pa.RecordBatch) -> np.ndarray:
        places = _lists(table.column(0))[1].to_numpy()
        counts = np.bincount(places[places >= 0], minlength=n_head + 2)
        counts[-2:] = len(places), table.num_rows
        return counts

    counts = _summed(train.select("places"), of_batch, n_head + 2, settings)
    return counts[:-2], int(counts[-2]), int(counts[-1])


@dataclass
class Core:
    """The words that the exchange clusters: some in the head list, some not."""

    of_head: np.ndarray  # number of a head word among the core words, or -1
    others: np.ndarray  # sorted hashes of core words that are not in the head list
    of_others: np.ndarray  # their numbers
    counts: np.ndarray  # by number

    def of_tokens(self, table: pa.RecordBatch, missing: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bounds, places, numbers) of a batch of ``places`` and ``words``; all other words get ``missing``."""
        bounds, places = _lists(table.column(0))
        places = places.to_numpy()
        numbers = np.full(len(places), -1, np.int64)
        in_head = places >= 0
        numbers[in_head] = self.of_head[places[in_head]]
        if len(self.others):
            firsts, hashes = _lists(table.column(1))
            found = Head(self.others).find(hashes.to_numpy().view(np.uint64))
            found = np.where(found >= 0, self.of_others[found], -1)
            at = np.flatnonzero(~in_head)
            numbers[at] = found[_word_at(bounds, places, firsts, at)]
        return bounds, places, np.where(numbers < 0, missing, numbers)


def _word_at(bounds: np.ndarray, places: np.ndarray, firsts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the words of the tokens ``at``, which have places below zero, are in the rows' own lists."""
    owner = np.searchsorted(bounds, at, side="right") - 1
    return firsts[owner] - 1 - places[at]


def _choose_core(head: np.ndarray, counts: np.ndarray, tail: DataFrame, settings: BrownSettings) -> Core:
    """The most frequent words by exact counts, in the head list or not."""
    top = tail.orderBy(F.desc("n"), "word").limit(settings.class_words).toArrow()
    hashes = np.concatenate([head.view(np.int64), top["word"].to_numpy().astype(np.int64)])
    n = np.concatenate([counts, top["n"].to_numpy().astype(np.int64)])
    chosen = np.lexsort((hashes, -n))[: settings.class_words]
    chosen = chosen[n[chosen] > 0]
    of_head = np.full(len(head), -1, np.int64)
    numbers, is_head = np.arange(len(chosen)), chosen < len(head)
    of_head[chosen[is_head]] = numbers[is_head]
    others = hashes[chosen[~is_head]].view(np.uint64)
    order = np.argsort(others)
    return Core(of_head, others[order], numbers[~is_head][order], n[chosen])


def _bigrams(train: DataFrame, core: Core, settings: BrownSettings) -> np.ndarray:
    """Counts of neighbours among core words, other words and ends, over all training documents."""
    n = len(core.counts)
    shared = train.sparkSession.sparkContext.broadcast(core)

    def of_batch(table: pa.RecordBatch) -> np.ndarray:
        bounds, _, numbers = shared.value.of_tokens(table, n)
        _, before, kind = neighbours(bounds, numbers, n + 1)
        return np.bincount(before * (n + 2) + kind, minlength=(n + 2) ** 2)

    return _summed(train.select("places", "words"), of_batch, (n + 2) ** 2, settings).reshape(n + 2, n + 2).astype(np.float64)


def _neighbour_counts(train: DataFrame, core: Core, own: np.ndarray, n_head: int, settings: BrownSettings) -> DataFrame:
    """(in_head, word, code, n): how often a word that is not a core word has which classes beside it.

    Head words are known by their places and counted in the task, with a code for the class before and one, from
    ``classes + 2`` on, for the class after. Other words have one code for both, from twice that on.
    """
    n_core, total = len(core.counts), settings.classes + 2
    shared = train.sparkSession.sparkContext.broadcast((core, own))
    names = ["in_head", "word", "code", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, own = shared.value
        sums = np.zeros(n_head * 2 * total, np.int32)
        for table in _blocks(batches, 0, settings.block_tokens):
            bounds, places, numbers = core.of_tokens(table, n_core)
            _, before, kinds = neighbours(bounds, own[numbers], total - 1)
            at = np.flatnonzero(numbers == n_core)  # tokens of no core word; their places among tokens and ends:
            owner = np.searchsorted(bounds, at, side="right") - 1
            left, right, place = before[at + owner], kinds[at + owner + 1], places[at]
            in_head = place >= 0
            begin = place[in_head].astype(np.int64) * 2 * total
            found, n = np.unique(np.concatenate([begin + left[in_head], begin + total + right[in_head]]), return_counts=True)
            sums[found] += n.astype(np.int32)
            firsts, hashes = _lists(table.column(1))
            word = hashes.to_numpy()[_word_at(bounds, places, firsts, at[~in_head])]
            code = 2 * total + left[~in_head] * total + right[~in_head]
            order = np.lexsort((code, word))
            word, code = word[order], code[order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (code[1:] != code[:-1])
            new = np.flatnonzero(new)
            n = np.diff(np.append(new, len(word)))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(new), bool)), *map(pa.array, (word[new], code[new], n))], names)
        found = np.flatnonzero(sums)
        for first in range(0, len(found), 100_000):
            part = found[first : first + 100_000]
            columns = part // (2 * total), part % (2 * total), sums[part].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(part), bool)), *map(pa.array, columns)], names)

    return train.select("places", "words").mapInArrow(run, "in_head boolean, word long, code long, n long")


def _vocabulary(counts: DataFrame, grid: np.ndarray, settings: BrownSettings) -> DataFrame:
    """(in_head, word, n, class) of all words that are not core words; rare ones are in class ``classes``.

    One shuffle, by word: the sums by word and code, and by word, find their rows together.
    """
    classes, total = settings.classes, len(grid)
    by_code = counts.repartition("in_head", "word").groupBy("in_head", "word", "code").agg(F.sum("n").alias("n"))
    n = F.sum(F.when(F.col("code") < total, F.col("n")).when(F.col("code") >= 2 * total, F.col("n")).otherwise(0))
    by_word = by_code.groupBy("in_head", "word").agg(n.alias("n"), F.collect_list(F.struct("code", "n")).alias("codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            n = table.column(2).to_numpy()
            bounds, pairs = _lists(table.column(3))
            owner = np.repeat(np.arange(len(n)), np.diff(bounds))
            codes, k = (pairs.field(i).to_numpy() for i in (0, 1))
            known = n >= settings.min_count
            number, used = np.cumsum(known) - 1, known[owner]
            of_word = np.full(len(n), classes, np.int64)
            of_word[known] = best_classes(grid, classes, number[owner[used]], codes[used], k[used], int(known.sum()))
            yield pa.RecordBatch.from_arrays([*table.columns[:3], pa.array(of_word)], ["in_head", "word", "n", "class"])

    # rare words need no neighbours
    codes = F.when(F.col("n") >= settings.min_count, F.col("codes")).otherwise(F.slice("codes", 1, 0))
    found = by_word.select("in_head", "word", "n", codes.alias("codes"))
    return store(found.mapInArrow(run, "in_head boolean, word long, n long, class long"), "lm-vocabulary")


@dataclass
class BrownModel:
    """What tasks need to know: bounded by ``head_words`` and ``classes``."""

    counts: np.ndarray  # of head words in training documents
    word_class: np.ndarray  # of head words; ``classes`` for rare ones
    class_counts: np.ndarray  # words of training documents by class
    class_types: np.ndarray  # different words
    n_tokens: int
    n_ends: int

    @property
    def n_types(self) -> int:
        return int(self.class_types.sum()) + (self.n_ends > 0)


def fit_brown(train: DataFrame, head: np.ndarray, settings: BrownSettings = BrownSettings()) -> tuple[BrownModel, DataFrame]:
    """Classes of all words from rows of :func:`_tokens`: of head words in the model, of others as (word, n, class)."""
    classes, total, spark = settings.classes, settings.classes + 2, train.sparkSession
    counts, n_words, n_ends = _head_counts(train, len(head), settings)
    tail = train.select(F.explode(F.arrays_zip("words", "tfs")).alias("t")).groupBy(F.col("t.words").alias("word"))
    tail = store(tail.agg(F.sum("t.tfs").alias("n")), "lm-tail-counts")
    core = _choose_core(head, counts, tail, settings)
    table = _bigrams(train, core, settings)
    own = exchange(table, len(core.counts), classes, settings.passes)
    member = np.zeros((len(own), total))
    member[np.arange(len(own)), own] = 1
    vocabulary = _vocabulary(_neighbour_counts(train, core, own, len(head), settings), member.T @ table @ member, settings)

    word_class = np.full(len(head), classes, np.int64)
    further = vocabulary.filter("in_head").select("word", "class").toArrow()
    word_class[further["word"].to_numpy()] = further["class"].to_numpy()
    word_class[core.of_head >= 0] = own[core.of_head[core.of_head >= 0]]
    class_counts = np.bincount(own[: len(core.counts)], core.counts, minlength=classes + 1).astype(np.int64)
    class_types = np.bincount(own[: len(core.counts)], minlength=classes + 1)
    for r in vocabulary.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect():
        class_counts[r["class"]] += r["n"]
        class_types[r["class"]] += r["types"]
    others = zip(core.others.view(np.int64).tolist(), core.counts[core.of_others].tolist(), own[core.of_others].tolist())
    others = spark.createDataFrame(list(others), "word long, n long, class long")  # at most class_words rows
    tail_words = vocabulary.filter("NOT in_head").select("word", "n", "class").unionByName(others)
    return BrownModel(counts, word_class, class_counts, class_types, n_words + n_ends, n_ends), tail_words


def _classed(tokens: DataFrame, tail_words: DataFrame, model: BrownModel, settings: BrownSettings) -> DataFrame:
    """Per row: the classes of its words, and the sums that need no class bigrams.

    One shuffle by word and one by row. A word that the row cannot know otherwise comes back to it; one that is in class
    ``classes`` and has the least count possible (1 in a training document, 0 elsewhere) need not.
    """
    classes = settings.classes
    shared = tokens.sparkSession.sparkContext.broadcast(model)
    words_of = tokens.select("row", "held_out", F.posexplode("words").alias("at", "word"))
    least = F.when(F.col("held_out"), 0).otherwise(1)
    back = words_of.join(tail_words, "word").filter((F.col("n") != least) | (F.col("class") != classes))
    back = back.groupBy(F.col("row").alias("back_row")).agg(F.collect_list(F.struct("at", "n", "class")).alias("back"))
    joined = tokens.drop("tfs").join(back, F.col("row") == F.col("back_row"), "left")
    joined = joined.select("id", "held_out", "places", F.size("words").alias("k"), F.coalesce("back", F.array().cast("array<struct<at:int,n:bigint,class:bigint>>")).alias("back"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        emissions = np.zeros(classes + 1)
        some = model.class_counts[:classes] > 0
        emissions[:classes][some] = np.log10(model.class_counts[:classes][some])
        for table in _blocks(batches, 2, settings.block_tokens):
            held = table.column(1).to_numpy(zero_copy_only=False)
            k = table.column(3).to_numpy()
            bounds, places = _lists(table.column(2))
            places, n = places.to_numpy(), len(held)
            firsts = np.concatenate([[0], np.cumsum(k)])
            own_count, own_class = np.repeat(np.where(held, 0, 1), k).astype(np.int64), np.full(firsts[-1], classes, np.int64)
            back_bounds, back = _lists(table.column(4))
            at = np.repeat(firsts[:-1], np.diff(back_bounds)) + back.field(0).to_numpy()
            own_count[at], own_class[at] = back.field(1).to_numpy(), back.field(2).to_numpy()
            count, kind = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
            in_head = places >= 0
            count[in_head], kind[in_head] = model.counts[places[in_head]], model.word_class[places[in_head]]
            tail = np.flatnonzero(~in_head)
            word = _word_at(bounds, places, firsts, tail)
            count[tail], kind[tail] = own_count[word], own_class[word]
            owner, rare = np.repeat(np.arange(n), np.diff(bounds)), kind == classes
            logs = np.log10(count + 1.0)
            inside = np.where(rare, logs, np.log10(np.maximum(count, 1)) - emissions[kind])
            columns = [
                table.column(0),
                table.column(1),
                pa.array(np.diff(bounds) + 1),
                pa.array(np.bincount(owner, count > 0, minlength=n).astype(np.int64) + (model.n_ends > 0)),
                pa.array(_sums(owner, logs, n) + np.log10(model.n_ends + 1.0)),
                pa.array(_sums(owner, inside, n)),
                pa.array(np.bincount(owner, rare, minlength=n).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(kind.astype(np.int16))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "held_out boolean, n_tokens long, n_known long, base double, inside double, n_rare long, classes array<short>"
    names = ["id", *(x.split()[0] for x in schema.split(", "))]
    return store(joined.mapInArrow(run, f"id {tokens.schema['id'].dataType.simpleString()}, {schema}"), "lm-classes")


def score_documents(docs: DataFrame, held_out: Column, settings: BrownSettings = BrownSettings()) -> DataFrame:
    """Per row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``n_classed``.

    The model and the counts come from the rows that are not held out. Both scores are log10 probabilities; ``n_classed``
    counts the tokens that are not in the class of rare words.
    """
    head = _head_list(docs.filter(~F.coalesce(held_out, F.lit(False))), settings)
    tokens = _tokens(docs, held_out, head, settings)
    model, tail_words = fit_brown(tokens.filter("NOT held_out"), head, settings)
    rows = _classed(tokens, tail_words, model, settings)

    total, end = settings.classes + 2, settings.classes + 1

    def of_batch(table: pa.RecordBatch) -> np.ndarray:
        bounds, kinds = _lists(table.column(0))
        _, before, kind = neighbours(bounds, kinds.to_numpy().astype(np.int64), end)
        return np.bincount(before * total + kind, minlength=total**2)

    grid = _summed(rows.filter("NOT held_out").select("classes"), of_batch, total**2, settings).reshape(total, total)
    transitions = np.log10((grid + settings.smoothing) / (grid.sum(axis=1, keepdims=True) + settings.smoothing * total))
    base_size = float(np.log10(model.n_tokens + model.n_types + 1.0))
    rare_size = float(np.log10(int(model.class_counts[settings.classes]) + int(model.class_types[settings.classes]) + 1.0))
    n_train = int(model.n_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, 7, settings.block_tokens):
            bounds, kinds = _lists(table.column(7))
            n_tokens, base, inside, n_rare = (table.column(i).to_numpy() for i in (2, 4, 5, 6))
            text, before, kind = neighbours(bounds, kinds.to_numpy().astype(np.int64), end)
            score = _sums(text, transitions[before, kind], table.num_rows) + inside - n_rare * rare_size
            columns = [pa.array(x) for x in (np.full(len(base), n_train), base - n_tokens * base_size, score, n_tokens - n_rare)]
            yield pa.RecordBatch.from_arrays([*table.columns[:4], *columns], names)

    names = [settings.id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_classed"]
    kind = docs.schema[settings.id_col].dataType.simpleString()
    schema = f"`{settings.id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_classed long"
    return rows.mapInArrow(run, schema)
