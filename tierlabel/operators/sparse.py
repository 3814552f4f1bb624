"""Texts against a reference side of sparse weighted tokens: the best reference of each text.

Items stay where they are and need no key. The references pass by in blocks whose size is measured in bytes, each broadcast as
arrays of numbers (a token is its 64-bit hash), and each row keeps the best reference so far. A block also has the
highest weight per token: from it follows a bound on every score that a text can get in the block, and texts whose best
score so far reaches the bound are not compared with it. Blocks come in the order of the reference ids, and equal scores go to the
lowest id, so the result is the same at every block size.

A reference that would fill a good part of a block by itself is not put into blocks: such wide references are cut by pieces of the
vocabulary, which lie in the shared folder, and each task adds up the scores of the texts that it holds piece by piece.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator, Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlabel.operators.dense import DECIMALS, PASSES, token_slices
from tierlabel.operators.groups import running_sums
from tierlabel.operators.pieces import CountedTexts, number_of_pieces, piece_of, read_cell, read_vocabulary, store_vocabulary, weights_by_count
from tierlabel.operators.tfidf import TfidfSettings
from tierlabel.session import cut_lineage, scratch_path
from tierlabel.sources.folders import kept_until_the_end

BIAS = ""  # no text has an empty token, so this one can carry a constant
BLOCK_BYTES = 64_000_000  # of a broadcast block
IDF_BYTES = 16  # of a token's hash and idf
POSTING_BYTES = 32  # of a posting, with the hash, idf and highest weight of a token that no other posting has
SCORE_CELLS = 1_000_000  # scores and postings held at once while a block is compared
WIDE = 4  # references of which fewer than this fit a block are cut into pieces
WIDE_CLASSES = 16  # references whose scores are added up at once, at most
WIDE_CELLS = 250_000  # weights of a piece: terms x references
HELD_BYTES = 16 << 20  # texts that a task holds while the pieces pass by
KNOWN_TEXTS = 50_000  # texts whose best reference a task remembers


@dataclass
class Block:
    """Some references, by token: for each token those that hold it, and their weights."""

    ids: pa.Array  # in rising order
    keys: np.ndarray  # token hashes in rising order
    idf: np.ndarray
    starts: np.ndarray
    refs: np.ndarray
    weights: np.ndarray
    top: np.ndarray  # per token its highest weight, at least 0, which a reference without the token has
    bias: np.ndarray  # per reference

    @classmethod
    def build(cls, rows: pa.Table, idf: pa.Table) -> Block:
        """From ``rows(ref, key, weight)``, key null for the constant, and ``idf(key, idf)`` of at least their tokens."""
        ref = rows["ref"].combine_chunks().dictionary_encode()
        order = pa.compute.array_sort_indices(ref.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        number, weight = place[ref.indices.to_numpy()], rows["weight"].to_numpy()
        constant = rows["key"].is_null().to_numpy()
        bias = np.zeros(len(order))
        bias[number[constant]] = weight[constant]
        by_key = np.argsort(idf["key"].to_numpy())
        keys = idf["key"].to_numpy()[by_key]
        term = np.searchsorted(keys, rows["key"].drop_null().to_numpy())
        number, weight = number[~constant], weight[~constant]
        by_term = np.argsort(term, kind="stable")
        top = np.zeros(len(keys))
        np.maximum.at(top, term, weight)
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(keys)))]).astype(np.int64)
        return cls(
            ref.dictionary.take(order), keys, idf["idf"].to_numpy()[by_key], starts, number[by_term].astype(np.int32), weight[by_term], top, bias
        )

    def best(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Best reference place and rounded score of rows 0..n-1, given their terms sorted by row.

        Equal scores go to the lowest reference id, so a row without terms gets the first reference.
        Rows are taken in groups whose scores and postings stay within a bounded size.
        """
        width = len(self.ids)
        length = self.starts[term + 1] - self.starts[term]
        cost = np.cumsum(np.bincount(row, weights=length, minlength=n) + width)
        best, score = np.empty(n, dtype=np.int64), np.empty(n)
        at = 0
        while at < n:
            done = cost[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(cost, done + SCORE_CELLS, side="right")))
            lo, hi = np.searchsorted(row, [at, to])
            size = length[lo:hi]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            posting = np.repeat(self.starts[term[lo:hi]], size) + inside
            cell = np.repeat(row[lo:hi] - at, size) * width + self.refs[posting]
            product = np.repeat(weight[lo:hi], size) * self.weights[posting]
            table = np.bincount(cell, weights=product, minlength=(to - at) * width).reshape(to - at, width)
            table = np.round(table + self.bias, DECIMALS) + 0.0
            best[at:to] = table.argmax(axis=1)
            score[at:to] = table[np.arange(to - at), best[at:to]]
            at = to
        return best, score

    def bounds(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """No reference of the block gives a row a higher rounded score than this."""
        slack = 2.0 * 10.0**-DECIMALS
        return np.bincount(row, weights=weight * self.top[term], minlength=n) + self.bias.max(initial=0.0) + slack


def _term_weights(batch: list[np.ndarray], keys: np.ndarray, idf: np.ndarray, sublinear: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of lists of token hashes as (row, term, weight), sorted by row; unknown tokens are dropped."""
    row = np.repeat(np.arange(len(batch)), [len(b) for b in batch])
    flat = np.concatenate([np.empty(0, np.int64), *batch]).astype(np.int64)
    if not len(keys) or not len(flat):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    term = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
    hit = keys[term] == flat
    key, tf = np.unique(row[hit] * len(keys) + term[hit], return_counts=True)
    row, term = key // len(keys), key % len(keys)
    return row, term, (np.log(tf) + 1.0 if sublinear else tf.astype(np.float64)) * idf[term]


def _parts_of_norm(row: np.ndarray, weight: np.ndarray, n: int, norm: str | None) -> np.ndarray:
    """What some terms add to the squared (or, for l1, plain) length of their rows."""
    return np.bincount(row, weights=weight * weight if norm == "l2" else np.abs(weight), minlength=n)


def _divisor(parts: np.ndarray, norm: str | None) -> np.ndarray:
    if norm is None:
        return np.ones(len(parts))
    length = np.sqrt(parts) if norm == "l2" else parts
    return np.where(length > 0, length, 1.0)


def _hashed(text: Column, settings: TfidfSettings) -> Column:
    return F.transform(settings.tokens(text), lambda token: F.xxhash64(token))


def _bytes_of(vectors: DataFrame, ref_id: str) -> DataFrame:
    """``(ref_id, bytes)`` that a reference takes in a block."""
    id_bytes = F.octet_length(F.col(ref_id).cast("string")) + 16
    return vectors.groupBy(ref_id).agg((F.count(F.lit(1)) * POSTING_BYTES + F.max(id_bytes)).alias("bytes"))


def _measured(vectors: DataFrame, idf: DataFrame, ref_id: str) -> tuple[int, int, int]:
    """Bytes of all references, of the largest one, and of the idf."""
    total = (F.coalesce(f("bytes"), F.lit(0)) for f in (F.sum, F.max))
    return *_bytes_of(vectors, ref_id).agg(*total).first(), idf.count() * IDF_BYTES


def _blocks(
    vectors: DataFrame, idf: DataFrame, ref_id: str, block_bytes: int, measured: tuple[int, int, int] | None = None
) -> tuple[list[pa.Table] | None, Iterator[Block]]:
    """Blocks of the references in the order of their ids; first, if the idf does not fit with them, the idf in pieces.

    ``vectors(ref, token, weight)`` and ``idf(key, idf)``. The sizes are measured by Spark before anything is collected.
    """
    ref_bytes, _, idf_bytes = measured or _measured(vectors, idf, ref_id)
    key = F.when(F.col("token") != BIAS, F.xxhash64("token")).alias("key")
    keyed = vectors.select(F.col(ref_id).alias("ref"), key, F.col("weight").cast("double").alias("weight"))
    if ref_bytes + idf_bytes <= block_bytes:
        return None, iter([Block.build(keyed.toArrow(), idf.toArrow())])
    n_pieces = math.ceil(idf_bytes / block_bytes)
    pieces = (idf.filter(F.pmod("key", F.lit(n_pieces)) == i).toArrow() for i in range(n_pieces))
    places = running_sums(_bytes_of(vectors, ref_id), [], [F.asc(ref_id)], {"upto": F.col("bytes")})
    block = F.floor((F.col("upto") - F.col("bytes")) / F.lit(block_bytes)).cast("long").alias("block")
    numbered = places.select(F.col(ref_id).alias("ref"), block)
    own = cut_lineage(keyed.join(numbered, "ref").join(idf, "key", "left"))

    def each() -> Iterator[Block]:
        for r in own.select("block").distinct().orderBy("block").collect():
            rows = own.filter(F.col("block") == r.block).select("ref", "key", "weight", "idf").toArrow()
            tokens = rows.select(["key", "idf"]).drop_null().group_by("key").aggregate([("idf", "min")]).rename_columns(["key", "idf"])
            yield Block.build(rows, tokens)

    return pieces, each()


def best_reference(
    items: DataFrame,
    text: str,
    settings: TfidfSettings,
    idf: DataFrame,
    vectors: DataFrame,
    ref_id: str,
    block_bytes: int = BLOCK_BYTES,
    skipped: Accumulator | None = None,
) -> DataFrame:
    """Items with ``__ref`` and ``__score``: the reference of highest dot product with the text's TF-IDF vector.

    ``vectors(ref_id, token, weight)`` are the references; their empty token, if any, is a constant that every text has once.
    Equal texts of one Arrow batch are scored once. A block holds whole references, as many as ``block_bytes`` hold; wide ones are cut.
    ``skipped`` counts the texts that did not have to be compared with a block.
    """
    measured = _measured(vectors, idf, ref_id)
    if measured[0] + measured[2] > block_bytes and measured[1] * WIDE > block_bytes:
        return _best_of_wide(items, text, settings, idf, vectors, ref_id)
    return BlockSearch.prepare(settings, idf, vectors, ref_id, block_bytes, measured).search(items, text, skipped)


def _best_of_wide(items: DataFrame, text: str, settings: TfidfSettings, idf: DataFrame, vectors: DataFrame, ref_id: str) -> DataFrame:
    """As ``best_reference``, for references with many tokens each.

    Their weights lie in the shared folder as matrices, a piece of the vocabulary times some references. A task holds texts of a
    bounded number of bytes, adds up their scores piece by piece, and keeps the best reference so far.
    """
    spark = items.sparkSession
    constant = F.max(F.when(F.col("token") == BIAS, F.col("weight").cast("double")))
    refs = vectors.groupBy(ref_id).agg(F.coalesce(constant, F.lit(0.0)).alias("bias")).orderBy(ref_id).collect()
    ids, biases = [r[0] for r in refs], np.array([r[1] for r in refs])
    width = min(len(ids), WIDE_CLASSES)
    n_pieces = number_of_pieces(idf.count(), max(1, WIDE_CELLS // width))
    folder = kept_until_the_end(spark, scratch_path(spark, "references"))
    vocabulary, wide = f"{folder}/vocabulary", f"{folder}/weights"
    store_vocabulary(idf, n_pieces, vocabulary)

    def pack(rows: pa.Table) -> pa.Table:
        g, p = rows["g"][0].as_py(), rows["p"][0].as_py()
        keys, term_idf = read_vocabulary(vocabulary, p, "keys"), read_vocabulary(vocabulary, p, "idf")
        matrix = np.zeros((min(width, len(ids) - g * width), len(keys)))
        if len(keys):
            term = np.minimum(np.searchsorted(keys, rows["key"].to_numpy()), len(keys) - 1)
            hit = keys[term] == rows["key"].to_numpy()
            np.add.at(matrix, (rows["n"].to_numpy()[hit] - g * width, term[hit]), rows["weight"].to_numpy()[hit] * term_idf[term[hit]])
        return pa.table([pa.array([g], pa.int64()), pa.array([p], pa.int64()), pa.array([matrix.tobytes()], pa.binary())], names=["g", "p", "weights"])

    numbers = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("n", T.LongType()), T.StructField("__id", vectors.schema[ref_id].dataType)]))
    numbered = vectors.filter(F.col("token") != BIAS).join(numbers, F.col(ref_id) == F.col("__id"))
    keyed = numbered.select(F.floor(F.col("n") / F.lit(width)).alias("g"), "n", F.xxhash64("token").alias("key"), F.col("weight").cast("double").alias("weight"))
    packed = keyed.withColumn("p", piece_of(F.col("key"), n_pieces)).groupBy("g", "p").applyInArrow(pack, "g long, p long, weights binary")
    packed.write.partitionBy("g", "p").option("compression", "zstd").parquet(wide)

    hit_type = T.StructType([T.StructField("ref", vectors.schema[ref_id].dataType), T.StructField("score", T.DoubleType())])
    limit = HELD_BYTES

    def scores_of(held: list[CountedTexts]) -> list[tuple[np.ndarray, np.ndarray]]:
        norms = [np.zeros(t.n) for t in held]
        found = [(np.zeros(t.n, np.int64), np.full(t.n, -np.inf)) for t in held]
        for first in range(0, len(ids), width):
            sums = [np.zeros((min(width, len(ids) - first), t.n)) for t in held]
            for p in range(n_pieces):
                keys, term_idf = read_vocabulary(vocabulary, p, "keys"), read_vocabulary(vocabulary, p, "idf")
                stored = read_cell(wide, "weights", g=first // width, p=p)
                weights = () if stored is None else np.frombuffer(stored.as_buffer()).reshape(-1, len(keys))
                for t, norm, total in zip(held, norms, sums):
                    terms, counts, row, tf = t.known(p, keys)
                    weight, each = weights_by_count(int(tf.max(initial=0)), settings.sublinear_tf)[tf], np.repeat(terms.astype(np.intp), counts)
                    row = row.astype(np.intp)
                    if not first:
                        norm += _parts_of_norm(row, weight * term_idf[each], t.n, settings.norm)
                    for k, w in enumerate(weights):
                        total[k] += np.bincount(row, weights=w[each] * weight, minlength=t.n)
            for norm, total, (best, score) in zip(norms, sums, found):
                total = np.round(total / _divisor(norm, settings.norm) + biases[first : first + width, None], DECIMALS) + 0.0
                top = total.argmax(axis=0)
                better = total[top, np.arange(len(top))] > score
                best[better], score[better] = first + top[better], total[top[better], np.flatnonzero(better)]
        return found

    @F.pandas_udf(hit_type)
    def search(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def meet() -> Iterator[pd.DataFrame]:
            found = iter(scores_of([t for _, texts in held for t in texts]))
            for places, texts in held:
                parts = [next(found) for _ in texts]
                best, score = (np.concatenate([x[i] for x in parts])[places] if parts else np.empty(0) for i in range(2))
                yield pd.DataFrame({"ref": pd.Series([ids[int(i)] for i in best], dtype=object), "score": score})

        for same, tokens in batches:
            places, texts = pd.factorize(same)
            asked = tokens.iloc[np.unique(places, return_index=True)[1]]
            length = asked.map(len).to_numpy(dtype=np.int64)
            slices = [(at, to, np.concatenate([np.empty(0, np.int64), *asked.iloc[at:to]]).astype(np.int64)) for at, to in token_slices(length)]
            held.append((places, [CountedTexts.of(length[at:to], flat, n_pieces) for at, to, flat in slices]))
            size += sum(t.nbytes + 8 * width * t.n for t in held[-1][1])
            if size >= limit:
                yield from meet()
                held, size = [], 0
        if held:
            yield from meet()

    shown = F.coalesce(F.col(text), F.lit(""))
    rows = items.withColumn("__hit", search(F.xxhash64(shown), _hashed(shown, settings)))
    return rows.select(*items.columns, F.col("__hit.ref").alias("__ref"), F.col("__hit.score").alias("__score"))


@dataclass
class Labels:
    """Text columns per reference, broadcast. A text without any known token gets those of the reference ``first``."""

    columns: tuple[str, ...]
    rows: Broadcast
    first: object

    def of(self, refs: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        asked = refs.copy()
        asked[~(scores > 0)] = self.first
        found = self.rows.value.reindex(pd.Index(asked.tolist())).reset_index(drop=True).astype(object)
        return found.where(found.notna(), None)


@dataclass
class BlockSearch:
    """A reference side that has been measured; what fits one block is broadcast once and serves any number of searches."""

    settings: TfidfSettings
    ref_type: T.DataType
    whole: object | None  # the broadcast block, if all fits one
    blocks: Callable[[], tuple[list[pa.Table] | None, Iterator[Block]]]
    context: object

    @classmethod
    def prepare(
        cls, settings: TfidfSettings, idf: DataFrame, vectors: DataFrame, ref_id: str, block_bytes: int = BLOCK_BYTES, measured: tuple[int, int, int] | None = None
    ) -> BlockSearch:
        hashed = idf.select(F.xxhash64("token").alias("key"), "idf")
        context = vectors.sparkSession.sparkContext
        pieces, blocks = _blocks(vectors, hashed, ref_id, block_bytes, measured)
        whole = context.broadcast(next(blocks)) if pieces is None else None
        again = lambda: _blocks(vectors, hashed, ref_id, block_bytes, measured)
        return cls(settings, vectors.schema[ref_id].dataType, whole, again, context)

    def search(self, items: DataFrame, text: str, skipped: Accumulator | None = None, labels: Labels | None = None) -> DataFrame:
        """Items with ``__ref``, ``__score`` and, if all references fit one block, the columns of ``labels`` as ``__<column>``."""
        settings, context = self.settings, self.context
        if labels is not None and self.whole is None:
            raise ValueError("labels need references that all fit one block")
        names = labels.columns if labels is not None else ()
        hit = T.StructType([T.StructField("ref", self.ref_type), T.StructField("score", T.DoubleType())])
        for c in names:
            hit = hit.add(c, T.StringType())
        shown = F.coalesce(F.col(text), F.lit(""))
        hashes, same = _hashed(shown, settings), F.xxhash64(shown)
        start = F.struct(F.lit(None).cast(self.ref_type).alias("ref"), F.lit(float("-inf")).alias("score"))
        rows = items.withColumn("__hit", start)
        if self.whole is None:
            pieces, blocks = self.blocks()
            rows = rows.withColumn("__norm", F.lit(0.0))
            for i, piece in enumerate(pieces if settings.norm else ()):
                rows = rows.withColumn("__norm", F.col("__norm") + self._norms(context.broadcast(piece))(hashes))
                rows = cut_lineage(rows) if i % PASSES == PASSES - 1 else rows
            norm, shared = F.col("__norm"), (context.broadcast(b) for b in blocks)
        else:
            norm, shared = F.lit(None).cast("double"), iter([self.whole])
        while group := list(islice(shared, PASSES)):
            search = self._search(group, hit, skipped, labels)
            rows = rows.withColumn("__hit", search(same, hashes, norm, F.col("__hit.ref"), F.col("__hit.score")))
            rows = cut_lineage(rows) if len(group) == PASSES else rows
        found = [F.col("__hit.ref").alias("__ref"), F.col("__hit.score").alias("__score")]
        return rows.select(*items.columns, *found, *[F.col(f"__hit.{c}").alias(f"__{c}") for c in names])

    def _norms(self, shared) -> Callable:
        settings = self.settings

        @F.pandas_udf(T.DoubleType())
        def norms(tokens: pd.Series) -> pd.Series:
            piece = shared.value.sort_by("key")
            row, _, weight = _term_weights(tokens.to_list(), piece["key"].to_numpy(), piece["idf"].to_numpy(), settings.sublinear_tf)
            return pd.Series(_parts_of_norm(row, weight, len(tokens), settings.norm))

        return norms

    def _search(self, group: list, hit: T.StructType, skipped: Accumulator | None, labels: Labels | None) -> Callable:
        """The blocks of a group pass by in one Python worker, for texts of a bounded number of tokens at a time.

        The worker remembers a bounded number of texts with their best references, so that a task compares equal texts once.
        """
        settings, limit = self.settings, KNOWN_TEXTS

        def compare(block: Block, tokens: list[np.ndarray], norm: np.ndarray, ref: np.ndarray, score: np.ndarray) -> None:
            n = len(tokens)
            row, term, weight = _term_weights(tokens, block.keys, block.idf, settings.sublinear_tf)
            if n and np.isnan(norm[0]):  # the block has the whole vocabulary
                norm = _parts_of_norm(row, weight, n, settings.norm)
            weight = weight / _divisor(norm, settings.norm)[row]
            live = block.bounds(row, term, weight, n) > score if len(block.ids) else np.zeros(n, bool)
            if skipped is not None:
                skipped.add(int(n - live.sum()))
            number = np.cumsum(live) - 1
            kept = live[row]
            best, found = block.best(number[row[kept]], term[kept], weight[kept], int(live.sum()))
            better = np.zeros(n, bool)
            better[live] = found > score[live]
            ref[better] = np.array(block.ids.take(pa.array(best[better[live]])).to_pylist(), dtype=object)
            score[better] = found[better[live]]

        @F.pandas_udf(hit)
        def search(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            known: dict[int, tuple] = {}
            for same, tokens, norm, ref, score in batches:
                places, texts = pd.factorize(same)
                texts, first = texts.tolist(), np.unique(places, return_index=True)[1]
                refs, scores = ref.iloc[first].to_numpy(dtype=object, copy=True), score.iloc[first].to_numpy(dtype=np.float64, copy=True)
                new = np.array([t not in known for t in texts], bool)
                for i in np.flatnonzero(~new):
                    refs[i], scores[i] = known[texts[i]]
                asked, norms = tokens.iloc[first[new]], norm.iloc[first[new]].to_numpy(dtype=np.float64)
                new_refs, new_scores = refs[new], scores[new]
                for at, to in token_slices(asked.map(len).to_numpy(dtype=np.int64)):
                    given = asked.iloc[at:to].to_list()
                    for shared in group:
                        compare(shared.value, given, norms[at:to], new_refs[at:to], new_scores[at:to])
                refs[new], scores[new] = new_refs, new_scores
                if len(known) + len(new_refs) > limit:
                    known.clear()
                known.update((texts[i], (refs[i], scores[i])) for i in np.flatnonzero(new)[:limit])
                found = pd.DataFrame({"ref": refs, "score": scores})
                if labels is not None:
                    found = pd.concat([found, labels.of(refs, scores)], axis=1)
                yield found.take(places).reset_index(drop=True)

        return search
