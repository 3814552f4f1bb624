"""A vocabulary in pieces that lie in the shared folder, and texts that meet one piece after the other.

A piece has the tokens of one range of 64-bit hashes, in the order of the hashes. A task holds texts of a bounded number of bytes
by their tokens, in the same order, and reads the pieces in turn; so nothing that it holds grows with the vocabulary.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_of_pieces(n_terms: int, piece_terms: int) -> int:
    return max(1, math.ceil(n_terms / piece_terms))


def piece_of(key: Column, n_pieces: int) -> Column:
    """The piece of a token's hash."""
    return F.shiftright((F.shiftright(key, 32) + F.lit(1 << 31)) * F.lit(n_pieces), 32)


def pieces_of(keys: np.ndarray, n_pieces: int) -> np.ndarray:
    return (((keys >> 32) + (1 << 31)) * n_pieces) >> 32


def read_cell(folder: str, column: str, **place: int) -> pa.Scalar | None:
    """A value of the one row that a table in the shared folder has at a place, read in a task; None if it has no such row."""
    system, root = pafs.FileSystem.from_uri(folder)
    path = "/".join([root, *(f"{name}={value}" for name, value in place.items())])
    for found in system.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if found.path.endswith(".parquet"):
            with system.open_input_file(found.path) as file:
                return pq.ParquetFile(file).read(columns=[column], use_threads=False)[column][0]
    return None


def store_vocabulary(idf: DataFrame, n_pieces: int, path: str) -> list[int]:
    """Write the pieces of ``idf(token, idf)``; how many terms each has."""
    keyed = idf.select(F.xxhash64("token").alias("key"), F.col("idf").cast("double").alias("idf"))

    def pack(rows: pa.Table) -> pa.Table:
        keys, first = np.unique(rows["key"].to_numpy(), return_index=True)
        values = rows["idf"].to_numpy()[first]
        columns = [rows["p"].combine_chunks()[:1], pa.array([len(keys)], pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())]
        return pa.table(columns, names=["p", "size", "keys", "idf"])

    packed = keyed.withColumn("p", piece_of(F.col("key"), n_pieces)).groupBy("p").applyInArrow(pack, "p long, size long, keys binary, idf binary")
    packed.write.partitionBy("p").option("compression", "zstd").parquet(path)
    stored = idf.sparkSession.read.schema("size long, p long").parquet(path)
    found = {r.p: r["size"] for r in stored.collect()}
    return [found.get(p, 0) for p in range(n_pieces)]


def read_vocabulary(path: str, p: int, column: str) -> np.ndarray:
    """The hashes (``keys``) or the ``idf`` of a piece, read in a task."""
    packed = read_cell(path, column, p=p)
    kind = np.int64 if column == "keys" else np.float64
    return np.empty(0, kind) if packed is None else np.frombuffer(packed.as_buffer(), kind)


def weights_by_count(most: int, sublinear: bool) -> np.ndarray:
    """The weight of a token that a text has 0, 1, .. ``most`` times, without its idf."""
    tf = np.arange(most + 1, dtype=np.float64)
    return np.log(np.maximum(tf, 1.0)) + 1.0 if sublinear else tf


def smallest(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the shortest type that holds them."""
    return values.astype(np.min_scalar_type(values.max(initial=0)))


@dataclass
class CountedTexts:
    """Texts 0..n-1 by token: distinct hashes in rising order, how many texts have each, these texts, and how often they have it."""

    n: int
    keys: np.ndarray
    counts: np.ndarray
    row: np.ndarray
    tf: np.ndarray
    first: np.ndarray  # of each token's texts
    bounds: np.ndarray  # of each piece's tokens

    @classmethod
    def of(cls, length: np.ndarray, tokens: np.ndarray, n_pieces: int) -> CountedTexts:
        """From each text's number of tokens, and the hashes of all of them in a row."""
        order = np.argsort(tokens, kind="stable")
        key, row = tokens[order], np.repeat(np.arange(len(length)), length)[order]
        other_key = np.ones(len(key), bool)
        other_key[1:] = key[1:] != key[:-1]
        other = other_key.copy()
        other[1:] |= row[1:] != row[:-1]
        start = np.flatnonzero(other)
        fresh = np.flatnonzero(other_key[start])
        keys, counts = key[start[fresh]], np.diff(fresh, append=len(start))
        first = np.concatenate([[0], np.cumsum(counts)])
        bounds = np.searchsorted(pieces_of(keys, n_pieces), np.arange(n_pieces + 1))
        tf = np.diff(start, append=len(key))
        return cls(len(length), keys, smallest(counts), smallest(row[start]), smallest(tf), first, bounds)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.counts, self.row, self.tf, self.first))

    def known(self, p: int, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of piece ``p`` that its vocabulary has: their places in it, numbers of texts, these texts, and their counts."""
        lo, hi = self.bounds[p], self.bounds[p + 1]
        keys, counts = self.keys[lo:hi], self.counts[lo:hi]
        row, tf = self.row[self.first[lo] : self.first[hi]], self.tf[self.first[lo] : self.first[hi]]
        if not len(vocabulary):
            return np.empty(0, np.int32), counts[:0], row[:0], tf[:0]
        terms = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1).astype(np.int32)
        hit = vocabulary[terms] == keys
        if not hit.all():
            each = np.repeat(hit, counts)
            terms, counts, row, tf = terms[hit], counts[hit], row[each], tf[each]
        return terms, counts, row, tf
