"""Dense vectors: hashed text encoder, wide and array forms, cosine scores and nearest references."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlabel.functions.text import tokens
from tierlabel.operators.blocks import BROADCAST_CELLS, SCORE_CELLS, cells
from tierlabel.operators.groups import renumber_ids
from tierlabel.session import cut_lineage

TOKEN_SLICE = 250_000  # token hashes worked on at once
PASSES = 8  # blocks that pass by in one stage
DECIMALS = 9  # scores are rounded before they are compared, so that the order of a sum cannot change a rank


# --- encoder and storage forms ------------------------------------------------------------------------


def token_slices(length: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows of about ``TOKEN_SLICE`` tokens at a time, at least one, given their numbers of tokens."""
    upto = np.cumsum(length)
    at = 0
    while at < len(length):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TOKEN_SLICE, side="right")))
        yield at, to
        at = to


def hashed_encoder(
    text: Column, dim: int = 64, analyzer: str = "char_wb", ngram_range: tuple[int, int] = (3, 3)
) -> Column:
    """A unit vector of signed token counts by feature hashing; all zeros for a text without tokens.

    Tokens and their hashes are made by Spark; only a small number per token, bucket and sign, goes to Python, where a slice of
    a batch is counted at once. Both come from the first 60 bits of the token's MD5, so other engines can redo it.
    """
    found = F.coalesce(tokens(text, analyzer, ngram_range), F.array().cast("array<string>"))
    digits = -(-dim.bit_length() // 4) if dim & (dim - 1) == 0 else 15  # for a power of two the last ones of the 15 decide
    kind = "tinyint" if dim <= 64 else "smallint" if dim <= 1 << 14 else "long"
    places = F.transform(
        found, lambda t: (F.conv(F.substring(F.md5(t), 16 - digits, digits), 16, 10).cast("long") % (2 * dim)).cast(kind)
    )

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def count(batch: pd.Series) -> pd.Series:
        length = batch.map(len).to_numpy(dtype=np.int64)
        found = np.empty((len(batch), dim), np.float32)
        for at, to in token_slices(length):
            n = to - at
            row = np.repeat(np.arange(n), length[at:to])
            flat = np.concatenate(batch.iloc[at:to].to_list()).astype(np.int64)
            sign = 1.0 - 2.0 * ((flat // dim) % 2)
            table = np.bincount(row * dim + flat % dim, weights=sign, minlength=n * dim).reshape(n, dim)
            found[at:to] = unit_rows(table)
        return pd.Series(list(found))

    return count(places)


def create_embeddings(
    df: DataFrame,
    text: str,
    id_col: str = "id",
    prefix: str = "embed_",
    dim: int = 64,
    encoder: Callable[[list[str]], np.ndarray] | None = None,
) -> DataFrame:
    """``(id, embed_0 .. embed_{dim-1})`` for a text column.

    ``encoder`` turns a list of texts into a matrix and runs once per Arrow batch, with nothing shared
    between batches; without one the hashed encoder is used.
    """
    if encoder is None:
        vectors = df.select(id_col, hashed_encoder(F.col(text), dim).alias("vector"))
    else:
        schema = T.StructType([df.schema[id_col], T.StructField("vector", T.ArrayType(T.FloatType()))])

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                matrix = np.asarray(encoder(batch[text].tolist()), dtype=np.float32)
                yield pd.DataFrame({id_col: batch[id_col], "vector": list(matrix)})

        vectors = df.select(id_col, text).mapInPandas(encode, schema)
    return unpack_vector(vectors, "vector", dim, prefix)


def unpack_vector(df: DataFrame, vector: str, dim: int, prefix: str = "embed_") -> DataFrame:
    """Array column to one column per dimension."""
    wide = [F.get(vector, F.lit(i)).alias(f"{prefix}{i}") for i in range(dim)]
    return df.select(*[c for c in df.columns if c != vector], *wide)


def pack_vector(df: DataFrame, vector: str = "vector", prefix: str = "embed_") -> DataFrame:
    """One column per dimension to an array column."""
    wide = sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    return df.select(*[c for c in df.columns if c not in set(wide)], F.array(*[F.col(f"`{c}`") for c in wide]).alias(vector))


# --- comparison ---------------------------------------------------------------------------------------


def unit_rows(table: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row stays zero."""
    norm = np.sqrt((table * table).sum(axis=1, keepdims=True))
    return table / np.where(norm == 0, 1.0, norm)


def unit_matrix(vectors: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """An Arrow column of equally long vectors as a matrix of unit rows in double precision.

    Vectors of different lengths, or not of length ``dim``, and vectors with nulls inside are errors.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if not len(vectors):
        return np.empty((0, dim or 0))
    lengths = set(vectors.value_lengths().to_pylist())
    if len(lengths) > 1 or (dim is not None and lengths != {dim}):
        raise ValueError(f"vectors must all have length {dim or min(lengths)}, found {sorted(lengths)}")
    flat = vectors.flatten()
    if flat.null_count:
        raise ValueError("a vector holds a null")
    return unit_rows(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1))


def _best_k(scores: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the ``k`` highest scores per row, equal ones from left to right."""
    if k == 1:
        return scores.argmax(axis=1)[:, None]
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def collect_block(refs: DataFrame, order: str, vector: str, *columns: str) -> tuple:
    """Columns and the matrix of a reference side whose size has been checked, in rising order."""
    block = refs.select(*dict.fromkeys([order, vector, *columns])).toArrow().sort_by(order)
    return *[block[c].combine_chunks() for c in columns], unit_matrix(block[vector])


def _blocks(refs: DataFrame, order: str, limit: int) -> Iterator[DataFrame]:
    """A reference side in pieces of at most ``limit`` numbers, in rising order."""
    refs = refs.persist()  # measured and then collected: computed once
    total = cells(refs, "__vector")
    if total <= limit:
        yield refs
        refs.unpersist()
        return
    numbered = cut_lineage(renumber_ids(refs.withColumn("__at", F.lit(0)), "__at", order))
    refs.unpersist()
    n = numbered.count()
    step = max(1, n * limit // (2 * total))
    for first in range(0, n, step):
        yield numbered.filter((F.col("__at") > first) & (F.col("__at") <= first + step))


def best_matches(
    rows: DataFrame,
    refs: DataFrame,
    k: int,
    order: str,
    value: str,
    within: str | None = None,
    broadcast_cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """Rows with ``__refs`` and ``__scores``: of the ``k`` best references the column ``value``, and the scores.

    Both sides have their vectors in ``__vector``; a row without one, or without references, has nulls and minus
    infinity. Rows stay where they are and need no key: the references pass by in blocks of at most ``broadcast_cells``
    numbers, and each block's matches are merged into those so far. Equal scores go to the reference that is first in
    ``order``. With ``within``, only references whose column of that name is equal are compared.
    """
    ref_type = refs.schema[value].dataType
    found = rows.withColumn("__refs", F.lit(None).cast(T.ArrayType(ref_type)))
    found = found.withColumn("__scores", F.lit(None).cast("array<double>"))
    names = found.columns
    at_vector, at_within = names.index("__vector"), names.index(within) if within else None
    columns = [value, within] if within else [value]
    context = rows.sparkSession.sparkContext

    def searched(found: DataFrame, group: list) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shared in group:
                    batch = _searched(batch, shared.value, at_vector, at_within, k)
                yield batch

        return found.mapInArrow(search, found.schema)

    group: list = []
    for block in _blocks(refs, order, broadcast_cells):
        group.append(context.broadcast(collect_block(block, order, "__vector", *columns)))
        if len(group) == PASSES:  # as many blocks in one stage, and in one Python worker, at most
            found = cut_lineage(searched(found, group))
            for shared in group:
                shared.destroy()
            group = []
    return searched(found, group) if group else found


def _searched(batch: pa.RecordBatch, block: tuple, at_vector: int, at_within: int | None, k: int) -> pa.RecordBatch:
    """A batch, whose last two columns are the matches so far, with those of a block merged into them."""
    ids, *parents, matrix = block
    step = max(1, SCORE_CELLS // max(1, len(ids)))
    options = _by_parent(parents[0]) if parents else None
    found = []
    for at in range(0, len(batch), step):
        part = batch.slice(at, step)
        score, column = _block_best(part.column(at_vector), part.column(at_within) if parents else None, matrix, options, k)
        found.append(_merged(part.column(batch.num_columns - 2), part.column(batch.num_columns - 1), ids, score, column, k))
    if not found:
        return batch
    refs, scores = (pa.concat_arrays(x) for x in zip(*found))
    return pa.RecordBatch.from_arrays([*batch.columns[:-2], refs, scores], batch.schema.names)


def _by_parent(parents: pa.Array) -> dict:
    places: dict = {}
    for i, p in enumerate(parents.to_pylist()):
        places.setdefault(p, []).append(i)
    return {p: np.array(own) for p, own in places.items()}


def _block_best(
    vectors: pa.Array, parents: pa.Array | None, matrix: np.ndarray, options: dict | None, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Scores and columns of the ``k`` best references of a block per row; minus infinity where there are fewer."""
    n = len(vectors)
    scores, columns = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
    present = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    if not len(present) or not len(matrix):
        return scores, columns
    given = unit_matrix(vectors.take(pa.array(present)), matrix.shape[1])
    groups = [(np.arange(len(present)), np.arange(len(matrix)))]
    if options is not None:
        own = pd.Series(parents.take(pa.array(present)).to_pylist(), dtype=object)
        groups = [(rows.to_numpy(), options[p]) for p, rows in own.groupby(own).groups.items() if p in options]
    for rows, refs in groups:
        values = np.round(given[rows] @ matrix[refs].T, DECIMALS) + 0.0
        best = _best_k(values, k)
        scores[present[rows], : best.shape[1]] = np.take_along_axis(values, best, axis=1)
        columns[present[rows], : best.shape[1]] = refs[best]
    return scores, columns


def _merged(
    refs: pa.Array, scores: pa.Array, ids: pa.Array, score: np.ndarray, column: np.ndarray, k: int
) -> tuple[pa.Array, pa.Array]:
    """The ``k`` best of the matches so far and those of a block; earlier ones first if equal."""
    n = len(score)
    if scores.null_count:  # nothing yet
        old, values, places = pa.array([], ids.type), score, column
    else:
        old = refs.flatten()
        values = np.hstack([scores.flatten().to_numpy().reshape(n, k), score])
        places = np.hstack([np.arange(n * k).reshape(n, k), column + n * k])
    best = np.argsort(-values, axis=1, kind="stable")[:, :k]
    values, places = np.take_along_axis(values, best, axis=1), np.take_along_axis(places, best, axis=1)
    taken = pa.array(places.ravel(), mask=np.isneginf(values).ravel())
    offsets = pa.array(np.arange(0, n * k + 1, k, dtype=np.int32))
    every = pa.concat_arrays([old.cast(ids.type), ids])
    return pa.ListArray.from_arrays(offsets, every.take(taken)), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))


def _with_vector(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    return df.select(id_col, F.col(vector).alias("__vector")).filter(F.col("__vector").isNotNull())


def top_k_similar(
    targets: DataFrame,
    references: DataFrame,
    k: int,
    target_id: str = "id",
    reference_id: str = "reference_id",
    target_vector: str = "vector",
    reference_vector: str = "vector",
    broadcast_cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """The ``k`` references of highest cosine for each target: ``(target, reference, score, rank)``.

    Equal scores (to nine decimals) go to the lowest reference id. Each target row is searched on its own, whatever
    its id; null vectors have no neighbours. Targets are not shuffled, see :func:`best_matches`.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = _with_vector(targets, target_id, target_vector)
    refs = _with_vector(references, reference_id, reference_vector)
    found = best_matches(rows, refs, k, reference_id, reference_id, broadcast_cells=broadcast_cells)
    hits = found.select(target_id, F.posexplode(F.arrays_zip("__refs", "__scores")).alias("__place", "__hit"))
    return hits.filter(F.col("__hit.__scores") > float("-inf")).select(
        target_id,
        F.col("__hit.__refs").alias(reference_id),
        F.col("__hit.__scores").alias("score"),
        (F.col("__place") + 1).alias("rank"),
    )


def cosine_top1(
    targets: DataFrame,
    references: DataFrame,
    target_id: str = "id",
    reference_id: str = "reference_id",
    target_vector: str = "vector",
    reference_vector: str = "vector",
    broadcast_cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """The nearest reference of each target by cosine distance: ``(target, reference, distance)``."""
    best = top_k_similar(
        targets, references, 1, target_id, reference_id, target_vector, reference_vector, broadcast_cells
    )
    return best.select(target_id, reference_id, (F.round(F.lit(1.0) - F.col("score"), DECIMALS) + 0.0).alias("distance"))


def pairs_at_least(a: np.ndarray, b: np.ndarray, at_least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs of rows whose rounded dot product reaches a value: ``(row of a, row of b, score)``; and how many were not scored.

    The dimensions in which ``b`` is largest come first; what the others add is at most the product of their lengths.
    """
    order = np.argsort(-(b * b).sum(axis=0), kind="stable")
    head, tail = order[: -(-len(order) // 4)], order[-(-len(order) // 4) :]
    rest_a, rest_b = (np.sqrt((x[:, tail] ** 2).sum(axis=1)) for x in (a, b))
    bound = a[:, head] @ b[:, head].T + np.outer(rest_a, rest_b)
    row, col = np.nonzero(bound >= at_least - 10.0 ** (1 - DECIMALS))
    scores = np.empty(len(row))
    step = max(1, SCORE_CELLS // max(1, a.shape[1]))
    for at in range(0, len(row), step):
        cut = slice(at, at + step)
        scores[cut] = np.einsum("ij,ij->i", a[row[cut]], b[col[cut]])
    scores = np.round(scores, DECIMALS) + 0.0
    hit = scores >= at_least
    return row[hit], col[hit], scores[hit], bound.size - len(row)


def cosine_scores(
    queries: DataFrame,
    documents: DataFrame,
    query_id: str = "id",
    document_id: str = "reference_id",
    query_vector: str = "vector",
    document_vector: str = "vector",
    at_least: float | None = None,
    broadcast_cells: int = BROADCAST_CELLS,
    skipped: Accumulator | None = None,
) -> DataFrame:
    """Every query against every document: ``(query, document, score)``, or the pairs that reach ``at_least``.

    The full matrix is what this operator is asked for without a threshold; for the best ones use ``top_k_similar``.
    Documents pass by in blocks, one pass over the queries each. With a threshold, a quarter of the dimensions and the length of the
    rest bound a score from above; pairs whose bound stays below it are not scored (``skipped`` counts them), and only hits are written.
    """
    asked = _with_vector(queries, query_id, query_vector)
    known = _with_vector(documents, document_id, document_vector)
    schema = T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(document_id, documents.schema[document_id].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    result = None
    for block in _blocks(known, document_id, broadcast_cells):
        shared = queries.sparkSession.sparkContext.broadcast(collect_block(block, document_id, "__vector", document_id))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            step = max(1, SCORE_CELLS // max(1, len(ids)))
            for batch in batches:
                for at in range(0, len(batch) if len(ids) else 0, step):
                    part = batch.slice(at, step)
                    given = unit_matrix(part.column(1), matrix.shape[1])
                    if at_least is None:
                        row, col = (x.ravel() for x in np.indices((len(given), len(matrix))))
                        values = (np.round(given @ matrix.T, DECIMALS) + 0.0).ravel()
                    else:
                        row, col, values, dropped = pairs_at_least(given, matrix, at_least)
                        if skipped is not None:
                            skipped.add(dropped)
                    columns = [part.column(0).take(pa.array(row)), ids.take(pa.array(col)), pa.array(values)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

        scored = asked.mapInArrow(score, schema)
        result = scored if result is None else result.union(scored)
    return result


def text_scores(
    queries: DataFrame,
    documents: DataFrame,
    query_id: str = "id",
    document_id: str = "reference_id",
    query_text: str = "text",
    document_text: str = "text",
    prompt: str = "",
    dim: int = 64,
    at_least: float | None = None,
) -> DataFrame:
    """Scores of texts, or those that reach ``at_least``; ``prompt`` is put in front of the query texts only."""
    asked = queries.select(query_id, hashed_encoder(F.concat(F.lit(prompt), F.col(query_text)), dim).alias("vector"))
    known = documents.select(document_id, hashed_encoder(F.col(document_text), dim).alias("vector"))
    return cosine_scores(asked, known, query_id, document_id, at_least=at_least)
