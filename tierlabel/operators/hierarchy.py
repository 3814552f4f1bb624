"""Nearest labels: one level, and segment, family and class one after the other."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlabel.operators.blocks import BROADCAST_CELLS, SCORE_CELLS, cells
from tierlabel.operators.dense import DECIMALS, best_matches, unit_matrix, unit_rows
from tierlabel.operators.groups import distinct_children, distinct_titles


def classify(
    items: DataFrame,
    labels: DataFrame,
    item_id: str = "item_id",
    vector: str = "vector",
    is_max: bool = True,
    broadcast_cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """``(item_id, label, score)``: the label of highest (or lowest) cosine, the first one on ties.

    ``labels(row_idx, label, vector)``. Every item gives one row; without a vector its label and score are null.
    """
    refs = labels.select("row_idx", "label", F.col("vector").alias("__vector")).filter("__vector IS NOT NULL")
    if not is_max:
        refs = refs.withColumn("__vector", F.transform("__vector", lambda x: -x))
    rows = items.select(item_id, F.col(vector).alias("__vector"))
    found = best_matches(rows, refs, 1, "row_idx", "label", broadcast_cells=broadcast_cells)
    value = F.get("__scores", F.lit(0))
    score = F.when(value > float("-inf"), value if is_max else F.lit(0.0) - value)
    return found.select(item_id, F.get("__refs", F.lit(0)).alias("label"), score.alias("score"))


def _candidates(taxonomy: DataFrame, vectors: DataFrame, labels: Sequence[str] | None) -> DataFrame:
    """All choices as ``(level, parent, row_idx, title, vector)``; segments have no parent."""
    segments = distinct_titles(taxonomy, "SegmentTitle").withColumnRenamed("SegmentTitle", "title")
    if labels is not None:
        rows = [(i, s) for i, s in enumerate(labels)]
        segments = taxonomy.sparkSession.createDataFrame(rows, "row_idx long, title string")
    families = distinct_children(taxonomy, "SegmentTitle", "FamilyTitle")
    classes = distinct_children(taxonomy, "FamilyTitle", "ClassTitle")
    levels = [
        segments.select(F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent"), "row_idx", "title"),
        families.select(F.lit(1).alias("level"), F.col("SegmentTitle").alias("parent"), "row_idx", F.col("FamilyTitle").alias("title")),
        classes.select(F.lit(2).alias("level"), F.col("FamilyTitle").alias("parent"), "row_idx", F.col("ClassTitle").alias("title")),
    ]
    every = levels[0].unionByName(levels[1]).unionByName(levels[2])
    return every.join(vectors.select("title", "vector"), "title").select("level", "parent", "row_idx", "title", "vector")


def hierarchical_classify(
    items: DataFrame,
    taxonomy: DataFrame,
    vectors: DataFrame,
    item_id: str = "item_id",
    vector: str = "vector",
    labels: Sequence[str] | None = None,
    prefix: str = "embed_",
    broadcast_cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """Items with ``{prefix}segment, {prefix}family, {prefix}class`` by cosine, level by level.

    The segment is chosen from all segment titles (or ``labels``), the family among the children of that
    segment, the class among the children of that family title. ``vectors(title, vector)`` has one vector per
    title, made once; a title without a vector is no candidate, and an item without candidates or without a
    vector gets null. Items are never shuffled and need no id: a taxonomy of up to ``broadcast_cells`` numbers is
    broadcast as one, a larger one passes by level by level in bounded blocks.
    """
    out = [f"{prefix}{level}" for level in ("segment", "family", "class")]
    choices = _candidates(taxonomy, vectors, labels).persist()  # measured and then collected: computed once
    n_cells = cells(choices, "vector")
    if n_cells > broadcast_cells:
        choices.unpersist()
        return _by_level(items, choices, vector, out, broadcast_cells)

    table = choices.toArrow().sort_by([("level", "ascending"), ("row_idx", "ascending")]).combine_chunks()
    choices.unpersist()
    level = table["level"].to_numpy()
    titles = np.array(table["title"].to_pylist(), dtype=object)
    children: dict[tuple[int, str | None], list[int]] = {}
    for i, key in enumerate(zip(level.tolist(), table["parent"].to_pylist())):
        children.setdefault(key, []).append(i)
    shared = items.sparkSession.sparkContext.broadcast(
        (titles, unit_matrix(table["vector"]), {k: np.array(v) for k, v in children.items()})
    )
    hit = T.StructType([T.StructField(c, T.StringType()) for c in out])

    @F.pandas_udf(hit)
    def descend(batch: pd.Series) -> pd.DataFrame:
        titles, matrix, children = shared.value
        step = max(1, SCORE_CELLS // max(1, len(titles)))
        parts = [_descend(batch.iloc[at : at + step], titles, matrix, children) for at in range(0, len(batch), step)]
        return pd.DataFrame(np.vstack(parts) if parts else np.empty((0, 3), dtype=object), columns=out)

    return items.withColumn("__hit", descend(F.col(vector))).select("*", "__hit.*").drop("__hit")


def _descend(vectors: pd.Series, titles: np.ndarray, matrix: np.ndarray, children: dict) -> np.ndarray:
    """The three titles of each vector; each level's choice gives the candidates of the next."""
    chosen = np.full((len(vectors), 3), None, dtype=object)
    present = np.flatnonzero(vectors.notna().to_numpy())
    if not len(present) or not len(titles):
        return chosen
    given = unit_rows(np.stack(vectors.iloc[present].to_list()).astype(np.float64))
    scores = np.round(given @ matrix.T, DECIMALS)
    groups: dict[str | None, np.ndarray] = {None: np.arange(len(present))}
    for level in range(3):
        found = np.full(len(present), None, dtype=object)
        for parent, members in groups.items():
            options = children.get((level, parent))
            if options is not None:
                found[members] = titles[options[scores[np.ix_(members, options)].argmax(axis=1)]]
        chosen[present, level] = found
        reached = pd.Series(found)
        groups = {parent: rows.to_numpy() for parent, rows in reached.dropna().groupby(reached).groups.items()}
    return chosen


def _by_level(items: DataFrame, choices: DataFrame, vector: str, out: Sequence[str], broadcast_cells: int) -> DataFrame:
    placed = items.withColumn("__vector", F.col(vector)).withColumn("__parent", F.lit(""))
    for level, name in enumerate(out):
        refs = choices.filter(F.col("level") == level).select(
            "row_idx", F.coalesce("parent", F.lit("")).alias("__parent"), "title", F.col("vector").alias("__vector")
        )
        found = best_matches(placed, refs.filter("__vector IS NOT NULL"), 1, "row_idx", "title", "__parent", broadcast_cells)
        placed = found.withColumn(name, F.get("__refs", F.lit(0))).drop("__refs", "__scores").withColumn("__parent", F.col(name))
    return placed.drop("__vector", "__parent")
