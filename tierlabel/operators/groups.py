"""Deduplication, numbering and first-row lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierlabel.operators.tables import Names, as_list, first_rows, lookup_join
from tierlabel.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its lower 33 bits


def drop_duplicates(df: DataFrame, columns: Names, id_col: str = "id") -> DataFrame:
    """Keep the row with the lowest id per value, one column after the other; nulls are one group."""
    for c in as_list(columns):
        df = first_rows(df, [c], [id_col])
    return df


def renumber_ids(df: DataFrame, id_col: str, order_by: Names, columns: Names | None = None) -> DataFrame:
    """Replace ``id_col`` by 1..n in the given order; equal rows are ordered by their old id.

    The rows are range-partitioned on order and old id, so one frequent order value still spreads over many
    tasks. The ranged rows are checkpointed, as both passes below must see the same ranges. The first pass
    counts rows per range; its running sum is a table of one row per partition. The second adds it.
    """
    order = as_list(order_by)
    keep = [c for c in (df.columns if columns is None else as_list(columns)) if c != id_col]
    sort_keys = [*order, *([id_col] if id_col in df.columns and id_col not in order else [])]
    needed = list(dict.fromkeys([*sort_keys, *keep]))
    ranged = df.select(*needed).repartitionByRange(*sort_keys).sortWithinPartitions(*sort_keys)
    ranged = cut_lineage(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _ROW_BITS)
    row = F.col("__at").bitwiseAND((1 << _ROW_BITS) - 1)
    ranged = ranged.withColumn("__part", part)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = ranged.join(F.broadcast(starts), F.col("__part") == F.col("__p"))  # one row per partition
    return numbered.select((F.col("__start") + row + 1).alias(id_col), *keep)


def running_sums(df: DataFrame, groups: Names, order_by: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """Add running sums of whole numbers in an order, and as ``<name>_total`` the sums of all rows, within each group.

    No group goes through one task: rows are range-partitioned by group and order, summed within each range, and the sums
    of the ranges before are added. The ranged rows are checkpointed, as both passes must see the same ranges; the table of
    starts has at most one row per range and group. The order must be total within a group.
    """
    keys = as_list(groups)
    ranged = df.withColumns({f"__v_{name}": value for name, value in sums.items()})
    ranged = ranged.repartitionByRange(*keys, *order_by).sortWithinPartitions(*keys, *order_by)
    ranged = cut_lineage(ranged.withColumn("__at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__part", F.shiftright("__at", _ROW_BITS))
    inside = Window.partitionBy("__part", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = ranged.groupBy("__part", *keys).agg(*[F.sum(f"__v_{name}").alias(f"__v_{name}") for name in sums])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    starts = parts.select(
        F.col("__part").alias("__p"),
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        *[F.coalesce(F.sum(f"__v_{name}").over(before), F.lit(0)).alias(f"__s_{name}") for name in sums],
        *[F.sum(f"__v_{name}").over(every).alias(f"{name}_total") for name in sums],
    )
    on = [F.col("__part") == F.col("__p"), *[F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]]
    summed = ranged.withColumns({name: F.sum(f"__v_{name}").over(inside) for name in sums}).join(F.broadcast(starts), on)
    totals = [(F.col(f"__s_{name}") + F.col(name)).alias(name) for name in sums]
    return summed.select(*df.columns, *totals, *[f"{name}_total" for name in sums])


def class_table(df: DataFrame, column: str, id_col: str = "id", name: str = "class_name") -> DataFrame:
    """Distinct values, numbered from 0 in their order."""
    values = df.select(F.col(column).alias(name)).distinct()
    return renumber_ids(values, id_col, name).withColumn(id_col, F.col(id_col) - 1)


def unique_table(df: DataFrame, min_col: str, columns: Names, group_by: Names) -> DataFrame:
    """The lowest ``min_col`` per group, with the grouping columns that are asked for."""
    grouped = df.groupBy(*as_list(group_by)).agg(F.min(min_col).alias(min_col))
    return grouped.select(min_col, *as_list(columns))


def first_per_class(
    taxonomy: DataFrame,
    key: str = "ClassTitle",
    columns: Sequence[str] = ("SegmentTitle", "FamilyTitle"),
    order: str = "row_idx",
) -> DataFrame:
    """Per class the first value that is not null, for each column on its own."""
    firsts = [F.expr(f"min_by(`{c}`, `{order}`) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in columns]
    return taxonomy.filter(F.col(key).isNotNull()).groupBy(key).agg(*firsts)


def first_row_per_class(
    taxonomy: DataFrame,
    key: str = "ClassTitle",
    columns: Sequence[str] = ("SegmentTitle", "FamilyTitle"),
    order: str = "row_idx",
) -> DataFrame:
    """Per class the columns of its first row, nulls included."""
    first = F.min_by(F.struct(*columns), F.col(order)).alias("__first")
    grouped = taxonomy.filter(F.col(key).isNotNull()).groupBy(key).agg(first)
    return grouped.select(key, *[F.col(f"__first.{c}").alias(c) for c in columns])


def extract_labels(
    items: DataFrame,
    taxonomy: DataFrame,
    class_col: str,
    segment_out: str = "pred_segment",
    family_out: str = "pred_family",
) -> DataFrame:
    """Segment and family of the first taxonomy row of each item's class.

    A class that the taxonomy does not have gives nulls and ``in_taxonomy = false``.
    """
    lookup = first_row_per_class(taxonomy).select(
        F.col("ClassTitle").alias("__class"),
        F.col("SegmentTitle").alias(segment_out),
        F.col("FamilyTitle").alias(family_out),
        F.lit(True).alias("__found"),
    )
    joined = lookup_join(items, lookup, class_col, "__class")
    return joined.withColumn("in_taxonomy", F.coalesce("__found", F.lit(False))).drop("__class", "__found")


def distinct_children(taxonomy: DataFrame, parent: str, child: str, order: str = "row_idx") -> DataFrame:
    """Distinct (parent, child) titles with the position of their first row."""
    present = taxonomy.filter(F.col(parent).isNotNull() & F.col(child).isNotNull())
    return present.groupBy(parent, child).agg(F.min(order).alias(order))


def distinct_titles(taxonomy: DataFrame, title: str, order: str = "row_idx") -> DataFrame:
    """Distinct titles of one level with the position of their first row."""
    return taxonomy.filter(F.col(title).isNotNull()).groupBy(title).agg(F.min(order).alias(order))


def top_1(distances: DataFrame, target: str, reference: str, distance: str = "distance") -> DataFrame:
    """The nearest reference of each target; equal distances go to the lowest reference id.

    A minimum over (distance, reference, other columns): each task keeps one row per target before anything is shuffled.
    """
    others = [c for c in distances.columns if c not in (target, reference, distance)]
    best = distances.groupBy(target).agg(F.min(F.struct(distance, reference, *others)).alias("__best"))
    return best.select(*[target if c == target else F.col(f"__best.{c}").alias(c) for c in distances.columns])
