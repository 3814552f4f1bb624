"""Table rewrites. Each one is a function from frames to a new frame; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

Names = str | Sequence[str]


def as_list(names: Names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type in which two keys can be compared without loss of either; an error if there is none."""
    if a == b:
        return a
    whole = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
    digits = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
    kinds = {type(a), type(b)}
    if kinds <= set(whole):
        return max(a, b, key=lambda t: whole.index(type(t)))
    if kinds <= {T.DecimalType, *whole}:
        sides = [(t.precision, t.scale) if isinstance(t, T.DecimalType) else (digits[type(t)], 0) for t in (a, b)]
        scale = max(s for _, s in sides)
        precision = max(p - s for p, s in sides) + scale
        if precision <= 38:
            return T.DecimalType(precision, scale)
    elif kinds <= {T.FloatType, T.DoubleType, *whole[:3]}:
        return T.DoubleType()
    elif kinds == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    elif kinds <= {T.StringType, T.VarcharType, T.CharType}:
        return T.StringType()
    raise TypeError(f"keys of types {a.simpleString()} and {b.simpleString()} have no common type")


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: Names, lookup_keys: Names, how: str = "left") -> DataFrame:
    """Join rows, whose keys may be hot, with a table of one row per key.

    A lookup that was just grouped by its key already lies where a join on that key wants it, and then Spark's
    skew join cannot split a hot key of the rows. The hash of the keys as one more join column makes Spark shuffle
    the small side once more (one row per key), so that it can. Small lookups are broadcast as ever. Equal values of
    different types hash differently, so both sides are hashed in their common type.
    """
    keys, lookup_keys = as_list(keys), as_list(lookup_keys)
    types = [common_type(rows.schema[k].dataType, lookup.schema[lk].dataType) for k, lk in zip(keys, lookup_keys, strict=True)]
    hashed_rows = rows.withColumn("__hash", F.xxhash64(*[F.col(k).cast(t) for k, t in zip(keys, types)]))
    hashed_lookup = lookup.withColumn("__lookup_hash", F.xxhash64(*[F.col(k).cast(t) for k, t in zip(lookup_keys, types)]))
    on = [F.col("__hash") == F.col("__lookup_hash")]
    on += [hashed_rows[k] == hashed_lookup[lk] for k, lk in zip(keys, lookup_keys)]
    return hashed_rows.join(hashed_lookup, on, how).drop("__hash", "__lookup_hash")


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename; names that do not occur are ignored."""
    return df.withColumnsRenamed(dict(names))


def drop_column(df: DataFrame, columns: Names) -> DataFrame:
    """Drop columns; one that does not occur is an error."""
    columns = as_list(columns)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {missing}")
    return df.drop(*columns)


def replicate_table(df: DataFrame, columns: Names) -> DataFrame:
    """A projection, to be saved under another name."""
    return df.select(*as_list(columns))


create_table_from = replicate_table


def drop_null_rows(df: DataFrame, columns: Names) -> DataFrame:
    """Keep the rows that are not null in any of the columns. NaN is a value, not a null."""
    for c in as_list(columns):
        df = df.filter(F.col(c).isNotNull())
    return df


def combine_columns(df: DataFrame, expression: Column, name: str) -> DataFrame:
    """Add an expression, trimmed of blanks. Build it with ``concat``, so that one null makes it null."""
    return df.withColumn(name, F.trim(expression))


def concatenate_tables(
    columns: Names, train: DataFrame, val: DataFrame | None = None, test: DataFrame | None = None
) -> DataFrame:
    """UNION ALL of the splits that are there, on the same columns."""
    columns = as_list(columns)
    result = train.select(*columns)
    for part in (val, test):
        if part is not None:
            result = result.unionByName(part.select(*columns))
    return result


def delete_rows_not_in(target: DataFrame, source: DataFrame, target_col: str, source_col: str) -> DataFrame:
    """What a ``DELETE ... WHERE t NOT IN (SELECT s ...)`` leaves behind, nulls included.

    A row goes only if the predicate is true: the source has no null and no equal value, and the row's
    own value is not null, or the source is empty. The two facts about the source are scalar subqueries.
    The source is reduced to distinct values before the join; Spark broadcasts it if it turns out small,
    and splits hot target values (skew join) otherwise.
    """
    facts = source.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.bool_or(F.col(source_col).isNull()), F.lit(False)).alias("has_null"),
        ).alias("facts")
    ).scalar()
    keys = source.select(F.col(source_col).alias("__key")).filter(F.col("__key").isNotNull()).distinct()
    keys = keys.withColumn("__match", F.lit(True))
    joined = lookup_join(target, keys, target_col, "__key").withColumn("__facts", facts)
    survives = F.col("__match").isNotNull() | (
        (F.col("__facts.n") > 0) & (F.col("__facts.has_null") | F.col(target_col).isNull())
    )
    return joined.filter(survives).select(*target.columns)


def update_table_columns(
    target: DataFrame,
    source: DataFrame,
    target_col: str,
    source_col: str,
    target_keys: Names,
    source_keys: Names,
) -> DataFrame:
    """Overwrite a column where the keys match, also with null; other rows keep their value.

    Two source rows with the same key make the query fail; that check is a group-by on the join keys.
    """
    target_keys, source_keys = as_list(target_keys), as_list(source_keys)
    if len(target_keys) != len(source_keys):
        raise ValueError("target_keys and source_keys must pair up")
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(source_keys)]
    keys = [f"__k{i}" for i in range(len(source_keys))]
    source = source.select(*named, F.col(source_col).alias("__value"))
    for k in keys:
        source = source.filter(F.col(k).isNotNull())
    grouped = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first("__value").alias("__first"))
    message = F.lit(f"update: more than one source row for a key of {source_keys}")
    checked = grouped.select(
        *keys,
        F.when(F.col("__n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)).alias("__match"),
        F.col("__first"),
    )
    updated = F.when(F.col("__match"), F.col("__first")).otherwise(F.col(target_col)).alias(target_col)
    return lookup_join(target, checked, target_keys, keys).select(
        *[updated if c == target_col else F.col(c) for c in target.columns]
    )


def merge_table_columns(
    target: DataFrame,
    source: DataFrame,
    target_cols: Names,
    source_cols: Names,
    target_key: str,
    source_key: str,
) -> DataFrame:
    """LEFT JOIN that keeps chosen columns of both sides and every match."""
    joined = target.join(source, target[target_key] == source[source_key], "left")
    return joined.select(*[target[c] for c in as_list(target_cols)], *[source[c] for c in as_list(source_cols)])


def left_merge_predictions(
    items: DataFrame, predictions: DataFrame, on: str = "product_name", order: str = "row_idx"
) -> DataFrame:
    """Attach predictions to items by text (null equals null) and keep the first row of each text.

    ``order`` orders both sides. Each side is reduced to its first row per text before the join, which
    gives the same rows as joining first, and never multiplies the copies of a hot text.
    """
    first_item = first_rows(items, [on], [order])
    first_prediction = first_rows(predictions, [on], [order]).drop(order).withColumnRenamed(on, "__on")
    joined = first_item.join(first_prediction, F.col(on).eqNullSafe(F.col("__on")), "left")
    return joined.drop("__on")


def first_rows(df: DataFrame, keys: Names, order: Names) -> DataFrame:
    """The first row of each group.

    ``row_number() = 1`` lets every task keep one row per group before the shuffle, so a group that holds
    a large part of the table shrinks to one row per task.
    """
    window = Window.partitionBy(*as_list(keys)).orderBy(*as_list(order))
    return df.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") == 1).drop("__rn")


def split_key(id_col: str, seed: int = 42) -> Column:
    """The hash that orders rows for a split: the same in every run and on any cluster."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def split_dataset(
    df: DataFrame, id_col: str, label_col: str = "class", test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Drop rows without label and add ``is_test``: exactly ``ceil(test_size * n)`` rows, chosen by hash.

    ``id_col`` must be unique. The cut is found without sorting the table: counts per four-digit hash prefix
    give the prefix in which it falls, and only the rows of that prefix (one of 65,536) are ranked. That is done
    at once, not again for each side that is used; the split itself is then a filter on the hash.
    """
    labelled = drop_null_rows(df, label_col)
    hashed = labelled.select(split_key(id_col, seed).alias("__h"))
    prefix = F.substring("__h", 1, 4)
    by_prefix = hashed.groupBy(prefix.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    up_to = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy()
    cut = (
        by_prefix.withColumn("__cum", F.sum("__n").over(up_to))
        .withColumn("__want", F.ceil(F.sum("__n").over(total) * F.lit(test_size)))
        .filter((F.col("__cum") >= F.col("__want")) & (F.col("__cum") - F.col("__n") < F.col("__want")))
        .select(F.struct("__p", (F.col("__want") - F.col("__cum") + F.col("__n")).alias("__rank")).alias("__cut"))
        .scalar()
    )
    ranked = (
        hashed.withColumn("__cut", cut)
        .filter(prefix == F.col("__cut.__p"))
        .withColumn("__rank", F.col("__cut.__rank"))
        .withColumn("__rn", F.row_number().over(Window.partitionBy(prefix).orderBy("__h")))
    )
    last = ranked.filter(F.col("__rn") == F.col("__rank")).agg(F.max("__h")).first()[0]
    return labelled.withColumn("is_test", F.coalesce(split_key(id_col, seed) <= F.lit(last).cast("string"), F.lit(False)))


def count_table_rows(df: DataFrame, column: str) -> DataFrame:
    """The number of rows in which the column is not null."""
    return df.agg(F.count(column).alias("n_rows"))


def result_table(scores: DataFrame, products: DataFrame, classes: DataFrame, actual: DataFrame) -> DataFrame:
    """Scores with product name, predicted and actual class: three inner joins.

    ``scores(product_id, class_id, distance)``, ``products(id, translated_product_name)``,
    ``classes(id, class_name)``, ``actual(product_id, class_name)``.
    """
    p = products.select(F.col("id").alias("product_id"), F.col("translated_product_name").alias("product_name"))
    c = classes.select(F.col("id").alias("class_id"), F.col("class_name").alias("predicted_class"))
    a = actual.select("product_id", F.col("class_name").alias("actual_class"))
    return (
        scores.join(c, "class_id")
        .join(p, "product_id")
        .join(a, "product_id")
        .select(
            "product_id",
            "product_name",
            "predicted_class",
            "actual_class",
            "distance",
            (F.lit(1.0) - F.col("distance")).alias("similarity"),
        )
    )
