"""Accuracy, per-label measures, distributions and coverage of predictions.

Every operator scans the predictions once and aggregates map-side, so what is shuffled and what the
windows below order is one row per label, not per item.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierlabel.operators.groups import running_sums

# The taxonomy levels, the confidence levels and the cut-offs of the running share.
LEVELS = ("segment", "family", "class")
CONFIDENCE_LEVELS = ("Low", "Medium", "High")
PARETO_SHARES = (0.7, 0.9)


def _right(true: str, predicted: str) -> Column:
    """True only if both are present and equal."""
    return F.coalesce(F.col(true) == F.col(predicted), F.lit(False))


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def accuracy(df: DataFrame, levels: Sequence[str] = LEVELS, prefix: str = "pred_", copies: str | None = None) -> DataFrame:
    """One row: the share of right predictions for each level. With a column ``copies`` a row counts as that many."""
    each = F.lit(1) if copies is None else F.col(copies)
    return df.agg(
        *[F.round(F.sum(F.when(_right(lv, f"{prefix}{lv}"), each).otherwise(0)) / F.sum(each), 9).alias(f"{lv}_accuracy") for lv in levels]
    )


def confusion_counts(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """Rows per pair of observed and predicted label; rows without an observed label are left out."""
    present = df.filter(F.col(observed).isNotNull())
    return present.groupBy(F.col(observed).alias("observed"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def label_scores(df: DataFrame, observed: str, predicted: str, num_labels: int | None = None) -> DataFrame:
    """Precision, recall, F1 and support per label that was observed or predicted.

    With ``num_labels`` the query fails when another number of labels occurs.
    """
    pairs = confusion_counts(df, observed, predicted)
    same = F.col("observed") == F.col("predicted")
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("observed").alias("label"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("predicted"),
                    F.when(same, F.col("n")).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col("predicted").alias("label"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("long").alias("hits"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    counts = (
        sides.filter(F.col("label").isNotNull())
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    if num_labels is not None:
        found = F.count(F.lit(1)).over(Window.partitionBy())
        problem = F.raise_error(F.concat(F.lit(f"expected {num_labels} labels, found "), found.cast("string")))
        counts = counts.withColumn("support", F.when(found == num_labels, F.col("support")).otherwise(problem.cast("long")))
    precision = _ratio(F.col("hits"), F.col("predicted"))
    recall = _ratio(F.col("hits"), F.col("support"))
    f1 = _ratio(F.lit(2) * F.col("hits"), F.col("predicted") + F.col("support"))
    return counts.select(
        "label",
        "support",
        "predicted",
        "hits",
        F.round(precision, 9).alias("precision"),
        F.round(recall, 9).alias("recall"),
        F.round(f1, 9).alias("f1"),
    )


def classification_summary(
    df: DataFrame, observed: str, predicted: str, num_labels: int | None = None
) -> DataFrame:
    """One row: accuracy and the micro, macro and weighted averages of precision, recall and F1."""
    labels = label_scores(df, observed, predicted, num_labels)
    p = _ratio(F.col("hits"), F.col("predicted"))
    r = _ratio(F.col("hits"), F.col("support"))
    f = _ratio(F.lit(2) * F.col("hits"), F.col("predicted") + F.col("support"))
    total, hits, guessed = F.sum("support"), F.sum("hits"), F.sum("predicted")
    measures = {"precision": p, "recall": r, "f1": f}
    micro = {"precision": _ratio(hits, guessed), "recall": _ratio(hits, total), "f1": _ratio(2 * hits, guessed + total)}
    columns = [
        F.count(F.lit(1)).alias("n_labels"),
        total.alias("n_rows"),
        F.round(_ratio(hits, total), 9).alias("accuracy"),
    ]
    for name, measure in measures.items():
        columns += [
            F.round(micro[name], 9).alias(f"micro_{name}"),
            F.round(F.avg(measure), 9).alias(f"macro_{name}"),
            F.round(_ratio(F.sum(measure * F.col("support")), total), 9).alias(f"weighted_{name}"),
        ]
    return labels.agg(*columns)


Levels = str | Sequence[str]


def _label_counts(df: DataFrame, levels: Levels, **sums: str) -> DataFrame:
    """``(level, label, n, ..)``: rows per label of all levels in one scan; of ``sums`` the rows right with that prefix."""
    names = [levels] if isinstance(levels, str) else list(levels)
    each = F.array(
        *[
            F.struct(
                F.lit(lv).alias("level"),
                F.col(lv).cast("string").alias("label"),
                *[_right(lv, f"{prefix}{lv}").cast("long").alias(name) for name, prefix in sums.items()],
            )
            for lv in names
        ]
    )
    long = df.select(F.explode(each).alias("r")).select("r.*").filter(F.col("label").isNotNull())
    return long.groupBy("level", "label").agg(F.count(F.lit(1)).alias("n"), *[F.sum(name).alias(name) for name in sums])


def _shown(df: DataFrame, levels: Levels) -> DataFrame:
    return df.drop("level") if isinstance(levels, str) else df


def level_distribution(df: DataFrame, levels: Levels) -> DataFrame:
    """Rows per label in falling order, with running count, share of all, and places from both ends.

    For a list of levels, they come from one scan, with the level as first column. ``share`` is the percentage of all rows;
    reports show it for the ten largest labels. Equal counts are ordered by label. ``top_3``, ``top_5`` and ``bottom_5`` mark
    the ends of the list.
    """
    order = [F.desc("n"), F.asc("label")]
    ranked = running_sums(_label_counts(df, levels), "level", order, {"cumulative": F.col("n"), "place": F.lit(1).cast("long")})
    return _shown(
        ranked.select(
            "level",
            "label",
            "n",
            "cumulative",
            F.round(F.col("n") * 100.0 / F.col("cumulative_total"), 9).alias("share"),
            "place",
            (F.col("place") <= 3).alias("top_3"),
            (F.col("place") <= 5).alias("top_5"),
            (F.col("place") > F.col("place_total") - 5).alias("bottom_5"),
        ),
        levels,
    )


def pareto_cutoff(df: DataFrame, levels: Levels, shares: Sequence[float] = PARETO_SHARES) -> DataFrame:
    """Per share p the last label whose running count is at most p of all rows; null if the first exceeds it."""
    names = [levels] if isinstance(levels, str) else list(levels)
    spread = running_sums(_label_counts(df, names), "level", [F.desc("n"), F.asc("label")], {"cumulative": F.col("n")})
    total = F.col("cumulative_total")
    cuts = [
        F.max_by("label", F.when(F.col("cumulative") <= total * F.lit(p), F.col("cumulative"))).alias(f"c{i}")
        for i, p in enumerate(shares)
    ]
    found = spread.groupBy("level").agg(*cuts)
    rows = F.array(*[F.struct(F.lit(float(p)).alias("share"), F.col(f"c{i}").alias("label")) for i, p in enumerate(shares)])
    every = df.sparkSession.createDataFrame([(lv,) for lv in names], "level string")
    return _shown(every.join(found, "level", "left").select("level", F.explode(rows).alias("r")).select("level", "r.share", "r.label"), levels)


def taxonomy_coverage(
    df: DataFrame,
    taxonomy: DataFrame,
    levels: Sequence[str] = LEVELS,
    titles: Sequence[str] = ("SegmentTitle", "FamilyTitle", "ClassTitle"),
) -> DataFrame:
    """Per level the distinct labels used, those defined, and the first as a percentage of the second.

    Each side is one distinct over (level, label), which drops repeats before the shuffle; the few counts
    that come out are joined by level.
    """

    def labels(frame: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(lv).alias("level"), F.col(c).alias("label")) for lv, c in zip(levels, columns)])
        long = frame.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("label").isNotNull())
        return long.distinct().groupBy("level").agg(F.count(F.lit(1)).alias(name))

    joined = labels(taxonomy, titles, "defined").join(labels(df, levels, "used"), "level", "left")
    used = F.coalesce("used", F.lit(0)).cast("long")
    return joined.select(
        "level", used.alias("used"), "defined", F.round(used * 100.0 / F.col("defined"), 9).alias("coverage")
    )


def confidence_distribution(df: DataFrame, mode: str = "full", levels: Sequence[str] = LEVELS) -> DataFrame:
    """Per level the percentage of rows with low, medium and high confidence.

    ``mode`` picks all rows, the right ones or the wrong ones; a missing prediction is wrong. Only rows with
    a true label count. Levels without a prediction column are skipped.
    """
    if mode not in ("full", "correct", "incorrect"):
        raise ValueError(f"unknown mode {mode!r}: rows are full, correct or incorrect")
    present = [lv for lv in levels if f"pred_{lv}" in df.columns]
    if not present:
        raise ValueError("no prediction column")

    def chosen(lv: str) -> Column:
        there = F.col(lv).isNotNull()
        if mode == "correct":
            return there & _right(lv, f"pred_{lv}")
        return there & ~_right(lv, f"pred_{lv}") if mode == "incorrect" else there

    known = F.col("confidence_level").isNotNull()
    counts = [
        _count_if(chosen(lv) & (F.col("confidence_level") == c)).alias(f"{lv}_{c}") for lv in present for c in CONFIDENCE_LEVELS
    ] + [_count_if(chosen(lv) & known).alias(f"{lv}_all") for lv in present]

    def share(lv: str, c: str) -> Column:
        return F.round(_ratio(F.col(f"{lv}_{c}") * 100.0, F.col(f"{lv}_all")), 9).alias(c.lower())

    rows = F.array(*[F.struct(F.lit(lv).alias("level"), *[share(lv, c) for c in CONFIDENCE_LEVELS]) for lv in present])
    return df.agg(*counts).select(F.explode(rows).alias("r")).select("r.*")


def classification_results(df: DataFrame, levels: Levels, mode: str = "absolute") -> DataFrame:
    """Per true label the right, wrong and all rows, as counts or percentages, with places from both ends.

    For a list of levels, they come from one scan, with the level as first column. ``place`` orders by all rows;
    ``top_5`` and ``bottom_5`` mark the labels with the most and the fewest (or best and worst) right rows.
    """
    if mode not in ("absolute", "percentage"):
        raise ValueError("mode must be 'absolute' or 'percentage'")
    counted = _label_counts(df, levels, correct="pred_").withColumnRenamed("n", "total")
    counted = counted.withColumn("incorrect", F.col("total") - F.col("correct"))
    if mode == "percentage":
        for c in ("correct", "incorrect"):
            counted = counted.withColumn(c, F.round(F.col(c) * 100.0 / F.col("total"), 9))
    one = F.lit(1).cast("long")
    placed = running_sums(counted, "level", [F.desc("total"), F.asc("label")], {"place": one}).drop("place_total")
    placed = running_sums(placed, "level", [F.desc("correct"), F.asc("label")], {"by_right": one})
    return _shown(
        placed.select(
            "level",
            "label",
            "correct",
            "incorrect",
            "total",
            "place",
            (F.col("by_right") <= 5).alias("top_5"),
            (F.col("by_right") > F.col("by_right_total") - 5).alias("bottom_5"),
        ),
        levels,
    )


def results_by_sublevel(df: DataFrame, upper: str, sub: str) -> DataFrame:
    """Per upper label and sub label the rows right and wrong at the upper level, largest first.

    The result has no order of its own; ``place`` numbers the sub labels of an upper label.
    """
    present = df.filter(F.col(upper).isNotNull() & F.col(sub).isNotNull())
    right = _right(upper, f"pred_{upper}")
    counted = present.groupBy(F.col(upper).alias("upper_label"), F.col(sub).alias("sub_label")).agg(
        _count_if(right).alias("correct"), _count_if(~right).alias("incorrect"), F.count(F.lit(1)).alias("total")
    )
    within = Window.partitionBy("upper_label").orderBy(F.desc("total"), F.asc("sub_label"))
    return counted.withColumn("place", F.row_number().over(within).cast("long"))


def sublevel_summary(df: DataFrame, upper: str, sub: str) -> DataFrame:
    """Per upper label the number of sub labels, all, right and wrong rows, and the accuracy in percent."""
    by_sub = results_by_sublevel(df, upper, sub).groupBy("upper_label").agg(
        F.count(F.lit(1)).alias("n_sub_labels"),
        F.sum("total").alias("total"),
        F.sum("correct").alias("correct"),
        F.sum("incorrect").alias("incorrect"),
    )
    return by_sub.withColumn("accuracy", F.round(F.col("correct") * 100.0 / F.col("total"), 9))


def all_levels(operator, df: DataFrame, levels: Sequence[str] = LEVELS, **options) -> DataFrame:
    """``level_distribution``, ``pareto_cutoff`` or ``classification_results`` for several levels, from one scan."""
    return operator(df, list(levels), **options)
