"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

A source may be repeated at most ``max_epochs`` times. Sources are given shares of the wanted total by weight; those
above their cap are clamped to it and what they cannot take is shared out again among the rest by weight, until none
is above. A source then takes whole passes over all of its documents and a fraction of one more pass: its documents
in the order of a seeded hash, up to the wanted number of words.

Edge cases: a null text has no words; null is a source of its own; a source without a weight, or with one of zero or
less, takes nothing; equal rows take equal parts; if all sources together cannot give the total, all are at their cap;
an empty table gives an empty result. Columns of the input other than id, source and text are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierlabel.llm.common import n_words, store

_PREFIX = 4  # hex digits: a source's documents fall into 65,536 slices of its seeded order


@dataclass(frozen=True)
class MixSettings:
    max_epochs: float = 2.0
    seed: int = 42
    id_col: str = "doc_id"
    source_col: str = "source"


def order_key(id_col: str, size: Column, seed: int) -> Column:
    """Sorts the documents of a source in seeded order; the same in every run and on any cluster."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.concat(hashed, F.lpad(size.cast("string"), 12, "0"))


def sized(docs: DataFrame, settings: MixSettings = MixSettings(), text_col: str = "text") -> DataFrame:
    """The narrow table that the plan is made from: id, source and number of words, in the shared folder."""
    rows = docs.select(
        F.col(settings.id_col).alias("__id"), F.col(settings.source_col).alias("__source"), n_words(text_col).alias("__size")
    )
    return store(rows, "mix-sizes")


def _fill(sources: DataFrame, total: float) -> float:
    """The water level: source i takes ``min(cap_i, level * weight_i)``.

    Each round clamps the sources above their cap and raises the level for the rest. A round is an aggregation to
    three numbers, so the sources themselves stay in Spark; the level only rises and ends when no more are clamped.
    """
    level, clamped = 0.0, -1
    while True:
        over = F.col("__cap") <= F.lit(level) * F.col("__weight")
        row = sources.agg(
            F.count_if(over).alias("n"),
            F.coalesce(F.sum(F.when(over, F.col("__cap"))), F.lit(0.0)).alias("caps"),
            F.coalesce(F.sum(F.when(~over, F.col("__weight"))), F.lit(0.0)).alias("weights"),
        ).first()
        if row["n"] == clamped:
            return level
        if row["weights"] == 0:
            return float("inf")
        level, clamped = max(level, (total - row["caps"]) / row["weights"]), row["n"]


def mixing_plan(
    sizes: DataFrame, weights: DataFrame, share: float, settings: MixSettings = MixSettings(), cut_last: bool = True
) -> DataFrame:
    """One row per source: its target, whole passes, and where its fractional pass ends.

    ``sizes`` comes from :func:`sized`; ``weights`` has one row (source, weight) per source; all sources together take
    ``share`` times all words. The document in which the fractional pass ends gives only the words still wanted; with
    ``cut_last=False`` it is taken whole if at least half of it is wanted, so that texts stay as they are.
    """
    by_source = sizes.groupBy("__source").agg(F.sum("__size").alias("__source_size"))
    named = weights.select(F.col(weights.columns[0]).alias("__name"), F.col(weights.columns[1]).cast("double").alias("__weight"))
    joined = by_source.join(named, by_source["__source"].eqNullSafe(named["__name"]), "left").drop("__name")
    sources = store(
        joined.withColumn("__weight", F.greatest(F.coalesce("__weight", F.lit(0.0)), F.lit(0.0))).withColumn(
            "__cap", F.col("__source_size") * F.lit(float(settings.max_epochs))
        ),
        "mix-sources",
    )
    total = sources.agg(F.coalesce(F.sum("__source_size"), F.lit(0))).first()[0]
    level = _fill(sources.filter((F.col("__weight") > 0) & (F.col("__cap") > 0)), total * share)
    reached = F.when(F.col("__weight") > 0, F.least(F.col("__cap"), F.lit(level) * F.col("__weight"))).otherwise(F.lit(0.0))
    whole = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(F.lit(0))
    targets = (
        sources.withColumn("__target", reached)
        .withColumn("__whole", whole.cast("long"))
        .withColumn("__left", F.floor(F.col("__target") + F.lit(0.5)).cast("long") - F.col("__whole") * F.col("__source_size"))
        .select("__source", "__source_size", "__target", "__whole", "__left")
    )

    # The slice of the seeded order in which the fractional pass ends: at most 65,536 sums per source.
    keyed = sizes.withColumn("__key", order_key("__id", F.col("__size"), settings.seed))
    prefix = F.substring("__key", 1, _PREFIX).alias("__prefix")
    slices = keyed.groupBy("__source", prefix).agg(F.sum("__size").alias("__sum"))
    running = Window.partitionBy("__source").orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("__before", F.coalesce(F.sum("__sum").over(running), F.lit(0)))
    t = targets.withColumnRenamed("__source", "__name")
    last_slice = (
        slices.join(t, slices["__source"].eqNullSafe(t["__name"]))
        .filter((F.col("__before") < F.col("__left")) & (F.col("__before") + F.col("__sum") >= F.col("__left")))
        .select(F.col("__name"), F.col("__prefix").alias("__last"), "__before", "__left")
    )

    # The document in that slice: one row of 65,536 is ranked.
    inside = keyed.join(last_slice, keyed["__source"].eqNullSafe(last_slice["__name"])).filter(prefix == F.col("__last"))
    peers = inside.groupBy("__source", "__key", "__size", "__left", "__before").agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy("__source").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.col("__left") - F.col("__before") - F.coalesce(F.sum(F.col("__n") * F.col("__size")).over(order), F.lit(0))
    part = F.floor(F.col("__wanted") / F.col("__n")).cast("long")
    if not cut_last:
        part = F.when(2 * part >= F.col("__size"), F.col("__size")).otherwise(F.lit(0).cast("long"))
    ends = (
        peers.withColumn("__wanted", wanted)
        .filter((F.col("__wanted") > 0) & (F.col("__wanted") <= F.col("__n") * F.col("__size")))
        .select(F.col("__source").alias("__name"), F.col("__key").alias("__end"), part.alias("__part"))
    )
    plan = targets.join(ends, targets["__source"].eqNullSafe(ends["__name"]), "left").drop("__name")
    return store(plan, "mix-plan")


def apply_plan(
    docs: DataFrame, plan: DataFrame, size: Column, settings: MixSettings = MixSettings(), prefix: str = "mix_"
) -> DataFrame:
    """Add ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted) and ``copies``, names prefixed.

    Nothing but the plan (one row per source) is joined, and Spark broadcasts it if it is small.
    """
    rows = docs.withColumn("__size", size)
    rows = rows.withColumn("__key", order_key(settings.id_col, F.col("__size"), settings.seed))
    joined = rows.join(plan.withColumnRenamed("__source", "__name"), rows[settings.source_col].eqNullSafe(F.col("__name")), "left")
    extra = (
        F.when(F.col("__key") < F.col("__end"), F.col("__size"))
        .when(F.col("__key") == F.col("__end"), F.col("__part"))
        .otherwise(F.lit(0))
    )
    more = F.when(F.col("__key") < F.col("__end"), 1).when((F.col("__key") == F.col("__end")) & (F.col("__part") > 0), 1)
    return joined.select(
        *docs.columns,
        F.col("__size").alias(f"{prefix}size"),
        F.col("__source_size").alias(f"{prefix}source_size"),
        F.col("__target").alias(f"{prefix}target"),
        (F.col("__whole") * F.col("__size") + extra).cast("long").alias(f"{prefix}taken"),
        (F.col("__whole") + F.coalesce(more, F.lit(0))).cast("int").alias(f"{prefix}copies"),
    )


def cycled_weights(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Weights dealt to the sources in code-point order, null last. The window runs over one row per source."""
    names = sizes.select("__source").distinct()
    place = F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1
    dealt = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    return names.select("__source", dealt.alias("weight"))


def mix(docs: DataFrame, share: float = 1.5, settings: MixSettings = MixSettings(), text_col: str = "text") -> DataFrame:
    """The mixed documents themselves: each row as often as it is taken, columns unchanged, texts whole."""
    sizes = sized(docs, settings, text_col)
    plan = mixing_plan(sizes, cycled_weights(sizes), share, settings, cut_last=False)
    counted = apply_plan(docs, plan, n_words(text_col), settings, prefix="__mix_")
    repeated = counted.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__mix_copies"))))
    return repeated.select(*docs.columns)
