"""Majority vote of three classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlabel.functions.text import confidence_level
from tierlabel.operators.groups import extract_labels


def vote(
    df: DataFrame,
    taxonomy: DataFrame,
    embed: str = "embed_class",
    brand: str = "brand_class",
    clf: str = "clf_class",
    num_models: int = 3,
) -> DataFrame:
    """Add the voted class, its confidence and the segment and family of that class.

    Two equal votes win, and null counts as a value; if all three differ the classifier (``clf``) decides.
    """
    e, b, c = F.col(embed), F.col(brand), F.col(clf)
    eb, ec, bc = e.eqNullSafe(b), e.eqNullSafe(c), b.eqNullSafe(c)
    votes = F.when(eb & ec, 3).when(eb | ec | bc, 2).otherwise(1)
    voted = df.withColumn("pred_class", F.when(eb | ec, e).when(bc, b).otherwise(c)).withColumn(
        "confidence_rate", votes / F.lit(float(num_models))
    )
    voted = voted.withColumn("confidence_level", confidence_level(F.col("confidence_rate")))
    return extract_labels(voted, taxonomy, "pred_class")
