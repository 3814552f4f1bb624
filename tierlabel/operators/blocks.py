"""Bounds on what is broadcast or held at once, counted in numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_CELLS = 8_000_000  # numbers in a broadcast block: 64 MB as doubles
SCORE_CELLS = 4_000_000  # scores held at once while a block is compared


def cells(df: DataFrame, *arrays: str) -> int:
    """How many numbers the array columns hold in all, at least one per row."""
    size = sum((F.coalesce(F.size(a), F.lit(0)) for a in arrays), F.lit(1)).cast("long")
    return int(df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])
