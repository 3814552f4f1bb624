"""Translations that are kept: a table in a shared folder that grows batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlabel.operators.language import translate_missing
from tierlabel.sources.folders import is_complete, subfolders

_SCHEMA = "source string, translation string"


@dataclass
class TranslationMemory:
    """Translations below ``path``, one folder per batch.

    A batch counts from the moment Spark has marked its folder as complete, so a reader never sees half of one.
    Adding a batch that is complete does nothing, and one that was cut off is written anew: a batch that is repeated after a failure
    leaves its rows once, and its texts are translated once. One application adds batches at a time.
    """

    spark: SparkSession
    path: str

    def batches(self) -> list[str]:
        """The names of the complete batches."""
        names = [n for n in subfolders(self.spark, self.path) if n.startswith("batch=")]
        return [n[len("batch=") :] for n in names if is_complete(self.spark, f"{self.path}/{n}")]

    def table(self) -> DataFrame:
        """``(source, translation)``, one row per source; of two batches the first by name counts."""
        names = self.batches()
        if not names:
            return self.spark.createDataFrame([], _SCHEMA)
        paths = [f"{self.path}/batch={n}" for n in names]
        rows = self.spark.read.schema(f"{_SCHEMA}, batch string").option("basePath", self.path).parquet(*paths)
        return rows.groupBy("source").agg(F.min_by("translation", "batch").alias("translation"))

    def add(self, items: DataFrame, text: str, lang: str, translator: Callable[[list[str]], list[str]], batch: str | int) -> bool:
        """Translate the distinct foreign texts that no batch has, and keep them. False if the batch is there already."""
        name = str(batch)
        if not name or not all(c.isalnum() or c in "-_." for c in name):
            raise ValueError("a batch is named by letters, digits, and - _ . only")
        names = self.batches()
        if name in names:
            return False
        fresh = translate_missing(items, text, lang, self.table() if names else None, translator)
        fresh.write.mode("overwrite").parquet(f"{self.path}/batch={name}")
        return True
