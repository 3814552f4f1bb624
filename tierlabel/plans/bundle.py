"""A whole ensemble in one folder: versions with all tables and settings, and a manifest that is written last."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Generic, TypeVar

from pyspark.sql import SparkSession

from tierlabel.operators.catalogue import CatalogueModel
from tierlabel.operators.language import LanguageModel
from tierlabel.operators.linear import LinearModel
from tierlabel.operators.memory import TranslationMemory
from tierlabel.plans.ensemble import Ensemble
from tierlabel.sources.folders import exists, is_complete, read_text, subfolders, write_text

_MANIFEST = "manifest.json"
Model = TypeVar("Model")


def versions(spark: SparkSession, folder: str) -> list[str]:
    """The names of the versions that have a manifest, oldest first."""
    names = [n for n in subfolders(spark, folder) if n.startswith("version-")]
    return [n for n in names if exists(spark, f"{folder}/{n}/{_MANIFEST}")]


def save_ensemble(ensemble: Ensemble, linear: LinearModel, folder: str) -> str:
    """Write a new version and return its name. Until its manifest is there, nobody loads it.

    A growing memory stays where it is, and the bundle names its path; a memory table is copied. One application saves at a time.
    """
    spark = ensemble.taxonomy.sparkSession
    last = max([int(n.split("-")[1]) for n in subfolders(spark, folder) if n.startswith("version-")], default=0)
    name = f"version-{last + 1:06}"
    path = f"{folder}/{name}"
    ensemble.brands.save(f"{path}/brands")
    linear.save(f"{path}/linear")
    ensemble.taxonomy.write.parquet(f"{path}/taxonomy")
    ensemble.vectors.write.parquet(f"{path}/vectors")
    parts = [f"brands/{t}" for t in ("idf", "vectors", "rows", "settings")] + [f"linear/{t}" for t in ("idf", "weights", "classes", "settings")]
    parts += ["taxonomy", "vectors"]
    memory = None
    if isinstance(ensemble.memory, TranslationMemory):
        memory = ensemble.memory.path
    elif ensemble.memory is not None:
        ensemble.memory.write.parquet(f"{path}/memory")
        parts.append("memory")
    if ensemble.languages is not None:
        ensemble.languages.save(f"{path}/languages")
        parts += ["languages/grams", "languages/languages"]
    write_text(spark, f"{path}/{_MANIFEST}", json.dumps({"dim": ensemble.dim, "parts": parts, "growing_memory": memory}))
    return name


def load_ensemble(
    spark: SparkSession, folder: str, version: str | None = None, translator: Callable[[list[str]], list[str]] | None = None
) -> Ensemble:
    """The newest version, or a named one, with the settings it was saved with. A missing or unfinished part is an error."""
    known = versions(spark, folder)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"{folder} has no complete version{'' if version is None else ' ' + version}")
    path = f"{folder}/{version or known[-1]}"
    stored = json.loads(read_text(spark, f"{path}/{_MANIFEST}"))
    missing = [p for p in stored["parts"] if not is_complete(spark, f"{path}/{p}")]
    if missing:
        raise FileNotFoundError(f"{path} lacks {', '.join(missing)}")
    taxonomy = spark.read.parquet(f"{path}/taxonomy")
    linear = LinearModel.load(spark, f"{path}/linear")
    memory = spark.read.parquet(f"{path}/memory") if "memory" in stored["parts"] else None
    if stored["growing_memory"]:
        memory = TranslationMemory(spark, stored["growing_memory"])
    return Ensemble(
        taxonomy,
        CatalogueModel.load(spark, f"{path}/brands"),
        lambda df: linear.predict(df, "translated", taxonomy),
        spark.read.parquet(f"{path}/vectors"),
        stored["dim"],
        memory,
        translator,
        LanguageModel.load(spark, f"{path}/languages") if "languages/grams" in stored["parts"] else None,
    )


@dataclass
class ModelHandle(Generic[Model]):
    """The newest model of a folder of versions, loaded once per version; for streams, which ask before each micro-batch.

    Asking lists the folder and starts no job while the version stays the same.
    """

    spark: SparkSession
    folder: str
    load: Callable[[SparkSession, str], Model]
    version: str | None = None
    model: Model | None = None

    def get(self) -> Model:
        known = versions(self.spark, self.folder)
        if not known:
            raise FileNotFoundError(f"{self.folder} has no complete version")
        if known[-1] != self.version:
            self.model = self.load(self.spark, f"{self.folder}/{known[-1]}")
            self.version = known[-1]
        return self.model


def catalogue_handle(spark: SparkSession, folder: str) -> ModelHandle[CatalogueModel]:
    """A handle on the catalogue model of an ensemble's bundle."""

    def load(spark: SparkSession, path: str) -> CatalogueModel:
        model = CatalogueModel.load(spark, f"{path}/brands")
        model.handle()
        return model

    return ModelHandle(spark, folder, load)
