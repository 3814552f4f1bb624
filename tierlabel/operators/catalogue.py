"""Labels of the most similar entry of a product catalogue."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlabel.functions.text import product_document
from tierlabel.operators.sparse import BLOCK_BYTES, BlockSearch, Labels
from tierlabel.operators.tables import lookup_join
from tierlabel.operators.tfidf import TfidfSettings, load_settings, save_settings, tfidf_fit, tfidf_transform

LABELS = ("Segment", "Family", "Class")


@dataclass
class CatalogueHandle:
    """What scoring needs of a catalogue: the search, the first row, and the labels by row if they and the references fit a block each."""

    references: BlockSearch
    first: object
    labels: Labels | None


@dataclass
class CatalogueModel:
    """TF-IDF fitted on the catalogue's own documents, with the catalogue's vectors and labels as tables."""

    settings: TfidfSettings
    idf: DataFrame
    vectors: DataFrame
    rows: DataFrame
    _handles: dict[int, CatalogueHandle] = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def fit(cls, catalogue: DataFrame, settings: TfidfSettings = TfidfSettings()) -> CatalogueModel:
        """``catalogue(row_idx, Sector, Brand, Product, Segment, Family, Class)``."""
        # kept, since the catalogue is often made from a larger table
        read = catalogue.select("row_idx", product_document("Sector", "Brand", "Product").alias("document"), *LABELS).persist()
        docs = read.select("row_idx", "document")
        idf = tfidf_fit(docs, "document", settings)
        vectors = tfidf_transform(docs, "row_idx", "document", idf, settings)
        return cls(settings, idf.persist(), vectors.persist(), read.select("row_idx", *LABELS))

    def handle(self, block_bytes: int = BLOCK_BYTES) -> CatalogueHandle:
        """The reference side, measured and, as far as it fits a block, broadcast; made once, so that later calls start no job."""
        if block_bytes not in self._handles:
            search = BlockSearch.prepare(self.settings, self.idf, self.vectors, "row_idx", block_bytes)
            size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in LABELS), F.lit(16 * (1 + len(LABELS))))
            measured = self.rows.agg(F.min("row_idx").alias("first"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
            labels = None
            if search.whole is not None and measured["bytes"] <= block_bytes:
                shared = self.rows.sparkSession.sparkContext.broadcast(self.rows.select("row_idx", *LABELS).toPandas().set_index("row_idx"))
                labels = Labels(LABELS, shared, measured["first"])
            self._handles[block_bytes] = CatalogueHandle(search, measured["first"], labels)
        return self._handles[block_bytes]

    def predict(self, items: DataFrame, text: str, prefix: str = "brand_", block_bytes: int = BLOCK_BYTES) -> DataFrame:
        """Items with the catalogue row, cosine score and labels of their best entry.

        The first entry wins ties. A text without any known token gets the first catalogue row, score 0
        and ``matched = false``. Labels that fit a block are broadcast with it and looked up by the search; others are joined.
        """
        handle = self.handle(block_bytes)
        scored = handle.references.search(items, text, labels=handle.labels)
        # without any known token: the first row, whether or not it has a vector
        first = F.lit(handle.first).cast(self.rows.schema["row_idx"].dataType)
        ref = F.when(F.coalesce(F.col("__score"), F.lit(0.0)) > 0, F.col("__ref")).otherwise(first)
        scored = scored.withColumn("__ref", ref)
        found = [
            F.col("__ref").alias(f"{prefix}row"),
            F.greatest(F.col("__score"), F.lit(0.0)).alias(f"{prefix}score"),
            (F.col("__score") > 0).alias(f"{prefix}matched"),
        ]
        names = [f"{prefix}{c.lower()}" for c in LABELS]
        if handle.labels is not None:
            return scored.select(*items.columns, *found, *[F.col(f"__{c}").alias(n) for c, n in zip(LABELS, names)])
        lookup = self.rows.select(F.col("row_idx").alias("__row"), *[F.col(c).alias(n) for c, n in zip(LABELS, names)])
        return lookup_join(scored, lookup, "__ref", "__row").select(*items.columns, *found, *names)

    def save(self, path: str) -> None:
        for name in ("idf", "vectors", "rows"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        save_settings(self.idf.sparkSession, self.settings, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CatalogueModel:
        """Read a saved model with the settings it was fitted with; a missing one is an error."""
        return cls(load_settings(spark, path), *[spark.read.parquet(f"{path}/{name}") for name in ("idf", "vectors", "rows")])
