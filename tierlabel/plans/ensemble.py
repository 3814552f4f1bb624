"""The whole classification: translate, three classifiers, vote, confidence; and the train-and-test job."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlabel.operators.catalogue import CatalogueModel
from tierlabel.operators.dense import hashed_encoder
from tierlabel.operators.evaluation import LEVELS, accuracy
from tierlabel.operators.groups import unique_table
from tierlabel.operators.hierarchy import hierarchical_classify
from tierlabel.operators.language import LanguageModel, translate_non_english
from tierlabel.operators.linear import LinearModel
from tierlabel.operators.memory import TranslationMemory
from tierlabel.operators.tfidf import TfidfSettings
from tierlabel.operators.voting import vote
from tierlabel.session import cut_lineage
from tierlabel.sources.tables import write_csv

# The columns of the flat output, in their order.
OUTPUT_COLUMNS = (
    "product_name",
    "pred_segment",
    "pred_family",
    "pred_class",
    "brand_segment",
    "brand_family",
    "brand_class",
    "embed_segment",
    "embed_family",
    "embed_class",
    "clf_segment",
    "clf_family",
    "clf_class",
    "confidence_rate",
    "confidence_level",
)


_TITLES = ("SegmentTitle", "FamilyTitle", "ClassTitle")


def as_items(spark: SparkSession, texts: str | Sequence[str]) -> DataFrame:
    """A text or a few texts, as typed in by a user, as items."""
    texts = [texts] if isinstance(texts, str) else texts
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, product_name string")


def title_vectors(taxonomy: DataFrame, dim: int = 64) -> DataFrame:
    """``(title, vector)`` for every distinct title of the taxonomy."""
    titles = taxonomy.select(F.explode(F.array(*_TITLES)).alias("title"))
    distinct = titles.filter(F.col("title").isNotNull()).distinct()
    return distinct.select("title", hashed_encoder(F.col("title"), dim).alias("vector"))


@dataclass
class Ensemble:
    """The fitted parts of the ensemble.

    ``classifier`` adds ``clf_segment, clf_family, clf_class`` to a frame with the text column ``translated``.
    ``languages`` detects the language of items that come without one. ``memory`` is a table of translations, or a
    ``TranslationMemory`` that grows with what ``translator`` translates.
    """

    taxonomy: DataFrame
    brands: CatalogueModel
    classifier: Callable[[DataFrame], DataFrame]
    vectors: DataFrame
    dim: int = 64
    memory: DataFrame | TranslationMemory | None = None
    translator: Callable[[list[str]], list[str]] | None = None
    languages: LanguageModel | None = None

    def translated(self, items: DataFrame, text: str, lang: str | None = None, batch: str | int | None = None) -> DataFrame:
        """Items with ``translated``: the English form of their text.

        Without a column ``lang`` the languages are detected, if there is a model for it. With a growing memory, what it lacks
        is translated and kept first, under the name ``batch``; without that name nothing is kept.
        """
        rows, columns = items, items.columns
        if lang is None and self.languages is not None:
            rows, lang = self.languages.detect(items, text, "__lang", "__lang_score"), "__lang"
        if lang is None:
            return items.withColumn("translated", F.col(text))
        memory, translator = self.memory, self.translator
        if isinstance(memory, TranslationMemory):
            if translator is not None and batch is not None:
                memory.add(rows, text, lang, translator, batch)
                translator = None
            memory = memory.table()
        return translate_non_english(rows, text, lang, memory, translator).select(*columns, "translated")

    def run(
        self,
        items: DataFrame,
        item_id: str = "item_id",
        text: str = "product_name",
        lang: str | None = None,
        batch: str | int | None = None,
    ) -> DataFrame:
        """All items with the output columns; ``product_name`` keeps the original text.

        Detection, translation and classifiers only add columns, and each scores the items in place, so there is
        no join of three results by id: the only joins are with the memory and with label tables of the size of the taxonomy.
        """
        rows = self.translated(items, text, lang, batch)
        rows = self.brands.predict(rows, "translated").drop("brand_row", "brand_score", "brand_matched")
        rows = self.classifier(rows)
        rows = rows.withColumn("__vector", hashed_encoder(F.col("translated"), self.dim))
        rows = hierarchical_classify(rows, self.taxonomy, self.vectors, item_id, "__vector")
        voted = vote(rows.drop("__vector"), self.taxonomy)
        return voted.drop("in_taxonomy", "translated")

    def flat(
        self,
        items: DataFrame,
        item_id: str = "item_id",
        text: str = "product_name",
        lang: str | None = None,
        keep: tuple[str, ...] = (),
        batch: str | int | None = None,
    ) -> DataFrame:
        """The fifteen output columns, after the columns of ``keep``."""
        rows = self.run(items, item_id, text, lang, batch).withColumnRenamed(text, "product_name")
        return rows.select(*keep, *OUTPUT_COLUMNS)


def _counted(items: DataFrame, *columns: str | None) -> DataFrame:
    """One row for all items that are equal in the columns, and their number as ``__copies``. What follows grows with distinct rows."""
    return items.groupBy(*dict.fromkeys(c for c in columns if c is not None)).agg(F.count(F.lit(1)).alias("__copies"))


def train(
    train_items: DataFrame,
    taxonomy: DataFrame,
    catalogue: DataFrame,
    settings: TfidfSettings = TfidfSettings(),
    text: str = "product_name",
    label: str = "class",
    dim: int = 64,
    lang: str | None = None,
    languages: LanguageModel | None = None,
    memory: DataFrame | TranslationMemory | None = None,
    translator: Callable[[list[str]], list[str]] | None = None,
    **svm_options,
) -> tuple[Ensemble, LinearModel]:
    """Fit the catalogue model and the linear classifier and put the ensemble together.

    Training items are translated as later ones are: their languages from the column ``lang`` or by ``languages``. Equal ones
    are counted before, and of equal taxonomy rows the first is kept, so both tables are read once.
    """
    taxonomy = unique_table(taxonomy, "row_idx", _TITLES, _TITLES).persist()
    brands = CatalogueModel.fit(catalogue, settings)
    vectors = title_vectors(taxonomy, dim).persist()
    ensemble = Ensemble(taxonomy, brands, lambda df: df, vectors, dim, memory, translator, languages)
    rows = ensemble.translated(_counted(train_items, text, lang, label), text, lang)
    svm = LinearModel.fit(rows, "translated", label, settings, copies="__copies", **svm_options)
    ensemble.classifier = lambda df: svm.predict(df, "translated", taxonomy)
    return ensemble, svm


def train_and_test(
    train_items: DataFrame,
    test_items: DataFrame,
    taxonomy: DataFrame,
    catalogue: DataFrame,
    output: str | None = None,
    lang: str | None = None,
    **options,
) -> DataFrame:
    """Fit, predict the test items, write their predictions if asked, and give one accuracy row per model.

    Items are translated by the column ``lang``, or by the languages that ``languages`` among the options detects.
    Accuracy compares true and predicted labels at each level, for each of the three models and the vote.
    The predictions are checkpointed, so the output and all accuracies come from one scoring pass. Without output, equal test
    items are scored once and count as often as they occur.
    """
    ensemble, _ = train(train_items, taxonomy, catalogue, lang=lang, **options)
    copies = "__copies" if output is None else None
    rows = test_items if output is not None else _counted(test_items, "product_name", lang, *LEVELS)
    predictions = cut_lineage(ensemble.run(rows, lang=lang))
    if output is not None:
        write_csv(predictions, output)
    scores = [
        accuracy(predictions, prefix=prefix, copies=copies).select(F.lit(name).alias("model"), "*")
        for name, prefix in (("linear", "clf_"), ("catalogue", "brand_"), ("embedding", "embed_"), ("ensemble", "pred_"))
    ]
    result = scores[0]
    for s in scores[1:]:
        result = result.unionByName(s)
    return result
