"""TF-IDF as tables: document frequencies, weights, and vectors as (id, token, weight) rows."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierlabel.functions.text import tokens
from tierlabel.operators.tables import lookup_join


TASK_TOKENS = 500_000  # tokens that a task counts, about


@dataclass(frozen=True)
class TfidfSettings:
    """How texts become weighted tokens."""

    analyzer: str = "word"
    ngram_range: tuple[int, int] = (1, 1)
    lowercase: bool = True
    strip_accents: bool = False
    stop_words: tuple[str, ...] = field(default_factory=tuple)
    min_df: int = 1
    max_df: float = 1.0
    smooth_idf: bool = True
    sublinear_tf: bool = True
    norm: str | None = "l2"

    def __post_init__(self) -> None:
        if self.norm not in ("l2", "l1", None):
            raise ValueError("norm must be 'l2', 'l1' or None")

    def tokens_per_byte(self) -> float:
        """About how many tokens a byte of text gives; a word has five bytes and more."""
        lo, hi = self.ngram_range
        return (hi - lo + 1) / (5 if self.analyzer == "word" else 1)

    def tokens(self, text: Column) -> Column:
        return tokens(text, self.analyzer, self.ngram_range, self.lowercase, self.strip_accents, self.stop_words)


def save_settings(spark: SparkSession, settings: TfidfSettings, path: str) -> None:
    """Keep the settings with a model, as a table of one row."""
    row = spark.range(1).select(F.lit(json.dumps(asdict(settings))).alias("settings"))
    row.write.mode("overwrite").parquet(f"{path}/settings")


def load_settings(spark: SparkSession, path: str) -> TfidfSettings:
    stored = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
    return TfidfSettings(**{k: tuple(v) if isinstance(v, list) else v for k, v in stored.items()})


def tfidf_fit(docs: DataFrame, text: str, settings: TfidfSettings = TfidfSettings(), copies: str | None = None) -> DataFrame:
    """The vocabulary: ``(token, df, idf)``.

    Repeats within a document are dropped inside the row, so that counting is one map-side combined
    group-by on the token. A null text counts as a document without tokens. A row counts as the number of documents in
    its column ``copies``, if that is named.
    """
    number = F.count(F.lit(1)) if copies is None else F.coalesce(F.sum(copies), F.lit(0))
    n = docs.agg(number.cast("double").alias("n")).scalar()
    found = docs.select(F.explode(F.array_distinct(settings.tokens(F.col(text)))).alias("token"), *([copies] if copies else []))
    counted = found.groupBy("token").agg(number.alias("df")).withColumn("__n", n)
    kept = counted.filter((F.col("df") >= settings.min_df) & (F.col("df") <= F.col("__n") * settings.max_df))
    extra = 1.0 if settings.smooth_idf else 0.0
    idf = F.log((F.col("__n") + extra) / (F.col("df") + extra)) + 1.0
    return kept.select("token", "df", idf.alias("idf"))


def term_counts(docs: DataFrame, doc_id: str, text: str, settings: TfidfSettings) -> DataFrame:
    """``(doc_id, token, tf)``, partitioned by document.

    The texts are shuffled by document id once; exploding and counting then stay inside the partition, so
    the many token rows are not shuffled. The texts are measured first, and the number of partitions follows from their size, so that
    a task counts about ``TASK_TOKENS`` tokens (at least one document) at every size of the table.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = max(1, math.ceil(size * settings.tokens_per_byte() / TASK_TOKENS))
    placed = docs.select(doc_id, text).repartition(n, doc_id)
    exploded = placed.select(doc_id, F.explode(settings.tokens(F.col(text))).alias("token"))
    return exploded.groupBy(doc_id, "token").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_transform(
    docs: DataFrame, doc_id: str, text: str, idf: DataFrame, settings: TfidfSettings = TfidfSettings()
) -> DataFrame:
    """``(doc_id, token, weight)``; tokens outside the vocabulary are dropped.

    The vocabulary joins as a broadcast when Spark measures it as small. Otherwise both sides shuffle by
    token; a frequent token has many document rows but one vocabulary row, which skew join splits.
    """
    vocabulary = idf.select(F.col("token").alias("__token"), "idf")
    counted = lookup_join(term_counts(docs, doc_id, text, settings), vocabulary, "token", "__token", "inner")
    tf = F.log("tf") + 1.0 if settings.sublinear_tf else F.col("tf").cast("double")
    weighted = counted.select(doc_id, "token", (tf * F.col("idf")).alias("weight"))
    if settings.norm is None:
        return weighted
    per_doc = Window.partitionBy(doc_id)
    if settings.norm == "l2":
        length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(per_doc))
    else:
        length = F.sum(F.abs("weight")).over(per_doc)
    return weighted.select(doc_id, "token", (F.col("weight") / length).alias("weight"))


def packed_vectors(weights: DataFrame, doc_id: str) -> DataFrame:
    """One row per document: ``(doc_id, terms array<string>, weights array<double>)``, sorted by token."""
    packed = weights.groupBy(doc_id).agg(F.sort_array(F.collect_list(F.struct("token", "weight"))).alias("v"))
    return packed.select(doc_id, F.col("v.token").alias("terms"), F.col("v.weight").alias("weights"))
