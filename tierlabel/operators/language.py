"""Language detection and translation of items that are not English."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlabel.operators.blocks import BROADCAST_CELLS
from tierlabel.operators.tables import lookup_join
from tierlabel.session import cut_lineage

ENGLISH = "en"  # fixed value: the one language that is not translated


GRAM_SLICE = 1_000_000  # characters counted at once
DETECT_SLICE = 500_000  # characters scored at once


DENSE_CODES = 4_000_000  # places of a table over all n-grams that the characters at hand can form


def distinct_grams(texts: Sequence[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of some texts in order: the row of each, its place among the distinct ones, and their codes.

    Up to three characters a code is the code points side by side, so that different n-grams differ; longer ones are
    hashed to 64 bits. Where few different characters occur, a table over all their combinations replaces sorting.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    total = max(0, len(points) - n + 1)
    whole = np.int32 if len(points) + n < 1 << 31 else np.int64
    row = np.repeat(np.arange(len(texts), dtype=whole), lengths)[:total]
    inside = np.arange(n, total + n, dtype=whole) <= np.cumsum(lengths).astype(whole)[row]
    letters = np.flatnonzero(np.bincount(points))
    size = len(letters)
    if size**n <= DENSE_CODES:
        number = np.zeros(int(letters[-1]) + 1 if size else 1, np.int32)  # as are the places, which are at most DENSE_CODES
        number[letters] = np.arange(size)
        compact = number[points]
        dense = np.zeros(total, np.int32)
        for i in range(n):
            dense = dense * size + compact[i : i + total]
        dense = dense[inside]
        met = np.flatnonzero(np.bincount(dense, minlength=1))
        met = met if len(dense) else met[:0]
        place = np.zeros(int(met[-1]) + 1 if len(met) else 1, np.int32)
        place[met] = np.arange(len(met))
        spelled = [letters[met // size ** (n - 1 - i) % size] for i in range(n)] if size else [met] * n
        return row[inside], place[dense], _codes(spelled)
    codes, place = np.unique(_codes([points[i : i + total] for i in range(n)])[inside], return_inverse=True)
    return row[inside], place, codes


def _codes(characters: Sequence[np.ndarray]) -> np.ndarray:
    """One number per n-gram, given its first characters, its second ones, and so on."""
    code = np.zeros(len(characters[0]), np.uint64)
    for c in characters:
        shifted = code << np.uint64(21) if len(characters) <= 3 else code * np.uint64(0x9E3779B97F4A7C15) ^ (code >> np.uint64(29))
        code = shifted + c.astype(np.uint64)
    return code.view(np.int64)


def _slices(lengths: Sequence[int] | np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Whole texts of about ``size`` characters at a time, given their lengths."""
    upto = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right")))
        yield at, to
        at = to


@dataclass
class LanguageModel:
    """Naive Bayes over character n-grams.

    ``languages`` lists (name, log prior, base) in the order of the names, a handful of rows kept as values.
    A language's score for a text is its log prior, plus its base per n-gram of the text, plus what each
    n-gram seen with that language adds: place i of ``added`` in ``grams(gram long, added array<double>)``.
    """

    n: int
    grams: DataFrame
    languages: list[tuple[str, float, float]]

    @classmethod
    def fit(cls, docs: DataFrame, text: str, lang: str, n: int = 3, alpha: float = 1.0) -> LanguageModel:
        """Count n-grams of whole texts per language, in each Arrow batch first; only these counts shuffle."""
        known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for name in sorted(set(names)):
                    own = [t for t, x in zip(texts, names) if x == name]
                    found = [(pa.nulls(1, pa.int64()), [len(own)])]  # without an n-gram: the number of texts
                    for at, to in _slices([len(t) for t in own], GRAM_SLICE):
                        _, place, codes = distinct_grams(own[at:to], n)
                        found.append((pa.array(codes), np.bincount(place, minlength=len(codes))))
                    for codes, counts in found:
                        columns = [pa.array([name] * len(codes), pa.string()), codes, pa.array(counts, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "c"])

        given = known.select(F.col(lang).cast("string").alias("lang"), F.lower(text).alias("text"))
        counts = given.mapInArrow(count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c")).persist()
        texts = {r.lang: r.c for r in counts.filter("gram IS NULL").collect()}
        seen = counts.filter("gram IS NOT NULL")
        totals = {r.lang: r.n for r in seen.groupBy("lang").agg(F.sum("c").alias("n")).collect()}
        vocabulary = seen.select("gram").distinct().count()
        languages = [
            (name, math.log(texts[name] / sum(texts.values())), math.log(alpha / max(alpha, totals.get(name, 0) + alpha * vocabulary)))
            for name in sorted(texts)
        ]
        added = F.log((F.col("c") + alpha) / F.lit(alpha))
        wide = [F.coalesce(F.max(F.when(F.col("lang") == name, added)), F.lit(0.0)) for name, _, _ in languages]
        grams = seen.groupBy("gram").agg(F.array(*wide).cast("array<double>").alias("added")).persist()
        return cls(n, grams, languages)

    def _block_sums(self, block: DataFrame) -> Callable:
        """A column function from lower-case texts to what the n-grams of a block add for each language."""
        n, width = self.n, len(self.languages)
        table = block.select("gram", "added").toArrow().sort_by("gram").combine_chunks()
        weights = table["added"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        shared = block.sparkSession.sparkContext.broadcast((table["gram"].to_numpy(), weights))

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def sums(texts: pa.Array) -> pa.Array:  # of a batch only a slice is held as Python strings
            codes, weights = shared.value
            found = np.zeros((len(texts), width))
            lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
            for at, to in _slices(lengths, DETECT_SLICE) if len(codes) else ():
                row, gram, met = distinct_grams(texts.slice(at, to - at).to_pylist(), n)
                place = np.minimum(np.searchsorted(codes, met), len(codes) - 1)
                added = np.where((codes[place] == met)[:, None], weights[place], 0.0)
                for i in range(width):
                    found[at:to, i] = np.bincount(row, weights=added[gram, i], minlength=to - at)
            offsets = pa.array(np.arange(0, found.size + 1, width, dtype=np.int32))
            return pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))

        return sums

    def detect(
        self, df: DataFrame, text: str, out: str = "lang", score: str = "lang_score", broadcast_cells: int = BROADCAST_CELLS
    ) -> DataFrame:
        """Add the most probable language and its score; equal scores go to the first language by name.

        Rows stay where they are and need no key. The model is broadcast in blocks of at most ``broadcast_cells``
        numbers, whose sums add up. A null text counts as an empty one.
        """
        if not self.languages:
            return df.withColumn(out, F.lit(None).cast("string")).withColumn(score, F.lit(None).cast("double"))
        width = len(self.languages)
        n_blocks = max(1, math.ceil(self.grams.count() * (width + 1) / broadcast_cells))
        lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
        rows = df.withColumn("__sums", F.array(*[F.lit(0.0)] * width))
        for i in range(n_blocks):
            block = self.grams.filter(F.pmod(F.xxhash64("gram"), F.lit(n_blocks)) == i) if n_blocks > 1 else self.grams
            rows = rows.withColumn("__sums", F.zip_with("__sums", self._block_sums(block)(lowered), lambda a, b: a + b))
            if i % 8 == 7:  # as many passes in one stage at most
                rows = cut_lineage(rows)
        n_grams = F.greatest(F.char_length(lowered) - (self.n - 1), F.lit(0))
        options = [
            F.struct(
                F.round(F.lit(prior) + n_grams * F.lit(base) + F.get("__sums", F.lit(i)), 6).alias("score"),
                F.lit(-i).alias("place"),
                F.lit(name).alias("lang"),
            )
            for i, (name, prior, base) in enumerate(self.languages)
        ]
        best = rows.withColumn("__best", F.array_max(F.array(*options)))
        return best.withColumn(out, F.col("__best.lang")).withColumn(score, F.col("__best.score")).drop("__sums", "__best")

    def save(self, path: str) -> None:
        spark = self.grams.sparkSession
        self.grams.write.mode("overwrite").parquet(f"{path}/grams")
        rows = [(self.n, *language) for language in self.languages] or [(self.n, None, None, None)]
        spark.createDataFrame(rows, "n int, name string, prior double, base double").write.mode("overwrite").parquet(f"{path}/languages")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LanguageModel:
        rows = spark.read.parquet(f"{path}/languages").orderBy("name").collect()
        languages = [(r.name, r.prior, r.base) for r in rows if r.name is not None]
        return cls(rows[0].n, spark.read.parquet(f"{path}/grams"), languages)


def is_foreign(text: str, lang: str) -> Column:
    """True for a text in a known language other than English."""
    return F.coalesce(F.col(lang) != ENGLISH, F.lit(False)) & F.col(text).isNotNull()


def translate_missing(
    items: DataFrame, text: str, lang: str, known: DataFrame | None, translator: Callable[[list[str]], list[str]]
) -> DataFrame:
    """``(source, translation)`` of the distinct foreign texts that ``known(source, ..)`` does not have.

    If ``known`` names the language of its sources in ``lang``, so does the result, and a text counts in each of its languages.
    ``translator`` gets a batch of texts at a time.
    """
    keys = ["source", "lang"] if known is not None and "lang" in known.columns else ["source"]
    misses = items.filter(is_foreign(text, lang)).select(F.col(text).alias("source"), F.col(lang).cast("string").alias("lang"))
    misses = misses.select(*keys).distinct()
    if known is not None:
        misses = misses.join(known.select(*keys), keys, "left_anti")

    def translate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(translation=translator(batch["source"].tolist()))

    return misses.mapInPandas(translate, ", ".join(f"{c} string" for c in [*keys, "translation"]))


def translate_non_english(
    items: DataFrame,
    text: str,
    lang: str,
    memory: DataFrame | None = None,
    translator: Callable[[list[str]], list[str]] | None = None,
    out: str = "translated",
) -> DataFrame:
    """Add the English form of a text; the text itself stays as it is.

    English and unknown languages pass unchanged. Others are looked up in ``memory(source, translation)``; a source
    that it has twice makes the query fail. The same text may be of two languages: a memory with a column ``lang`` translates
    a source for items of that language only, and may have it once per language. ``translator``, if given, gets the distinct texts that the memory does not have, a
    batch at a time. What is still missing passes unchanged.
    """
    foreign = is_foreign(text, lang)
    known, keys = None, ["source"]
    if memory is not None:
        keys = ["source", "lang"] if "lang" in memory.columns else keys
        grouped = memory.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("translation").alias("translation"))
        twice = F.raise_error(F.lit("translate: a source occurs twice in the memory")).cast("string")
        known = grouped.select(*keys, F.when(F.col("n") > 1, twice).otherwise(F.col("translation")).alias("translation"))
    if translator is not None:
        fresh = translate_missing(items, text, lang, known, translator)
        known = fresh if known is None else known.unionByName(fresh)
    if known is None:
        return items.withColumn(out, F.col(text))
    # Other rows have no key, and are spread by a random one where Spark has to shuffle.
    asked = items.withColumn("__asked", F.when(foreign, F.col(text)))
    spread = F.when(foreign, F.lit(0)).otherwise(F.floor(F.rand(7) * 1024) + 1).cast("int")
    known = known.withColumnsRenamed({c: f"__known_{c}" for c in known.columns}).withColumn("__none", F.lit(0))
    asked = asked.withColumns({"__spread": spread, "__asked_lang": F.col(lang)})
    by = ["__asked", "__asked_lang", "__spread"] if "lang" in keys else ["__asked", "__spread"]
    joined = lookup_join(asked, known, by, [*[f"__known_{k}" for k in keys], "__none"])
    translated = joined.withColumn(out, F.coalesce("__known_translation", F.col(text)))
    return translated.select(*[c for c in translated.columns if c in items.columns or c == out])
