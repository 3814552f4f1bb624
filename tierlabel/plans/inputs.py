"""Frames of the product domain, made from the given tables by Spark. All of them use whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlabel.operators.groups import unique_table
from tierlabel.operators.tables import lookup_join


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    """Every part as a taxonomy row; one type has lost its segment title and one name its class title."""
    part = table(spark, folder, "part")
    return part.select(
        F.col("p_partkey").alias("row_idx"),
        F.nullif("p_type", F.lit("PROMO")).alias("SegmentTitle"),
        F.col("p_brand").alias("FamilyTitle"),
        F.nullif("p_name", F.lit("hot gear")).alias("ClassTitle"),
    )


def full_taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return part.select(
        F.col("p_partkey").alias("row_idx"),
        F.col("p_type").alias("SegmentTitle"),
        F.col("p_brand").alias("FamilyTitle"),
        F.col("p_name").alias("ClassTitle"),
    )


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct (type, brand, name) of all parts with the lowest key of each."""
    keys = ["p_type", "p_brand", "p_name"]
    rows = unique_table(table(spark, folder, "part"), "p_partkey", keys, keys)
    return rows.select(
        F.col("p_partkey").alias("row_idx"),
        F.col("p_type").alias("Sector"),
        F.col("p_brand").alias("Brand"),
        F.col("p_name").alias("Product"),
        F.col("p_type").alias("Segment"),
        F.col("p_brand").alias("Family"),
        F.col("p_name").alias("Class"),
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Every part as an item to classify; promotion items come with a foreign language tag."""
    part = table(spark, folder, "part")
    return part.select(
        F.col("p_partkey").alias("item_id"),
        F.concat("p_brand", F.lit(" "), "p_name").alias("product_name"),
        F.when(F.col("p_type") == "PROMO", "fr").otherwise("en").alias("lang"),
        F.col("p_type").alias("segment"),
        F.col("p_brand").alias("family"),
        F.col("p_name").alias("class"),
    )


def item_memory(spark: SparkSession, folder: str) -> DataFrame:
    """A translation for every item text: its words in another order and one more word."""
    part = table(spark, folder, "part")
    texts = part.select(
        F.concat("p_brand", F.lit(" "), "p_name").alias("source"),
        F.concat("p_name", F.lit(" imported "), "p_brand").alias("translation"),
    )
    return texts.distinct()


def voters(spark: SparkSession, folder: str) -> DataFrame:
    """Items with three class votes: the class of the first part that shares some attributes with the item."""
    part = table(spark, folder, "part")
    rows = part.select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_type").alias("segment"),
        F.col("p_brand").alias("family"),
        F.col("p_name").alias("class"),
        "p_size",
    )
    for name, keys in (
        ("embed_class", ["segment", "family", "p_size"]),
        ("brand_class", ["family", "p_size"]),
        ("clf_class", ["segment", "p_size"]),
    ):
        grouped = rows.groupBy(*keys).agg(F.min_by("class", "item_id").alias(name))
        first = grouped.withColumnsRenamed({k: f"__{k}" for k in keys})
        rows = lookup_join(rows, first, keys, [f"__{k}" for k in keys]).drop(*first.columns[: len(keys)])
    return rows.drop("p_size")


def embedding_taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    """A tree over the labels of the embeddings: two labels to a family, two families to a segment."""
    rows = table(spark, folder, "embeddings").select("vec_id", "label")
    return rows.select(
        F.col("vec_id").alias("row_idx"),
        F.expr("concat('segment ', cast(label div 4 as string))").alias("SegmentTitle"),
        F.expr("concat('family ', cast(label div 2 as string))").alias("FamilyTitle"),
        F.expr("concat('class ', cast(label as string))").alias("ClassTitle"),
    )


def prototypes(spark: SparkSession, folder: str) -> DataFrame:
    """One vector per title of the tree: the mean of all embeddings below the title."""
    rows = table(spark, folder, "embeddings")
    titles = F.expr(
        "array(concat('segment ', cast(label div 4 as string)),"
        " concat('family ', cast(label div 2 as string)), concat('class ', cast(label as string)))"
    )
    places = rows.select(titles.alias("titles"), F.posexplode("embedding").alias("place", "value"))
    titled = places.select(F.explode("titles").alias("title"), "place", "value")
    means = titled.groupBy("title", "place").agg(F.avg(F.col("value").cast("double")).alias("value"))
    packed = means.groupBy("title").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v"))
    return packed.select("title", F.col("v.value").alias("vector"))


def write_workbooks(df: DataFrame, folder: str) -> DataFrame:
    """Each task writes its rows as .xlsx workbooks below a folder that all executors share; returns their paths."""
    import uuid
    import zipfile
    from xml.sax.saxutils import escape

    names = df.columns
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = f'<workbook xmlns="{main}" xmlns:r="{relation}"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>'
    links = (
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        f'<Relationship Id="rId1" Type="{relation}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'
    )

    def cell(value) -> str:
        if value is None:
            return "<c/>"
        return f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            rows = [names, *batch.itertuples(index=False)]
            body = "".join(f"<row>{''.join(cell(v) for v in r)}</row>" for r in rows)
            path = f"{root}/{uuid.uuid4().hex}.xlsx"
            with system.open_output_stream(path) as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("xl/workbook.xml", book)
                z.writestr("xl/_rels/workbook.xml.rels", links)
                z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
            yield pd.DataFrame({"path": [path]})

    texts = df.select(*[F.col(c).cast("string").alias(c) for c in names])
    return texts.mapInPandas(write, "path string")
