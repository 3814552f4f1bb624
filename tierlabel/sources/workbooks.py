"""Folders of .xlsx workbooks: one task reads many files, each file on its own."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name spaces of the Office Open XML spreadsheet format (ECMA-376).
SHEET_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{SHEET_NS}sheets/{SHEET_NS}sheet")
    wanted = sheet.get(f"{RELATION_NS}id")
    for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if link.get("Id") == wanted:
            target = link.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError("the workbook has no first sheet")


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{SHEET_NS}t"))


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _rows(content: bytes) -> Iterator[list[str | None]]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            table = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = [_text(item) for item in table.iter(f"{SHEET_NS}si")]
        with book.open(_first_sheet(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{SHEET_NS}row":
                    continue
                values: list[str | None] = []
                for cell in row.iter(f"{SHEET_NS}c"):
                    at = _column_number(cell.get("r")) if cell.get("r") else len(values)
                    values += [None] * (at + 1 - len(values))
                    raw = cell.find(f"{SHEET_NS}v")
                    if cell.get("t") == "inlineStr":
                        values[at] = _text(cell)
                    elif raw is not None:
                        values[at] = shared[int(raw.text)] if cell.get("t") == "s" else raw.text
                yield values
                row.clear()


def parse_workbooks(files: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Rows of the first sheet of every workbook in ``files(path, content)``; the first row is the header.

    Columns are found by name; a missing one is null. Values are cast to the schema by Spark.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = schema.fieldNames()
    texts = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = _rows(content)
                header = next(rows, [])
                places = [header.index(n) if n in header else -1 for n in names]
                picked = [[r[p] if 0 <= p < len(r) else None for p in places] for r in rows]
                yield pd.DataFrame(picked, columns=names, dtype=object)

    parsed = files.select("content").mapInPandas(parse, texts)
    return parsed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_workbooks(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All .xlsx files of a folder (or one file) as rows."""
    return parse_workbooks(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path), schema)
