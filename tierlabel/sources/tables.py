"""Files and catalog tables."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlabel.operators.groups import renumber_ids
from tierlabel.sources.workbooks import read_workbooks

# What to do with a table that already exists.
IF_EXISTS = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}

# Short column type codes of the warehouse catalog.
TYPE_CODES = {
    "CV": "string",
    "CF": "string",
    "D": "date",
    "I": "int",
    "F": "double",
    "BO": "binary",
}


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = False
) -> DataFrame:
    """Read a .csv, .parquet or .xlsx path with a header.

    Types are inferred only when no schema is given, which costs one more pass over a CSV. Spark splits large files;
    those whose values hold line breaks need ``multiline=True``, and are then read by one task each.
    """
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix == ".csv":
        reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return reader.csv(path)
    if suffix == ".parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    if suffix == ".xlsx":
        if schema is None:
            raise ValueError("a workbook needs a schema")
        return read_workbooks(spark, path, schema)
    raise ValueError(f"files of type '{suffix}' are not supported")


def with_row_index(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Number the rows of files from 0 in file order: by path, then by place in the file.

    ``df`` comes straight from a reader (filters and projections may follow it). Spark reads larger files first, so the
    order of its partitions says nothing; the order here is file, start of the split, and position within the split.
    The numbering costs one range-partitioned shuffle and is stable, see ``renumber_ids``.
    """
    place = [
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__split"),
        F.monotonically_increasing_id().alias("__place"),
    ]
    ordered = df.select(*df.columns, *place)
    numbered = renumber_ids(ordered.withColumn(name, F.lit(0)), name, ["__file", "__split", "__place"], df.columns)
    return numbered.withColumn(name, F.col(name) - 1)


def write_csv(df: DataFrame, path: str) -> None:
    """Write a folder of CSV files with a header, replacing what is there."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def get_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, left lazy."""
    return spark.table(name)


def insert_table(df: DataFrame, name: str, if_exists: str = "replace") -> None:
    """Save as a catalog table; by default the table is replaced."""
    if if_exists not in IF_EXISTS:
        raise ValueError(f"if_exists must be one of {sorted(IF_EXISTS)}")
    df.write.mode(IF_EXISTS[if_exists]).format("parquet").saveAsTable(name)


def execute_query(spark: SparkSession, query: str) -> DataFrame:
    """Run one SQL statement; statements without a result give a frame without columns."""
    return spark.sql(query)


def create_table(spark: SparkSession, name: str, columns: Sequence[str], types: Sequence[str]) -> None:
    """Create an empty table; types are Spark type names or the short catalog codes."""
    if len(columns) != len(types):
        raise ValueError("columns and types must have the same length")
    ddl = ", ".join(f"`{c}` {TYPE_CODES.get(t, t)}" for c, t in zip(columns, types))
    spark.createDataFrame([], ddl).write.format("parquet").saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a table; a missing one is an error."""
    spark.sql(f"DROP TABLE {name}")


def sample_rows(df: DataFrame, n: int = 3, by: str | None = None, seed: int = 42) -> DataFrame:
    """Any ``n`` rows, or with ``by`` the same rows each time: the lowest hashes of that key.

    The ordered form keeps ``n`` rows per task and merges those, so nothing is sorted as a whole.
    """
    if by is None:
        return df.limit(n)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(by).cast("string")))
    return df.orderBy(key, F.col(by)).limit(n)


def describe_schema(spark: SparkSession, database: str | None = None) -> DataFrame:
    """One row per column of every permanent table of a database, in the order of table and position.

    Only names and types travel: the catalog is metadata of the driver.
    """
    rows = []
    catalog = spark.catalog
    for table in sorted(catalog.listTables(database), key=lambda t: t.name):
        if table.isTemporary or table.tableType == "VIEW":
            continue
        full = ".".join([*(table.namespace or []), table.name])
        for position, column in enumerate(catalog.listColumns(full)):
            rows.append((table.name, position, column.name, column.dataType))
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")
