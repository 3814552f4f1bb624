import uuid

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for columns of their own
        *[T.StructField(c, T.StringType()) for c in ("size", "node", "words", "key", "kept", "target", "id", "row", "p", "copies")],
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table with extra columns from (id, text[, source]) rows."""

    def make(rows):
        full = []
        for r in rows:
            i, text, source = (*r, "s")[:3] if len(r) == 2 else r
            full.append((i, text, "en", source, len(text or ""), *["x"] * 10))
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def on_disk(documents, tmp_path_factory):
    """A folder of tables as the registered queries read them."""

    def write(rows):
        folder = tmp_path_factory.mktemp(f"tables-{uuid.uuid4().hex[:6]}")
        documents(rows).write.parquet(f"{folder}/documents.parquet")
        return str(folder)

    return write
