"""Scoring of arriving items with the batch classifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def score_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType | str,
    score: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score every Parquet file that arrives in ``source`` and write the results below ``sink``.

    Items do not depend on each other, so the stream has no state and needs no watermark. Each micro-batch runs
    the batch function ``score`` and overwrites its own folder ``batch_id=n``: a batch that is repeated after a
    failure leaves the same rows once. By default all files that are there are scored and the query ends.

    A ``score`` that asks a ``ModelHandle`` for its model takes a new version between micro-batches, and starts no
    job for the model while the version stays the same.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return (
        reader.parquet(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
