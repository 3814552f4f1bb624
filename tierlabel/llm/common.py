"""What the operators of this subpackage share: scratch tables and the word pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlabel.session import scratch_path

#: A word is a run of anything but the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the application ends."""
    path = scratch_path(spark, name)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target)
    system.deleteOnExit(target)
    return path


def store(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage like a checkpoint, gives column pruning and pushed filters to what follows, and tells the
    optimizer the true size, so that joins with small tables are broadcast and others are not. While it runs, Arrow
    batches are held to a size that keeps Python workers and Arrow buffers small.
    """
    path, conf = new_folder(df.sparkSession, name) + "/rows", df.sparkSession.conf
    before = conf.get(_BATCH_BYTES)
    conf.set(_BATCH_BYTES, "8m")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        conf.set(_BATCH_BYTES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text: Column | str) -> Column:
    """The number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
