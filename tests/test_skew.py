"""Hot keys: plans keep what splits them, and results stay whole."""

import pytest
from row_helpers import rows
from pyspark.sql import functions as F

from tierlabel.operators import groups as G
from tierlabel.operators import tables as T


@pytest.fixture
def skew_settings(spark):
    """No broadcast joins, and thresholds at which small tables count as skewed."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_rows(spark):
    """40,000 rows in eight tasks, half of them with key 0."""
    key = F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id"))
    return spark.range(0, 40_000, 1, 8).select("id", key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_delete_splits_a_hot_key(spark, skew_settings):
    source = spark.range(0, 40_000, 3).select(F.col("id").alias("s"))
    left = T.delete_rows_not_in(hot_rows(spark), source, "k", "s")
    assert "skew=true" in final_plan(left)
    assert left.count() == hot_rows(spark).filter("k % 3 = 0").count()


def test_update_splits_a_hot_key(spark, skew_settings):
    source = spark.range(0, 40_000, 3).select(F.col("id").alias("s"), F.lit("new").alias("v"))
    updated = T.update_table_columns(hot_rows(spark), source, "pad", "v", "k", "s")
    assert "skew=true" in final_plan(updated)
    assert updated.filter("pad = 'new'").count() == hot_rows(spark).filter("k % 3 = 0").count()
    assert updated.count() == 40_000


def test_label_lookup_splits_a_hot_class(spark, skew_settings):
    gpc = spark.range(0, 40_000, 3).select(
        F.col("id").alias("row_idx"), F.lit("s").alias("SegmentTitle"), F.lit("f").alias("FamilyTitle"), F.col("id").alias("ClassTitle")
    )
    found = G.extract_labels(hot_rows(spark), gpc, "k")
    assert "skew=true" in final_plan(found)
    assert found.filter("in_taxonomy").count() == hot_rows(spark).filter("k % 3 = 0").count()


def test_first_rows_shrink_before_the_shuffle(spark):
    first = T.first_rows(hot_rows(spark), "k", "id")
    plan = first._jdf.queryExecution().executedPlan().toString()
    below_shuffle = plan.split("Exchange")[-1]
    assert "WindowGroupLimit" in below_shuffle
    assert first.count() == hot_rows(spark).select("k").distinct().count()


def test_numbering_spreads_a_hot_value(spark):
    numbered = G.renumber_ids(hot_rows(spark).withColumn("h", F.least("k", F.lit(1))), "id", "h", ["h"])
    assert [r.id for r in numbered.select("id").orderBy("id").collect()] == list(range(1, 40_001))
    assert rows(numbered.groupBy("h").agg(F.max("id"))) == [(0, 20_000), (1, 40_000)]
