"""Sharding: a minimax contiguous partition of ordered groups that stay together.

Documents are put in the order of their text's hash, so equal texts are neighbours and form one atomic group. A
binary search finds the smallest capacity with which a greedy walk over the groups (fill a shard while the next group
fits) needs no more than the wanted number of shards; the cuts of that walk are the shards. No other contiguous
partition has a smaller largest shard.

Scale: the only shuffles move narrow rows (id, hash, size, checksum), range-partitioned by (hash, id), so a text that
a third of all rows share still spreads over many tasks. A search round tries many capacities at once, one aggregation
per shard over the stored running sums; the parquet statistics of that sorted column keep each one to the part of
the table that it needs. Once at most 20,000 group ends can still be cuts, the driver finishes on these; it never holds
more than that.

Edge cases: a null text has no bytes, size 1, and belongs with the empty texts; equal rows are rows of their own with
neighbouring slots; with fewer groups than shards the last shards stay empty; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierlabel.llm.common import store

_TRIED = 31  # capacities per round
_LOCAL = 20_000  # group ends that the driver may hold to finish the search


@dataclass(frozen=True)
class ShardPlan:
    """``rows``: one row per document with its running sum; ``cuts``: the running sum at which each shard ends."""

    rows: DataFrame
    cuts: list[int]
    first_rows: list[int]
    capacity: int


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in hash order with the running sum of sizes (``at``), row number from 0, and whether a group ends here."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = store(
        docs.select(
            F.col(id_col).alias("id"),
            F.unhex(F.md5(text)).alias("key"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("crc"),
        ),
        "shard-sizes",
    )
    ranged = narrow.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    ranged = store(
        ranged.select("*", F.monotonically_increasing_id().alias("place"), F.spark_partition_id().alias("part")), "shard-order"
    )
    by_part = ranged.groupBy("part").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min_by("key", "place").alias("first_key")
    )
    parts = Window.orderBy("part")  # one row per range partition
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select(
        F.col("part").alias("__part"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("__bytes"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n"),
        F.lead("first_key").over(parts).alias("__next"),
    )
    within = Window.partitionBy("part").orderBy("place")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.select(
        "*",
        F.sum("size").over(upto).alias("__sum"),
        F.row_number().over(within).alias("__rank"),
        F.lead("key").over(within).alias("__following"),
    )
    following = F.coalesce("__following", "__next")
    joined = summed.join(F.broadcast(starts), F.col("part") == F.col("__part"))  # one row per range partition
    rows = joined.select(
        "id",
        "size",
        "crc",
        (F.col("__bytes") + F.col("__sum")).alias("at"),
        (F.col("__n") + F.col("__rank") - 1).alias("row"),
        F.coalesce(following != F.col("key"), F.lit(True)).alias("is_end"),
    )
    return store(rows, "shard-sums")


def _walk(ends: DataFrame, capacities: list[int], n_shards: int) -> list[list[int]]:
    """The greedy cuts for each capacity: per step, the last group end within reach of each one's last cut."""
    cuts: list[list[int]] = [[] for _ in capacities]
    at = [0] * len(capacities)
    for _ in range(n_shards):
        limits = [a + c for a, c in zip(at, capacities)]
        reach = ends.filter((F.col("at") > min(at)) & (F.col("at") <= max(limits)))
        found = reach.agg(*[F.max(F.when(F.col("at") <= x, F.col("at"))).alias(f"c{i}") for i, x in enumerate(limits)]).first()
        at = [max(a, found[i] or 0) for i, a in enumerate(at)]
        for own, a in zip(cuts, at):
            own.append(a)
    return cuts


def _finish(at: list[int], low: int, high: int, cuts: list[int], total: int) -> tuple[int, list[int]]:
    """Binary search among the group ends that are still possible cuts."""
    while low < high:
        middle = (low + high) // 2
        walked, last = [], 0
        for _ in cuts:
            reached = bisect_right(at, last + middle)
            last = max(last, at[reached - 1] if reached else 0)
            walked.append(last)
        if last >= total:
            high, cuts = middle, walked
        else:
            low = middle + 1
    return high, cuts


def shard_plan(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> ShardPlan:
    """Find the smallest feasible capacity and its cuts."""
    rows = _ordered(docs, id_col, text_col)
    ends = rows.filter("is_end").select("at")
    total = ends.agg(F.max("at")).first()[0] or 0
    low, high = -(-total // n_shards), total  # the answer lies within, both included
    lows, highs = [0] * n_shards, [total] * n_shards  # so the j-th cut lies between these
    while low < high:
        near = ends.filter(reduce(lambda a, b: a | b, [F.col("at").between(x, y) for x, y in set(zip(lows, highs))]))
        if near.count() <= _LOCAL:
            high, highs = _finish(sorted(r["at"] for r in near.collect()), low, high, highs, total)
            break
        width = high - low
        tried = sorted({low + width * i // _TRIED for i in range(_TRIED)})
        for capacity, cuts in zip(tried, _walk(ends, tried, n_shards)):
            if cuts[-1] >= total:
                high, highs = capacity, cuts
                break
            low, lows = capacity + 1, cuts
    best = highs
    at_cuts = rows.filter(F.col("at").isin(best)).select("at", "row").collect() if total else []
    last = {r["at"]: r["row"] for r in at_cuts}
    starts = [0] + [last.get(c, -1) + 1 for c in best[:-1]]
    return ShardPlan(rows, best, starts, high)


def assign_shards(plan: ShardPlan) -> DataFrame:
    """id, size, crc, shard (from 0) and slot (from 0 without gaps in each shard)."""
    shard, start = F.lit(0), F.lit(0).cast("long")
    for i, cut in enumerate(plan.cuts[:-1]):
        beyond = F.col("at") > cut
        shard = F.when(beyond, F.lit(i + 1)).otherwise(shard)
        start = F.when(beyond, F.lit(plan.first_rows[i + 1]).cast("long")).otherwise(start)
    return plan.rows.select("id", "size", "crc", shard.alias("shard"), (F.col("row") - start).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document under the law ``bytes``: shards of nearly equal bytes, equal texts together."""
    return assign_shards(shard_plan(docs, n_shards, id_col, text_col)).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
