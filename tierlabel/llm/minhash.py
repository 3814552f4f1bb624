"""MinHash near-duplicates with sequential Bayesian verification.

1. A document is the set of its distinct 5-word shingles. Equal sets are one node, named by the smallest id.
2. A node's signature is cut into bands; nodes with an equal band are candidates. The number of bands follows from the
   threshold and the accepted chance that a linked pair shares none (``miss``).
3. A candidate pair's signatures are compared batch by batch. After each batch, the posterior of the similarity (uniform
   prior) is asked for the chance that it reaches the threshold; below ``prune`` the pair is dropped.
4. Survivors are verified exactly on their full shingle sets.
5. Links are joined to components.

Large buckets. A group of near copies, some of which are linked and most of which are not quite, fills its buckets with
pairs that bands cannot tell apart. Members of buckets of more than ``small`` nodes therefore get exact keys in place of
these buckets: their shingles, rarest first, of which two linked sets must share one of the first n - ceil(t n) + 1;
and the places of a shared key in both sets bound what they can have in common. No linked pair is lost by that.

No group is expanded into all pairs. In a first round each bucket's or key's members are compared with one pivot. In the
second, members outside of the largest component of their bucket are compared with the members in other components;
a pair within one component needs no comparing. So what is linked indirectly costs nothing, however large the group.

Scale: texts are read by tasks and never shuffled; what moves is ids, 64-bit bands, signatures of half a kilobyte, and
the shingles of nodes in large buckets and surviving pairs. Hot keys (a set that a third of all rows share, a bucket of
thousands) meet only in grouped sums with map-side combine and in joins that skew join splits.

Edge cases: null and empty texts, and texts without words, have no shingles and are linked with nothing; fewer than
five words are one shingle of their own; rows that share an id share its links; a row with a null id is linked with
nothing, has a null component and is kept; columns other than id and text are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierlabel.llm.common import store
from tierlabel.llm.components import components
from tierlabel.llm.words import blocks, mix, windows, words

_U = np.uint64
_SLOTS = 24  # bits of the filter that tells which texts' sets are needed


@dataclass(frozen=True)
class NearSettings:
    percent: int = 85  # link if 100 * intersection >= percent * union
    width: int = 5  # words in a shingle
    rows: int = 6  # hashes in a band
    miss: float = 2e-8  # chance that a pair at the threshold shares no band
    prune: float = 1e-9  # posterior chance below which a pair is pruned
    small: int = 4  # nodes in a bucket up to which the bucket itself is used
    id_col: str = "doc_id"
    text_col: str = "text"

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


# --- inside tasks -------------------------------------------------------------------------------------------


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    own = words(texts, lower=True)
    keys, first = windows(own, width)
    bounds = np.searchsorted(first, own.bounds)
    sets = []
    for i, n in enumerate(own.counts):
        if n >= width:
            sets.append(np.unique(keys[bounds[i] : bounds[i + 1]]))
        elif n:  # the whole sequence is one shingle, different from all of full width
            value = np.array([n], np.uint64)
            for h in own.hashes[own.bounds[i] : own.bounds[i + 1]]:
                value = mix(value * _U(0x9E3779B97F4A7C15) + h)
            sets.append(value)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(511)
    return (
        random.integers(0, 1 << 32, (n, 1), dtype=np.uint32),
        random.integers(0, 1 << 31, (n, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1),
    )


def signature(shingles: np.ndarray, salts: np.ndarray, factors: np.ndarray, step: int = 512) -> np.ndarray:
    """The minimum of each hash function over the set, as 16 bits of it."""
    low = (shingles >> _U(32)).astype(np.uint32)
    best = np.full(len(salts), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), step):
        values = low[None, at : at + step] ^ salts
        values *= factors
        np.minimum(best, values.min(axis=1), out=best)
    best ^= best >> np.uint32(15)
    best *= np.uint32(0x846CA68B)
    return (best >> np.uint32(16)).astype(np.uint16)


def fewest_matches(settings: NearSettings) -> list[int]:
    """Per batch, the matches needed so far to stay a candidate. A batch is one hash of each band.

    With a uniform prior and m matches in n hashes, the posterior chance of a similarity of at least t is the chance of
    at most m successes in n + 1 trials of chance t.
    """
    t, needed = settings.percent / 100, []
    for n in range(settings.bands, settings.hashes + 1, settings.bands):
        total, m = 0.0, 0
        while m <= n:
            total += math.exp(
                math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log(1 - t)
            )
            if total >= settings.prune:
                break
            m += 1
        needed.append(m)
    return needed


# --- steps --------------------------------------------------------------------------------------------------


def _sketches(docs: DataFrame, settings: NearSettings) -> DataFrame:
    """(id, n, key, sig): set size, 128-bit name of the set, signature. One pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts, factors = _functions(settings.hashes)
        for table in batches:
            for first, texts in blocks(table.column(1)):
                n, keys, sigs, last = [], [], [], {}
                for s in shingle_sets(texts, settings.width):
                    n.append(len(s))
                    if not len(s):
                        keys.append(None)
                        sigs.append(None)
                        continue
                    key = blake2b(s.tobytes(), digest_size=16).digest()
                    if key not in last:  # copies in a batch are worked on once
                        last[key] = signature(s, salts, factors).tobytes()
                    keys.append(key)
                    sigs.append(last[key])
                columns = [pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays([table.column(0).slice(first, len(texts)), *columns], ["id", "n", "key", "sig"])

    kind = docs.schema[settings.id_col].dataType.simpleString()
    rows = docs.select(settings.id_col, settings.text_col).mapInArrow(run, f"id {kind}, n long, key binary, sig binary")
    return store(rows, "near-sketches")


def _band_rows(nodes: DataFrame, settings: NearSettings, kind: str) -> DataFrame:
    """(bucket, node): one row per node and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            if not len(table):
                continue
            sig = _signatures(table.column(1)).reshape(len(table), settings.bands, settings.rows)
            value = np.broadcast_to(np.arange(settings.bands, dtype=np.uint64), sig.shape[:2]).copy()
            for i in range(settings.rows):
                value = mix(value * _U(0x9E3779B97F4A7C15) + sig[:, :, i])
            bucket = value.view(np.int64)
            for at in range(settings.bands):
                yield pa.RecordBatch.from_arrays([pa.array(bucket[:, at]), table.column(0)], ["bucket", "node"])

    return nodes.select("node", "sig").mapInArrow(run, f"bucket long, node {kind}")


def _signatures(column: pa.Array) -> np.ndarray:
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.uint16).reshape(len(column), -1)


def _prune(pairs: DataFrame, nodes: DataFrame, settings: NearSettings, kind: str) -> DataFrame:
    """The distinct candidate pairs (lo, hi) that stay possible after all batches of their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needed = fewest_matches(settings)
        for table in batches:
            if not len(table):
                continue
            # every batch takes one hash of each band, since hashes of a shared band agree
            a, b = (_signatures(table.column(i)).reshape(len(table), settings.bands, settings.rows) for i in (2, 3))
            alive, matches = np.arange(len(table)), np.zeros(len(table), np.int64)
            for i in range(settings.rows):
                matches += (a[alive, :, i] == b[alive, :, i]).sum(axis=1)
                stays = matches >= needed[i]
                alive, matches = alive[stays], matches[stays]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(alive)) for c in table.columns[:2]], ["lo", "hi"])

    left = nodes.select(F.col("node").alias("lo"), F.col("sig").alias("sig_lo"))
    right = nodes.select(F.col("node").alias("hi"), F.col("sig").alias("sig_hi"))
    rows = pairs.distinct().join(left, "lo").join(right, "hi").select("lo", "hi", "sig_lo", "sig_hi")
    return store(rows.mapInArrow(run, f"lo {kind}, hi {kind}"), "near-survivors")


class _Sets:
    """Shingle sets of the nodes that needed them so far, in the shared folder."""

    def __init__(self, docs: DataFrame, settings: NearSettings, kind: str):
        self.docs, self.settings, self.kind = docs, settings, kind
        self.parts: list[DataFrame] = []

    def of(self, needed: DataFrame) -> DataFrame:
        """(node, shingles) for at least the given nodes.

        Texts stay where they are: tasks get a bit map of fixed size that tells (nearly) which of them are needed.
        """
        needed = needed.select("node").distinct()
        have = reduce(DataFrame.union, self.parts) if self.parts else None
        if have is not None:
            needed = needed.join(have.select("node"), "node", "left_anti")
        slot = F.pmod(F.xxhash64("node"), F.lit(1 << _SLOTS))
        bits = needed.select(slot.alias("slot")).groupBy((F.col("slot") / 32).cast("int").alias("at"))
        found = bits.agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 32 AS INT)))").alias("bits")).toArrow()
        if len(found) or have is None:
            bitmap = np.zeros(1 << (_SLOTS - 5), np.uint32)
            bitmap[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
            self.parts.append(self._read(bitmap))
        return reduce(DataFrame.union, self.parts)

    def _read(self, bitmap: np.ndarray) -> DataFrame:
        settings, shared = self.settings, self.docs.sparkSession.sparkContext.broadcast(bitmap)  # 2 MB

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in batches:
                slot = table.column(2).to_numpy()
                wanted = (shared.value[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1)
                table = table.filter(pa.array(wanted.astype(bool)))
                for first, texts in blocks(table.column(1)):
                    sets = pa.array([s.tobytes() for s in shingle_sets(texts, settings.width)], pa.binary())
                    yield pa.RecordBatch.from_arrays([table.column(0).slice(first, len(texts)), sets], ["node", "shingles"])

        ids = self.docs.select(F.col(settings.id_col).alias("node"), settings.text_col).filter("node IS NOT NULL")
        rows = ids.withColumn("slot", F.pmod(F.xxhash64("node"), F.lit(1 << _SLOTS)))
        return store(rows.mapInArrow(run, f"node {self.kind}, shingles binary"), "near-sets")


def _verify(pairs: DataFrame, sets: DataFrame, settings: NearSettings, kind: str) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            linked = []
            for a, b in zip(table.column(2), table.column(3)):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b)])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= settings.percent * (len(both) - shared) and shared > 0)
            out = pa.RecordBatch.from_arrays(table.columns[:2], ["a", "b"])
            yield out.filter(pa.array(linked, pa.bool_()))

    left = sets.select(F.col("node").alias("lo"), F.col("shingles").alias("set_lo"))
    right = sets.select(F.col("node").alias("hi"), F.col("shingles").alias("set_hi"))
    rows = pairs.join(left, "lo").join(right, "hi").select("lo", "hi", "set_lo", "set_hi")
    return store(rows.mapInArrow(run, f"a {kind}, b {kind}"), "near-links")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("lo").alias("node")).union(pairs.select(F.col("hi").alias("node")))


def _rare_keys(dense: DataFrame, sets: DataFrame, settings: NearSettings, kind: str) -> DataFrame:
    """(bucket, node, n, place) of the shingles, rarest first, of which linked sets must share one.

    ``place`` is the number of shingles of the set that come before. Shingles of one set only come first and are counted,
    and nothing else is done with them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            for node, shingles in zip(table.column(0), table.column(1)):
                values = np.frombuffer(shingles.as_buffer(), np.int64)
                owner = pa.array([node.as_py()] * len(values), table.column(0).type)
                yield pa.RecordBatch.from_arrays([owner, pa.array(values), pa.array(np.full(len(values), len(values)))], names)

    names = ["node", "shingle", "n"]
    own = sets.join(dense, "node", "left_semi").dropDuplicates(["node", "shingles"])
    rows = store(own.mapInArrow(run, f"node {kind}, shingle long, n long"), "near-shingles")
    shared = store(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "near-frequencies")
    known = rows.join(shared, "shingle")
    order = Window.partitionBy("node", "n").orderBy("df", "shingle")
    ranked = known.select(
        "node",
        "n",
        "shingle",
        F.row_number().over(order).alias("rank"),
        F.count(F.lit(1)).over(Window.partitionBy("node", "n")).alias("known"),
    )
    place = F.col("n") - F.col("known") + F.col("rank") - 1
    keys = ranked.select(F.xxhash64("shingle", F.lit("key")).alias("bucket"), "node", "n", place.alias("place"))
    return keys.filter(100 * (F.col("n") - F.col("place")) >= settings.percent * F.col("n"))


def _possible(settings: NearSettings, n: str, place: str, other_n: str, other_place: str):
    """Whether two sets can reach the threshold, given the places of a key that is the first they share."""
    most = F.least(F.col(n) - F.col(place), F.col(other_n) - F.col(other_place))
    return (100 + settings.percent) * most >= settings.percent * (F.col(n) + F.col(other_n))


def near_components(docs: DataFrame, settings: NearSettings = NearSettings()) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and (node, component) of the nodes that are linked with another one."""
    kind = docs.schema[settings.id_col].dataType.simpleString()
    sketches = _sketches(docs, settings)
    named = sketches.filter("key IS NOT NULL AND id IS NOT NULL")
    first = named.groupBy("key").agg(F.min("id").alias("id"))
    nodes = named.join(first, ["key", "id"], "left_semi").select(F.col("id").alias("node"), "n", "sig")
    nodes = store(nodes.dropDuplicates(["node", "sig"]), "near-nodes")
    bands = store(_band_rows(nodes, settings, kind), "near-bands")
    sizes = bands.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("k"))
    buckets = store(sizes.filter("k > 1 AND first != last"), "near-buckets")
    members = store(bands.join(buckets, "bucket").select("bucket", "node", "k"), "near-members")
    dense = store(members.filter(F.col("k") > settings.small).select("node").distinct(), "near-dense")
    few = members.filter(F.col("k") <= settings.small).join(nodes.select("node", "n"), "node")
    few = store(few.select("bucket", "node", "n", F.lit(0).cast("long").alias("place")).distinct(), "near-few")
    sets = _Sets(docs, settings, kind)

    def pairs_of(rows: DataFrame, others: DataFrame, when=F.lit(True)) -> DataFrame:
        joined = rows.join(others, "bucket").filter(_possible(settings, "n", "place", "other_n", "other_place"))
        joined = joined.filter((F.col("node") != F.col("other")) & when)
        return joined.select(F.least("node", "other").alias("lo"), F.greatest("node", "other").alias("hi"))

    def stars(rows: DataFrame) -> DataFrame:
        """Each member with the pivot of its bucket, the one in which the key comes first."""
        pivots = store(rows.groupBy("bucket").agg(F.min(F.struct("place", "node", "n")).alias("p"), F.count(F.lit(1)).alias("k")), "near-pivots")
        pivots = pivots.filter("k > 1").select(
            "bucket", F.col("p.node").alias("other"), F.col("p.n").alias("other_n"), F.col("p.place").alias("other_place")
        )
        return pairs_of(rows, pivots)

    # First round: every member with one pivot.
    near = _prune(stars(few), nodes, settings, kind)
    of_dense = sets.of(dense.union(_ends(near)))
    keys = store(_rare_keys(dense, of_dense, settings, kind), "near-keys")
    near_keys = _prune(stars(keys), nodes, settings, kind)
    links = _verify(near.union(near_keys).distinct(), sets.of(_ends(near)), settings, kind)
    comps = store(components(links), "near-components")

    # Second round: members outside of the largest component of their bucket, with all in other components.
    rest = few.union(keys).join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = store(rest, "near-rest")
    by_component = rest.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
    largest = by_component.groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("m"), F.count(F.lit(1)).alias("parts"))
    largest = store(largest.filter("parts > 1").select("bucket", F.col("m.component").alias("largest")), "near-open")
    still = store(rest.join(largest, "bucket"), "near-open")
    others = still.select(
        "bucket",
        *[F.col(c).alias(f"other_{c}") for c in ("n", "place", "component")],
        F.col("node").alias("other"),
        (F.col("component") != F.col("largest")).alias("other_apart"),
    )
    apart = F.col("component") != F.col("other_component")
    once = ~F.col("other_apart") | (F.col("node") < F.col("other"))  # two members that are both outside meet twice
    near = _prune(pairs_of(still.filter("component != largest"), others, apart & once), nodes, settings, kind)
    more = _verify(near, sets.of(_ends(near)), settings, kind)
    if more.isEmpty():
        return sketches, comps
    old = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return sketches, store(components(more.union(old)), "near-components")


def near_duplicates(docs: DataFrame, settings: NearSettings = NearSettings()) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``."""
    sketches, comps = near_components(docs, settings)
    first = sketches.filter("key IS NOT NULL AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("node"))
    named = first.join(comps, "node", "left").select(F.col("key").alias("__key"), F.coalesce("component", "node").alias("component_id"))
    # the salt lets skew join split a set that many rows share
    named = named.withColumn("__salt", F.xxhash64("__key"))
    rows = sketches.select("id", "n", "key", F.xxhash64("key").alias("__at"))
    joined = rows.join(named, (F.col("__at") == F.col("__salt")) & (F.col("key") == F.col("__key")), "left")
    found = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return joined.select(
        F.col("id").alias(settings.id_col),
        F.col("n").alias("n_shingles"),
        found.alias("component_id"),
        F.coalesce(found == F.col("id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, settings: NearSettings = NearSettings()) -> DataFrame:
    """The documents with one of each group kept, columns unchanged.

    The smallest id of a group stays. Where ids are null or occur twice, rows get a stored number in place of the id,
    and the smallest number stays, so that repeated rows and copies without an id go too.
    """
    id_col = settings.id_col
    if docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter(F.col(id_col).isNull() | (F.col("n") > 1)).isEmpty():
        gone = near_duplicates(docs, settings).filter("NOT kept").select(F.col(id_col).alias("__gone")).distinct()
        return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
    numbered = store(docs.withColumn("__row", F.monotonically_increasing_id()), "near-numbered")
    gone = near_duplicates(numbered, replace(settings, id_col="__row")).filter("NOT kept").select(F.col("__row").alias("__gone"))
    return numbered.join(gone, F.col("__row") == F.col("__gone"), "left_anti").drop("__row")
