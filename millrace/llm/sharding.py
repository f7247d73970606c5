"""Sharding by best-fit-decreasing bin packing.

Documents with equal texts are one indivisible group. Groups sorted by size, largest first, go to the bin with the
least remaining capacity that still holds them, found in a balanced tree of remaining capacities.

It works in two levels, so that no task holds all groups. Each task packs the groups hashed to it into bricks of a fixed
capacity, a small share of a shard; a larger group is a brick of its own. The bricks, at most 2 * SHARDS *
BRICKS + tasks of them whatever the input, are then packed into shards on the driver, with the smallest capacity
(by bisection) at which best fit needs no more than the given number of shards.

Nulls: a null text counts as an empty one (size 1, crc32 0) and groups with it; a null doc_id is kept. Ties in size go
by group hash; repeated rows are members of one group. An empty table gives an empty result; columns besides
doc_id and text are not read. A group larger than an even share leaves its shard that much larger."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import documents, partitions, written

SHARDS = 16
#: Bricks in a full shard.
BRICKS = 512
#: Groups with more than this share of all rows are numbered in slices; there are fewer than 1 / HOT of them.
HOT = 1 / 500


class Capacities:
    """A balanced (AA) tree of (remaining capacity, bin), for the tightest bin that holds a size."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # nodes are [key, level, left, right]

    @staticmethod
    def _skew(t):
        left = t[2]
        if left is not None and left[1] == t[1]:
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t):
        right = t[3]
        if right is not None and right[3] is not None and right[3][1] == t[1]:
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def insert(self, key: tuple[int, int]) -> None:
        self.root = self._insert(self.root, key)

    def _insert(self, t, key):
        if t is None:
            return [key, 1, None, None]
        side = 2 if key < t[0] else 3
        t[side] = self._insert(t[side], key)
        return self._split(self._skew(t))

    def remove(self, key: tuple[int, int]) -> None:
        self.root = self._remove(self.root, key)

    def _remove(self, t, key):
        if t is None:
            raise KeyError(key)
        if key < t[0]:
            t[2] = self._remove(t[2], key)
        elif key > t[0]:
            t[3] = self._remove(t[3], key)
        elif t[2] is None and t[3] is None:
            return None
        elif t[2] is None:
            nearest = t[3]
            while nearest[2] is not None:
                nearest = nearest[2]
            t[0] = nearest[0]
            t[3] = self._remove(t[3], nearest[0])
        else:
            nearest = t[2]
            while nearest[3] is not None:
                nearest = nearest[3]
            t[0] = nearest[0]
            t[2] = self._remove(t[2], nearest[0])
        low = min(t[2][1] if t[2] else 0, t[3][1] if t[3] else 0) + 1
        if low < t[1]:
            t[1] = low
            if t[3] is not None and t[3][1] > low:
                t[3][1] = low
        t = self._skew(t)
        if t[3] is not None:
            t[3] = self._skew(t[3])
            if t[3][3] is not None:
                t[3][3] = self._skew(t[3][3])
        t = self._split(t)
        if t[3] is not None:
            t[3] = self._split(t[3])
        return t

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest (remaining, bin) with remaining >= size."""
        found, t, least = None, self.root, (size, -1)
        while t is not None:
            if t[0] >= least:
                found, t = t[0], t[2]
            else:
                t = t[3]
        return found


class BestFit:
    """Puts sizes, which must come largest first, into bins of one capacity. A larger size gets a bin of its own."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.tree = Capacities()
        self.bins = 0

    def place(self, size: int) -> int:
        found = self.tree.tightest(size)
        if found is None:
            number, self.bins = self.bins, self.bins + 1
            left = self.capacity - size
        else:
            left, number = found[0] - size, found[1]
            self.tree.remove(found)
        if left > 0:
            self.tree.insert((left, number))
        return number


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """The bin of every size, which are sorted here, and the number of bins."""
    packer, bins = BestFit(capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bins[i] = packer.place(sizes[i])
    return bins, packer.bins


def into_shards(sizes: list[int], shards: int) -> list[int]:
    """The shard of every size, at about the smallest capacity for which best fit needs at most `shards` bins."""
    if not sizes:
        return []
    low = max(max(sizes), -(-sum(sizes) // shards))
    bins, used = best_fit_decreasing(sizes, low)
    if used <= shards:
        return bins
    high, kept = low, None
    step = max(1, low // 4096)
    while kept is None:  # widen until it fits
        high += step
        step *= 2
        bins, used = best_fit_decreasing(sizes, high)
        kept = bins if used <= shards else None
    while high - low > max(1, low // 20_000):
        middle = (low + high) // 2
        bins, used = best_fit_decreasing(sizes, middle)
        if used <= shards:
            high, kept = middle, bins
        else:
            low = middle
    return kept


_PLACED = "grp binary, rows bigint, brick bigint, before bigint, size bigint"


def _bricks(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        packer, rows_in = BestFit(capacity), {}
        for batch in batches:  # largest first
            sizes, rows = batch.column("size").to_pylist(), batch.column("rows").to_pylist()
            bricks, before = [], []
            for size, n in zip(sizes, rows, strict=True):
                number = packer.place(size)
                bricks.append(base + number)
                before.append(rows_in.get(number, 0))
                rows_in[number] = before[-1] + n
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("rows"), pa.array(bricks, pa.int64()), pa.array(before, pa.int64()), batch.column("size")], names=["grp", "rows", "brick", "before", "size"])

    return run


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, text) as (doc_id, size, text_crc32, shard, slot); equal texts share a shard and shards are near equal in bytes."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = written(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("grp")), "shard-base")
    groups = base.groupBy("grp").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    totals = groups.agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).first()
    total, rows = totals["size"] or 0, totals["rows"] or 0
    capacity = max(1, -(-total // (shards * BRICKS)))
    ordered = groups.repartition(partitions(spark), "grp").sortWithinPartitions(F.desc("size"), "grp")
    placed = written(ordered.mapInArrow(_bricks(capacity), _PLACED), "shard-groups")

    # bounded by 2 * shards * BRICKS + tasks
    bricks = placed.groupBy("brick").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).orderBy("brick").collect()
    shard_of = into_shards([b["size"] for b in bricks], shards)
    filled, homes = [0] * shards, []
    for brick, shard in zip(bricks, shard_of, strict=True):
        homes.append((brick["brick"], shard, filled[shard]))
        filled[shard] += brick["rows"]
    home = spark.createDataFrame(homes, "brick bigint, shard int, brick_slot bigint")

    # rows of large groups are numbered in slices by hash of doc_id; fewer than 1 / HOT groups, each of fewer than 1 / HOT slices
    slice_rows = max(1000, int(rows * HOT))
    large = placed.where(F.col("rows") > slice_rows).select("grp", F.ceil(F.col("rows") / slice_rows).cast("int").alias("slices"))
    keyed = base.join(F.broadcast(large), "grp", "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("slices")), F.lit(0)).cast("int"))
    # doc_id first, then size and crc, which are equal within a group
    numbered = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("grp", "slice").orderBy("doc_id")) - 1)
    sliced = keyed.where(F.col("slices").isNotNull()).groupBy("grp", "slice").agg(F.count("*").alias("slice_size"))
    ahead = F.coalesce(F.sum("slice_size").over(Window.partitionBy("grp").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    many = sliced.select("grp", "slice", ahead.alias("ahead"))
    small = placed.join(F.broadcast(large.select("grp")), "grp", "left_anti").select("grp", F.lit(0).alias("slice"), F.lit(0).cast("long").alias("ahead"), "brick", "before")
    split = placed.join(F.broadcast(many), "grp").select("grp", "slice", "ahead", "brick", "before")
    where = small.unionByName(split).join(F.broadcast(home), "brick").select("grp", "slice", "shard", (F.col("brick_slot") + F.col("before") + F.col("ahead")).alias("first"))
    return numbered.join(where, ["grp", "slice"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharded(documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
