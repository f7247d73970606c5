"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of a stated percent or more.

1. Every document becomes its set of shingle hashes. Equal sets are one class; from here on classes are compared.
2. Two linked sets share one of their n - ceil(percent * n / 100) + 1 first shingles in any common order. Rare shingles
   come first: frequent ones are found by counting, and their order only steers the work.
3. Shingles are hashed into GROUPS; the counts are a class's point in an R-tree, where a node's summed coordinate minima
   with a query's point bound the overlap. Among the classes that share a first shingle such trees leave the pairs that
   may link; they spread to candidate groups, through spanning links only, never pair by pair.
4. Within a candidate group an R-tree proposes pairs again, and they are verified on whole sets.
5. Links spread to components, which lead back to documents.

Both times, the classes that meet (under a shingle, in a candidate group) are cut into leaves by hash, each a block of one
task, and a thinning share of them meets again in blocks above, so that like classes of all leaves soon hang together. What
does then not belong to a group's largest component, the rest, meets all of the group, in blocks too: no link is lost,
and a group of M near copies costs M, not M * M. Only groups whose members may link by their points but do not cost more.

Classes and shingles are 64-bit hashes. Nulls: a null text is an empty one; a document without words is linked with
nothing. A null doc_id takes its class's component; a component of null doc_ids alone has none. Repeated rows share a class.
A doc_id may have several texts, each of which has its own class. A text is held whole, as eight bytes a word in a few
arrays. An empty table gives an empty result; columns besides doc_id, text and those to carry are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, partitions, remove, stored, written
from millrace.llm.graph import components
from millrace.llm.words import chunks, mix, shingle_hashes, word_hashes

#: Coordinates of the point of a set of fewer than FINE shingles; four times as many for each fourfold size, so that
#: chance differences of unlike sets stay beyond what the bound allows.
GROUPS = 64
FINE = 1000
FANOUT = 16
#: A count in a shuffled point that stands for this many or more: it bounds nothing.
FULL = 255
#: Classes, and shingles, in a leaf of a candidate group.
LEAF = 800
#: Classes of one shingle that meet in a task.
SHARERS = 2000
#: Of a leaf's classes, so many meet again in a block above.
RISE = 8
LEVELS = 4
#: Buckets of the filter of doc_ids whose texts are needed: the most rows that are broadcast for it.
FILTER = 1 << 18
LEAF_SHINGLES = 1_000_000
#: Frequent shingles that are ordered by their counts.
FREQUENT = 1 << 15


def sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    for chunk in chunks(texts):
        values, at = shingle_hashes(*word_hashes(chunk), k)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.unique(values[a:b])


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit hash of the set."""
    parts = np.array([shingles.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(shingles)), len(shingles)], np.uint64)
    return int(mix(mix(parts) * np.array([3, 5, 7], np.uint64)).sum(dtype=np.uint64).view(np.int64))


def enough(a: int, b: int, percent: int) -> int:
    """The least overlap with which sets of a and b shingles link."""
    return -(-percent * (a + b) // (100 + percent))


def first_shingles(shingles: np.ndarray, percent: int, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set's rarest shingles, as many as the join needs; frequent ones come last, by count."""
    n = len(shingles)
    need = n - (-(-percent * n // 100)) + 1
    if not len(frequent):
        return shingles[:need]
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    weight = np.where(frequent[at] == shingles, counts[at], 0)
    if not weight.any():
        return shingles[:need]
    return shingles[np.argsort(weight, kind="stable")[:need]]


class CountTree:
    """A static R-tree over count vectors, for sets that may overlap a query's enough."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        spread = int(np.argmax(points.var(axis=0))) if len(points) else 0
        self.order = np.lexsort((points[:, spread], sizes))  # neighbours in a leaf: equal size, then alike where points differ most
        self.levels = []  # from the leaves up: coordinate maxima, least and largest size of each node
        high, low, big = points[self.order], sizes[self.order], sizes[self.order]
        while len(high) > 1:
            cuts = np.arange(0, len(high), FANOUT)
            high, low, big = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(big, cuts)
            self.levels.append((high, low, big))

    def candidates(self, point: np.ndarray, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that the bound leaves, and their bounds."""
        least, most = -(-percent * size // 100), 100 * size // percent
        alive = np.zeros(1, np.int64)
        for depth, (high, low, big) in enumerate(reversed(self.levels)):
            if depth:
                alive = (alive[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                alive = alive[alive < len(high)]
            bound = np.minimum(high[alive], point).sum(axis=1)
            need = -(-percent * (size + np.maximum(low[alive], least)) // (100 + percent))
            alive = alive[(bound >= need) & (low[alive] <= most) & (big[alive] >= least)]
            if not len(alive):
                return alive, alive
        if self.levels:
            alive = (alive[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            alive = alive[alive < len(self.order)]
        rows = self.order[alive]
        bound = np.minimum(self.points[rows], point).sum(axis=1)
        sizes = self.sizes[rows]
        kept = (bound >= -(-percent * (size + sizes) // (100 + percent))) & (sizes >= least) & (sizes <= most)
        return rows[kept], bound[kept]


def groups_for(n: int) -> int:
    groups, limit = GROUPS, FINE
    while n >= limit:
        groups, limit = groups * 4, limit * 4
    return groups


def point_of(shingles: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def spanning(points: np.ndarray, sizes: np.ndarray, sides: np.ndarray, percent: int, verify) -> list[tuple[int, int]]:
    """Links that span every component. The tree proposes rows for each row; verify(i, rows) tells which of them link.
    Rows of different sides are compared; with one side, all are. Rows that are connected already are not compared."""
    m = len(sizes)
    tree, crossing = CountTree(points, sizes), len(set(sides.tolist())) > 1
    root = np.arange(m)  # every row's component, kept flat
    members: dict[int, list[int]] = {i: [i] for i in range(m)}
    links = []
    for i in range(m):
        rows, bounds = tree.candidates(points[i], int(sizes[i]), percent)
        use = rows > i
        if crossing:
            use &= sides[rows] != sides[i]
        rows = rows[use][np.argsort(-bounds[use], kind="stable")]
        while len(rows := rows[root[rows] != root[i]]):
            some, rows = rows[:64], rows[64:]
            for j in some[verify(i, some)].tolist():
                a, b = int(root[i]), int(root[j])
                if a != b:
                    links.append((i, j))
                    if len(members[a]) < len(members[b]):
                        a, b = b, a
                    root[members[b]] = a
                    members[a] += members.pop(b)
    return links


def linked(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning links of sets, verified on whole sets."""
    sizes = np.array([len(s) for s in sets])

    def verify(i: int, rows: np.ndarray) -> np.ndarray:
        whole = np.concatenate([sets[j] for j in rows])
        at = np.minimum(np.searchsorted(sets[i], whole), len(sets[i]) - 1)
        starts = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
        overlap = np.add.reduceat((sets[i][at] == whole).astype(np.int64), starts)
        return (100 + percent) * overlap >= percent * (sizes[i] + sizes[rows])

    groups = groups_for(int(sizes.max()))
    return spanning(np.stack([point_of(s, groups) for s in sets]), sizes, sides, percent, verify)


def _by_block(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], rows_of, links_of) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of each block of consecutive rows with one key. rows_of(batch) gives (side, cls, row) of every row."""
    block, ids, sides, held = None, [], [], []

    def edges() -> list[tuple[int, int]]:
        found = [(ids[a], ids[b]) for a, b in links_of(held, np.array(sides))] if len(held) > 1 else []
        for x in (ids, sides, held):
            x.clear()
        return found

    def batch_of(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        out = []
        for now, (side, cls, row) in zip(zip(*(batch.column(c).to_pylist() for c in key), strict=True), rows_of(batch), strict=True):
            if now != block:
                out += edges()
                block = now
            if row is None or (ids and (ids[-1], sides[-1]) == (cls, side)):  # a repeated row
                continue
            ids.append(cls)
            sides.append(side)
            held.append(row)
        if out:
            yield batch_of(out)
    yield batch_of(edges())


def _proposed(percent: int):
    """Spanning links among the classes of each shingle that their points allow."""

    def rows_of(batch: pa.RecordBatch):
        rows = zip(batch.column("point").to_pylist(), batch.column("n").to_pylist(), strict=True)
        return zip(batch.column("side").to_pylist(), batch.column("cls").to_pylist(), rows, strict=True)

    def links_of(rows, sides):
        """Level by level: sets with as many coordinates, and those just beyond, folded to as many."""
        links, widths, sizes = [], np.array([len(r[0]) for r in rows]), np.array([r[1] for r in rows])
        for width in np.unique(widths).tolist():
            limit = FINE * width // GROUPS  # sets of this size and more have finer points
            at = np.flatnonzero((widths == width) | ((widths == 4 * width) & (percent * sizes <= 100 * limit)))
            if len(at) < 2:
                continue
            points = np.zeros((len(at), width), np.int64)
            for k, i in enumerate(at):
                point = np.frombuffer(rows[i][0], np.uint8).astype(np.int64)
                point[point == FULL] = 1 << 40
                points[k] = point.reshape(-1, width).sum(axis=0)
            links += [(at[a], at[b]) for a, b in spanning(points, sizes[at], sides[at], percent, lambda i, found: np.ones(len(found), bool))]
        return links

    return lambda batches: _by_block(batches, ("key", "i", "j"), rows_of, links_of)


def _verified(k: int, percent: int):
    """Links of each block of a candidate group."""

    def rows_of(batch: pa.RecordBatch):
        for side, cls, s in zip(batch.column("side").to_pylist(), batch.column("cls").to_pylist(), sets_of(batch.column("text"), k), strict=True):
            yield side, cls, s if len(s) and class_of(s) == cls else None  # hashes of rows can collide

    return lambda batches: _by_block(batches, ("key", "i", "j"), rows_of, lambda sets, sides: linked(sets, sides, percent))


def _first_blocks(rows: DataFrame, limit: int) -> DataFrame:
    """rows (key, cls, leaves) as (key, cls, i, j, side): each in its leaf, and again in every level that its hash reaches."""
    step, height = max(2, limit // RISE), F.pmod(F.xxhash64("cls", F.lit(9)), F.lit(1 << 40))
    at = []
    for level in range(LEVELS):
        wide = F.ceil(F.col("leaves") / float(step**level))
        here = F.struct(F.pmod(F.xxhash64("cls", F.lit(3 + level)), wide).alias("i"), F.lit(-1 - level).cast("long").alias("j"))
        rises = (F.col("leaves") > step ** (level - 1)) & (height % step**level == 0) if level > 1 else (F.col("leaves") > 1) & (height % step == 0)
        at.append(F.when(rises, here) if level else here)
    spots = F.explode(F.filter(F.array(*at), lambda x: x.isNotNull())).alias("at")
    return rows.select("key", "cls", spots).select("key", "cls", "at.i", "at.j", F.lit(0).alias("side"))


def _rest_blocks(hot: DataFrame, labels: DataFrame, limit: int) -> DataFrame | None:
    """Of rows (key, cls, leaves) cut into leaves: those outside their key's largest component meet all of the key. None if there are none."""
    label = F.coalesce("component", "cls").alias("label")
    named = hot.join(labels, F.col("cls") == F.col("node"), "left").select("key", "cls", "leaves", label)
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    big = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("big"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    open_rows = named.join(big.select("key", "big", F.ceil(F.col("rest") / limit).alias("chunks")), "key")
    rows, _ = stored(open_rows.select("key", "cls", "leaves", "chunks", (F.col("label") != F.col("big")).alias("guest")), "rest")
    if rows.isEmpty():
        return None
    number = lambda n, salt: F.pmod(F.xxhash64("cls", F.lit(salt)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    homes = rows.select("key", "cls", number("leaves", 3).alias("i"), every("chunks").alias("j"), F.lit(0).alias("side"))
    guests = rows.where("guest").select("key", "cls", every("leaves").alias("i"), number("chunks", 5).alias("j"), F.lit(1).alias("side"))
    return homes.unionByName(guests)


def _joined_up(rows: DataFrame, limit: int, payload, links_of) -> DataFrame:
    """(node, component) over the links among classes of one key. rows: (key, cls, leaves); payload: adds columns to (key, cls, i, j, side) for links_of."""

    def links(blocks: DataFrame) -> DataFrame:
        dealt = payload(blocks).repartition(partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "cls")
        return dealt.mapInArrow(links_of, "a bigint, b bigint")

    labels = components(links(_first_blocks(rows, limit)))
    hot = rows.where("leaves > 1")
    rest = None if hot.isEmpty() else _rest_blocks(hot, labels, limit)
    if rest is None:
        return labels
    return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links(rest)))


def _frequent(k: int):
    """(shingle, count) of shingles that several documents of a block share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= 2
            values, counts = values[often], counts[often]
            top = np.argsort(-counts, kind="stable")[:8192]
            return pa.RecordBatch.from_arrays([pa.array(values[top].view(np.int64)), pa.array(counts[top].astype(np.int64))], names=["shingle", "n"])

        for batch in batches:
            for s in sets_of(batch.column("text"), k):
                held.append(s)
                size += len(s)
                if size > 4_000_000:
                    yield counted()
                    held.clear()
                    size = 0
        if held:
            yield counted()

    return run


def _described(k: int, percent: int, frequent, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, often = frequent.value, counts.value
        for batch in batches:
            sizes, classes, keys, points = [], [], [], []
            for s in sets_of(batch.column("text"), k):
                sizes.append(len(s))
                if not len(s):
                    classes.append(None)
                    keys.append(None)
                    points.append(None)
                    continue
                points.append(np.minimum(point_of(s, groups_for(len(s))), FULL).astype(np.uint8).tobytes())
                classes.append(class_of(s))
                keys.append(first_shingles(s, percent, hot, often).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("at"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(points, pa.binary())], names=["doc_id", "at", "n_shingles", "cls", "keys", "point"])

    return run


def joined(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """docs (doc_id, text) as (doc_id, text_hash, n_shingles, component_id, component).

    text_hash: xxhash64 of the text (null: of ""). component: a number that the rows of one component share, null where there are no words."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    often = texts.select("text").mapInArrow(_frequent(k), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    table = often.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toPandas()  # FREQUENT rows
    hot = table["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot)
    send = spark.sparkContext.broadcast
    describe = _described(k, percent, send(hot[order]), send(table["n"].to_numpy(np.int64)[order]))
    hashed = texts.select("doc_id", F.xxhash64("text").alias("at"), "text")
    described = written(hashed.mapInArrow(describe, "doc_id bigint, at bigint, n_shingles bigint, cls bigint, keys array<bigint>, point binary"), "jaccard")

    # first shingles that several classes have; copies of one class are merged before the shuffle
    some = described.where(F.col("cls").isNotNull())
    keyed = some.select("cls", F.explode("keys").alias("key"))
    repeated = keyed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    sharing, sharing_path = stored(keyed.join(repeated, "key").select("key", "cls").distinct(), "sharing")
    shared = sharing.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / SHARERS).alias("leaves"))
    # each class's text is read from one of its rows, found by hash
    row = F.xxhash64("doc_id", "at")
    classes = written(some.groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.min(row).alias("row"), F.max("n_shingles").alias("n"), F.max("point").alias("point")), "classes")
    points = classes.select("cls", "n", "point")
    groups, groups_path = stored(_joined_up(sharing.join(shared, "key"), SHARERS, lambda blocks: blocks.join(points, "cls"), _proposed(percent)), "groups")
    remove(spark, sharing_path)

    members = groups.select(F.col("node").alias("cls"), F.col("component").alias("key")).join(classes.select("cls", "row", "n"), "cls")
    weights = members.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("weight"))
    leaves = F.greatest(F.ceil(F.col("rows") / LEAF), F.ceil(F.col("weight") / LEAF_SHINGLES))
    leafed, leafed_path = stored(members.join(weights.select("key", leaves.alias("leaves")), "key").select("row", "cls", "key", "leaves"), "members")
    bucket = F.pmod(F.col("row"), F.lit(FILTER)).alias("bucket")
    rows = hashed.select(row.alias("row"), "text").withColumn("bucket", bucket)

    def with_text(blocks: DataFrame) -> DataFrame:
        wanted = blocks.join(leafed.select("key", "cls", "row"), ["key", "cls"])
        near = rows.join(F.broadcast(leafed.select(bucket).distinct()), "bucket", "left_semi")
        return near.select("row", "text").join(wanted, "row").select("key", "cls", "i", "j", "side", "text")

    found, found_path = stored(_joined_up(leafed.select("key", "cls", "leaves"), LEAF, with_text, _verified(k, percent)), "found")
    remove(spark, leafed_path)
    remove(spark, groups_path)

    named = found.join(classes, F.col("node") == F.col("cls")).select("cls", "component", "first_id")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    label = named.join(least, "component").select("cls", "component", "component_id")
    by_class = classes.join(label, "cls", "left").select("cls", F.coalesce("component", "cls").alias("component"), F.coalesce("component_id", "first_id").alias("component_id"))
    out = described.select("doc_id", F.col("at").alias("text_hash"), "n_shingles", "cls").join(by_class, "cls", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "component")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(documents(spark, sf_dir), 4, 85).select("doc_id", "n_shingles", "component_id")
