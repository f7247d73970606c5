"""Threshold-scaled sketches of documents.

A sketch keeps every distinct hash of a five-word shingle (ASCII case folded) below a fixed fraction of the
hash space. Sketches of any two documents can be merged by union, and the containment of either in the other
is estimated from the hashes they share, however unequal the documents are. Where no hash lies below the
threshold the smallest one stands in (an anchor); merging keeps the smaller anchor, or drops it beside real hashes.

Nulls: a null text is an empty text; its sketch is empty, its likeness to another empty text 1, to others 0.
A null doc_id sorts after every other. Rows that repeat a doc_id follow each other in order of text.
A table of one row is its own next document; an empty table gives an empty result."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bucket_of, documents, partitions, split_points
from millrace.llm.words import chunks, shingle_hashes, word_hashes

SHINGLE_WORDS = 5
FRACTION = 0.25


def threshold(fraction: float = FRACTION) -> np.uint64:
    return np.uint64(int(fraction * 2.0**64))


def sketches(texts: pa.Array, fraction: float = FRACTION) -> list[np.ndarray]:
    """Sorted kept hashes of each text."""
    limit, out = threshold(fraction), []
    for chunk in chunks(texts):
        values, at = shingle_hashes(*word_hashes(chunk), SHINGLE_WORDS)
        below = values < limit
        for a, b in zip(at[:-1], at[1:], strict=True):
            kept = values[a:b][below[a:b]]
            out.append(np.unique(kept) if len(kept) else values[a:b].min(keepdims=True) if b > a else values[:0])
    return out


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of both documents' shingles together."""
    both = np.union1d(a, b)
    kept = both[both < threshold(fraction)]
    return kept if len(kept) else both[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0 if not len(b) else 0.0
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The larger of the two containments: that of the smaller sketch in the larger."""
    return containment(a, b) if len(a) <= len(b) else containment(b, a)


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def edited(text: str, following: str) -> str:
    """text with its last third replaced by the first as many code points of the following document."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(doc_id, text, next text) of every own row; rows come by bucket, own rows before the bucket's guest."""
    held = None  # bucket, doc_id, text of the row that waits for the next
    for batch in batches:
        out = []
        for bucket, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text")), strict=True):
            if held is not None and held[0] == bucket:
                out.append((held[1], held[2], text))
                held = None
            if not guest:
                held = (bucket, doc_id, text)
        yield out
    if held is not None:
        raise ValueError("a bucket has no guest row")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for pairs in _pairs(batches):
        for i in range(0, len(pairs), 500):
            part = pairs[i : i + 500]
            new = [edited(text, following) for _, text, following in part]
            own = sketches(pa.array([p[1] for p in part], pa.string()))
            changed = sketches(pa.array(new, pa.string()))
            after = own[1:] + sketches(pa.array([part[-1][2]], pa.string()))
            # within a bucket the next document's sketch is the next row's; elsewhere it is computed
            for k in range(len(part) - 1):
                if part[k][2] is not part[k + 1][1]:
                    after[k] = sketches(pa.array([part[k][2]], pa.string()))[0]
            columns = [
                [p[0] for p in part],
                [len(p[1]) for p in part],
                [hashlib.sha256(t.encode()).hexdigest() for t in new],
                [encode(s) for s in own],
                [encode(s) for s in changed],
                [likeness(a, b) for a, b in zip(own, changed, strict=True)],
                [likeness(a, b) for a, b in zip(own, after, strict=True)],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs (doc_id, text) and of their edited texts, the next document being that of descending doc_id.

    Texts are shuffled once, into ranges of doc_id; each range also gets the first row of the next one as a guest."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = split_points(docs, "doc_id", partitions(docs.sparkSession))
    ids = docs.select("doc_id", bucket_of(F.col("doc_id"), cuts).alias("bucket"), F.lit(False).alias("guest"))
    if cuts:  # null ids come after every other: below the lowest range
        ids = ids.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("bucket")))
    bounds = ids.groupBy("bucket").agg(F.max("doc_id").alias("first")).orderBy(F.desc("bucket")).collect()  # a row per range at most
    guests = [(row["first"], bounds[i - 1]["bucket"], row["bucket"]) for i, row in enumerate(bounds)]
    bucket = F.when(F.col("doc_id").isNull() & F.lit(bool(cuts)), -1).otherwise(bucket_of(F.col("doc_id"), cuts))
    own = docs.select(bucket.alias("bucket"), F.lit(False).alias("guest"), "doc_id", "text")
    edges = docs.sparkSession.createDataFrame(guests, "first bigint, target int, home int")
    lent = docs.join(F.broadcast(edges), F.col("doc_id").eqNullSafe(F.col("first"))).select(F.col("target").alias("bucket"), F.lit(True).alias("guest"), "doc_id", "text")
    placed = own.unionByName(lent).repartition(max(1, len(bounds)), "bucket")
    ordered = placed.sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "text")
    return ordered.mapInArrow(_fingerprints, _SCHEMA)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
