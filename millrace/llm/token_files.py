"""Token ids in directly addressable codes.

A segment holds the ids of consecutive documents. Ids are split into 8-bit chunks, low ones first: level k has the
k-th chunk of every id that reaches it, a bitmap of those that go on, and a rank directory (ones before each block of
512 bits) that turns a position into the next level's, so any token is read without decoding its neighbours.
Segments are written as rows of a Parquet table, one file image per row: that works in any store that Spark writes.

A range of doc_id is a task of its own, which holds one segment's ids at a time, or one longer document's.

Nulls: a null text is an empty one, of the end id alone; null doc_ids come first, all in one range. Rows that repeat a doc_id follow
each other in order of text. An empty table gives an empty result; columns besides doc_id and text are not read."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bucket_of, documents, partitions, split_points, written
from millrace.llm.tokens import encoder

MAGIC = b"MDAC1\0"
BLOCK = 512
SEGMENT_IDS = 1 << 19
END_ID = 0
_HEAD = struct.Struct("<6sHqq")  # magic, levels, documents, ids
NO_ID = -(1 << 63)


def encode_ids(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of (chunks, continuation bitmap, rank directory)."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest):
        more = rest > 0xFF
        padded = np.zeros(-(-len(rest) // BLOCK) * BLOCK, bool)
        padded[: len(rest)] = more
        ranks = np.concatenate([[0], np.cumsum(padded.reshape(-1, BLOCK).sum(axis=1))])[:-1].astype("<u4")
        levels.append(((rest & 0xFF).astype(np.uint8), np.packbits(padded, bitorder="little"), ranks))
        rest = rest[more] >> 8
    return levels


def to_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A segment's file image."""
    levels = encode_ids(ids)
    parts = [_HEAD.pack(MAGIC, len(levels), len(doc_ids), len(ids)), np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<i8").tobytes()]
    for chunks, bitmap, ranks in levels:
        parts += [struct.pack("<q", len(chunks)), ranks.tobytes(), bitmap.tobytes(), chunks.tobytes()]
    return b"".join(parts)


class Segment:
    """A segment over its file image; arrays are views of it."""

    def __init__(self, image: bytes):
        magic, levels, docs, self.n = _HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(image, "<i8", docs, at)
        self.lengths = np.frombuffer(image, "<i8", docs, at + 8 * docs)
        at += 16 * docs
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<q", image, at)
            blocks = -(-n // BLOCK)
            at += 8
            ranks = np.frombuffer(image, "<u4", blocks, at)
            bitmap = np.frombuffer(image, np.uint8, blocks * BLOCK // 8, at + 4 * blocks)
            at += 4 * blocks + blocks * BLOCK // 8
            self.levels.append((np.frombuffer(image, np.uint8, n, at), bitmap, ranks))
            at += n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """The i-th id: one chunk and one rank a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            word = int.from_bytes(bitmap[block * BLOCK // 8 : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - block * BLOCK)) - 1)
            i, shift = int(ranks[block]) + word.bit_count(), shift + 8
        return value

    def ids(self) -> np.ndarray:
        """All ids, from the last level up."""
        rest = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            out = chunks.astype(np.uint32)
            out[np.unpackbits(bitmap, count=len(chunks), bitorder="little").view(bool)] |= rest << np.uint32(8)
            rest = out
        return rest


_SEGMENTS = "bucket int, segment int, local_start bigint, n_docs bigint, n_ids bigint, image binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("segment", pa.int32()), ("local_start", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])


def _encode(path: str, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, byte_level=True)
        end = np.array([end_id], "<u4").tobytes()
        state = {"bucket": None, "segment": 0, "start": 0}
        docs: list = []
        lengths: list[int] = []
        raw: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal held
            row = (state["bucket"], state["segment"], state["start"], len(docs), held, to_file(docs, lengths, np.frombuffer(b"".join(raw), "<u4")))
            state["segment"] += 1
            state["start"] += held
            docs.clear()
            lengths.clear()
            raw.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                for bucket, doc_id, ids in zip(part.column("bucket").to_pylist(), part.column("doc_id").to_pylist(), encode.ids(part.column("text").to_pylist()), strict=True):
                    if docs and (bucket != state["bucket"] or held >= segment_ids):
                        yield close()
                    if bucket != state["bucket"]:
                        state.update(bucket=bucket, segment=0, start=0)
                    docs.append(doc_id)
                    lengths.append(len(ids) // 4 + 1)
                    raw += [ids, end]
                    held += lengths[-1]
        if docs:
            yield close()

    return run


def write_ids(docs: DataFrame, path: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Writes the token files of docs (doc_id, text) in ascending doc_id order and returns their table (bucket, segment, local_start, n_docs, n_ids, image).
    Buckets are ranges of doc_id; texts are shuffled once, into them."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = split_points(texts, "doc_id", partitions(docs.sparkSession))
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(bucket_of(F.col("doc_id"), cuts))
    ordered = texts.withColumn("bucket", bucket).repartitionById(len(cuts) + 2, F.col("bucket") + 1).sortWithinPartitions("bucket", "doc_id", "text")
    return written(ordered.mapInArrow(_encode(path, end_id, segment_ids), _SEGMENTS), "tokens")


_DOCS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _decode(base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(batch.column("image")[row].as_py())
                raw = segment.ids().astype("<u4").tobytes()
                ends = np.cumsum(segment.lengths)
                starts = ends - segment.lengths
                first = base[batch.column("bucket")[row].as_py()] + batch.column("local_start")[row].as_py()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                ids = [None if d == NO_ID else d for d in segment.doc_ids.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(first + starts), pa.array(segment.lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_ids(segments: DataFrame) -> DataFrame:
    """Every document of the token files: its place among all ids, its count of ids and their crc32."""
    totals = segments.groupBy("bucket").agg(F.sum("n_ids").alias("n")).orderBy("bucket").collect()  # a row per range of doc_id
    base, at = {}, 0
    for row in totals:
        base[row["bucket"]], at = at, at + row["n"]
    return segments.select("bucket", "local_start", "image").mapInArrow(_decode(base), _DOCS)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_ids(write_ids(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))
