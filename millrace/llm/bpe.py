"""Byte-level BPE by merge ranks, with a hierarchical-bitmap rank queue.

Encoding a pre-token keeps its parts in a linked list over byte positions. Each rank that some neighbours could merge
to has a bucket of positions; a bitmap tree over the ranks finds the lowest non-empty bucket by find-first-set on a word
per level. An entry is stale, and skipped, if the pair now at its position no longer has that rank. Cost grows with the
length, not its square, so very long pre-tokens are no special case.

Nulls: a null text is an empty one, of no ids; a null doc_id is kept. Rows are encoded one by one, ties and repeats
alike. An empty table gives an empty result; columns besides doc_id and text are not read."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents

#: Distinct pre-tokens that a worker remembers after a second sight, and those seen once. Each memory is emptied when full and only saves time.
CACHE = 600_000
YOUNG = 300_000


class RankQueue:
    """Buckets of positions by rank, under a bitmap of two levels: a bit per rank, and a bit per word of the level below.
    Words have about the square root of the ranks as bits. Encoding.merge pushes and pops in line, for speed; a
    queue that was drained is empty again."""

    def __init__(self, ranks: int):
        self.log = max(1, (max(ranks - 1, 1).bit_length() + 1) // 2)
        self.words = [0] * ((ranks >> self.log) + 1)
        self.buckets: dict[int, list[int]] = {}
        self.bit_of = [1 << r for r in range(1 << self.log)]  # as many serve for words: there are no more of them


class Encoding:
    """Merge ranks with the pattern that cuts texts into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.young: dict[str, tuple[str, tuple[int, ...]]] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Encoding:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        queue, get = self.queue, ranks.get
        log, words, buckets, bit_of = queue.log, queue.words, queue.buckets, queue.bit_of
        mask, top = len(bit_of) - 1, 0
        after = list(range(1, n + 2))  # where the part at each position ends; the end's own entry is never read as a part
        before = list(range(-1, n))
        alive = bytearray(b"\1") * n
        fresh = [(rank, i) for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
        while True:
            for rank, i in fresh:  # push
                if rank in buckets:
                    buckets[rank].append(i)
                    continue
                buckets[rank] = [i]
                word = rank >> log
                words[word] |= bit_of[rank & mask]
                top |= bit_of[word]
            if not top:
                break
            word = (top & -top).bit_length() - 1  # find first set on each level
            bits = words[word]
            low = bits & -bits
            words[word] = bits ^ low
            if bits == low:
                top &= top - 1
            rank = (word << log) + low.bit_length() - 1
            positions = buckets.pop(rank)
            if len(positions) > 1:
                positions.sort()
            fresh = []
            for k, i in enumerate(positions):
                if not alive[i] or (middle := after[i]) == n:
                    continue
                end = after[middle]
                if get(piece[i:end]) != rank:
                    continue  # stale: a neighbour has merged since
                alive[middle] = 0
                after[i] = end
                before[end] = i
                least = rank + 1
                if end < n and (merged := get(piece[i : after[end]])) is not None:
                    fresh.append((merged, i))
                    least = merged
                if i and (merged := get(piece[before[i] : end])) is not None:
                    fresh.append((merged, before[i]))
                    least = min(least, merged)
                if least <= rank:  # a new pair goes first: the rest of this bucket waits
                    fresh += [(rank, j) for j in positions[k + 1 :]]
                    break
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def _entry(self, token: str) -> tuple[str, tuple[int, ...]]:
        entry = self.young.get(token)
        if entry is not None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[token] = entry
            return entry
        ids = self.merge(token.encode())
        entry = (str(ids)[1:-1].replace(" ", ""), tuple(ids))
        if len(token) <= 64:
            if len(self.young) >= YOUNG:
                self.young.clear()
            self.young[token] = entry
        return entry

    def entries(self, text: str) -> list[tuple[str, tuple[int, ...]]]:
        """Every pre-token's ids, as decimal text and as numbers."""
        get, make = self.cache.get, self._entry
        return [get(t) or make(t) for t in self.find(text)]

    def encode(self, text: str) -> list[int]:
        return [i for entry in self.entries(text) for i in entry[1]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_encodings: dict[tuple[str, str], Encoding] = {}


def encoding(path: str, pattern: str) -> Encoding:
    """One encoding per worker and file."""
    key = (path, pattern)
    if key not in _encodings:
        _encodings.clear()
        _encodings[key] = Encoding.load(path, pattern)
    return _encodings[key]


_SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                counts, ids_hash, text_hash = [], [], []
                for text in part.column("text").to_pylist():
                    found = bpe.entries(text)
                    ids = [i for entry in found for i in entry[1]]
                    counts.append(len(ids))
                    ids_hash.append(hashlib.sha256(",".join([entry[0] for entry in found]).encode()).hexdigest())
                    text_hash.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Every document encoded and decoded again, as counts and digests."""
    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_digests(path, pattern), _SCHEMA)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (doc_id, text) as (doc_id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(path, pattern)
        for batch in batches:
            ids = pa.array([bpe.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, ids array<int>")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
