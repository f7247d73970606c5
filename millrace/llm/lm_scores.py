"""Stupid-backoff scores of documents under bigram counts of all other documents.

The count table is partitioned by hash of the n-gram. Documents are dealt into blocks by hash; a block's exploded
n-grams, each once with its count, are sent to the n-grams' partitions as packed rows, joined there to the summed table,
and the counts come back to the block, where each document's terms are summed. A document's own occurrences
are taken off, so its score says how well the rest of the corpus predicts it.

Term of a word w after v (words split at white space, as written):
    ln(c(v w) / c(v)) if c(v w) > 0, else ln(ALPHA) + u(w);  a document's first word has u(w)
    u(w) = ln(c(w) / N), or ln(ALPHA / N) if c(w) = 0;  N: words of the other documents, 1 at least
Terms are rounded to millionths, so that sums do not depend on their order.

Nulls: a null or empty text has no words, a score_micro of 0 and a null score; a null doc_id is kept. Repeated rows
count as documents of their own. A document is never split: a task's memory follows its longest text. An empty table gives an empty result; columns besides doc_id and text are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents
from millrace.llm.words import Chunk, buffers, mix, powers, word_hashes

ALPHA = 0.4
#: Bytes of text in a block: a task holds about forty times as much in arrays, or as a longer document's.
BLOCK_BYTES = 3 << 20
#: Blocks for each partition of the count table, which takes about as many times a block's n-grams into one task.
SPREAD = 3
TOTAL = np.uint64(0)  # stands for the count of all words


class Block:
    """N-grams of one block: words, bigrams and the total as sorted distinct hashes with counts."""

    def __init__(self, texts: pa.Array):
        data, starts = buffers(texts)
        self.words, self.at = word_hashes(Chunk(0, data[starts[0] : starts[-1]], starts - starts[0]), lower=False)
        self.sizes = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        factors = powers(4)
        one = mix(self.words + np.uint64(1))
        follows = self.doc[1:] == self.doc[:-1]
        self.second = np.flatnonzero(follows) + 1  # words that have one before them
        two = mix(self.words[self.second - 1] * factors[2] + self.words[self.second] * factors[3])
        every = np.concatenate([one, two, [TOTAL]])
        self.grams, self.inverse, self.counts = np.unique(every, return_inverse=True, return_counts=True)
        self.counts = self.counts.astype(np.int64)
        self.counts[self.inverse[-1]] = len(self.words)

    def own(self, gram: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """How often each n-gram occurs in its own document."""
        _, inverse, counts = np.unique(doc * np.int64(len(self.grams)) + gram, return_inverse=True, return_counts=True)
        return counts[inverse]

    def scores(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed terms in millionths and the number of words that backed off, by document. table: counts of the whole corpus, one a gram."""
        n = len(self.words)
        gram1, gram2 = self.inverse[:n], self.inverse[n:-1]
        rest = np.maximum(int(table[self.inverse[-1]]) - self.sizes, 1)[self.doc]
        one = table[gram1] - self.own(gram1, self.doc)
        two = table[gram2] - self.own(gram2, self.doc[self.second])
        terms = np.log(np.where(one > 0, one, ALPHA) / rest)
        backed = two <= 0
        context = np.maximum(one[self.second - 1], 1)
        terms[self.second] = np.where(backed, np.log(ALPHA) + terms[self.second], np.log(np.maximum(two, 1) / context))
        micro = np.rint(terms * 1e6).astype(np.int64)
        many = len(self.sizes)
        sums = np.zeros(many, np.int64)
        np.add.at(sums, self.doc, micro)
        return sums, np.bincount(self.doc[self.second[backed]], minlength=many).astype(np.int64)


def _cuts(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's hashes begin in the sorted hashes, and their end."""
    home = ((grams >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(home, np.arange(buckets + 1, dtype=np.uint64))


def _pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit values: width of a difference in bytes, the first value, the differences."""
    steps = np.diff(values)
    width = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 0
    return bytes([width]) + values[:1].astype("<u8").tobytes() + _narrow(steps, width)


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(raw, "<u8", 1, 1), _wide(raw[9:], raw[0])]), dtype=np.uint64)


def _narrow(values: np.ndarray, width: int) -> bytes:
    """The low bytes of 64-bit values, byte planes one after another: like bytes lie together and compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _wide(raw: bytes, width: int) -> np.ndarray:
    n = len(raw) // width if width else 0
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _pack_counts(counts: np.ndarray) -> bytes:
    width = (int(counts.max()).bit_length() + 7) // 8
    return bytes([width]) + _narrow(counts, width)


def _unpack_counts(raw: bytes) -> np.ndarray:
    return _wide(raw[1:], raw[0]).astype(np.int64)


def _one(table: pa.Table, column: str) -> pa.Array:
    found = table.column(column).combine_chunks()
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def _asked(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block = Block(_one(table, "text"))
        cuts = _cuts(block.grams, buckets)
        full = np.flatnonzero(np.diff(cuts))
        grams = [_pack(block.grams[cuts[b] : cuts[b + 1]]) for b in full]
        counts = [_pack_counts(block.counts[cuts[b] : cuts[b + 1]]) for b in full]
        return pa.table({"block": pa.array([table.column("block")[0].as_py()] * len(full), pa.int32()), "bucket": pa.array(full, pa.int32()), "grams": pa.array(grams, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return run


def _summed(table: pa.Table) -> pa.Table:
    """The count table of one bucket, joined to the n-grams that asked."""
    asked = [_unpack(x) for x in table.column("grams").to_pylist()]
    own = np.concatenate([_unpack_counts(x) for x in table.column("counts").to_pylist()])
    _, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(inverse, weights=own).astype(np.int64)  # exact below 2 ** 53
    ends = np.cumsum([len(a) for a in asked])
    answers = [_pack_counts(total[part]) for part in np.split(inverse, ends[:-1])]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "answers": pa.array(answers, pa.binary())})


_SCHEMA = "doc_id bigint, n_words bigint, n_backoff bigint, score_micro bigint"


def _scored(texts: pa.Table, answers: pa.Table) -> pa.Table:
    block = Block(_one(texts, "text"))
    order = np.argsort(answers.column("bucket").to_numpy())
    counts = answers.column("answers").to_pylist()
    table = np.concatenate([_unpack_counts(counts[i]) for i in order])
    sums, backed = block.scores(table)
    return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(block.sizes.astype(np.int64)), "n_backoff": pa.array(backed), "score_micro": pa.array(sums)})


def scored(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text) as (doc_id, n_words, n_backoff, score_micro, score): summed and mean natural logarithms."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    asked = dealt.groupBy("block").applyInArrow(_asked(int(blocks) // SPREAD + 1), "block int, bucket int, grams binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(_summed, "block int, bucket int, answers binary")
    found = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored, _SCHEMA)
    return found.withColumn("score", F.when(F.col("n_words") > 0, F.col("score_micro") / 1e6 / F.col("n_words")))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir)).withColumn("score", F.round("score", 6))
