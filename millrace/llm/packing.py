"""Sum-of-squares online packing of documents into fixed token windows.

A packer counts its partially filled windows by fill level. It puts each piece into the level (or a new window)
that leaves the smallest sum of squared counts, the fullest window among equals. Documents longer than a window are
cut into whole windows and a remainder. Every scan partition runs one packer; windows that it leaves partly filled
are placed once more by a packer per GATHER partitions, as pieces that keep together.

Nulls: a null text is an empty one, of the end id alone; a null doc_id is kept. Ties and repeated rows are packed row by
row. An empty table gives an empty result; columns besides doc_id and text are not read."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, written
from millrace.llm.tokens import encoder

WINDOW = 4096
END_ID = 2
#: Windows filled to this share at a partition's end are left as they are.
DONE = 0.99
GATHER = 32
_SECOND = 1 << 60


class SumOfSquares:
    """Places sizes into windows; .level[h] counts the open windows filled to h."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.level = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[int]] = defaultdict(list)
        self.made = 0

    def place(self, size: int) -> tuple[int, int, bool]:
        """(window's number, offset in it, whether it is full now)."""
        if not 0 < size <= self.window:
            raise ValueError(f"size {size} does not fit a window of {self.window}")
        best, cost = 0, 0 if size == self.window else 2 * int(self.level[size]) + 1
        last = self.window - size
        at = np.flatnonzero(self.level[1 : last + 1]) + 1
        if len(at):
            costs = 2 * (self.level[at + size] - self.level[at] + 1)
            if at[-1] == last:  # such a window leaves the count
                costs[-1] = 1 - 2 * self.level[last]
            k = len(at) - 1 - int(np.argmin(costs[::-1]))
            if costs[k] <= cost:
                best = int(at[k])
        if best:
            number = self.open[best].pop()
            self.level[best] -= 1
        else:
            number, self.made = self.made, self.made + 1
        full = best + size == self.window
        if not full:
            self.open[best + size].append(number)
            self.level[best + size] += 1
        return number, best, full

    def fills(self) -> dict[int, int]:
        """Fill of every open window."""
        return {number: h for h, numbers in self.open.items() for number in numbers}


_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_FIRST = _SCHEMA + ", fill bigint, part int"


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "part" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)


def _pack(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, waiting = SumOfSquares(window), defaultdict(list)
        end = np.array([end_id], "<u4").tobytes()
        encode = encoder(path, byte_level=False)
        names = [*_NAMES, "fill", "part"]
        for batch in batches:
            ids_of, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo in range(0, len(ids_of), 200):
                out = []
                for doc_id, ids in zip(ids_of[lo : lo + 200], encode.ids(texts.slice(lo, 200).to_pylist()), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        size = min(window, total - start)
                        number, offset, full = packer.place(size)
                        waiting[number].append((doc_id, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), total, (part << 32) + number, offset))
                        if full:
                            out += [(*row, window, part) for row in waiting.pop(number)]
                if out:
                    yield _batch(out, names)
        fills = packer.fills()
        yield _batch([(*row, fills[number], part) for number, rows in waiting.items() for row in rows], names)

    return run


def _repack(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId()
        held = defaultdict(list)  # pieces of each window left open
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in [*_NAMES, "fill"]), strict=True):
                held[row[5]].append(row)
        packer, out = SumOfSquares(window), []
        for _, rows in sorted(held.items(), key=lambda x: (-x[1][0][7], x[0])):
            number, base, _ = packer.place(rows[0][7])
            out += [(*row[:5], _SECOND + (group << 32) + number, base + row[6]) for row in rows]
        yield _batch(out, _NAMES)

    return run


def packed(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces of docs (doc_id, text), each with its window (sequence_id) and place there. path: a tokenizers file that drops white space."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    first = written(texts.mapInArrow(_pack(path, window, end_id), _FIRST), "packed")
    closed = first.where(F.col("fill") >= int(DONE * window)).select(*_NAMES)
    parts = first.agg(F.max("part")).first()[0] or 0
    groups = parts // GATHER + 1
    left = first.where(F.col("fill") < int(DONE * window)).repartitionById(groups, F.floor(F.col("part") / GATHER).cast("int"))
    return closed.unionByName(left.mapInArrow(_repack(window), _SCHEMA))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
