"""Words and shingles of Arrow text columns as 64-bit hashes, computed on the UTF-8 buffers with numpy.

A chunk holds whole documents, about CHUNK bytes or one longer document; a longer document is
hashed in pieces cut at white space, so memory follows the number of its words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
PIECE = 1 << 22
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, so that any bits can serve as a hash."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(2 * n, _BASE, np.uint64))])
    return _powers


class Chunk(NamedTuple):
    first: int  # row of the batch
    data: np.ndarray  # bytes of the documents
    starts: np.ndarray  # offsets in data, one more than documents


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary array; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.binary()):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if column.type == pa.string() else b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """The column's documents in order, in chunks of about limit bytes."""
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield Chunk(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def pieces(data: np.ndarray, space: np.ndarray = SPACE) -> Iterator[np.ndarray]:
    """One document's bytes in pieces of about PIECE bytes, cut behind white space; a longer word is never cut."""
    at, n = 0, len(data)
    while at < n:
        end = at + PIECE
        while end < n:
            gap = np.flatnonzero(space[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
                break
            end += PIECE
        yield data[at : min(end, n)]
        at = end


def hash_piece(data: np.ndarray, doc_starts: np.ndarray, table: np.ndarray = LOWER, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and length of every word of data; no word crosses a document's start."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), none, none
    text = ~space[data]
    first = text.copy()
    first[1:] &= ~text[:-1]
    heads = doc_starts[doc_starts < len(data)]
    first[heads] = text[heads]
    begins = np.flatnonzero(first)
    if not len(begins):
        return np.zeros(0, np.uint64), none, none
    at = np.flatnonzero(text)
    bounds = np.flatnonzero(first[at])
    lengths = np.diff(np.append(bounds, len(at)))
    inside = np.arange(len(at)) - np.repeat(bounds, lengths)
    terms = (table[data[at]].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[inside]
    return mix(np.add.reduceat(terms, bounds)), begins, lengths


def word_hashes(chunk: Chunk, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the chunk's documents in order, and each document's offsets in them."""
    table = LOWER if lower else SAME
    if len(chunk.data) <= PIECE:
        hashes, begins, _ = hash_piece(chunk.data, chunk.starts[:-1], table)
        return hashes, np.searchsorted(begins, chunk.starts)
    found, offsets = [], [0]
    for a, b in zip(chunk.starts[:-1], chunk.starts[1:], strict=True):
        own = [hash_piece(p, np.zeros(1, np.int64), table)[0] for p in pieces(chunk.data[a:b])]
        found += own
        offsets.append(offsets[-1] + sum(map(len, own)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.array(offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words, and each document's offsets in them. A document of 1 to k - 1 words has its whole sequence as one."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    factors = powers(k + 2)
    counts = np.diff(offsets)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        rolled[: n - j] += words[j:] * factors[j + 1]
    windows = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(windows)])
    at = np.arange(out[-1]) - np.repeat(out[:-1], windows) + np.repeat(offsets[:-1], windows)
    values = rolled[at]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        a, b = offsets[i], offsets[i + 1]
        values[out[i]] = (words[a:b] * factors[1 : b - a + 1]).sum(dtype=np.uint64) + np.uint64(b - a)
    return mix(values), out
