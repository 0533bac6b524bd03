"""Numpy helpers over blocks of texts: bytes of many documents side by side.

A block is a run of whole documents of about BLOCK_BYTES; a longer document is a block of its own, so
what a task holds is bounded by the larger of the two. All arithmetic wraps at 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2_000_000
BLOCK_ROWS = 2048
U64 = np.uint64


class Block:
    """`ids[i]` owns `data[at[i]:at[i + 1]]`; `missing[i]` tells a null text from an empty one."""

    def __init__(self, ids, data, at, missing):
        self.ids, self.data, self.at, self.missing = ids, data, at, missing

    def __len__(self):
        return len(self.ids)

    def text(self, i: int) -> str:
        return self.data[self.at[i]:self.at[i + 1]].tobytes().decode("utf-8")


def _column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[Block, pa.RecordBatch]]:
    """Each block with the rows it came from; a null text has no bytes."""
    for batch in batches:
        raw, at = _column_bytes(batch.column(text))
        missing = np.asarray(batch.column(text).is_null())
        low, n = 0, batch.num_rows
        while low < n:
            high = min(max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1), low + BLOCK_ROWS, n)
            rows = batch.slice(low, high - low)
            ids = rows.column("doc_id") if "doc_id" in batch.schema.names else None
            yield Block(ids if ids is not None else np.arange(low, high), raw[at[low]:at[high]], at[low:high + 1] - at[low], missing[low:high]), rows
            low = high


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


@lru_cache(maxsize=8)
def byte_codes(seed: int) -> np.ndarray:
    """A random odd-ish 64-bit code per byte value."""
    return mixed(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93) + U64(seed))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASES = {1: 0x9E6C63D0876A9A47 | 1, 2: 0xC6A4A7935BD1E995 | 1}


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i for i below n (kept for ordinary blocks)."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 70_000)
        base = _BASES[seed]
        inverse = pow(base, -1, 1 << 64)

        def ladder(b):
            out = np.full(size, b, U64)
            out[0] = 1
            return np.multiply.accumulate(out)

        have = ladder(base), ladder(inverse)
        if size <= 2 * BLOCK_BYTES:
            _POWERS[seed] = have
    return have


class Ranges:
    """Hashes of arbitrary byte ranges of a block in constant time each."""

    def __init__(self, data: np.ndarray, seed: int, table: np.ndarray | None = None):
        n = len(data)
        up, self.down = powers(seed, n + 1)
        codes = (byte_codes(seed) if table is None else table)[data]
        codes *= up[:n]
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(codes, out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Also the length enters, so that no range equals one with other length."""
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mixed(raw + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a block with A-Z in lower case: hash, place, and each document's share."""

    def __init__(self, block: Block, seed: int = 1):
        data = LOWER[block.data]
        gap = SPACE[data]
        n = len(data)
        before = np.empty(n, bool)
        before[1:] = gap[:-1]
        inner = block.at[:-1][block.at[:-1] < n]
        before[inner] = True
        after = np.empty(n, bool)
        after[:-1] = gap[1:]
        if n:
            before[0] = True
            after[-1] = True
            after[(inner - 1)[inner > 0]] = True
        self.start = np.flatnonzero(before & ~gap)
        self.end = np.flatnonzero(after & ~gap) + 1
        self.data = data
        self.hash = Ranges(data, seed).hash(self.start, self.end)
        #: words of document i: first[i] up to first[i + 1]
        self.first = np.searchsorted(self.start, block.at)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of `size` words; a document with fewer words has its whole sequence as one."""
    first, n_docs = words.first, len(words.first) - 1
    count = np.diff(first)
    doc = np.repeat(np.arange(n_docs), count)
    n = len(words.hash)
    weight = [mixed(np.array([7919 * (j + 1)], U64))[0] | U64(1) for j in range(size)]
    total = np.zeros(n, U64)
    for j in range(size):
        total[:max(0, n - j)] += words.hash[j:] * weight[j]
    place = np.arange(n) - first[:-1][doc] if n else np.zeros(0, np.int64)
    full = place + size <= count[doc] if n else np.zeros(0, bool)
    hashes, docs = mixed(total[full]), doc[full]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.array([_sequence(words.hash[first[d]:first[d + 1]], weight) for d in short], U64)
        hashes, docs = np.concatenate([hashes, extra]), np.concatenate([docs, short])
    return hashes, docs


def _sequence(hashes: np.ndarray, weight: list) -> np.uint64:
    total = (hashes * np.array(weight[:len(hashes)], U64)).sum(dtype=U64)
    return mixed(np.array([total], U64) + U64(len(hashes) * 0x51ED27))[0]
