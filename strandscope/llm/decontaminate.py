"""Benchmark decontamination: SimHash of item-sized windows, multi-index search, exact check.

For every benchmark item of n words all windows of n words of a document are compared with it; a
document of fewer words is one window by itself, compared with every item that shares enough of its
shingles, without fingerprints (they are too coarse where a few shingles differ in number). Else a
window's fingerprint has BITS bits, the signs of the sums over its word shingles. Cut into BLOCKS bytes,
two fingerprints within RADIUS bits agree up to NEAR bits in at least one byte, so a table of the
items near each byte value finds all of them. Only items are looked up that share so many shingles with the
stretch of text that the threshold is in reach, for a bounded number of windows at a time. Candidates are confirmed by the weighted similarity of
the two shingle multisets (sum of smaller counts over sum of larger counts).

Windows without a shingle of any item of their size have similarity 0 and are passed over. Items come in
blocks of bounded number and size, each sent to all tasks; documents are read once per block and are
never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import filtered, work_columns
from .text import Block, Words, blocks, mixed

BITS, BLOCKS = 64, 8
NEAR = 2
RADIUS = BLOCKS * (NEAR + 1) - 1
BLOCK_ITEMS = 20_000
BLOCK_ITEM_BYTES = 32_000_000
FILTER_BITS = 22
#: How many pairs of a window and an item are looked up at once.
CELLS = 1 << 20


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def run_hashes(words: Words, size: int) -> np.ndarray:
    """Hash of the `size` words from each word on, across the whole block (callers stay within documents)."""
    n = len(words.hash) - size + 1
    total = np.zeros(max(0, n), np.uint64)
    for j in range(size):
        total += words.hash[j:j + len(total)] * (mixed(np.array([104729 * (j + 1)], np.uint64))[0] | np.uint64(1))
    return mixed(total)


def fingerprints(hashes: np.ndarray, length: int) -> np.ndarray:
    """SimHash of each run of `length` shingles of `hashes`, by differences of running sums."""
    spread = mixed(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A))
    signs = np.unpackbits(spread.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs, 0, dtype=np.int32)])
    above = (sums[length:] - sums[:-length]) > 0
    return np.packbits(above, axis=1, bitorder="little").view("<u8").reshape(-1)


class SizeIndex:
    """Items of one size: fingerprints, and for each block and byte value the items near it."""

    def __init__(self, words: int, shingle: int):
        self.words, self.shingle = words, min(shingle, words)
        self.runs = words - self.shingle + 1
        self.ids, self.sets, self.prints = [], [], []

    def add(self, item_id, hashes: np.ndarray) -> None:
        self.ids.append(item_id)
        self.sets.append(np.unique(hashes, return_counts=True))
        self.prints.append(fingerprints(hashes, self.runs)[0])

    def close(self) -> None:
        self.prints = np.array(self.prints, np.uint64)
        self.known = np.unique(np.concatenate([s for s, _ in self.sets]))
        values = np.arange(256, dtype=np.uint8)[:, None]
        held = self.prints.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
        self.near = [_ones(values ^ held[:, b]) <= NEAR for b in range(BLOCKS)]
        names = np.concatenate([s for s, _ in self.sets])
        order = np.argsort(names, kind="stable")
        self.held = (names[order], np.repeat(np.arange(len(self.sets)), [len(s) for s, _ in self.sets])[order],
                     np.concatenate([n for _, n in self.sets])[order])

    def sharing(self, hashes: np.ndarray, threshold: float) -> np.ndarray:
        """Items (ascending) that have so many shingles in common with `hashes`, repeated ones as often as
        both have them, that a part of it can reach the threshold. Bounded by the shingles of all items."""
        names, items, counts = self.held
        have, times = np.unique(hashes, return_counts=True)
        low = np.searchsorted(names, have, "left")
        n = np.searchsorted(names, have, "right") - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(items[at], np.minimum(np.repeat(times, n), counts[at]), len(self.ids))
        return np.flatnonzero(shared / self.runs >= threshold)

    def candidates(self, prints: np.ndarray, items: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, items) of all pairs within RADIUS of the given items, CELLS pairs looked up at a time."""
        step = max(1, CELLS // max(1, len(items)))
        near = [table[:, items] for table in self.near]
        for low in range(0, len(prints), step):
            some = prints[low:low + step]
            cut = some.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
            found = np.zeros((len(some), len(items)), bool)
            for b in range(BLOCKS):
                found |= near[b][cut[:, b]]
            window, at = np.nonzero(found)
            close = _ones(some[window] ^ self.prints[items[at]]) <= RADIUS
            yield low + window[close], items[at[close]]

    def similarity(self, hashes: np.ndarray, item: int) -> float:
        names, counts = self.sets[item]
        have, n = np.unique(hashes, return_counts=True)
        at = np.minimum(np.searchsorted(names, have), len(names) - 1)
        same = int(np.minimum(n, counts[at])[names[at] == have].sum())
        return same / (len(hashes) + int(counts.sum()) - same)


def item_index(items: list[tuple], shingle: int) -> dict[int, SizeIndex]:
    """By number of words; items without words are left out (nothing can match them)."""
    out: dict[int, SizeIndex] = {}
    for item_id, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        words = Words(Block([item_id], raw, np.array([0, len(raw)]), np.zeros(1, bool)))
        n = len(words.hash)
        if n:
            index = out.setdefault(n, SizeIndex(n, shingle))
            index.add(item_id, run_hashes(words, index.shingle))
    for index in out.values():
        index.close()
    return out


def _filter_bits(known: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << FILTER_BITS, bool)
    out[(known >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return out


def block_matches(words: Words, index: dict[int, SizeIndex], filters: dict[int, np.ndarray], threshold: float) -> dict[tuple[int, int, int], float]:
    """{(document, item size, item): best similarity} at or above the threshold."""
    best: dict[tuple[int, int, int], float] = {}
    first = words.first
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for shingle in sorted({s.shingle for s in index.values()}):
        hashes = run_hashes(words, shingle)
        if not len(hashes):
            continue
        maybe = np.flatnonzero(filters[shingle][(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        maybe = maybe[owner[maybe] == owner[maybe + shingle - 1]]
        for size, at in sorted(index.items()):
            if at.shingle != shingle or not len(maybe):
                continue
            place = np.minimum(np.searchsorted(at.known, hashes[maybe]), len(at.known) - 1)
            hits = maybe[at.known[place] == hashes[maybe]]
            for low, high in _stretches(hits, at.runs, owner, first, size):
                stretch = hashes[low:high + at.runs - 1]
                items = at.sharing(stretch, threshold)
                if not len(items):
                    continue
                for window, item in at.candidates(fingerprints(stretch, at.runs), items):
                    for w, i in zip(window.tolist(), item.tolist(), strict=True):
                        value = at.similarity(stretch[w:w + at.runs], i)
                        if value >= threshold:
                            key = (int(owner[low]), size, i)
                            best[key] = max(value, best.get(key, 0.0))
            for doc in _shorter(hits, at, owner, first, threshold):
                own = hashes[first[doc]:first[doc + 1] - shingle + 1]
                for i in at.sharing(own, threshold).tolist():
                    value = at.similarity(own, i)
                    if value >= threshold:
                        best[doc, size, i] = value
    return best


def _shorter(hits: np.ndarray, at: SizeIndex, owner: np.ndarray, first: np.ndarray, threshold: float) -> list[int]:
    """Documents with a hit and fewer words than the items, but not so few that the threshold is out of reach."""
    docs = np.unique(owner[hits])
    runs = first[docs + 1] - first[docs] - at.shingle + 1
    return docs[(runs < at.runs) & (runs / at.runs >= threshold)].tolist()


def _stretches(hits: np.ndarray, runs: int, owner: np.ndarray, first: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """[low, high) of window starts that hold a hit and stay within a document, joined where they touch."""
    low_end = high_end = -1
    for hit in hits.tolist():
        doc = owner[hit]
        low, high = max(int(first[doc]), hit - runs + 1), min(hit, int(first[doc + 1]) - size) + 1
        if low >= high:
            continue
        if low <= high_end and owner[low] == owner[low_end]:
            high_end = max(high_end, high)
            continue
        if high_end > low_end >= 0:
            yield low_end, high_end
        low_end, high_end = low, high
    if high_end > low_end >= 0:
        yield low_end, high_end


def _matched(batches: Iterator[pa.RecordBatch], index, threshold: float) -> Iterator[pa.RecordBatch]:
    filters = {s: _filter_bits(np.concatenate([i.known for i in index.values() if i.shingle == s])) for s in {i.shingle for i in index.values()}}
    for block, rows in blocks(batches):
        best = block_matches(Words(block), index, filters, threshold) if index else {}
        if best:
            ids = rows.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([ids[d] for d, _, _ in best], pa.int64()), "item_id": pa.array([index[s].ids[i] for _, s, i in best], pa.int64()),
                "similarity": pa.array(list(best.values()), pa.float64())})


def leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity): every item that a window of the document reaches the threshold with.

    The whole document is the window where it has fewer words than the item.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; an item of fewer than `shingle` words is one
    shingle. Null or blank texts and items match nothing, equal items are all reported, an empty table
    on either side gives no rows. Rows without doc_id are reported under null. More columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    parts = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["b"] // BLOCK_ITEM_BYTES))
    texts = work_columns(docs).where("text is not null")
    out = None
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        shared = docs.sparkSession.sparkContext.broadcast(item_index(sorted((r["item_id"] or 0, r["text"]) for r in rows), shingle))
        found = texts.mapInArrow(lambda it, shared=shared: _matched(it, shared.value, threshold), "doc_id long, item_id long, similarity double")
        out = found if out is None else out.unionByName(found)
    return out


def decontamination_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: contaminated, the items found (ascending) and the best similarity (null: none)."""
    found = leaks(docs, benchmark).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("best_similarity"))
    ids = work_columns(docs).select("doc_id")
    return ids.join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), "best_similarity")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without a leaked item, with all their columns; each row is judged by its own text."""
    return filtered(docs, lambda texts: leaks(texts, benchmark).select("doc_id").distinct())
