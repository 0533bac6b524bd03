"""Packing documents into sequences of a fixed number of tokens by sums of squares.

Documents are taken from the longest to the shortest. One that fits an open sequence goes where the
squared counts of open sequences per gap add up to the least afterwards; a new sequence is opened only
where none fits. The rule sees nothing of a document but its length, so the placing is worked out on the
histogram of lengths (one row per length) and is a short list of runs: so many documents of one length, from
this rank on, go into as many sequences that follow each other, at this offset. Ranks are given out
without gathering anything: in the task that encodes, plus the counts of the tasks before it.

The placing takes the documents one by one, whatever their number, but only counts them: so many of a length
went to sequences that held so much. The sequences themselves follow when a length is done, in stretches of numbers, so
the list grows with the lengths and levels that occur, not with the documents.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .tables import pinned, work_columns
from .text import SPACE, Block, blocks

CAPACITY = 1024
#: A longer stretch of spaces or of other bytes goes to the tokenizers library with its whole text.
STRETCH = 400


class Encoder:
    """The ids that the tokenizers library gives, from tiktoken where both cut words alike.

    Both hold the same vocabulary: the library's file lists its merges in the order of the ids they make.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        import tokenizers

        vocab = bpe.vocabulary(path)
        made = [m[2] for m in vocab.merged]
        if any(a >= b for a, b in zip(made, made[1:], strict=False)):
            raise ValueError("the ids of this vocabulary do not follow its merges")
        special = set(vocab.special.values())
        ranks = {b: i for i, b in enumerate(vocab.bytes) if i not in special}
        self.fast = tiktoken.Encoding("file", pat_str=bpe.PATTERN.pattern, mergeable_ranks=ranks, special_tokens={})
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def encode(self, block: Block) -> Iterator[np.ndarray]:
        slow = _stretched(block)
        for i in range(len(block)):
            text = block.text(i)
            if i in slow or "<|" in text or bpe.PLAIN.search(text) is not None:
                yield np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
            else:
                yield self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def _stretched(block: Block) -> set[int]:
    """Documents with a stretch of more than STRETCH bytes that are all spaces or all none."""
    turns = np.flatnonzero(np.diff(SPACE[block.data])) + 1
    edges = np.concatenate([[0], turns, [len(block.data)]])
    long = np.flatnonzero(np.diff(edges) > STRETCH)
    out = set()
    for a, b in zip(edges[long].tolist(), edges[long + 1].tolist(), strict=True):
        low, high = np.searchsorted(block.at, [a, b - 1], "right").tolist()
        out.update(range(low - 1, high))
    return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n_ids: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the pieces of a document: all are full but the first one."""
    first = n_ids - (n_ids - 1) // capacity * capacity
    start = np.concatenate([[0], np.arange(first, n_ids, capacity)])
    return start, np.diff(np.append(start, n_ids))


def plan(counts: np.ndarray, steps: int | None = None) -> np.ndarray:
    """Runs (length, first rank, documents, first sequence, offset), a column each, by length and rank.

    `counts[n]` documents have n tokens; the last entry is the capacity, whose documents fill a sequence
    each. Ties between gaps go to the fullest sequences. A caller who wants a coarser plan may name a number of `steps`:
    then the documents of a step, of one length, are placed alike.
    """
    capacity = len(counts) - 1
    unit = 1 if steps is None else max(1, -(-int(counts[:capacity].sum()) // steps))
    never = np.iinfo(np.int64).max
    opened = [0] * (capacity + 1)  # by tokens held; full sequences are not counted
    bundles: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    runs, fresh = [], int(counts[capacity])
    if fresh:
        runs.append((capacity, 0, fresh, 0, 0))
    for size in np.flatnonzero(counts[:capacity])[::-1].tolist():
        if not size:
            continue
        top, left, placed = capacity - size, int(counts[size]), {}

        def squares(level, size=size, top=top):
            return 2 * (opened[level + size] - opened[level]) + (1 if level == top else 2) if opened[level] else never

        change = np.array([squares(level) for level in range(top, 0, -1)], np.int64)  # from the fullest on
        while left:
            best = int(change.argmin())
            held = top - best if change[best] != never else 0
            taken = min(unit, left, opened[held]) if held else min(unit, left)
            left -= taken
            placed[held] = placed.get(held, 0) + taken
            if held:
                opened[held] -= taken
            if held < top:
                opened[held + size] += taken
            for level in (held - size, held, held + size):
                if 0 < level <= top:
                    change[top - level] = squares(level)
        rank = 0
        for held in sorted(placed):  # a sequence may rise from level to level within a length
            wanted, source = placed[held], bundles[held]
            if not held:
                source.append((fresh, wanted))
                fresh += wanted
            while wanted:
                first, there = source.pop()
                taken = min(wanted, there)
                if there > taken:
                    source.append((first + taken, there - taken))
                runs.append((size, rank, taken, first, held))
                wanted, rank = wanted - taken, rank + taken
                if held < top:
                    bundles[held + size].append((first, taken))
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Every piece with the task (`part`) that made it and its rank there among pieces of its length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, used, words = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(path)
        end = np.array([end_id], "<u4")
        for block, rows in blocks(batches):
            which, number, starts, lengths, data = [], [], [], [], []
            for i, ids in enumerate(words.encode(block)):
                ids = np.concatenate([ids, end])
                start, length = cut(len(ids), capacity)
                which.append(np.full(len(start), i))
                number.append(np.arange(len(start)))
                starts.append(start)
                lengths.append(length)
                raw = ids.tobytes()
                data += [raw[4 * a:4 * (a + n)] for a, n in zip(start.tolist(), length.tolist(), strict=True)]
            length = np.concatenate(lengths)
            order = np.argsort(length, kind="stable")
            ranks = np.empty(len(length), np.int64)
            grouped = length[order]
            ranks[order] = np.arange(len(order)) - np.searchsorted(grouped, grouped) + used[grouped]
            used += np.bincount(length, minlength=capacity + 1)
            columns = {"doc_id": rows.column("doc_id").take(pa.array(np.concatenate(which))), "piece": pa.array(np.concatenate(number), pa.int32()),
                       "start": pa.array(np.concatenate(starts), pa.int64()), "length": pa.array(length, pa.int64()),
                       "ids_crc32": pa.array([zlib.crc32(d) for d in data], pa.int64()), "part": pa.array(np.full(len(length), part), pa.int32()),
                       "place": pa.array(ranks, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(data, pa.binary())} if with_ids else {}))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
    return work_columns(docs).mapInArrow(run, schema + (", ids binary" if with_ids else ""))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids binary]), one row per piece.

    A null or empty text is the end id alone. A document longer than a sequence is cut from its end into
    full pieces; its first piece takes what is left over. Rows are treated one by one, so repeated rows are packed
    repeatedly; documents of equal length are interchangeable to the rule. No rows give no rows; more
    columns are ignored. What reaches the driver is one count per length, what is sent to every task the
    runs of `plan`.
    """
    rows = pinned(pieces(docs, path, capacity, end_id, with_ids))
    counted = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    runs = docs.sparkSession.sparkContext.broadcast(plan(counts))
    ranked = rows.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("place")).drop("part", "place", "base")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, _, sequence, offset = runs.value.T
        keys = size << 48 | first
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() << 48 | rank, "right") - 1
            columns = {c: batch.column(c) for c in out if c in batch.schema.names}
            columns |= {"sequence_id": pa.array(sequence[at] + rank - first[at], pa.int64()), "offset": pa.array(offset[at], pa.int64())}
            yield pa.RecordBatch.from_pydict({c: columns[c] for c in out})

    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    kinds = {"piece": "int", "ids": "binary"}
    return ranked.mapInArrow(place, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in out))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids binary, doc_ids, offsets) of pieces packed with their ids: the training rows."""
    one = F.struct("offset", "doc_id", "length", "ids")
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("held"))
    joined = F.aggregate("held", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return held.select("sequence_id", F.aggregate("held", F.lit(0).cast("long"), lambda acc, p: acc + p["length"]).alias("n_tokens"),
                       joined.alias("ids"), F.col("held.doc_id").alias("doc_ids"), F.col("held.offset").alias("offsets"))
