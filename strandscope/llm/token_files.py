"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code.

A file holds blocks of whole documents in ascending doc_id order. In a block the ids are replaced by
their frequency rank (0 is the most frequent, equal counts by id) and stored in one to four bytes;
the lengths stand apart, four to a control byte, two bits each. Reading looks the control bytes up
in a table of 256 rows, adds the lengths up to find every value, and maps ranks back to ids.

The files are Parquet, so any store that Spark writes will do:

    part int, block int           place of the block in the order
    n_ids long                    how many ids it holds
    doc_ids binary                64-bit little-endian, documents in order (absent ids as in `null_ids`)
    null_ids binary               one byte per document
    counts binary                 32-bit little-endian, ids per document
    ranked binary                 32-bit little-endian, the id of every rank
    control, data binary          the coded ranks
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import shared_folder, work_columns
from .text import Ranges, blocks, mixed

BLOCK_IDS = 500_000
KEPT_WORDS = 600_000
WORDS_A_CALL = 100
#: Texts of other characters go to the library whole; these are in composed form and go to lower case one by one.
ODD = re.compile(r"[^\t\n\r\x20-\x7e¡-įı-ſ]")


# Character classes of this vocabulary's words, and the endings it cuts off.
GAP, LETTER, NUMBER, SIGN = range(4)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every character that ODD lets through (and of the separator 0)."""
    return np.array([GAP if not c or chr(c).isspace() else LETTER if regex.match(r"\p{L}", chr(c)) else NUMBER if regex.match(r"\p{N}", chr(c)) else SIGN
                     for c in range(0x180)], np.uint8)


def word_spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words of a row of characters: runs of letters or of signs, single numbers;
    a lone apostrophe takes an ending of ENDINGS that follows it."""
    kind = character_classes()[points]
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    lone = np.flatnonzero(points == ord("'"))
    lone = lone[new[lone] & (lone + 1 < len(points))]
    lone = lone[kind[lone + 1] == LETTER]
    for ending in ENDINGS:
        at = lone[lone + len(ending) < len(points)]
        for k, c in enumerate(ending):
            at = at[points[at + 1 + k] == ord(c)]
        new[at + 1] = False
        after = at + 1 + len(ending)
        after = after[after < len(points)]
        new[after] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(points))
    held = kind[start] != GAP
    return start[held], end[held]


SCHEMA = "part int, block int, n_ids long, doc_ids binary, null_ids binary, counts binary, ranked binary, control binary, data binary"


@lru_cache(maxsize=1)
def length_table() -> np.ndarray:
    """Row c: the four lengths that control byte c stands for."""
    codes = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
    return (codes + 1).astype(np.int64)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of 32-bit values."""
    values = values.astype("<u4")
    lengths = 1 + (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[:len(values)] = lengths - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    kept = np.arange(4) < lengths[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = length_table()[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(lengths) - lengths
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out = np.zeros(n, np.uint32)
    for k in range(4):
        out |= np.where(lengths > k, padded[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id of every rank, rank of every position)."""
    different, where, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((different, -counts))
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return different[order].astype("<u4"), rank[where]


class Tokenizer:
    """The library's encode(text, add_special_tokens=False), asked once for each different word of a block.

    Words of the last two generations, KEPT_WORDS each, are remembered; a word's ids never depend on that.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [i for i, t in enumerate(texts) if ODD.search(t) is None and "<|" not in t]
        out = [b""] * len(texts)
        for i in set(range(len(texts))).difference(plain):
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        if plain:
            for i, ids in zip(plain, self._plain([texts[i].lower() for i in plain]), strict=True):
                out[i] = ids
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        row = "\0".join(texts) + "\0"
        points = np.frombuffer(row.encode("utf-16-le"), np.uint16)
        start, end = word_spans(points)
        names, where, which = np.unique(Ranges(points, 1, point_codes()).hash(start, end), return_index=True, return_inverse=True)
        coded = self._ids([row[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)])
        sizes = np.array([len(c) for c in coded], np.int64) // 4
        flat = np.frombuffer(b"".join(coded), "<u4")
        taken = sizes[which]
        ends = np.cumsum(taken)
        origin = (np.cumsum(sizes) - sizes)[which] if len(sizes) else sizes
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(origin - (ends - taken), taken)].tobytes()
        edges = np.cumsum([len(t) + 1 for t in texts])
        at = [0, *(4 * np.concatenate([[0], ends])[np.searchsorted(start, edges)]).tolist()]
        return [ids[at[i]:at[i + 1]] for i in range(len(texts))]

    def _ids(self, words: list[str]) -> list[bytes]:
        if len(self.known) > KEPT_WORDS:
            self.known, self.older = {}, self.known
        fresh = []
        for word in words:
            if word not in self.known:
                ids = self.older.pop(word, None)
                if ids is None:
                    fresh.append(word)
                else:
                    self.known[word] = ids
        for at in range(0, len(fresh), WORDS_A_CALL):
            part = fresh[at:at + WORDS_A_CALL]
            self.known.update(zip(part, self._asked(part), strict=True))
        return [self.known[w] for w in words]

    def _asked(self, words: list[str]) -> list[bytes]:
        """Words are cut the same way with spaces between them."""
        found = self.library.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        ends = np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))) * 4
        at = [0, *ends.tolist()]
        return [ids[at[i]:at[i + 1]] for i in range(len(words))]


@lru_cache(maxsize=1)
def point_codes() -> np.ndarray:
    return mixed(np.arange(1, 0x181, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=1)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _packed(part: int, block: int, ids: list, coded: list[bytes]) -> pa.RecordBatch:
    values = np.frombuffer(b"".join(coded), "<u4")
    names, ranks = ranked(values)
    control, data = pack(ranks)
    columns = {
        "doc_ids": np.array([0 if i is None else i for i in ids], "<i8").tobytes(), "null_ids": bytes(i is None for i in ids),
        "counts": np.array([len(c) // 4 for c in coded], "<u4").tobytes(), "ranked": names.tobytes(), "control": control, "data": data}
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "n_ids": pa.array([len(values)], pa.int64())}
                                      | {k: pa.array([v], pa.binary()) for k, v in columns.items()})


def coded_blocks(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, words = TaskContext.get().partitionId(), 0, tokenizer(path)
        end = np.array([end_id], "<u4").tobytes()
        ids, coded, held = [], [], 0
        for texts, rows in blocks(batches):
            for i, c in zip(rows.column("doc_id").to_pylist(), words.encode([texts.text(k) for k in range(len(texts))]), strict=True):
                ids.append(i)
                coded.append(c + end)
                held += len(c) // 4 + 1
                if held >= BLOCK_IDS:
                    yield _packed(part, block, ids, coded)
                    ids, coded, held, block = [], [], 0, block + 1
        if ids:
            yield _packed(part, block, ids, coded)

    return work_columns(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA)


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 2) -> None:
    """Writes the ids of every document plus `end_id`, in ascending doc_id order (null first, ties by text).

    A null or empty text has just the end id. No rows give a folder without blocks; more columns are ignored.
    """
    coded_blocks(docs, path, end_id).write.option("compression", "zstd").parquet(folder)


def read_token_files(spark, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids binary]) of every document in the files."""
    files = spark.read.parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
                ranks = unpack(row["control"], row["data"], int(counts.sum()))
                ids = np.frombuffer(row["ranked"], "<u4")[ranks].astype("<u4").tobytes()
                ends = np.cumsum(counts)
                spans = [ids[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                absent = np.frombuffer(row["null_ids"], np.uint8).astype(bool)
                columns = {
                    "part": pa.array(np.full(len(counts), row["part"]), pa.int32()), "block": pa.array(np.full(len(counts), row["block"]), pa.int32()),
                    "doc_id": pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=absent), "before": pa.array(ends - counts, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array([zlib.crc32(s) for s in spans], pa.int64())}
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(spans, pa.binary())} if with_ids else {}))

    rows = files.mapInArrow(run, "part int, block int, doc_id long, before long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
    totals = files.select("part", "block", "n_ids")  # one short row per block
    parts = totals.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    bases = parts.select("part", (F.sum("n_part").over(Window.orderBy("part")) - F.col("n_part")).alias("part_base"))
    within = totals.select("part", "block", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")).alias("block_base"))
    starts = within.join(bases, "part")
    return rows.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("part_base") + F.col("block_base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_files_query(docs: DataFrame, path: str) -> DataFrame:
    folder = shared_folder(docs.sparkSession, "token-files")
    write_token_files(docs, folder, path)
    return read_token_files(docs.sparkSession, folder)
