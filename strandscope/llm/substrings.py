"""Repeated byte strings by a radix sort of suffixes that goes no deeper than the threshold.

Suffixes are ordered only through `length` bytes, most significant digits first, and one that shares its
digits with no other drops out at once; groups that are left after the last digit are exactly the
repeated strings. Three passes:

1. Digit one is the GRAM-byte string with the smallest hash inside the `length` bytes (the rightmost of
   equals). It depends on those bytes alone, so equal strings agree on it and on its place, and
   neighbouring starts share it: about three rows per hundred bytes are dealt by it, not one per byte.
   Starts that share a gram form a stretch.
2. Digit two is the whole stretch. Within a gram, all of a stretch that occurs earlier is repeated; of
   equal stretches the first stays, and it is alone in its gram unless a different stretch shares it.
3. Stretches that differ but share a gram send their bytes: at most 2 * length - GRAM. Their starts are
   sorted digit by digit, eight bytes each, in numpy; equal groups end the sort.

A gram that very many different stretches share (a common line beside changing text) is spread: its starts go
to pass three one by one under the hash of their own `length` bytes. Every task first settles what repeats
within itself, so a key never brings more rows than FEW per task. Passes one and two compare 128 bits of
independent hashes instead of bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import pinned, work_columns
from .text import Block, Ranges, blocks, mixed

GRAM = 32
FEW = 64
MANY = 1000
PLACE_BITS = 24
PIECE = 8_000_000
#: Kinds of rows between the passes.
STRETCH, REPEATED, SPREAD, MARK = range(4)
LAST_ID = (1 << 63) - 1


def _ids(column) -> np.ndarray:
    """A null doc_id comes after all others."""
    return np.asarray(column.fill_null(LAST_ID)).astype(np.int64)


class Stretches:
    """Starts of `length`-byte strings of a block by their gram: gram place, first and last start."""

    def __init__(self, block: Block, length: int):
        self.block = block
        gram = min(GRAM, length)
        one, two = Ranges(block.data, 1), Ranges(block.data, 2)
        self.one, self.two = one, two
        size = np.diff(block.at)
        runs = np.maximum(size - length + 1, 0)
        first, last, place = [], [], []
        for low in range(0, max(0, len(block.data) - length + 1), PIECE):
            high = min(low + PIECE, len(block.data) - length + 1)
            at = np.arange(low, high + length - gram)
            key = one.hash(at, at + gram) >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)
            key |= np.uint64((1 << PLACE_BITS) - 1) - (at - low).astype(np.uint64)
            best = _window_min(key, length - gram + 1)
            spot = low + ((1 << PLACE_BITS) - 1 - (best & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64))
            inside = np.zeros(high - low, bool)
            for a, n in zip(block.at[:-1].tolist(), runs.tolist(), strict=True):
                if n and a < high and a + n > low:
                    inside[max(a, low) - low:min(a + n, high) - low] = True
            start = np.flatnonzero(inside)
            if not len(start):
                continue
            spot = spot[start]
            new = np.ones(len(start), bool)
            new[1:] = (spot[1:] != spot[:-1]) | (start[1:] != start[:-1] + 1)
            begin = np.flatnonzero(new)
            first.append(low + start[begin])
            last.append(low + start[np.append(begin[1:], len(start)) - 1])
            place.append(spot[begin])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.first, self.last, self.place = join(first), join(last), join(place)
        self.doc = np.searchsorted(block.at, self.first, "right") - 1
        self.gram = one.hash(self.place, self.place + gram)
        whole = two.hash(self.first, self.last + length) + (self.place - self.first).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        self.whole = mixed(whole)


def _window_min(key: np.ndarray, size: int) -> np.ndarray:
    width, out = 1, key
    while 2 * width <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if width < size:
        out = np.minimum(out[:len(out) - (size - width)], out[size - width:])
    return out


def _first_of(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True where no row with equal keys has a smaller (doc, start)."""
    order = np.lexsort((start, doc, *keys[::-1]))
    new = np.ones(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] = new[1:] & (k[1:] == k[:-1])
    new[1:] = ~new[1:]
    if len(order):
        new[0] = True
    # rows that repeat a document are that document
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    out = np.empty(len(order), bool)
    out[order] = (doc[order] == doc[head]) & (start[order] == start[head])
    return out


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of a document become one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    far = np.empty_like(end)
    group = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    span = int(end.max()) + 1
    far = np.maximum.accumulate(end + group * span) - group * span
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > far[:-1])
    begin = np.flatnonzero(new)
    return doc[begin], start[begin], far[np.append(begin[1:], len(doc)) - 1]


def _first_pass(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(gram, whole, doc_id, start, n, place, kind): `n` starts from `start` on; for REPEATED a byte range of `n`."""
    for batch in batches:
        parts = []
        for block, rows in blocks([batch]):
            s = Stretches(block, length)
            parts.append((s.gram, s.whole, _ids(rows.column("doc_id"))[s.doc], s.first - block.at[s.doc], s.last - s.first + 1, s.place - s.first))
        if not parts:
            continue
        gram, whole, doc, start, n, place = (np.concatenate(p) for p in zip(*parts, strict=True))
        first = _first_of([gram, whole], doc, start)
        again = ~first
        r_doc, r_start, r_end = _merged(doc[again], start[again], start[again] + n[again] + length - 1)
        yield _rows(mixed(r_doc.astype(np.uint64) * np.uint64(31) + r_start.astype(np.uint64)), np.zeros(len(r_doc), np.uint64), r_doc, r_start, r_end - r_start, 0 * r_doc, REPEATED)
        gram, whole, doc, start, n, place = (x[first] for x in (gram, whole, doc, start, n, place))
        names, where, count = np.unique(gram, return_inverse=True, return_counts=True)
        hot = (count > FEW)[where]
        yield _rows(gram[~hot], whole[~hot], doc[~hot], start[~hot], n[~hot], place[~hot], STRETCH)
        yield _rows(mixed(gram[hot] ^ whole[hot]), whole[hot], doc[hot], start[hot], n[hot], place[hot], SPREAD)
        marks = names[count > FEW]
        zero = np.zeros(len(marks), np.int64)
        yield _rows(marks, marks, zero, zero, zero, zero, MARK)


FIRST = "gram long, whole long, doc_id long, start int, n int, place short, kind short"


def _rows(gram, whole, doc, start, n, place, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "gram": pa.array(gram.view(np.int64)), "whole": pa.array(whole.view(np.int64)), "doc_id": pa.array(doc), "start": pa.array(start.astype(np.int32)),
        "n": pa.array(n.astype(np.int32)), "place": pa.array(place.astype(np.int16)), "kind": pa.array(np.full(len(gram), kind, np.int16))})


def _shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for block, rows in blocks(batches):
        blobs = [pack.compress(block.data[a:b].tobytes()) for a, b in zip(block.at[:-1], block.at[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(_ids(rows.column("doc_id"))), "blob": pa.array(blobs, pa.binary())})


THIRD = "key long, other long, doc_id long, start int, n int, bytes binary"


def _sent(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """For pass three: the bytes of stretches, or every start of a spread one under its own hashes."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        key, other, doc, start, n, raw = [], [], [], [], [], []
        spread: list[tuple] = []
        for row in batch.to_pylist():
            text = unpack.decompress(row["blob"])
            ranges = None
            for s in row["stretches"]:
                if s["spread"]:
                    ranges = ranges or tuple(Ranges(np.frombuffer(text, np.uint8), seed) for seed in (1, 2))
                    at = np.arange(s["start"], s["start"] + s["n"])
                    spread.append((ranges[0].hash(at, at + length), ranges[1].hash(at, at + length), np.full(len(at), row["doc_id"]), at))
                else:
                    key.append(s["gram"])
                    other.append(0)
                    doc.append(row["doc_id"])
                    start.append(s["start"])
                    n.append(s["n"])
                    raw.append(text[s["start"]:s["start"] + s["n"] + length - 1])
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(other, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int32()),
                                          pa.array(n, pa.int32()), pa.array(raw, pa.binary())], names=[c.split()[0] for c in THIRD.split(", ")])
        if spread:
            one, two, owner, at = (np.concatenate(p) for p in zip(*spread, strict=True))
            first = _first_of([one, two], owner, at)
            # what repeats within the task is known: it is told as a pair that no other row joins
            twin = first.copy()
            for flag, part in ((True, twin), (False, ~twin)):
                m = int(part.sum())
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array((one[part] if flag else mixed(owner[part].astype(np.uint64) + at[part].astype(np.uint64) * np.uint64(77))).view(np.int64)),
                    "other": pa.array(two[part].view(np.int64)), "doc_id": pa.array(owner[part]), "start": pa.array(at[part].astype(np.int32)),
                    "n": pa.array(np.full(m, 1 if flag else -1, np.int32)), "bytes": pa.nulls(m, pa.binary())})


def repeated_starts(windows: np.ndarray, group: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True for rows of `windows` (one byte string each) that equal a row of their group with a smaller
    (doc, start): most significant digits first, eight bytes a digit; a row alone in its group drops out."""
    width = -(-windows.shape[1] // 8) * 8
    padded = np.zeros((len(windows), width), np.uint8)
    padded[:, :windows.shape[1]] = windows
    digits = padded.view(">u8")
    rows, group = np.arange(len(windows)), group.astype(np.int64)
    for d in range(digits.shape[1]):
        digit = digits[rows, d].astype(np.uint64)
        order = np.lexsort((digit, group))
        rows, group, digit = rows[order], group[order], digit[order]
        new = np.ones(len(rows), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        shared = size[group] > 1
        rows, group = rows[shared], group[shared]
        if not len(rows):
            break
    out = np.zeros(len(windows), bool)
    if len(rows):
        out[rows] = ~_first_of([group], doc[rows], start[rows])
    return out


def _third_pass(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, n): byte ranges that repeat; the input is sorted by key and other."""
    held: list[pa.RecordBatch] = []

    def settle(table: pa.Table) -> pa.RecordBatch:
        key, other = np.asarray(table["key"]), np.asarray(table["other"])
        doc, start, n = np.asarray(table["doc_id"]), np.asarray(table["start"]).astype(np.int64), np.asarray(table["n"]).astype(np.int64)
        sent = np.asarray(table["bytes"].is_valid())
        told = n < 0
        alone = ~sent & ~told
        again = told.copy()
        again[alone] = ~_first_of([key[alone], other[alone]], doc[alone], start[alone])
        out = [(doc[again], start[again], start[again] + length)]
        where = np.flatnonzero(sent)
        low = 0
        while low < len(where):  # whole grams, a few thousand starts at a time
            high, many = low, 0
            while high < len(where) and (many < 60_000 or key[where[high]] == key[where[high - 1]]):
                many += int(n[where[high]])
                high += 1
            part = where[low:high]
            raw = [np.frombuffer(table["bytes"][int(i)].as_py(), np.uint8) for i in part]
            views = np.concatenate([np.lib.stride_tricks.sliding_window_view(r, length) for r in raw])
            owner = np.repeat(np.arange(len(part)), n[part])
            at = start[part][owner] + np.concatenate([np.arange(k) for k in n[part]])
            hit = repeated_starts(views, np.unique(key[part], return_inverse=True)[1][owner], doc[part][owner], at)
            out.append((doc[part][owner][hit], at[hit], at[hit] + length))
            low = high
        doc, start, end = _merged(*(np.concatenate(p) for p in zip(*out, strict=True)))
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc), "start": pa.array(start.astype(np.int32)), "n": pa.array((end - start).astype(np.int32))})

    for batch in batches:
        # the last key of a batch may go on in the next
        last = batch.column("key")[batch.num_rows - 1] if batch.num_rows else None
        if last is None:
            continue
        key = np.asarray(batch.column("key"))
        cut = int(np.searchsorted(key, last.as_py(), "left"))
        if cut:
            yield settle(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield settle(pa.Table.from_batches(held))


def _cut_out(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []} | ({"kept": []} if with_text else {})
        for row in batch.to_pylist():
            text = unpack.decompress(row["blob"])
            spans = row["spans"] or []
            doc, start, end = _merged(np.zeros(len(spans), np.int64), np.array([s["start"] for s in spans], np.int64), np.array([s["start"] + s["n"] for s in spans], np.int64))
            at = [0, *np.stack([start, end], 1).reshape(-1).tolist(), len(text)]
            left = b"".join(text[at[i]:at[i + 1]] for i in range(0, len(at), 2))
            for name, value in (("doc_id", None if row["doc_id"] == LAST_ID else row["doc_id"]), ("n_bytes", len(text)), ("n_removed", len(text) - len(left)),
                                ("n_spans", len(start)), ("kept_sha256", hashlib.sha256(left).hexdigest())):
                rows[name].append(value)
            if with_text:
                rows["kept"].append(left)
        kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()})


def repeated_ranges(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, start, n) byte ranges covered by strings that also start earlier, (doc_id, blob) texts)."""
    texts = work_columns(docs)
    packed = texts.mapInArrow(_shrunk, "doc_id long, blob binary")
    # dealt by gram, which serves both windows
    rows = texts.where("text is not null").mapInArrow(lambda it: _first_pass(it, length), FIRST).repartition("gram")
    in_gram = Window.partitionBy("gram")
    in_stretch = Window.partitionBy("gram", "whole").orderBy("doc_id", "start")
    ordered = rows.withColumn("head", F.first(F.struct("doc_id", "start")).over(in_stretch)).withColumn("turn", F.row_number().over(in_stretch))
    judged = ordered.select(
        "*", (F.min("whole").over(in_gram) != F.max("whole").over(in_gram)).alias("shared"),
        F.sum((F.col("turn") == 1).cast("int")).over(in_gram).alias("stretches"), F.max((F.col("kind") == MARK).cast("int")).over(in_gram).alias("marked"))
    again = (F.col("kind") == REPEATED) | (F.col("kind").isin(STRETCH, SPREAD) & (F.struct("doc_id", "start") != F.col("head")))
    open_ = ((F.col("kind") == SPREAD) | ((F.col("kind") == STRETCH) & F.col("shared"))) & (F.col("turn") == 1) & ~again
    settled = pinned(judged.where(again | open_).select(
        "gram", "doc_id", "start", "n", again.alias("again"),
        ((F.col("kind") == SPREAD) | (F.col("marked") == 1) | (F.col("stretches") > MANY)).alias("spread"), "kind"))
    found = settled.where("again").select("doc_id", "start", F.when(F.col("kind") == REPEATED, F.col("n")).otherwise(F.col("n") + length - 1).alias("n"))
    waiting = settled.where("not again").groupBy("doc_id").agg(F.collect_list(F.struct("gram", "start", "n", "spread")).alias("stretches"))
    sent = packed.join(waiting, "doc_id").select("doc_id", "blob", "stretches").mapInArrow(lambda it: _sent(it, length), THIRD)
    later = sent.repartition("key").sortWithinPartitions("key", "other").mapInArrow(lambda it: _third_pass(it, length), "doc_id long, start int, n int")
    return found.unionByName(later), packed


def remove_repeats(docs: DataFrame, length: int = 100, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]), one row per input row.

    Removes every byte covered by a string of `length` bytes that also starts earlier (smaller doc_id, or
    same document and earlier start); overlaps count and strings are judged on the input. A null text
    has no bytes; a null doc_id comes after all others. Rows that repeat both doc_id and text are one
    document; different texts under one doc_id share their ranges, so ids should be unique. No rows give
    no rows; more columns are ignored.
    """
    found, packed = repeated_ranges(docs, length)
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return packed.join(spans, "doc_id", "left").select("doc_id", "blob", "spans").mapInArrow(lambda it: _cut_out(it, with_text), result)


#: Every window and every byte as a row, for the 100-byte query.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(n - 99)) AS s, unnest(list_transform(range(n - 99), lambda s: substr(h, 2 * s + 1, 200))) AS t FROM d WHERE n >= 100),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
b AS (SELECT doc_id, unnest(range(n)) AS p, unnest(list_transform(range(n), lambda p: substr(h, 2 * p + 1, 2))) AS x FROM d),
m AS (SELECT b.*, coalesce(max(r.s) OVER (PARTITION BY b.doc_id ORDER BY p) > p - 100, false) AS gone FROM b LEFT JOIN r ON r.doc_id = b.doc_id AND r.s = p),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM m),
g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
             string_agg(x, '' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
