"""Language-model scoring by context-tree weighting over bytes.

Each byte is coded as eight binary decisions, each with a context tree of its own over the last DEPTH
bytes. A node of a tree has the Krichevsky-Trofimov estimate of its decisions; weighting mixes, at every
node, this estimate with the product of its children's, so that all depths up to DEPTH take part. The
trees are filled from all training texts: the counts of all (DEPTH + 1)-byte strings are summed by Spark. A text
is coded with an end symbol (byte 255, never part of UTF-8), which also fills the context before its start.

No part of the tree is left out. Texts are cut into blocks; the different strings of a block go to the
bucket of their nearest NEAREST + 1 bytes of context, so each bucket holds whole subtrees, weights them by
itself and sends the sums of their roots up. The nodes of at most NEAREST bytes, at most 2 ** 24 by the
size of their names whatever the corpus (in UTF-8 far fewer), are weighted on the driver and sent to all
tasks. Each bucket then values its strings, of training and of other texts, and answers every block.

The word base (add one over words and one end per text) takes the counts of the most frequent words, at
most MAX_WORDS, from a broadcast table and those of all other words by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import pinned, written
from .text import Block, Words, blocks, mixed

DEPTH = 5
END, OTHER = 0xFF, 0xC0
MAX_GRAMS = 500_000
MAX_WORDS = 1 << 18
NEAREST = 2
SCORE_BYTES = 2_500_000
BUCKETS, BUCKET_BYTES = 64, 8_000_000
WALK = 100_000
FRACTION = 2.0 ** 32
END_WORD = np.array([0x0E4D], np.uint64)


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def gram_codes(block: Block, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the `depth` before it as one number, the byte lowest; where each document's begin."""
    n, size = len(block), np.diff(block.at)
    padded = np.full(len(block.data) + n * (depth + 1), END, np.uint8)
    padded[np.arange(len(block.data)) + np.repeat(np.arange(n) * (depth + 1) + depth, size)] = block.data
    starts = block.at + np.arange(n + 1)
    at = np.arange(starts[-1]) + np.repeat(np.arange(n) * depth, size + 1)
    code = np.zeros(len(at), np.uint64)
    for _ in range(depth + 1):
        code <<= np.uint64(8)
        code |= padded[at]
        at += 1
    return code, starts


def _as_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of whole documents, compressed, so that a JVM never holds many texts at once."""
    for block, rows in blocks(batches, size=SCORE_BYTES):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(rows)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([sink.getvalue().to_pybytes()], pa.binary()), "size": pa.array([len(block.data) + len(block)], pa.int64())})


def _block_at(batch: pa.RecordBatch, i: int) -> tuple[Block, pa.RecordBatch]:
    return next(blocks([pa.ipc.open_stream(batch.column("rows")[i].as_buffer()).read_next_batch()], size=1 << 62))


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers, byte plane by byte plane."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _from_planes(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").reshape(-1)


def _packed(values: np.ndarray) -> bytes:
    """Ascending numbers as their differences."""
    return _planes(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(raw), dtype=np.uint64)


def _fixed(log10: np.ndarray) -> bytes:
    """Logarithms of probabilities, rounded to multiples of 1 / FRACTION: a text of n bytes is off by n / (2 * FRACTION) at most."""
    return _planes(np.rint(np.maximum(-log10, 0) * FRACTION).astype(np.uint64))


def _from_fixed(raw: bytes) -> np.ndarray:
    return _from_planes(raw).astype(np.float64) / -FRACTION


def _buckets(codes: np.ndarray, depth: int, parts: int) -> np.ndarray:
    near = (codes >> np.uint64(8)) & np.uint64((1 << (8 * (_nearest(depth) + 1))) - 1)
    return (mixed(near + np.uint64(1)) % np.uint64(parts)).astype(np.int64)


def _nearest(depth: int) -> int:
    return min(NEAREST, depth - 1)


def _in_buckets(codes: np.ndarray, depth: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by (bucket, string) of sorted strings, and where each bucket begins."""
    bucket = _buckets(codes, depth, parts)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(parts + 1))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n_train, n_all) of the words of every block, one end per text."""
    for batch in batches:
        for i in range(batch.num_rows):
            block, rows = _block_at(batch, i)
            train = np.asarray(rows.column("train"))
            words = Words(block)
            owned = np.repeat(train, np.diff(words.first))
            names, where = np.unique(np.concatenate([words.hash, np.repeat(END_WORD, len(block))]), return_inverse=True)
            n_train = np.bincount(where, np.concatenate([owned, train]), len(names)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(names.view(np.int64)), "n_train": pa.array(n_train), "n_all": pa.array(np.bincount(where, minlength=len(names)))})


def _asked(batches: Iterator[pa.RecordBatch], depth: int, parts: int) -> Iterator[pa.RecordBatch]:
    """(bucket, block, names, counts): the different strings of every block and how often training texts have them."""
    for batch in batches:
        for i, name in enumerate(batch.column("block").to_pylist()):
            block, rows = _block_at(batch, i)
            codes, starts = gram_codes(block, depth)
            codes <<= np.uint64(1)
            codes |= np.repeat(np.asarray(rows.column("train")), np.diff(starts))
            codes.sort()
            first = np.flatnonzero(np.diff(codes >> np.uint64(1), prepend=~np.uint64(0)))
            names, n = codes[first] >> np.uint64(1), np.add.reduceat(codes & np.uint64(1), first)
            order, cut = _in_buckets(names, depth, parts)
            names, n = names[order], n[order]
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(full), "block": pa.array(np.full(len(full), name, np.int64)),
                "names": pa.array([_packed(names[cut[b]:cut[b + 1]]) for b in full], pa.binary()),
                "counts": pa.array([_planes(n[cut[b]:cut[b + 1]]) for b in full], pa.binary())})


def _met(rows: pa.Table, depth: int) -> pa.Table:
    """One row per bucket: its strings with their counts, which block asked for which, and what its subtrees send up."""
    each = [_unpacked(x) for x in rows["names"].to_pylist()]
    names, where = np.unique(np.concatenate(each), return_inverse=True)
    counts = np.bincount(where, np.concatenate([_from_planes(x) for x in rows["counts"].to_pylist()]), len(names))
    _, up = lower_levels(names, counts, depth)
    return pa.table({
        "names": pa.array([_packed(names)], pa.binary()), "counts": pa.array([_planes(counts.astype(np.uint64))], pa.binary()), "places": pa.array([_packed(where)], pa.binary()),
        "blocks": pa.array([rows["block"].to_pylist()], pa.list_(pa.int64())), "sizes": pa.array([[len(x) for x in each]], pa.list_(pa.int64())),
        "bucket": rows["bucket"].combine_chunks()[:1],
        **{k: pa.array([v], pa.list_(t)) for k, v, t in zip(("node", "split", "zeros", "ones"), up, (pa.int64(), *[pa.float64()] * 3), strict=True)}})


def _valued(batches: Iterator[pa.RecordBatch], depth: int, upper: list) -> Iterator[pa.RecordBatch]:
    """(block, bucket, log10): the values of the strings that the block has in the bucket, in their order."""
    for batch in batches:
        for row in batch.to_pylist():
            names = _unpacked(row["names"])
            p, _ = lower_levels(names, _from_planes(row["counts"]).astype(np.float64), depth)
            value = through_upper(names, p, upper)[_unpacked(row["places"]).astype(np.int64)]
            cut = np.concatenate([[0], np.cumsum(row["sizes"])])
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(row["blocks"], pa.int64()), "bucket": pa.array(np.full(len(row["blocks"]), row["bucket"], np.int64)),
                "log10": pa.array([_fixed(value[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: eight steps up, then Stirling's series."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        shift -= np.log(y)
        y += 1
    inverse = 1 / y
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the block probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def node_names(d: int, context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """A node's name: depth, the nearest d bytes of context, and the decision (1 to 255)."""
    near = context & np.uint64((1 << (8 * d)) - 1)
    return (np.uint64(d) << np.uint64(56)) | near << np.uint64(8) | node


def decisions(names: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(decision, whether it is a one) of each of the eight bits of the strings' last bytes."""
    symbol = names & np.uint64(255)
    for bit in range(8):
        yield np.uint64(1 << bit) | symbol >> np.uint64(8 - bit), (symbol >> np.uint64(7 - bit)) & np.uint64(1) == 1


def lower_levels(names: np.ndarray, counts: np.ndarray, depth: int) -> tuple[list[np.ndarray], tuple]:
    """Levels below NEAREST of whole subtrees: each string's mixed probability of every decision, and the parents'
    (name, logarithm of the children's product, zeros, ones). A string with count 0 is valued but not learnt."""
    top, context = _nearest(depth), names >> np.uint64(8)
    out, sent = [], []
    for node, one in decisions(names):
        below = p = None
        for d in range(depth, max(top, 0) - 1, -1):
            keys, where = np.unique(node_names(d, context, node), return_inverse=True)
            n1 = np.bincount(where, counts * one, len(keys))
            n0 = np.bincount(where, counts, len(keys)) - n1
            split = None
            if below is not None:
                parent = np.empty(len(below[1]), np.int64)
                parent[below[0]] = where
                split = np.bincount(parent, below[1], len(keys))
            if d == top:
                seen = n0 + n1 > 0
                sent.append((keys[seen].view(np.int64), split[seen], n0[seen], n1[seen]))
                break
            beta, weighted = _weighed(n0, n1, split)
            p = _mixed_in(p, beta[where], ((n1 + 0.5) / (n0 + n1 + 1))[where], one, (n0 + n1 > 0)[where])
            below = where, weighted
        out.append(p)
    if not sent:
        sent = [(np.zeros(0, np.int64), *[np.zeros(0)] * 3)]
    return out, tuple(np.concatenate(x) for x in zip(*sent, strict=True))


def _weighed(n0: np.ndarray, n1: np.ndarray, split: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Share of the own estimate against the children (infinite at the deepest level), logarithm of the weighted probability."""
    own = log_kt(n0, n1)
    if split is None:
        return np.full(len(own), np.inf), own
    return np.exp(np.clip(own - split, -60, 60)), np.logaddexp(own, split) - math.log(2)


def _mixed_in(p, beta: np.ndarray, p1: np.ndarray, one: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """One level up; a node without counts says one half."""
    estimate = np.where(one, p1, 1 - p1)
    return np.where(seen, estimate if p is None else (beta * estimate + p) / (beta + 1), 0.5)


def upper_levels(keys: np.ndarray, split: np.ndarray, n0: np.ndarray, n1: np.ndarray, depth: int) -> list[tuple]:
    """(depth, names, shares, estimates of a one) from NEAREST up to the root, from what the subtrees have sent."""
    out = []
    order = np.argsort(keys)
    keys, split, n0, n1 = keys[order], split[order], n0[order], n1[order]
    for d in range(_nearest(depth), -1, -1):
        beta, weighted = _weighed(n0, n1, split)
        out.append((d, keys, beta, (n1 + 0.5) / (n0 + n1 + 1)))
        if d:
            keys, where = np.unique(node_names(d - 1, keys >> np.uint64(8), keys & np.uint64(255)), return_inverse=True)
            split, n0, n1 = (np.bincount(where, x, len(keys)) for x in (weighted, n0, n1))
    return out


def through_upper(names: np.ndarray, lower: list[np.ndarray], upper: list[tuple]) -> np.ndarray:
    """log10 probability of the strings' last bytes."""
    total, context = np.zeros(len(names)), names >> np.uint64(8)
    for p, (node, one) in zip(lower, decisions(names), strict=True):
        for d, keys, beta, p1 in upper:
            if not len(keys):
                p = np.full(len(names), 0.5)
                continue
            key = node_names(d, context, node)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            p = _mixed_in(p, beta[at], p1[at], one, keys[at] == key)
        total += np.log10(p)
    return total


class ContextTrees:
    """Weighted trees from (string, count) in memory; probabilities of strings, seen or not. Not used by the query."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, kept: dict[int, np.ndarray], depth: int = DEPTH):
        self.depth, self.kept = depth, kept
        order = np.argsort(grams)
        self.grams, counts = grams[order], counts[order].astype(np.float64)
        context, symbol = self.grams >> np.uint64(8), self.grams & np.uint64(255)
        keys, share, ones = [], [], []
        total = np.zeros(len(self.grams))
        for bit in range(8):
            node = np.uint64(1 << bit) | symbol >> np.uint64(8 - bit)
            one = (symbol >> np.uint64(7 - bit)) & np.uint64(1)
            levels, below = [], None
            for d in range(depth, -1, -1):
                key = self._key(d, context, node)
                names, where = np.unique(key, return_inverse=True)
                where = where.astype(np.int32)
                n1 = np.bincount(where, counts * one, len(names))
                n0 = np.bincount(where, counts, len(names)) - n1
                own = log_kt(n0, n1)
                if below is None:
                    weighted, beta = own, np.full(len(names), np.inf)
                else:
                    child_where, child_weighted = below
                    parent = np.empty(len(child_weighted), np.int32)
                    parent[child_where] = where
                    split = np.bincount(parent, child_weighted, len(names))
                    beta = np.exp(np.clip(own - split, -60, 60))
                    weighted = np.logaddexp(own, split) - math.log(2)
                levels.append((where, beta, (n1 + 0.5) / (n0 + n1 + 1)))
                below = where, weighted
                keys.append(names)
                share.append(beta.astype(np.float32))
                ones.append(levels[-1][2].astype(np.float32))
            p = None
            for where, beta, p1 in levels:
                estimate = np.where(one == 1, p1[where], 1 - p1[where])
                p = estimate if p is None else (beta[where] * estimate + p) / (beta[where] + 1)
            total += np.log10(p) if p is not None else 0
        self.log10 = total
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        self.keys, self.share, self.ones = keys[order], np.concatenate(share)[order], np.concatenate(ones)[order]

    _key = staticmethod(node_names)

    def canonical(self, codes: np.ndarray) -> np.ndarray:
        """Bytes of context beyond the deepest context in the model become OTHER."""
        return canonical(codes, self.kept, self.depth)

    def log10_of(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each string in its context."""
        out, open_ = self._seen(codes)
        if len(open_):
            names, where = np.unique(self.canonical(codes[open_]), return_inverse=True)
            values, rest = self._seen(names)
            for low in range(0, len(rest), WALK):
                values[rest[low:low + WALK]] = self._walk(names[rest[low:low + WALK]])
            out[open_] = values[where]
        return out

    def _seen(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the strings that the model holds, places of the others."""
        out = np.zeros(len(codes))
        if not len(self.grams):
            return out, np.arange(len(codes))
        at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        seen = self.grams[at] == codes
        out[seen] = self.log10[at[seen]]
        return out, np.flatnonzero(~seen)

    def _walk(self, codes: np.ndarray) -> np.ndarray:
        """Decision by decision; a node without counts says one half."""
        if not len(self.keys):
            return np.full(len(codes), -8 * math.log10(2))
        context, symbol = codes >> np.uint64(8), codes & np.uint64(255)
        total = np.zeros(len(codes))
        for bit in range(8):
            node = np.uint64(1 << bit) | symbol >> np.uint64(8 - bit)
            one = ((symbol >> np.uint64(7 - bit)) & np.uint64(1)) == 1
            p = np.full(len(codes), 0.5)
            for d in range(self.depth, -1, -1):
                key = self._key(d, context, node)
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                known = self.keys[at] == key
                beta, p1 = self.share[at].astype(np.float64), self.ones[at].astype(np.float64)
                estimate = np.where(one, p1, 1 - p1)
                with np.errstate(invalid="ignore"):
                    mix = np.where(np.isinf(beta), estimate, (beta * estimate + p) / (beta + 1))
                p = np.where(known, mix, 0.5)
            total += np.log10(p)
        return total


def canonical(codes: np.ndarray, kept: dict[int, np.ndarray], depth: int) -> np.ndarray:
    context, out = codes >> np.uint64(8), codes.copy()
    lost = np.zeros(len(codes), bool)
    for d in range(2, depth + 1):
        near = context & np.uint64((1 << (8 * d)) - 1)
        names = kept[d]
        at = np.minimum(np.searchsorted(names, near), max(0, len(names) - 1))
        lost |= ~(names[at] == near) if len(names) else True
        place = np.uint64(8 * d)
        out = np.where(lost, out & ~(np.uint64(255) << place) | np.uint64(OTHER) << place, out)
    return out


def _byte_context(d: int):
    """The d bytes before the last, of the column `key`."""
    return F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * d)) - 1))


def _least_power(counts: DataFrame, size: str, weight: str, most: int) -> int:
    """The smallest p for which rows with `size` >= 2 ** p have a total `weight` of at most `most`."""
    by_power = counts.groupBy(F.floor(F.log2(size)).cast("int").alias("power")).agg(F.sum(weight).alias("w")).orderBy(F.desc("power")).collect()
    held = 0
    for row in by_power:  # at most 64 rows
        held += row["w"]
        if held > most:
            return row["power"] + 1
    return 0


def fit_trees(strings: DataFrame, depth: int = DEPTH, max_grams: int = MAX_GRAMS) -> ContextTrees:
    """A small model in memory from (key, n): contexts of two or more bytes seen fewer than T times share, per
    parent, one child OTHER; T is the smallest power of two for which at most `max_grams` strings lie under
    the deepest contexts. Not used by the query, whose trees are whole."""
    deepest = strings.groupBy(_byte_context(depth).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("grams"))
    power = _least_power(deepest, "n", "grams", max_grams)
    kept = {}
    for d in range(2, depth + 1):
        names = strings.groupBy(_byte_context(d).alias("c")).agg(F.sum("n").alias("n")).where(F.col("n") >= (1 << power)).select("c")
        kept[d] = np.sort(_column(names, "c").view(np.uint64))

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.asarray(batch.column("key")).view(np.uint64)
            yield pa.RecordBatch.from_pydict({"key": pa.array(canonical(codes, kept, depth).view(np.int64)), "n": batch.column("n")})

    final = strings.mapInArrow(rename, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return ContextTrees(np.asarray(final["key"]).view(np.uint64), np.asarray(final["n"]), kept, depth)


def _column(df: DataFrame, name: str) -> np.ndarray:
    held = df.toArrow()[name].combine_chunks()
    return np.asarray(held).astype(np.int64)


def _scored(texts: pa.Table, values: pa.Table, depth: int, parts: int, words_known: np.ndarray, words_count: np.ndarray, end_count: int) -> pa.Table:
    """The documents of one block; `values` has the block's strings bucket by bucket."""
    block, rows = _block_at(texts.combine_chunks().to_batches()[0], 0)
    n = len(block)
    codes, starts = gram_codes(block, depth)
    names, where = np.unique(codes, return_inverse=True)
    log10 = np.empty(len(names))
    answers = sorted(zip(values["bucket"].to_pylist(), values["log10"].to_pylist(), strict=True))
    log10[_in_buckets(names, depth, parts)[0]] = np.concatenate([_from_fixed(x) for _, x in answers])
    score = np.add.reduceat(log10[where], starts[:-1])
    words = Words(block)
    tokens = np.diff(words.first)
    doc = np.repeat(np.arange(n), tokens)
    different, where = np.unique(words.hash, return_inverse=True)
    at = np.minimum(np.searchsorted(words_known, different), max(0, len(words_known) - 1))
    common = words_known[at] == different if len(words_known) else np.zeros(len(different), bool)
    count = np.where(common, words_count[at], 0) if len(words_count) else np.zeros(len(different), np.int64)
    base = np.bincount(doc, np.log10(count + 1.0)[where], n) + math.log10(end_count + 1)
    known = np.bincount(doc, (count > 0)[where], n).astype(np.int64) + (end_count > 0)
    rare = ~common[where]
    key = doc[rare] * np.int64(len(different) + 1) + where[rare]
    pairs, times = np.unique(key, return_counts=True)
    owner, word = pairs // (len(different) + 1), pairs % (len(different) + 1)
    cut = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    lists = lambda values: pa.ListArray.from_arrays(pa.array(cut), pa.array(values))
    return pa.table({
        "doc_id": rows.column("doc_id"), "held_out": pa.array(~np.asarray(rows.column("train"))), "n_tokens": pa.array(tokens.astype(np.int64) + 1),
        "n_common": pa.array(known), "common": pa.array(base), "score": pa.array(score),
        "rare": lists(different[word].view(np.int64)), "times": lists(times.astype(np.int64))})


def score_documents(docs: DataFrame, train, depth: int = DEPTH, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    `train` is a condition on `docs`: the model learns from those rows. A null text counts as empty: one
    end. Without training rows every decision has probability one half and the base knows no token.
    Repeated rows and ids repeat; no rows give no rows; more columns are ignored. The logarithm of every byte
    is rounded to a multiple of 1 / FRACTION before a text's are summed.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    texts = written(rows.mapInArrow(_as_blocks, "rows binary, size long")
                    .withColumn("block", F.monotonically_increasing_id()))
    words = pinned(texts.mapInArrow(_word_counts, "key long, n_train long, n_all long")
                   .groupBy("key").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all")))
    totals = words.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n"), F.count(F.when(F.col("n_train") > 0, 1)).alias("v")).first()
    power = _least_power(words.withColumn("one", F.lit(1)), "n_all", "one", max_words)
    top = words.where(F.col("n_all") >= (1 << power)).select("key", "n_train").toArrow()
    key, n = np.asarray(top["key"]).astype(np.int64).view(np.uint64), np.asarray(top["n_train"]).astype(np.int64)
    order = np.argsort(key)
    key, n = key[order], n[order]
    ends = words.where(F.col("key") == int(END_WORD.view(np.int64)[0])).agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n")).first()["n"]
    size = texts.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    parts = max(BUCKETS, -(-size // BUCKET_BYTES))
    met = written(texts.mapInArrow(lambda it: _asked(it, depth, parts), "bucket long, block long, names binary, counts binary")
                  .groupBy("bucket").applyInArrow(lambda rows: _met(rows, depth), "names binary, counts binary, places binary, "
                  "blocks array<long>, sizes array<long>, bucket long, node array<long>, split array<double>, zeros array<double>, ones array<double>"))
    nodes = met.select(F.explode(F.arrays_zip("node", "split", "zeros", "ones")).alias("r")).groupBy("r.node").agg(
        *[F.sum(f"r.{k}").alias(k) for k in ("split", "zeros", "ones")]).toArrow()
    upper = upper_levels(np.asarray(nodes["node"]).astype(np.int64).view(np.uint64), *[np.asarray(nodes[k]).astype(np.float64) for k in ("split", "zeros", "ones")], depth)
    model = spark.sparkContext.broadcast((upper, (key, n, int(ends))))  # bounded by the names of nodes and MAX_WORDS
    values = met.drop("node", "split", "zeros", "ones").mapInArrow(lambda it: _valued(it, depth, model.value[0]), "block long, bucket long, log10 binary")

    scored = pinned(texts.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(
        lambda left, right: _scored(left, right, depth, parts, *model.value[1]),
        "doc_id long, held_out boolean, n_tokens long, n_common long, common double, score double, rare array<long>, times array<long>",
    ).withColumn("row_key", F.monotonically_increasing_id()))
    rare = scored.select("row_key", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row_key", F.col("r.rare").alias("key"), F.col("r.times").alias("times"))
    looked = rare.join(words.select("key", "n_train"), "key").groupBy("row_key").agg(
        F.sum(F.col("times") * F.log10(F.col("n_train") + 1)).alias("rare_base"), F.sum(F.when(F.col("n_train") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    unit = math.log10(totals["n"] + totals["v"] + 1)
    return scored.drop("rare", "times").join(looked, "row_key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(totals["n"]).cast("long").alias("train_tokens"),
        (F.col("common") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * unit).alias("base_score"), "score")


def scoring_query(docs: DataFrame) -> DataFrame:
    return score_documents(docs, ~held_out(docs["doc_id"]))
