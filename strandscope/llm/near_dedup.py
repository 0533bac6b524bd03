"""Near-duplicates: one-permutation MinHash with optimal densification, banded buckets, star edges.

1. Every text becomes the set of its word shingles. One hash per shingle picks a bin and a value; the
   smallest value per bin is the signature, and an empty bin borrows from a bin that a hash of (bin,
   attempt) names. BANDS groups of ROWS bins give one bucket each. A pair at similarity 0.8 misses all
   buckets with a probability of about 5e-7.
2. Texts with equal sets are one class from here on; its smallest doc_id stands for it.
3. In every bucket a hub is linked with the other members: a star, not all pairs. Links are confirmed
   on the full sets, confirmed links are contracted to components.
4. Nearly all links are found by now, and of the other pairs of a bucket few are similar. Members of
   buckets that still have several components are banded once more, by FINE_BANDS of FINE_ROWS, which a
   pair at similarity 0.8 misses with a probability of about 5e-7 and one at 0.5 nearly always.
5. Texts then meet components, not each other: the largest components of a bucket are its hubs, and every
   other text of the bucket is compared with a hub component once, wherever it meets it. The component comes in
   slices of about SLICE texts, the texts in chunks; a task holds one of each and compares all of their sets
   exactly. So a text that shares buckets with thousands of linked copies is a row per slice, not per copy.
   A hub has met all others of its bucket and leaves it; one hub a bucket, then four, and so on until no bucket has
   two components.

Bucket, hub and label steps are aggregates and joins that adaptive execution can split; no bucket is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import pinned, released, tied, work_columns, written
from .text import BLOCK_BYTES, BLOCK_ROWS, Block, Words, blocks, mixed, shingles

BANDS, ROWS = 48, 6
FINE_BANDS, FINE_ROWS = 205, 12
FIRST_BANDS = 8
SLICE, CHUNK, MOST_HUBS = 64, 512, 256
ATTEMPTS = 4096
#: A block has at most 2 ** 11 documents, which leaves so many bits of a hash beside the document's number.
HASH_BITS = 53


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, 53-bit hash) of each document's different shingles, ordered by both."""
    hashes, docs = shingles(Words(block), size)
    key = np.sort(docs.astype(np.uint64) << np.uint64(HASH_BITS) | hashes >> np.uint64(64 - HASH_BITS))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1)


def _donor(bins: np.ndarray, attempt: int, n_bins: int) -> np.ndarray:
    """The bin that an empty bin asks at its so-manieth attempt, the same for every document."""
    return (mixed(bins.astype(np.uint64) * np.uint64(ATTEMPTS) + np.uint64(attempt + 0x5EED)) % np.uint64(n_bins)).astype(np.int64)


def signatures(docs: np.ndarray, hashes: np.ndarray, n: int, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """n x (bands * rows) values, one per bin; rows of documents without shingles hold no values."""
    n_bins = bands * rows
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n, n_bins), empty, np.uint64)
    spread = mixed(hashes + np.uint64(0x2545F491))
    bins = ((spread >> np.uint64(32)) * np.uint64(n_bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(out.reshape(-1), docs * n_bins + bins, spread & np.uint64(0xFFFFFFFF))
    filled = out != empty
    row, col = np.nonzero(~filled & filled.any(1)[:, None])
    for attempt in range(ATTEMPTS):
        if not len(row):
            break
        donor = _donor(col, attempt, n_bins)
        found = filled[row, donor]
        out[row[found], col[found]] = out[row[found], donor[found]]
        row, col = row[~found], col[~found]
    for r, c in zip(row, col, strict=True):  # practically never: the next filled bin
        out[r, c] = out[r, (c + 1 + np.argmax(np.roll(filled[r], -c - 1))) % n_bins]
    return out


def band_keys(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    weight = mixed(np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    total = (values.reshape(len(values), bands, rows) * weight).sum(2, dtype=np.uint64)
    return mixed(total + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for block, rows in blocks(batches, size=BLOCK_BYTES // 2):
        docs, hashes = shingle_sets(block, size)
        n = np.bincount(docs, minlength=len(block)).astype(np.int64)
        wide = mixed(hashes + np.uint64(1))
        one, two = np.zeros(len(block), np.uint64), np.zeros(len(block), np.uint64)
        np.add.at(one, docs, wide)
        np.add.at(two, docs, mixed(wide ^ np.uint64(0xABCDEF)))
        keys = band_keys(signatures(docs, hashes, len(block)))
        yield pa.RecordBatch.from_pydict({
            "doc_id": rows.column("doc_id"), "n_shingles": pa.array(n), "set1": pa.array(one.view(np.int64)), "set2": pa.array(two.view(np.int64)),
            "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))})


def _shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed before they are shuffled."""
    pack = zstandard.ZstdCompressor(level=1)
    for block, rows in blocks(batches):
        blobs = [pack.compress(block.data[a:b].tobytes()) for a, b in zip(block.at[:-1], block.at[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "blob": pa.array(blobs, pa.binary())})


def _finer(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Band keys of the second banding, a few documents at a time."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for low in range(0, batch.num_rows, 128):
            rows = batch.slice(low, 128)
            block = _block([unpack.decompress(b) for b in rows.column("blob").to_pylist()])
            docs, hashes = shingle_sets(block, size)
            keys = band_keys(signatures(docs, hashes, len(block), FINE_BANDS, FINE_ROWS), FINE_BANDS, FINE_ROWS)
            yield pa.RecordBatch.from_pydict({"node": rows.column("doc_id"), "n": pa.array(np.bincount(docs, minlength=len(block)).astype(np.int64)),
                                              "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * FINE_BANDS), pa.array(keys.reshape(-1)))})


def _block(texts: list[bytes]) -> Block:
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return Block(np.arange(len(texts)), np.frombuffer(b"".join(texts), np.uint8), at, np.zeros(len(texts), bool))


def _confirmed(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, linked) by exact intersection and union of the two sets."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        left, right = batch.column("blob_a").to_pylist(), batch.column("blob_b").to_pylist()
        low = 0
        linked = []
        while low < len(left):
            high, held, texts = low, 0, []
            while high < len(left) and (high == low or held < BLOCK_BYTES // 2) and 2 * (high - low) < BLOCK_ROWS:
                texts += [unpack.decompress(left[high]), unpack.decompress(right[high])]
                held += len(texts[-1]) + len(texts[-2])
                high += 1
            docs, hashes = shingle_sets(_block(texts), size)
            n = np.bincount(docs, minlength=len(texts))
            both = np.sort((docs // 2).astype(np.uint64) << np.uint64(HASH_BITS) | hashes)
            same = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(HASH_BITS)).astype(np.int64), minlength=high - low)
            union = n[0::2] + n[1::2] - same
            linked += (100 * same >= percent * union).tolist()
            low = high
        yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(linked, pa.bool_())})


def _met(left: pa.Table, right: pa.Table, size: int, percent: int) -> pa.Table:
    """(a, b) for every text of `right` that is linked with a text of `left`, a slice of one component: one link each."""
    unpack = zstandard.ZstdDecompressor()
    out_a, out_b = [], []
    nodes, blobs = left.column("node").to_numpy(), left.column("blob").to_pylist()
    texts, others = right.column("text").to_numpy(), right.column("data").to_pylist()
    for low in range(0, len(nodes), SLICE):
        docs, hashes = shingle_sets(_block([unpack.decompress(b) for b in blobs[low:low + SLICE]]), size)
        many = np.bincount(docs, minlength=SLICE)
        order = np.argsort(hashes, kind="stable")
        held, owner = hashes[order], docs[order]
        for at in range(0, len(texts), SLICE):
            which, mine = shingle_sets(_block([unpack.decompress(b) for b in others[at:at + SLICE]]), size)
            own = np.bincount(which, minlength=SLICE)
            first = np.searchsorted(held, mine, "left")
            found = np.searchsorted(held, mine, "right") - first
            # a text most of whose shingles are in none of these texts cannot be linked with one of them
            enough = 100 * np.bincount(which[found > 0], minlength=SLICE) >= percent * own
            kept = enough[which] & (found > 0)
            found, first, which = found[kept], first[kept], which[kept]
            ends = np.cumsum(found)
            spots = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - found), found)
            same = np.bincount(np.repeat(which, found) * SLICE + owner[spots], minlength=SLICE * SLICE).reshape(SLICE, SLICE)
            linked = (same > 0) & (100 * same >= percent * (own[:, None] + many - same))
            row = np.flatnonzero(linked.any(1))
            out_a.append(texts[at + row])
            out_b.append(nodes[low + linked[row].argmax(1)])
    empty = [np.zeros(0, np.int64)]
    return pa.table({"a": np.concatenate(out_a or empty), "b": np.concatenate(out_b or empty)})


def _links_with(wanted: DataFrame, state: DataFrame, packed: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between the texts and the components of wanted (node, label)."""
    asked = wanted.groupBy("label").agg(F.count(F.lit(1)).alias("asked"))
    shape = state.join(asked.select("label"), "label").groupBy("label").agg(F.count(F.lit(1)).alias("held")).join(asked, "label").select(
        "label", F.ceil(F.col("held") / SLICE).cast("int").alias("slices"), F.ceil(F.col("asked") / CHUNK).cast("int").alias("chunks"))

    def part(kind: str):
        return F.pmod(F.xxhash64("node"), F.col(kind)).cast("int")

    def every(kind: str):
        return F.explode(F.sequence(F.lit(0), F.col(kind) - 1))

    blobs = packed.select(F.col("doc_id").alias("node"), "blob")
    key = ["label", "slice", "chunk"]
    left = state.join(shape, "label").join(blobs, "node").withColumn("slice", part("slices")).withColumn("chunk", every("chunks")).select(*key, "node", "blob")
    right = wanted.join(shape, "label").join(blobs, "node").withColumn("chunk", part("chunks")).withColumn("slice", every("slices")).select(
        *[F.col(c).alias(c) for c in key], F.col("node").alias("text"), F.col("blob").alias("data"))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda a, b: _met(a, b, size, percent), "a long, b long")


def contracted(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, label) for links (a, b): label is the smallest node that can be reached.

    Each round every node turns to its smallest neighbour, chains of such turns are shortened by
    halves, and the links that still cross are renamed; the number of rounds is logarithmic. `rows`: how many links there are.
    """
    crossing = written(links.select("a", "b").where("a <> b").distinct(), rows)
    labels, nodes = None, None if rows is None else 2 * rows
    while not crossing.isEmpty():
        both = crossing.union(crossing.select("b", "a"))
        turns = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), nodes)
        while True:
            up = turns.select(F.col("node").alias("label"), F.col("label").alias("up"))
            step = written(turns.join(up, "label").select("node", F.col("up").alias("label"), (F.col("up") != F.col("label")).alias("moved")), nodes)
            turns = step.select("node", "label")
            if step.where("moved").isEmpty():
                break
        if labels is None:
            labels = turns
        else:
            up = turns.select(F.col("node").alias("label"), F.col("label").alias("up"))
            labels = written(labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")).unionByName(
                turns.join(labels.select("node"), "node", "left_anti")), nodes)
        for side in ("a", "b"):
            crossing = crossing.join(turns.select(F.col("node").alias(side), F.col("label").alias("_to")), side).drop(side).withColumnRenamed("_to", side)
        crossing = written(crossing.select("a", "b").where("a <> b").distinct(), rows)
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)


def _relabelled(state: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """state (node, label) after the components along links (nodes a, b) have met."""
    names = state.select(F.col("node").alias("a"), F.col("label").alias("la"))
    others = state.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    merged = contracted(links.join(names, "a").join(others, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")), links.count())
    up = merged.select(F.col("node").alias("label"), F.col("label").alias("up"))
    return written(state.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")), rows)


def _starred(members: DataFrame, state: DataFrame, packed: DataFrame, size: int, percent: int, rows: int, n_nodes: int) -> DataFrame:
    """state after one star per bucket: every member is compared with the member that shares most buckets with others."""
    placed = members.join(state, "node")
    hub = placed.groupBy("bucket").agg(F.min(F.struct("first", "node", "label", "n")).alias("hub"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    possible = (F.col("hub.label") != F.col("label")) & (100 * F.least("hub.n", "n") >= percent * F.greatest("hub.n", "n"))
    pairs = placed.join(hub, "bucket").where(possible).select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    with_a = pairs.join(packed.select(F.col("doc_id").alias("a"), F.col("blob").alias("blob_a")), "a")
    with_b = with_a.join(packed.select(F.col("doc_id").alias("b"), F.col("blob").alias("blob_b")), "b")
    links = written(with_b.mapInArrow(lambda it: _confirmed(it, size, percent), "a long, b long, linked boolean").where("linked").select("a", "b"), rows)
    state = state if links.isEmpty() else _relabelled(state, links, n_nodes)
    released(members.sparkSession)
    return state


def near_components(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row; doc_id must be unique.

    Texts are linked if 100 * intersection >= percent * union of their sets of `size`-word shingles; a
    text with fewer words has its whole sequence as one shingle. Null, empty and blank texts have none,
    are linked with nothing and stay. component_id is the smallest doc_id that links reach. A row
    without doc_id never stands for others: it is kept only if nothing else equals it. Empty tables
    give empty results; more columns are ignored.
    """
    texts = work_columns(docs)
    signed = pinned(texts.mapInArrow(lambda it: _signed(it, size), "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>"))
    full = signed.where("n_shingles > 0")
    keys = ["set1", "set2", "n_shingles"]
    classes = pinned(tied(full.select("doc_id", *keys), keys, "doc_id").select("doc_id", "n_shingles", F.col("first").alias("node")))

    heads = classes.where("doc_id = node").select("node")
    entries = full.select(F.col("doc_id").alias("node"), "n_shingles", "bands").join(heads, "node").select(
        "node", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "bucket"))
    shared = pinned(entries.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high").select("bucket", "size"))
    members = pinned(entries.join(shared, "bucket").select("bucket", "node", "n", "band", "size"))
    rows = members.count()
    known = written(members.groupBy("node").agg((-F.sum("size")).alias("first")), rows // FIRST_BANDS)
    state = known.select("node", F.col("node").alias("label"))
    n_nodes = known.count()
    packed = pinned(texts.where("doc_id is not null").mapInArrow(_shrunk, "doc_id long, blob binary").join(
        state.select(F.col("node").alias("doc_id")), "doc_id"))

    members = members.join(known, "node").select("bucket", "node", "n", "first", (F.col("band") >= FIRST_BANDS).alias("skip"))
    for now in (members.where("not skip"), members):
        state = _starred(now, state, packed, size, percent, rows, n_nodes)
    several = members.join(state, "node").groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    again = written(members.join(several, "bucket").select(F.col("node").alias("doc_id")).distinct(), n_nodes)
    fine = packed.join(again, "doc_id").mapInArrow(lambda it: _finer(it, size), "node long, n long, bands array<long>")
    fine = fine.select("node", F.explode("bands").alias("bucket"))
    members, hubs, met = fine, 1, None
    while True:
        placed = members.join(state, "node").select("bucket", "node", "label")
        groups = placed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("held"))
        # partly ranked: a bucket keeps its largest components only, however many it has
        order = Window.partitionBy("bucket").orderBy(F.col("held").desc(), "label")
        heads = groups.withColumn("place", F.row_number().over(order)).where(F.col("place") <= hubs + 1)
        heads = heads.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("place", "label"))).alias("heads")).where(F.size("heads") > 1)
        heads = heads.select("bucket", F.slice("heads.label", 1, hubs).alias("hubs"))
        # the largest component of a bucket waits for the others to come; of two hubs the smaller one comes
        around = written(placed.join(heads, "bucket").where(F.col("label") != F.get("hubs", F.lit(0))))
        if around.isEmpty():
            break
        place = F.array_position("hubs", F.col("label")).cast("int")
        greater = F.when(place > 0, F.slice("hubs", 1, F.greatest(place - 1, F.lit(0)))).otherwise(F.col("hubs"))
        wanted = around.select("node", F.explode(greater).alias("label")).distinct()
        if met is not None:
            wanted = wanted.join(met, ["node", "label"], "left_anti")
        wanted = written(wanted, n_nodes)
        links = written(_links_with(wanted, state, packed, size, percent))
        met = wanted if met is None else met.unionByName(wanted)
        members = around.where(~F.array_contains("hubs", F.col("label"))).select("bucket", "node")
        if not links.isEmpty():
            state = _relabelled(state, links, n_nodes)
        hubs = min(4 * hubs, MOST_HUBS)
        released(docs.sparkSession)

    joined = classes.join(state, "node", "left").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("component_id"))
    blank = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(blank).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: Brute force over all pairs that share a shingle, for the two-word query.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] END) AS sh
  FROM w WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  JOIN n nx ON nx.doc_id = a.doc_id JOIN n ny ON ny.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
