"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

The ring is cut into equal cells; each belongs to the first virtual node clockwise. A row goes to the
cell of its hashed key. Every shard has a capacity; rows first claim the shard of their own cell, and
what finds it full continues clockwise to the next virtual node of a shard with room. Only the row
counts of the cells (at most RING_CELLS numbers, however many rows there are) are needed to work
out which ranks of a cell end where, so the rows themselves meet that small table in one broadcast
join. Capacities differ by one row at most and add up to the number of rows, so counts do too.
"""

from __future__ import annotations

import bisect
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import work_columns

RING_BITS = 14
RING_CELLS = 1 << RING_BITS
VIRTUAL_NODES = 64


def ring_owners(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[list[int]]:
    """[cell, shard] of each virtual node, clockwise; where two fall into a cell the smaller shard has it."""
    spots: dict[int, int] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            cell = zlib.crc32(f"shard {shard} node {node}".encode()) >> (32 - RING_BITS)
            spots[cell] = min(shard, spots.get(cell, shard))
    return [[cell, spots[cell]] for cell in sorted(spots)]


def ring_segments(counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple]:
    """(cell, first rank, end rank, home shard, shard, first slot) for every run of ranks that stays together."""
    total = sum(counts.values())
    room = [total // shards + (shard < total % shards) for shard in range(shards)]
    used = [0] * shards
    nodes = ring_owners(shards, virtual_nodes)
    cells = [cell for cell, _ in nodes]
    segments, waiting = [], []

    def accept(cell, rank, home, shard, left):
        taken = min(left, room[shard] - used[shard])
        if taken:
            segments.append((cell, rank, rank + taken, home, shard, used[shard]))
            used[shard] += taken
        return taken

    for cell in sorted(counts):
        at = bisect.bisect_left(cells, cell) % len(nodes)
        home = nodes[at][1]
        taken = accept(cell, 0, home, home, counts[cell])
        if taken < counts[cell]:
            waiting.append((cell, taken, home, at))
    for cell, rank, home, at in waiting:
        while rank < counts[cell]:
            at = (at + 1) % len(nodes)
            rank += accept(cell, rank, home, nodes[at][1], counts[cell] - rank)
    return segments


def shard_rows(docs: DataFrame, shards: int = 24, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard), one row per input row.

    `size` is the UTF-8 length of the text plus 8, a null text has no bytes. `home_shard` is the shard
    whose arc holds the key; it differs from `shard` for rows that had to continue clockwise. Null
    keys share one place on the ring. Rows with equal doc_id are ordered by size and checksum; rows
    equal in all of them are interchangeable. No rows give no rows; more columns are ignored.
    """
    spot = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - RING_BITS).cast("int")
    counts = {row["cell"]: row["n"] for row in
              work_columns(docs).select(spot.alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = docs.sparkSession
    segments = spark.createDataFrame(
        ring_segments(counts, shards, virtual_nodes),
        "cell int, first_rank long, end_rank long, home_shard int, shard int, first_slot long")
    payload = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = work_columns(docs).select(
        "doc_id", (F.octet_length(payload) + 8).cast("long").alias("size"), F.crc32(payload).alias("text_crc32"),
        spot.alias("cell"), F.xxhash64("doc_id").alias("place"))
    rank = Window.partitionBy("cell").orderBy("place", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(rank).cast("long") - 1)
    at = F.broadcast(segments)  # at most RING_CELLS plus one row per virtual node and full shard
    return (
        ranked.join(at, (ranked["cell"] == at["cell"]) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                (F.col("first_slot") + F.col("rank") - F.col("first_rank")).alias("slot"),
                F.lit(None).cast("int").alias("grown_shard"), "home_shard"))
