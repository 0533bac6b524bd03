"""Hard negatives of anchors by exact integer products of anchor and candidate tiles.

Components become integers, so scores are exact and ties are true ties. Anchors and candidates are dealt to
blocks of bounded size; every pair of blocks is one tile, multiplied in one task by Strassen's
recursion on 64-bit integers (zero padding, sums that wrap are exact again at the end). Two rounds of tiles:
the first keeps, per anchor, a heap of the best rows of its own label; the heaps of all tiles merge into
the anchor's positives. The second keeps, per anchor and positive, a heap of the best rows of other labels within
the positive's window of scores; these merge likewise. A task holds one tile; heaps have a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import pinned

ANCHOR_BLOCK, CANDIDATE_BLOCK = 2048, 2048
#: Anchors of a tile that are multiplied at once.
STRIP = 256
#: Tiles this narrow are multiplied directly.
LEAF = 16
SCALE = 256
#: Scaled components below this, and this many at most, have sums of products that 64 bits hold.
LARGEST, LONGEST = 1 << 24, 1 << 14
NONE = np.iinfo(np.int64).min
#: Stands for a missing vec_id, which comes last among equal scores.
NO_ID = np.iinfo(np.int64).max


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of two int64 matrices; odd sides are padded with zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return np.einsum("ij,jk->ik", a, b)
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    r, s, t = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    both = strassen(a11 + a22, b11 + b22, leaf)
    lower = strassen(a21 + a22, b11, leaf)
    right = strassen(a11, b12 - b22, leaf)
    left = strassen(a22, b21 - b11, leaf)
    upper = strassen(a11 + a12, b22, leaf)
    out = np.empty((2 * r, 2 * t), np.int64)
    out[:r, :t] = both + left - upper + strassen(a12 - a22, b21 + b22, leaf)
    out[:r, t:] = right + upper
    out[r:, :t] = lower + left
    out[r:, t:] = both - lower + right + strassen(a21 - a11, b11 + b12, leaf)
    return out[:m, :n]


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores of each row; equal ones from the left, NONE never."""
    k = min(k, scores.shape[1])
    if k == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.partition(scores, -k, axis=1)[:, -k, None]
    above, equal = scores > least, (scores == least) & (least != NONE)
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | equal & (np.cumsum(equal, axis=1) <= room))


def prepared(embeddings: DataFrame) -> DataFrame:
    """(key, vec_id, label, vector array<int>, anchor) of the rows that take part, each with a key of its own.

    Rows with a null label or vector, or a null or non-finite component, take no part, nor do rows whose scores 64 bits cannot
    hold (a component of 65,536 or more, or more than 16,384 of them).
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    sound = F.forall("x", lambda v: v.isNotNull() & (F.abs(F.coalesce(v, F.lit(0.0))) < LARGEST / SCALE))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & sound & (F.size("x") <= LONGEST)).select(
        F.monotonically_increasing_id().alias("key"), F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), moved.alias("label"),
        F.transform("x", lambda v: F.floor(v * SCALE).cast("int")).alias("vector"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)).alias("anchor"))


def _matrix(vectors: pa.ListArray | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of `width` numbers; a shorter vector ends with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy()
    return out


def _stacked(parts: list[tuple], width: int) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in range(width)]


class Tile:
    """One block of anchors against one block of candidates, candidates in the order of their ids."""

    def __init__(self, anchors: pa.Table, candidates: pa.Table):
        self.anchors, self.candidates = anchors, candidates.sort_by("vec_id")
        width = max([0, *(int(np.diff(t.column("vector").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (anchors, candidates))])
        self.left = _matrix(anchors.column("vector"), width)
        self.right = np.ascontiguousarray(_matrix(self.candidates.column("vector"), width).T)
        self.keys = self.candidates.column("key").to_numpy()
        self.ids = self.candidates.column("vec_id").to_numpy()
        self.labels = self.candidates.column("label").to_numpy()
        self.anchor_labels = anchors.column("label").to_numpy()
        self.anchor_keys = anchors.column("key").to_numpy()

    def strips(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(anchors, scores, whether the labels are equal) a strip at a time."""
        for low in range(0, len(self.left), STRIP):
            part = slice(low, low + STRIP)
            yield part, strassen(self.left[part], self.right), self.anchor_labels[part, None] == self.labels


def _in_tiles(rows: DataFrame, other: str, n_blocks: int, n_other: int) -> DataFrame:
    """Rows dealt to a block of their own kind and repeated for every block of the other kind."""
    own = "anchor_block" if other == "candidate_block" else "candidate_block"
    return rows.withColumn(own, F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))


def _heap(rows: DataFrame, keys: list[str], score: str, vec_id: str, k: int) -> DataFrame:
    """The k best of the rows per key with their rank; Spark keeps k of them before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(vec_id).asc())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   anchor_block: int = ANCHOR_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Per anchor (vec_id divisible by 100) the `positives` best other rows of its label, and for each of them
    the `negatives` best rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    Equal scores go by vec_id, a missing one last. A shorter vector counts as if it ended with zeros. Repeated rows
    are rows of their own: each is another row to its copies, and each repeated anchor gives its own rows. An anchor
    without positives or a positive without negatives gives no rows; no rows give none; more columns are ignored.
    """
    rows = pinned(prepared(embeddings))
    n_rows, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    across, down = max(1, -(-n_anchors // anchor_block)), max(1, -(-n_rows // candidate_block))
    anchors = rows.where("anchor").drop("anchor")
    candidates = _in_tiles(rows.drop("anchor"), "anchor_block", down, across)
    tile = ["anchor_block", "candidate_block"]

    def own_label(left: pa.Table, right: pa.Table) -> pa.Table:
        t, out = Tile(left, right), []
        for part, scores, same in t.strips():
            held = np.where(same & (t.anchor_keys[part, None] != t.keys), scores, NONE)
            row, column = best(held, positives)
            out.append((t.anchor_keys[part][row], t.ids[column], held[row, column]))
        key, ids, score = _stacked(out, 3)
        return pa.table({"key": key, "positive_id": ids, "positive_score": score})

    def other_label(left: pa.Table, right: pa.Table) -> pa.Table:
        t, out = Tile(left, right), []
        wanted = _matrix(left.column("positive_scores"), positives)
        many = np.diff(left.column("positive_scores").combine_chunks().offsets.to_numpy())
        least = wanted // 100 * low - wanted % 100 * -low // 100  # rounded up; no product leaves 64 bits
        most = wanted // 100 * high + wanted % 100 * high // 100
        for part, scores, same in t.strips():
            scores[same] = NONE
            for p in range(positives):
                inside = (scores >= least[part, p, None]) & (scores <= most[part, p, None]) & (many[part, None] > p)
                row, column = best(np.where(inside, scores, NONE), negatives)
                out.append((t.anchor_keys[part][row], np.full(len(row), p, np.int32), t.ids[column], scores[row, column]))
        key, place, ids, score = _stacked(out, 4)
        return pa.table({"key": key, "place": pa.array(place, pa.int32()), "negative_id": ids, "negative_score": score})

    def products(left: DataFrame, fn, schema: str) -> DataFrame:
        return _in_tiles(left, "candidate_block", across, down).groupBy(*tile).cogroup(candidates.groupBy(*tile)).applyInArrow(fn, schema)

    near = _heap(products(anchors, own_label, "key long, positive_id long, positive_score long"), ["key"], "positive_score", "positive_id", positives)
    chosen = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("chosen"))
    known = pinned(anchors.join(chosen, "key").select(
        "key", "vec_id", "label", "vector", F.col("chosen.positive_id").alias("positive_ids"), F.col("chosen.positive_score").alias("positive_scores")))
    found = _heap(products(known, other_label, "key long, place int, negative_id long, negative_score long"), ["key", "place"], "negative_score", "negative_id", negatives)
    named = found.join(known.select("key", F.col("vec_id").alias("anchor_id"), "positive_ids", "positive_scores"), "key")

    def shown(vec_id):
        return F.when(vec_id != NO_ID, vec_id)

    return named.select(
        "anchor_id", shown(F.get("positive_ids", "place")).alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        shown(F.col("negative_id")).alias("negative_id"), F.get("positive_scores", "place").alias("positive_score"), "negative_score")


SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS k
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.k, a.vec_id AS anchor_id, c.vec_id, c.k = a.k AS own, c.label = a.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM e a, e c WHERE a.vec_id % 100 = 0
), p AS (
  SELECT k, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND NOT own
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.k = s.k AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.k, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10
"""
