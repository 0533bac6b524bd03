"""Merkle manifest of a table: nested structs rolled up by the digits of a rank (DataFrame functions only).

Leaves are numbered within their language; the number's octal digits say where a leaf hangs. Three digits
are grouped away one after the other inside a block of 512 leaves, each step nesting the structs of the
step before, so that a block is one row of bounded size. Blocks are the leaves of the next three levels,
and so on; the tops of all languages form one more tree. On the way back each block row meets the row of
its path upwards by grouping (one row of either kind per block), and a transform over the nested structs,
exploded, gives every leaf its own path. No document meets another one outside its block.

A path is an array of steps (before, after): the digests of the siblings left and right of the node, as
one text each. Folding a leaf along its path gives the root; the siblings alone are the proof.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .tables import pinned

#: Children of a node, as a power of two, and the levels that one block nests.
FANOUT_BITS, NESTED = 3, 3
FANOUT = 1 << FANOUT_BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# The letters that tampering changes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "array<struct<before:string,after:string>>"
UP = f"struct<path:{STEP},tops:array<string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    said = value.cast("string")
    return F.when(said.isNull(), "-").otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): `tampered` is the leaf after tampering, null where nothing is tampered with."""
    rows = docs.select(*[F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS])
    fields = [field(F.col(c)) for c in FIELDS]
    lowered = field(F.translate("text", UPPER, LOWER))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return rows.select("doc_id", "lang", digest(*fields).alias("leaf"), F.when(hit, digest(*fields[:-1], lowered)).alias("tampered"))


def _levels(total: Column) -> Column:
    """How often `total` nodes are grouped until one is left."""
    reach = F.array(*[F.lit(FANOUT ** i) for i in range(20)])
    return F.size(F.filter(reach, lambda most: most < total))


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda n: n["hash"]), "")


def _nested(nodes: DataFrame, depth: int) -> DataFrame:
    """(tree, levels, block, hash, kids): every block of nodes as one row, `kids` nested NESTED levels deep.

    A level beyond the tree's own has one node, which passes unchanged.
    """
    digits = [F.shiftright("rank", FANOUT_BITS * i).bitwiseAND(FANOUT - 1).cast("int").alias(f"digit{i}") for i in range(NESTED)]
    rows = nodes.select("tree", "levels", F.shiftright("rank", FANOUT_BITS * NESTED).alias("block"), *digits, "hash", "item")
    rows, inside = rows.repartition("tree", "block"), ["hash", "item"]
    for i in range(NESTED):
        above = [f"digit{j}" for j in range(i + 1, NESTED)]
        kids = F.array_sort(F.collect_list(F.struct(F.col(f"digit{i}").alias("digit"), *inside)))
        rows = rows.groupBy("tree", "levels", "block", *above).agg(kids.alias("kids"))
        hashed = F.when(F.col("levels") > NESTED * depth + i, F.sha2(_joined(F.col("kids")), 256)).otherwise(F.col("kids")[0]["hash"])
        rows, inside = rows.withColumn("hash", hashed), ["hash", "kids"]
    return rows


def _step(nodes: Column, place: Column, level: int) -> Column:
    """The step of the node at `place` among its siblings, or none above the top of the tree."""
    one = F.struct(_joined(F.slice(nodes, 1, place)).alias("before"), _joined(F.slice(nodes, place + 2, FANOUT)).alias("after"))
    return F.when(F.col("levels") > level, F.array(one)).otherwise(F.array()).cast(STEP)


def _paths(kids: Column, level: int, above: Column) -> Column:
    """array<struct<item, path>> of every leaf below `kids`, whose own siblings stand on `level`."""
    def one(node: Column, place: Column) -> Column:
        path = F.concat(_step(kids, place, level), above)
        if level % NESTED == 0:
            return F.array(F.struct(node["item"].alias("item"), path.alias("path")))
        return _paths(node["kids"], level - 1, path)

    return F.flatten(F.transform(kids, one))


def climb(nodes: DataFrame, deepest: int, crown: Callable[[DataFrame], DataFrame] | None = None, depth: int = 0) -> DataFrame:
    """(tree, item, up struct<path, tops>) of every node (tree, levels, rank, hash, item).

    `levels` is the height of the node's tree and `deepest` the largest of them. `crown` takes the tops
    (tree, hash) and returns (tree, up) for them; without it a path ends at its tree's top.
    """
    blocks = pinned(_nested(nodes, depth))
    if deepest > NESTED * (depth + 1):
        below = blocks.select("tree", "levels", F.col("block").alias("rank"), "hash", F.col("block").alias("item"))
        above = climb(below, deepest, crown, depth + 1).select("tree", F.col("item").alias("block"), "up")
    else:
        tops = blocks.select("tree", "hash")
        above = (crown(tops) if crown else tops.select("tree", _end(F.col("hash")).alias("up"))).withColumn("block", F.lit(0).cast("long"))
    kind = blocks.schema["kids"].dataType
    both = blocks.select("tree", "block", "levels", "kids", F.lit(None).cast(UP).alias("up")).unionByName(
        above.select("tree", "block", F.lit(None).cast("int").alias("levels"), F.lit(None).cast(kind).alias("kids"), "up"))
    met = both.groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("levels", "kids", "up")])
    paths = _paths(F.col("kids"), NESTED * (depth + 1) - 1, F.col("up")["path"])
    return met.select("tree", F.col("up")["tops"].alias("tops"), F.inline(paths)).select(
        "tree", "item", F.struct("path", "tops").cast(UP).alias("up"))


def _end(*tops: Column) -> Column:
    return F.struct(F.array().cast(STEP).alias("path"), F.array(*tops).alias("tops")).cast(UP)


def _deepest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("levels")).first()[0] or 0


def _crowned(tops: DataFrame) -> DataFrame:
    """The tree over the tops of all languages, in their order; its root is added to `tops` of each path."""
    ranked = numbered(tops.withColumnRenamed("tree", "lang"), [], ["lang"], "place")
    nodes = pinned(ranked.select(
        F.lit(0).alias("tree"), _levels(F.col("place_total")).alias("levels"), (F.col("place") - 1).alias("rank"), "hash",
        F.struct("lang", F.col("hash").alias("subroot")).alias("item")))
    return climb(nodes, _deepest(nodes)).select(
        F.col("item.lang").alias("tree"),
        F.struct(F.col("up.path").alias("path"), F.concat(F.array("item.subroot"), F.col("up.tops")).alias("tops")).cast(UP).alias("up"))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered, path array<struct<before,after>>, subroot, root), one row per input row.

    Leaves of a language ascend by doc_id (null first), rows with equal doc_id by their digest; equal rows
    are interchangeable. Null fields are told apart from empty ones, a null lang is a language of its own
    and the first one. A row without id is never tampered with. A language with one row has its leaf as
    subroot, a single language its subroot as root. No rows give no rows; more columns are ignored.
    """
    ranked = numbered(leaves(docs), ["lang"], ["doc_id", "leaf"], "place")
    nodes = pinned(ranked.select(
        F.col("lang").alias("tree"), _levels(F.col("place_total")).alias("levels"), (F.col("place") - 1).alias("rank"),
        F.col("leaf").alias("hash"), F.struct("doc_id", "leaf", "tampered").alias("item")))
    return climb(nodes, _deepest(nodes), _crowned).select(
        "item.doc_id", F.col("tree").alias("lang"), "item.leaf", "item.tampered", "up.path",
        F.col("up.tops")[0].alias("subroot"), F.col("up.tops")[1].alias("root"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that `leaf` gives with the siblings on `path`."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["before"], node, step["after"]))


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def manifest_query(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per input row as in `manifest`."""
    rows = manifest(docs).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_HEAD = " || ".join(_FIELD.format(c) for c in FIELDS[:-1])
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({_HEAD} || {_FIELD.format('text')}) AS leaf,
         sha256({_HEAD} || {_FIELD.format(f"translate(text, '{UPPER}', '{LOWER}')")}) AS tampered,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda h, b: list_reduce(list_concat([xor(h, b)], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)),
             4294967295) % 3 = 0 AS hit
  FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM d
), t AS (
  SELECT lang, 0 AS lv, idx, n, leaf AS h FROM r
  UNION ALL
  SELECT lang, lv + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY lang, lv, idx // 8, n
), s AS (
  SELECT lang, lv AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS spot, count(*) OVER () AS n_langs FROM t WHERE n = 1
), u AS (
  SELECT 0 AS lv, spot AS idx, n_langs AS n, subroot AS h FROM s
  UNION ALL
  SELECT lv + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY lv, idx // 8, n
), steps AS (
  SELECT a.lang, a.lv, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS after
  FROM t a JOIN t b ON a.lang IS NOT DISTINCT FROM b.lang AND a.lv = b.lv AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY ALL
), crown AS (
  SELECT a.lv, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS after
  FROM u a JOIN u b ON a.lv = b.lv AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY ALL
), walk AS (
  SELECT r.doc_id, r.leaf, s.subroot, s.lang, s.height, s.spot, r.idx, 0 AS lv, '' AS said,
         CASE WHEN r.hit AND r.doc_id IS NOT NULL THEN r.tampered ELSE r.leaf END AS node
  FROM r JOIN s ON r.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.lang, w.height, w.spot, w.idx, w.lv + 1, w.said || p.before || p.after, sha256(p.before || w.node || p.after)
  FROM walk w JOIN (
    SELECT lang, lv, idx, before, after, false AS upper FROM steps UNION ALL SELECT NULL, lv, idx, before, after, true FROM crown) p
  ON p.upper = (w.lv >= w.height) AND (p.upper OR p.lang IS NOT DISTINCT FROM w.lang) AND p.lv = w.lv - CASE WHEN p.upper THEN w.height ELSE 0 END
     AND p.idx = (CASE WHEN p.upper THEN w.spot ELSE w.idx END) // (8 ** p.lv)::BIGINT
)
SELECT doc_id, leaf, subroot, root, sha256(said) AS proof_sha256, node AS folded_root, node = root AS verified
FROM walk, (SELECT h AS root, lv AS top FROM u WHERE n = 1) WHERE walk.lv = height + top
"""
