"""Manifest, packing and hard negatives: brute force, and nulls, ties, repeated rows, empty tables, clashing names."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandscope.llm import merkle, negatives, packing
from strandscope.llm.queries import tokenizer_file

LONG = " ".join(f"Word{i % 977} other{i % 31}" for i in range(5_000))
ROWS = [
    (5, "Same  text\there", "en", "a", 3), (2, "same text", "en", None, None), (2, "same text", "en", None, None), (2, "Same Text", "en", None, 1),
    (7, None, None, "b", 0), (9, "", "", "", 0), (11, " \n ", "é", "c", 3), (13, LONG, "en", "a", 9), (14, LONG + " Tail", "z", "a", 9),
    (None, "no id A", "en", "a", 1), (None, "no id A", None, "a", 1), (15, "日本語 ½ <|endoftext|> é", "é", "c", 5),
]
NAMES = "tree levels rank hash item block kids up place leaf part length base offset ids key anchor vector chosen".split()


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return base.select("*", *[F.lit(f"clash {n}").alias(n) for n in NAMES]).repartition(3)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lower(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(hashes):
    """All levels from the leaves to the top."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    for nodes in levels[:-1]:
        first = i // 8 * 8
        yield nodes[first:i], nodes[i + 1:first + 8]
        i //= 8


def brute_manifest(rows):
    def leaf(r, text):
        return digest(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(text))

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: climb([g[2] for g in sorted(groups[x], key=lambda g: g[:3])]) for x in langs}
    crown = climb([trees[x][-1][0] for x in langs])
    out = []
    for spot, x in enumerate(langs):
        for i, (_, _, own, r) in enumerate(sorted(groups[x], key=lambda g: g[:3])):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node, said = (leaf(r, lower(r[1])) if hit else own), []
            for before, after in [*path(trees[x], i), *path(crown, spot)]:
                said += before + after
                node = digest(*before, node, *after)
            root = crown[-1][0]
            out.append((r[0], own, trees[x][-1][0], root, digest(*said), node, node == root))
    return sorted(out, key=repr)


def test_manifest_edges(docs):
    got = merkle.manifest_query(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_manifest(ROWS)
    assert merkle.manifest_query(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 8, 9, 520, 4200])
def test_manifest_of_any_size(spark, n):
    rows = [(i, f"Text {i}", "en" if i % 50 else f"l{i % 700}", "s", i) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert sorted(map(tuple, merkle.manifest_query(df).collect()), key=repr) == brute_manifest(rows)


def test_manifest_paths_prove_their_leaves(docs):
    for r in merkle.manifest(docs).collect():
        node = r.leaf
        for before, after in r.path:
            node = digest(before, node, after)
        assert node == r.root


def brute_plan(lengths, capacity):
    """One document at a time, from the longest on, over all levels."""
    opened, n = defaultdict(int), 0
    for size in sorted(lengths, reverse=True):
        if size == capacity:
            n += 1
            continue

        def squares(level):
            after = dict(opened)
            after[level] -= 1
            if level + size < capacity:
                after[level + size] = after.get(level + size, 0) + 1
            return sum(v * v for v in after.values())

        fits = [level for level in sorted(opened, reverse=True) if opened[level] and level + size <= capacity]
        if fits:
            level = min(fits, key=squares)
            opened[level] -= 1
        else:
            level, n = 0, n + 1
        if level + size < capacity:
            opened[level + size] += 1
    return n, {k: v for k, v in opened.items() if v}


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_the_sum_of_squares_rule(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, rng.integers(0, 300))
    counts = np.bincount(lengths, minlength=65)
    for steps in (10**6, 20, 1):
        runs = packing.plan(counts, steps)
        held = defaultdict(list)
        for size, rank, taken, first, offset in runs.tolist():
            for k in range(taken):
                held[first + k].append((offset, size))
        for parts in held.values():
            at = 0
            for offset, size in sorted(parts):
                assert offset == at
                at += size
            assert at <= 64
        assert np.bincount([s for parts in held.values() for _, s in parts], minlength=65).tolist() == counts.tolist()
        if steps == 10**6:
            n, opened = brute_plan(lengths.tolist(), 64)
            assert len(held) == n
            assert dict(sorted(opened.items())) == {int(k): int(v) for k, v in zip(*np.unique([sum(s for _, s in p) for p in held.values() if sum(s for _, s in p) < 64], return_counts=True), strict=True)}


def test_plan_goes_one_by_one_whatever_the_number():
    counts = np.bincount(np.random.default_rng(1).integers(1, 65, 140_000), minlength=65)
    want, opened = counts[64], np.zeros(65, np.int64)
    for size in range(63, 0, -1):
        for _ in range(counts[size]):
            before, after = opened[64 - size:0:-1], opened[64:size:-1]
            change = np.where(before > 0, 2 * (after - before) + 2, 10**9)
            change[0] -= before[0] > 0
            held = 64 - size - int(change.argmin()) if before.any() else 0
            opened[held] -= held > 0
            want += held == 0
            opened[held + size] += held + size < 64
    runs = packing.plan(counts)
    at = np.argsort(runs[:, 3], kind="stable")
    fill = np.zeros(int((runs[:, 3] + runs[:, 2]).max()), np.int64)
    for size, _, taken, first, offset in runs[at[np.argsort(runs[at, 4], kind="stable")]].tolist():
        assert (fill[first:first + taken] == offset).all()
        fill[first:first + taken] += size
    assert len(fill) == want and (np.bincount(fill, minlength=65)[:64] == opened[:64]).all()
    assert np.bincount(runs[:, 0], weights=runs[:, 2], minlength=65).tolist() == counts.tolist() and len(runs) < 10_000


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = ["a" * 3000, " " * 3000 + "x", "x\n\n  y\t\tz 's I'LL 're", "<|endoftext|>", "é½ª ß", "\x1c\x85\xa0"]
    everything = docs.select("doc_id", "text").unionByName(more).unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(odd, 1)], "doc_id long, text string"))
    rows = packing.pack_documents(everything.withColumn("part", F.lit("clash")), tokenizer_file("byte_bpe_50k.json"), with_ids=True)
    got = rows.collect()
    want = sorted([*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in everything.collect())
    by, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    whole = []
    for doc_id, parts in by.items():
        parts.sort(key=lambda r: r.start)
        flat = np.frombuffer(b"".join(r.ids for r in parts), "<u4").tolist()
        if doc_id is not None and sum(r.piece == 0 for r in parts) == 1:
            assert [r.piece for r in parts] == list(range(len(parts))) and all(r.length == 1024 for r in parts[1:])
            assert [r.start for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1].tolist()]
            whole.append(flat)
    assert all(w in want for w in whole) and len(whole) > 190
    assert sum(r.length for r in got) == sum(map(len, want))
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(seqs) <= 1.03 * -(-sum(map(len, want)) // 1024)
    for r in packing.sequences(rows).collect():
        parts = sorted(seqs[r.sequence_id], key=lambda p: p.offset)
        assert r.ids == b"".join(p.ids for p in parts) and r.n_tokens == sum(p.length for p in parts) and r.doc_ids == [p.doc_id for p in parts]
    assert packing.pack_documents(everything.limit(0), tokenizer_file("byte_bpe_50k.json")).collect() == []


def test_cut_leaves_the_rest_to_the_first_piece():
    assert [list(x) for x in packing.cut(2500, 1024)] == [[0, 452, 1476], [452, 1024, 1024]]
    assert [list(x) for x in packing.cut(1024, 1024)] == [[0], [1024]] and [list(x) for x in packing.cut(1, 1024)] == [[0], [1]]


@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 33, 65), (40, 64, 128), (3, 100, 7), (5, 0, 4), (0, 8, 3)])
def test_strassen_is_exact(shape):
    m, k, n = shape
    rng = np.random.default_rng(m + n)
    a, b = rng.integers(-2**24, 2**24, (m, k)), rng.integers(-2**24, 2**24, (k, n))
    assert (negatives.strassen(a, b, 2) == (a.astype(object) @ b.astype(object) if k else np.zeros((m, n)))).all()


def test_best_takes_ties_from_the_left():
    rows, columns = negatives.best(np.array([[3, 5, 5, 1, 5], [negatives.NONE] * 4 + [0]]), 2)
    assert list(zip(rows.tolist(), columns.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 4)]


def brute_negatives(rows):
    held = []
    for i, (vec_id, x, label) in enumerate(rows):
        if label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        held.append((i, vec_id, label, [int(np.floor(256 * float(np.float32(v)))) for v in x]))
    out = []
    for i, anchor, label, v in held:
        if anchor is None or anchor % 100:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(v, w, strict=False)), c is None, c or 0, c, k == label) for j, c, k, w in held if j != i))
        for p in [s for s in scored if s[4]][:5]:
            inside = [s for s in scored if not s[4] and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]][:10]
            out += [(anchor, p[3], rank, s[3], -p[0], -s[0]) for rank, s in enumerate(inside, 1)]
    return sorted(out, key=repr)


def test_negatives_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(v) for v in rng.integers(-3, 4, 6) / 4], int(rng.integers(0, 3))) for i in range(420)]
    rows += [(i, x, label) for i, x, label in rows[:4]] + [(700, [0.0] * 6, 1), (800, rows[8][1], None), (900, None, 1), (901, [1.0, None], 1)]
    rows += [(1000, [float("nan"), 1.0], 1), (1001, [float("inf")], 2), (1100, [], 0), (1200, [1.5, -2.0], 2), (None, rows[5][1], 1), (None, rows[5][1], 2), (-100, rows[9][1], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", *[F.lit("clash").alias(n) for n in NAMES]).repartition(4)
    want = brute_negatives(rows)
    assert want and any(r[3] is None for r in want)
    for blocks in ({}, {"anchor_block": 3, "candidate_block": 50}):
        assert sorted((tuple(r) for r in negatives.hard_negatives(df, **blocks).collect()), key=repr) == want
    assert negatives.hard_negatives(df.limit(0)).collect() == []
    assert negatives.hard_negatives(df.where("vec_id % 100 != 0")).collect() == []
    huge = spark.createDataFrame([(0, [1e30], 1), (1, [1.0], 1), (2, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(huge).collect() == []
