"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from strandscope.llm import bpe, chat, decontaminate, exact_dedup, language, lm, near_dedup, sharding, substrings, token_files
from strandscope.llm.queries import tokenizer_file
from strandscope.llm.tables import shared_folder
from strandscope.llm.text import Block, Words

LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(30_000))
ROWS = [
    (5, "Same  text\there"), (2, "Same text here"), (2, "Same text here"), (7, None), (9, ""), (11, "   \n "), (12, "x"),
    (13, LONG), (14, LONG + " tail"), (15, "日本語 ½ <|endoftext|> é"), (None, "text without an id but with words"), (16, "text without an id but with words"),
]
NAMES = "content slice head place in_slice cell rank node label bucket band first members gone_id row own top stays blob train key kind n gram spans".split()


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
    return base.select("*", *[F.lit(f"clash {n}").alias(n) for n in NAMES]).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


OPERATORS = {
    "language": lambda d: language.language_query(d),
    "substrings": lambda d: substrings.remove_repeats(d),
    "bpe": lambda d: bpe.bpe_documents(d, tokenizer_file("byte_bpe_50k.json")),
    "exact": lambda d: exact_dedup.exact_groups(d),
    "sharding": lambda d: sharding.shard_rows(d),
    "near": lambda d: near_dedup.near_components(d),
    "lm": lambda d: lm.scoring_query(d),
    "files": lambda d: token_files.token_files_query(d, tokenizer_file("word_bpe_49k.json")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_row_and_none_for_none(docs, none, name):
    got = OPERATORS[name](docs).select("doc_id").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in ROWS)
    assert OPERATORS[name](none).count() == 0


def test_exact_ties_and_repeats(docs):
    rows = exact_dedup.exact_groups(docs).collect()
    same = [r for r in rows if r.doc_id in (2, 5)]
    assert [r.group_size for r in same] == [3, 3, 3] and {r.keep_id for r in same} == {2} and sum(r.kept for r in same) == 1
    empty = {r.doc_id: r for r in rows if r.doc_id in (7, 9)}
    assert empty[7].kept and not empty[9].kept and empty[9].keep_id == 7
    blank = next(r for r in rows if r.doc_id == 11)
    assert blank.text_sha256 == hashlib.sha256(b" ").hexdigest()
    lost = [r for r in rows if r.doc_id in (None, 16)]
    assert {r.keep_id for r in lost} == {16} and [r.kept for r in sorted(lost, key=lambda r: r.doc_id is None)] == [True, False]
    left = exact_dedup.keep_first(docs)
    assert sorted(r.doc_id or -1 for r in left.collect()) == [2, 7, 11, 12, 13, 14, 15, 16] and left.columns == docs.columns


def test_stages_decide_row_by_row(spark, docs, none):
    sf = "/root/testdata/sf0.001"
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        left[name] = sorted(r.doc_id or -1 for r in out.collect())
        assert name == "bpe" or out.columns == docs.columns
        assert stage(spark, none, sf).count() == 0
    assert not {7, 9, 11} & set(left["language_id"])
    assert (-1 in left["language_id"]) == (16 in left["language_id"])  # one text, one fate
    assert left["near_dedup"] == [2, 7, 9, 11, 12, 13, 15, 16]
    assert left["decontamination"] == left["bpe"] == sorted(i or -1 for i, _ in ROWS)


def test_rows_without_ids_and_with_repeated_ids_are_told_apart(spark):
    """Rows leave by their own text, however many share an id or have none; of equal rows one stays."""
    rows = [(None, f"text {i % 7}") for i in range(40)] + [(3, "text 1"), (3, "other"), (3, "other"), (8, "text 2"), (9, "text 9")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("gone_id", F.lit(3)).repartition(5)
    left = exact_dedup.keep_first(df)
    assert left.columns == df.columns
    got = sorted((r.doc_id or -1, r.text) for r in left.collect())
    assert got == sorted([(-1, f"text {i}") for i in (0, 3, 4, 5, 6)] + [(3, "text 1"), (3, "other"), (8, "text 2"), (9, "text 9")])
    empty = spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string")
    assert exact_dedup.keep_first(empty).count() == 1


def test_shards_by_a_walk_over_single_rows(spark):
    ids = [*range(0, 6000, 3), *[5] * 40, *[None] * 300]
    df = spark.createDataFrame([(i, "t" * (k % 9)) for k, i in enumerate(ids)], "doc_id long, text string").repartition(4)
    for shards in (24, 25):
        spots = {}
        for shard in range(shards):
            for node in range(64):
                spots.setdefault(zlib.crc32(f"shard {shard} node {node}".encode()) >> 18, []).append(shard)
        ring = [(cell, min(owners)) for cell, owners in sorted(spots.items())]
        place = {i: 42 if i is None else xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42) for i in ids}
        room = [len(ids) // shards + (s < len(ids) % shards) for s in range(shards)]
        used, want, waiting = [0] * shards, Counter(), []
        for i in sorted(ids, key=lambda i: place[i]):
            cell = place[i] >> 50
            at = next((k for k, (c, _) in enumerate(ring) if c >= cell), 0)
            home = ring[at][1]
            if used[home] < room[home]:
                used[home] += 1
                want[i, home, home] += 1
            else:
                waiting.append((i, home, at))
        for i, home, at in waiting:
            while used[ring[at][1]] == room[ring[at][1]]:
                at = (at + 1) % len(ring)
            used[ring[at][1]] += 1
            want[i, home, ring[at][1]] += 1
        assert waiting and Counter((r.doc_id, r.home_shard, r.shard) for r in sharding.shard_rows(df, shards).collect()) == want


def test_twenty_thousand_items_of_one_size_in_bounded_memory():
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(["which", "of", "these", "is", "right", *(vocabulary[j] for j in rng.integers(0, 400, 35))])) for i in range(20_000)]
    index = decontaminate.item_index(items, 5)
    planted = sorted(rng.choice(20_000, 300, replace=False).tolist())
    text = " ".join(f"{items[i][1].replace('these', 'those')} which of these is right {' '.join(vocabulary[j] for j in rng.integers(0, 400, 20))}" for i in planted)
    raw = np.frombuffer(text.encode(), np.uint8)
    words = Words(Block([1], raw, np.array([0, len(raw)]), np.zeros(1, bool)))
    filters = {5: decontaminate._filter_bits(index[40].known)}
    tracemalloc.start()
    best = decontaminate.block_matches(words, index, filters, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(index[40].ids[i] for _, _, i in best) == planted and len(words.hash) > 19_000
    assert peak < 500_000_000


def test_shards_are_full_and_gapless(docs, spark):
    many = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("é").alias("text"))
    rows = sharding.shard_rows(many).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {len(s) for s in slots.values()} == {41, 42}
    assert {(r.size, r.law) for r in rows} == {(10, "rows")}
    assert {r.size for r in sharding.shard_rows(docs).where("doc_id in (7, 9)").collect()} == {8}
    grown = {r.doc_id: r.shard for r in sharding.shard_rows(many, 25).collect()}
    moved = sum(grown[r.doc_id] != r.shard for r in rows)
    assert moved < 400  # dealing anew would move 24 of 25
    home = sum(r.home_shard == r.shard for r in rows)
    assert home > 750


def test_near_edges(docs):
    rows = {r.doc_id: r for r in near_dedup.near_components(docs).where("doc_id is not null").collect()}
    assert rows[5].component_id == 2 and not rows[5].kept and rows[2].kept
    assert [rows[i].n_shingles for i in (7, 9, 11, 12)] == [0, 0, 0, 1]
    assert all(rows[i].component_id == i for i in (7, 9, 11, 12)) and rows[14].component_id == 13


def test_language_edges(docs):
    rows = {r.doc_id: r for r in language.language_query(docs).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].rejected and rows[i].score == 0 for i in (7, 9, 11))
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.language_query(unlabelled).collect()} == {"und"}


def test_decontamination_edges(spark, docs, none):
    passage = "text without an id but with words"
    benchmark = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (4, "x"), (None, LONG)], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    rows = {r.doc_id: r for r in decontaminate.decontamination_query(docs, benchmark).collect()}
    assert rows[16].item_ids == [1] and rows[16].best_similarity == 1 and rows[12].item_ids == [4]
    assert rows[13].contaminated and rows[14].contaminated and rows[None].item_ids == [1]
    assert not rows[7].contaminated and rows[7].best_similarity is None and not rows[5].contaminated
    assert decontaminate.decontamination_query(none, benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontamination_query(docs, benchmark.limit(0)).collect())
    left = decontaminate.without_leaks(docs, benchmark)
    assert left.columns == docs.columns and sorted(r.doc_id or -1 for r in left.collect()) == [2, 2, 5, 7, 9, 11, 15]  # the row without an id goes by its own text


def test_chat_edges(spark):
    turns = [(1, 2, "user", "b\\"), (1, 1, "user", "<|im_next|>"), (1, 3, "assistant", "\\<|x"), (1, 3, "assistant", None), (2, None, None, "n"), (None, 0, "assistant", "é<|im_end|>\n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    rows = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert [tuple(t) for t in rows[1].turns] == [("user", "<|im_next|>"), ("user", "b\\"), ("assistant", ""), ("assistant", "\\<|x")]
    assert rows[1].loss_texts == ["", "\\<|x"] and rows[None].loss_texts == ["é<|im_end|>\n"] and [tuple(t) for t in rows[2].turns] == [("", "n")]
    assert rows[1].formatted.count("<|im_start|>") == 2
    assert chat.chat_digests(df.limit(0)).count() == 0


def test_scores_without_training(docs):
    rows = {r.doc_id: r for r in lm.score_documents(docs, F.lit(False)).collect()}
    assert rows[9].n_tokens == 1 and rows[9].n_known == 0 and rows[9].train_tokens == 0 and rows[9].base_score == 0
    assert rows[12].score == pytest.approx(-16 * np.log10(2))


def test_token_files_hold_every_id(spark, docs):
    folder = shared_folder(spark, "token-files")
    token_files.write_token_files(docs, folder, tokenizer_file("word_bpe_49k.json"))
    rows = token_files.read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([i for i, _ in ROWS], key=lambda i: (i is not None, i or 0))
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens and np.frombuffer(r.ids, "<u4")[-1] == 2
        at += r.n_tokens
