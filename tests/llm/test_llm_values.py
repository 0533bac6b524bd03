"""Results against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandscope.llm import bpe, decontaminate, language, lm, near_dedup, substrings, token_files
from strandscope.llm.queries import QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def split(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]


def brute_repeats(docs, length):
    seen, out = set(), {}
    for i, text in sorted(docs):
        raw, gone = (text or "").encode(), set()
        for s in range(len(raw) - length + 1):
            if raw[s:s + length] in seen:
                gone.update(range(s, s + length))
            seen.add(raw[s:s + length])
        spans = sum(1 for p in gone if p - 1 not in gone)
        out[i] = (len(raw), len(gone), spans, hashlib.sha256(bytes(b for p, b in enumerate(raw) if p not in gone)).hexdigest())
    return out


@pytest.mark.parametrize(("few", "many", "length"), [(64, 1000, 100), (1, 2, 100), (1, 2, 40)])
def test_repeated_substrings(spark, monkeypatch, few, many, length):
    monkeypatch.setattr(substrings, "FEW", few)
    monkeypatch.setattr(substrings, "MANY", many)
    rng = random.Random(length + few)
    base = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 300))) for _ in range(6)]
    docs = [(i, "".join(rng.choice(base)[rng.randint(0, 80):][:rng.randint(0, 250)] if rng.random() < 0.6 else
                        "".join(rng.choice("abc") for _ in range(rng.randint(0, 120))) for _ in range(rng.randint(0, 4)))) for i in range(150)]
    docs += [(300, "a" * 700), (301, "ab" * 400), (302, "a" * 120), (303, "é" * 200), (304, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(df, length).collect()}
    assert got == brute_repeats(docs, length)


def test_repeated_substrings_of_documents(documents, texts):
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(documents).collect()}
    assert got == brute_repeats(texts.items(), 100)


def test_radix_sort_drops_and_finds():
    rows = np.frombuffer(b"aaaaaaaaaaxaaaaaaaaaayaaaaaaaaaaxbbbbbbbbbbb", np.uint8).reshape(4, 11)
    again = substrings.repeated_starts(rows, np.zeros(4), np.array([3, 1, 2, 0]), np.zeros(4, np.int64))
    assert again.tolist() == [True, False, False, False]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_bpe_equals_the_library(spark, documents, texts, name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file(name))
    odd = ["", None, "aaaaaaaaaaaaaaa", "a  b   c\n\n d", "x<|endoftext|>y", "日本語 ½ ⅷ ​ \x1c \x85 x", "😀😀 test's 're I'LL", "ab" * 900, "é́ İ"]
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    for r in bpe.bpe_documents(df, tokenizer_file(name), with_ids=True).collect():
        text = texts[r.doc_id] if r.doc_id < 10_000 else odd[r.doc_id - 10_000] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_token_files_equal_the_library(documents, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    rows = {r.doc_id: r for r in QUERIES["op10_token_files"](documents.sparkSession, SF).collect()}
    at = 0
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 2]
        assert tuple(rows[i]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_words_are_cut_as_the_library_does():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), token_files.Tokenizer(tokenizer_file("word_bpe_49k.json"))
    rng = random.Random(5)
    some = ["".join(rng.choice("ab'sStTrReEvVmMlLdD 1  2!?.-éÉßÇ\n\t½²ªº'''") for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["İ ſ", "日本"]
    assert [np.frombuffer(c, "<u4").tolist() for c in own.encode(some)] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


def test_variable_length_code():
    values = np.array([0, 1, 255, 256, 65_535, 65_536, 2**24, 2**32 - 1, 7], np.uint32)
    assert token_files.unpack(*token_files.pack(values), len(values)).tolist() == values.tolist()
    assert token_files.unpack(*token_files.pack(values[:0]), 0).tolist() == []
    names, ranks = token_files.ranked(np.array([9, 4, 9, 4, 1], np.uint32))
    assert names.tolist() == [4, 9, 1] and ranks.tolist() == [1, 0, 1, 0, 2]


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.language_query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) > 0.97 * len(rows)
    assert not any(r.rejected for r in rows)
    foreign = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 5)], "doc_id long, text string")
    model = language.fit_language_model(docs)
    assert language.identify(foreign, model).first().rejected


def brute_components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, s in sets.items():
        for item in s:
            by.setdefault(item, []).append(i)
    near = Counter((a, b) for ids in by.values() for a in ids for b in ids if a < b)
    for (a, b), same in near.items():
        if 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def shingle_set(text, k):
    words = split(text)
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


@pytest.mark.parametrize("size", [2, 5])
def test_near_components(documents, texts, size):
    sets = {i: shingle_set(t, size) for i, t in texts.items()}
    rows = {r.doc_id: r for r in near_dedup.near_components(documents, size).collect()}
    assert {i: r.n_shingles for i, r in rows.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in rows.items()} == brute_components(sets)


def test_near_components_of_chains(spark):
    """Neighbours of a chain are linked, its ends are not; many share a bucket with a hub they are not linked with."""
    rng = random.Random(4)
    docs, words = [], [f"w{i}" for i in range(60)]
    for i in range(250):
        docs.append((i, " ".join(words)))
        words = list(words)
        words[rng.randrange(60)] = f"n{i}"
        if i % 83 == 82:
            words = [f"f{i}x{j}" if rng.random() < 0.3 else w for j, w in enumerate(words)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(df).collect()}
    assert got == brute_components({i: shingle_set(t, 2) for i, t in docs})


def test_contraction_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in near_dedup.contracted(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_decontamination(spark, documents, texts):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: split(r.text) for r in benchmark.collect()}
    planted = {20_000 + k: "some words before " + " ".join(w if j != len(items[k]) // 2 else "changed" for j, w in enumerate(items[k])) + " and after" for k in items}
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(list(planted.items()), "doc_id long, text string"))
    got = {r.doc_id: set(r.item_ids) for r in decontaminate.decontamination_query(df, benchmark).collect()}
    for i, text in {**texts, **planted}.items():
        words, want = split(text), set()
        for k, item in items.items():
            n = len(item)
            a = Counter(tuple(item[s:s + 5]) for s in range(n - 4))
            for s in range(len(words) - n + 1):
                b = Counter(tuple(words[s + j:s + j + 5]) for j in range(n - 4))
                same = sum((a & b).values())
                if 5 * same >= 4 * (2 * (n - 4) - same):
                    want.add(k)
                    break
        assert got[i] == want, i


def test_decontamination_of_documents_shorter_than_the_item(spark):
    """Copies with words missing, as whole documents, among them ones just above and just below the threshold."""
    items = {r.item_id: split(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(15).collect()}
    items |= {1000 + n: [f"u{n}x{j}" for j in range(n)] for n in range(1, 40)}
    benchmark = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    texts = {}
    for k, item in items.items():
        for cut in (1, 2, len(item) // 6, len(item) // 4):
            texts[len(texts)] = item[:len(item) - cut]
            texts[len(texts)] = item[cut:]
        texts[len(texts)] = item[:len(item) // 2] + item[len(item) // 2 + 1:]
        texts[len(texts)] = ["other"] + item[2:]
    df = spark.createDataFrame([(i, " ".join(v)) for i, v in texts.items()], "doc_id long, text string").repartition(3)
    got = {r.doc_id: dict.fromkeys(r.item_ids, r.best_similarity) for r in decontaminate.decontamination_query(df, benchmark).collect()}
    short = 0
    for i, words in texts.items():
        want = {}
        for k, item in items.items():
            n, size = len(item), min(5, len(item))
            a = Counter(tuple(item[s:s + size]) for s in range(n - size + 1))
            for s in range(max(0, len(words) - n) + 1):
                b = Counter(tuple(words[s + j:s + j + size]) for j in range(min(n, len(words)) - size + 1))
                same = sum((a & b).values())
                if same and 5 * same >= 4 * (a.total() + b.total() - same):
                    want[k] = max(want.get(k, 0), same / (a.total() + b.total() - same))
                    short += len(words) < n
        assert set(got[i]) == set(want), i
        assert not want or set(got[i].values()) == {max(want.values())}
    assert short > 100


def brute_tree(strings, depth):
    """Weighted probability of every string's last byte, decision by decision, by plain recursion."""
    counts = {}
    for s, n in strings.items():
        for bit in range(8):
            node = (1 << bit) | s[-1] >> (8 - bit)
            for d in range(depth + 1):
                counts.setdefault((s[len(s) - 1 - d:-1], node), [0, 0])[s[-1] >> (7 - bit) & 1] += n
    children = {}
    for context, node in counts:
        if context:
            children.setdefault((context[1:], node), []).append((context, node))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(key):
        own = kt(*counts[key])
        if len(key[0]) == depth:
            return own, own, 0.0
        split_ = sum(weighted(c)[0] for c in children.get(key, []))
        return np.logaddexp(own, split_) - math.log(2), own, split_

    def probability(context, byte):
        total = 0.0
        for bit in range(8):
            node, one = (1 << bit) | byte >> (8 - bit), byte >> (7 - bit) & 1
            p = 0.5
            for d in range(depth, -1, -1):
                key = (context[len(context) - d:], node)
                if key not in counts:
                    p = 0.5
                    continue
                n = counts[key]
                estimate = (n[one] + 0.5) / (sum(n) + 1)
                _, own, split_ = weighted(key)
                beta = math.exp(own - split_)
                p = estimate if d == depth else (beta * estimate + p) / (beta + 1)
            total += math.log10(p)
        return total

    return probability


def test_context_trees():
    text, depth = b"\xff\xff" + b"abracadabra abracadabra barbara" + b"\xff", 2
    strings = Counter(text[i:i + depth + 1] for i in range(len(text) - depth))
    code = lambda s: int.from_bytes(s, "big")
    kept = {2: np.unique(np.array([code(s[:2]) for s in strings], np.uint64))}
    trees = lm.ContextTrees(np.array([code(s) for s in strings], np.uint64), np.array(list(strings.values())), kept, depth)
    want = brute_tree(strings, depth)
    for context in (b"ab", b"ra", b"\xff\xff"):
        every = np.array([code(context + bytes([x])) for x in range(256)], np.uint64)
        got = trees.log10_of(every)
        assert (10.0 ** got).sum() == pytest.approx(1)
        assert got == pytest.approx([want(context, x) for x in range(256)], rel=1e-5)
    unseen = trees.log10_of(np.array([code(b"zq" + bytes([x])) for x in range(256)], np.uint64))
    assert (10.0 ** unseen).sum() == pytest.approx(1)


def test_bounded_trees_still_add_up(spark):
    strings = Counter()
    raw = (b"\xff" * 3 + b"the cat sat on the mat and the rat ate the cat that sat " * 3 + b"zebra quilt") * 2
    for i in range(len(raw) - 3):
        strings[int.from_bytes(raw[i:i + 4], "big")] += 1
    df = spark.createDataFrame(list(strings.items()), "key long, n long")
    trees = lm.fit_trees(df, depth=3, max_grams=30)
    assert len(trees.kept[3]) < len({s >> 8 for s in strings})
    assert trees.grams.size and sum(strings.values()) == pytest.approx(sum(strings.values()))
    for context in (b"the", b"zeb", b"xyz"):
        every = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)], np.uint64)
        assert (10.0 ** trees.log10_of(every)).sum() == pytest.approx(1)


def test_lm_scores_use_every_context(spark, monkeypatch):
    """Whatever MAX_GRAMS is, scores are those of the whole tree; small blocks and many buckets meet."""
    monkeypatch.setattr(lm, "MAX_GRAMS", 30)
    monkeypatch.setattr(lm.fit_trees, "__defaults__", (lm.DEPTH, 30))
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(["tree", "trace", "étude", "zebra", "quilt", "日本"]) + rng.choice(["", "s", "x"]) for _ in range(rng.randrange(12))) for i in range(120)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    for depth in (1, 5):
        held = lambda s: b"\xff" * depth + s.encode() + b"\xff"  # noqa: B023, E731
        strings = Counter(raw[j:j + depth + 1] for i, t in texts.items() if i % 3 for raw in [held(t)] for j in range(len(raw) - depth))
        code = lambda s: int.from_bytes(s, "big")
        kept = {d: np.unique(np.array([code(s[-1 - d:-1]) for s in strings], np.uint64)) for d in range(2, depth + 1)}
        trees = lm.ContextTrees(np.array([code(s) for s in strings], np.uint64), np.array(list(strings.values())), kept, depth)
        rows = lm.score_documents(df, F.col("doc_id") % 3 != 0, depth).collect()
        assert len(rows) == len(texts)
        for r in rows:
            raw = held(texts[r.doc_id])
            want = trees.log10_of(np.array([code(raw[j:j + depth + 1]) for j in range(len(raw) - depth)], np.uint64)).sum()
            assert r.score == pytest.approx(want, rel=1e-5), (depth, r.doc_id)


def test_lm_scores(documents, texts):
    rows = {r.doc_id: r for r in lm.scoring_query(documents).collect()}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    count = Counter(w for i in train for w in [*split(texts[i]), None])
    n, v = sum(count.values()), len(count)
    for i, text in texts.items():
        tokens = [*split(text), None]
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(tokens), sum(count[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens))
        assert r.score < 0
    rare = {r.doc_id: r for r in lm.score_documents(documents, ~lm.held_out(F.col("doc_id")), max_words=50).collect()}
    assert all(rare[i].n_known == rows[i].n_known and rare[i].base_score == pytest.approx(rows[i].base_score) for i in texts)
    bits = -sum(r.score for r in rows.values() if r.held_out) / math.log10(2)
    assert bits < 2.5 * sum(len(texts[i].encode()) + 1 for i in texts if i not in train)


def test_pipeline_stages(spark, documents, texts):
    docs, kept = documents, dict(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == documents.columns
        left = {r.doc_id: r.text for r in out.collect()}
        if name == "exact_dedup":
            first = {}
            for i in sorted(kept):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i]), i)
            assert set(left) == set(first.values())
        if name == "near_dedup":
            labels = brute_components({i: shingle_set(t, 5) for i, t in kept.items()})
            assert set(left) == set(labels.values())
        if name == "decontamination":
            assert 0 < len(kept) - len(left) < 10
        if name == "language_id":
            assert len(kept) - len(left) <= 1
        docs, kept = documents.where(F.col("doc_id").isin(list(left))), left
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(rows) == set(kept) and all(r.n_tokens > 0 and r.decoded_sha256 == hashlib.sha256(kept[i].encode()).hexdigest() for i, r in rows.items())
