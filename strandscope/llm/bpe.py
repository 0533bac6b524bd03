"""BPE encoding and decoding over all words of a block at once.

Texts are cut into words by the vocabulary's pattern. The different words of a block lie side by
side as one row of symbols. An index maps each pair of neighbouring symbols to all its positions;
the active ranks are applied in ascending order, each to all positions of its pair, and the lists of
the neighbouring pairs that a merge makes are extended. A word's ids are kept for later blocks of the
task, up to a number of words that does not change any result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .tables import work_columns
from .text import blocks

#: Fixed value: the word pattern of this vocabulary.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Characters whose classes no Unicode version disputes; other texts are cut by the tokenizer library's splitter.
PLAIN = regex.compile(r"[^\t\n\r\x20-\x7e¡-ɏ]")
KEPT_WORDS = 400_000


@lru_cache(maxsize=2)
def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte (fixed rule: printable Latin-1 stays, others follow from 256 on)."""
    stays = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in stays}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(stays))})
    return out


class Vocabulary:
    """Merge ranks, byte ids and the bytes of every id, read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        alphabet = byte_alphabet()
        ids = held["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.of_byte[b] = ids[c]
        #: (left, right) as one number -> (rank, merged id); a rank is the place in the file
        self.rank, self.merged, born = {}, [], {}
        for rank, (left, right) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in held["model"]["merges"]):
            if max(born.get(left, -1), born.get(right, -1)) >= rank:
                raise ValueError(f"merge {rank} uses a token that is made later")
            born.setdefault(left + right, rank)
            self.rank[ids[left] << 20 | ids[right]] = rank
            self.merged.append((ids[left], ids[right], ids[left + right]))
        self.pair_keys = np.array(sorted(self.rank), np.int64)
        self.pair_ranks = np.array([self.rank[k] for k in self.pair_keys.tolist()], np.int64)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.at_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        keys = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_words(words: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """The ids of every word as little-endian 32-bit integers."""
    sizes = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    symbol = vocab.of_byte[data].astype(np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    closes = np.empty(n, bool)  # the last symbol of a word pairs with nothing
    closes[:-1] = word[1:] != word[:-1]
    closes[-1:] = True
    following[closes] = -1
    opens = np.empty(n, bool)
    opens[1:] = closes[:-1]
    opens[:1] = True
    before[opens] = -1
    alive = np.ones(n, bool)

    left = np.flatnonzero(~closes)
    ranks = vocab.ranks_of(symbol[left], symbol[left + 1])
    left, ranks = left[ranks >= 0], ranks[ranks >= 0]
    order = np.argsort(ranks, kind="stable")
    left, ranks = left[order], ranks[order]
    index: dict[int, list[np.ndarray]] = {}
    if len(ranks):
        cut = np.flatnonzero(np.diff(ranks)) + 1
        for r, where in zip(ranks[np.concatenate([[0], cut])].tolist(), np.split(left, cut), strict=True):
            index[r] = [where]
    active = list(index)
    heapq.heapify(active)

    def extend(positions: np.ndarray) -> None:
        found = vocab.ranks_of(symbol[positions], symbol[following[positions]])
        positions, found = positions[found >= 0], found[found >= 0]
        if not len(found):
            return
        order = np.argsort(found, kind="stable")
        positions, found = positions[order], found[order]
        cut = np.flatnonzero(np.diff(found)) + 1
        for r, where in zip(found[np.concatenate([[0], cut])].tolist(), np.split(positions, cut), strict=True):
            if r in index:
                index[r].append(where)
            else:
                index[r] = [where]
                heapq.heappush(active, r)

    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        a, b, made = vocab.merged[rank]
        where = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        right = following[where]
        still = alive[where] & (symbol[where] == a) & (right >= 0)
        where, right = where[still], right[still]
        still = symbol[right] == b
        where, right = where[still], right[still]
        if a == b and len(where) > 1:
            where, right = _without_overlaps(np.sort(where), following)
        if not len(where):
            continue
        symbol[where] = made
        alive[right] = False
        after = following[right]
        following[where] = after
        inner = after >= 0
        before[after[inner]] = where[inner]
        prior = before[where]
        extend(np.unique(np.concatenate([where[inner], prior[prior >= 0]])))

    ids = symbol[alive].astype("<u4").tobytes()
    ends = np.cumsum(np.bincount(word[alive], minlength=len(words))) * 4
    at = [0, *ends.tolist()]
    return [ids[at[i]:at[i + 1]] for i in range(len(words))]


def _without_overlaps(where: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In a chain x x x the pairs are taken from the left, each symbol once: every second link of a chain."""
    chained = np.zeros(len(where), bool)
    chained[1:] = following[where[:-1]] == where[1:]
    begins = np.flatnonzero(~chained)
    place = np.arange(len(where)) - begins[np.cumsum(~chained) - 1]
    where = where[place % 2 == 0]
    return where, following[where]


def split_words(text: str, splitter=None) -> list[str]:
    """The words of a text without special tokens."""
    if PLAIN.search(text) is None:
        return PATTERN.findall(text)
    from tokenizers import pre_tokenizers

    cutter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return [text[a:b] for _, (a, b) in cutter.pre_tokenize_str(text)] if text else []


class Encoder:
    """Encodes texts in small groups, remembering words."""

    def __init__(self, vocab: Vocabulary, kept_words: int = KEPT_WORDS):
        self.vocab, self.known, self.kept_words = vocab, {}, kept_words

    def _cut(self, text: str) -> list[str]:
        """Words; a special token stands between them as itself."""
        if self.vocab.at_special is None or self.vocab.at_special.search(text) is None:
            return split_words(text)
        out, at = [], 0
        for found in self.vocab.at_special.finditer(text):
            out += split_words(text[at:found.start()])
            out.append((found.group(),))
            at = found.end()
        return out + split_words(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.kept_words:
            self.known.clear()
        for token, i in self.vocab.special.items():
            self.known[(token,)] = np.array([i], "<u4").tobytes()
        cuts = [self._cut(t) for t in texts]
        fresh: set = set()
        for cut in cuts:
            fresh.update(cut)
        fresh = sorted(w for w in fresh if w not in self.known)
        if fresh:
            self.known.update(zip(fresh, merge_words([w.encode("utf-8") for w in fresh], self.vocab), strict=True))
        known = self.known
        return [b"".join([known[w] for w in cut]) for cut in cuts]


def decode(ids: np.ndarray, vocab: Vocabulary) -> bytes:
    """The UTF-8 text of the ids; bytes that are no UTF-8 become the replacement character."""
    sizes = vocab.lengths[ids]
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    at = np.arange(total) + np.repeat(vocab.starts[ids] - (ends - sizes), sizes)
    raw = vocab.flat[at].tobytes()
    return raw.decode("utf-8", "replace").encode("utf-8")


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids binary, decoded string]), one row per input row.

    A null text counts as empty and has no ids. `ids` are little-endian unsigned 32-bit integers. Rows
    are treated one by one, so repeated rows and ids repeat; no rows give no rows; more columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        encoder = Encoder(vocab)
        for block, rows in blocks(batches):
            coded = encoder.encode([block.text(i) for i in range(len(block))])
            counts, hashes, texts = [], [], []
            for ids in coded:
                text = decode(np.frombuffer(ids, "<u4"), vocab)
                counts.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                texts.append(text if with_ids else hashlib.sha256(text).hexdigest())
            columns = {"doc_id": rows.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(hashes, pa.string())}
            if with_ids:
                columns["decoded_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
                columns |= {"ids": pa.array(coded, pa.binary()), "decoded": pa.array([t.decode() for t in texts], pa.string())}
            else:
                columns["decoded_sha256"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return work_columns(docs).mapInArrow(run, RESULT + (", ids binary, decoded string" if with_ids else ""))
