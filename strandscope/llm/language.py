"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text in lower case is cut into letter n-grams (a word's edge counts as a character), hashed to
BUCKETS rows of an embedding table whose average goes through a linear softmax. The table is trained
with stochastic gradient descent in numpy on a bounded sample, MAX_SAMPLE labelled rows, drawn evenly
over the languages by a hash of the id, in one task; a row brings it at most BUCKETS counts. A
quarter of the sample is set aside: a temperature that depends on the length is fitted there, and the
confidence and the share of n-grams known from training below which a text is rejected: of the texts set
aside about one in a thousand would be.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Block, blocks, mixed

BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
ORDERS = (2, 3, 4)
WIDTH = 16
MAX_SAMPLE = 2000
MAX_LANGUAGES = 500
EPOCHS = 12
BATCH = 32
RATE = 4.0
SLICE = 500_000
UNKNOWN = "und"
#: No text this many times surer than guessing is rejected, however sure the calibration texts are.
ABOVE_GUESSING = 1.2
#: Nor is one of which this share of n-grams is known from training.
KNOWN_SHARE = 0.5


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _points(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case, with one 0 before, between and after them; where each begins."""
    texts = [block.text(i).lower() for i in range(len(block))]
    points = np.frombuffer(("\0" + "".join(t + "\0" for t in texts)).encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[1], 1 + np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return np.where(letters()[points], points, 0).astype(np.uint64), starts


def subwords(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of every n-gram, a slice of the block at a time."""
    points, starts = _points(block)
    for low in range(0, len(points), SLICE):
        high = min(len(points), low + SLICE)
        part = points[low:min(len(points), high + max(ORDERS) - 1)]
        word = part != 0
        for n in ORDERS:
            many = min(high - low, len(part) - n + 1)
            if many <= 0:
                continue
            code = np.full(many, 0x9E3779B97F4A7C15 * n & (1 << 64) - 1, np.uint64)
            inner = np.ones(many, bool)
            for j in range(n):
                code = code * np.uint64(0x100000001B3) + part[j:j + many]
                if 0 < j < n - 1:
                    inner &= word[j:j + many]
            inner &= word[:many] | word[n - 1:n - 1 + many] if n == 2 else inner
            at = np.flatnonzero(inner)
            yield np.searchsorted(starts, at + low + 1, "right") - 1, (mixed(code[at]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def counted(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each document."""
    total = np.zeros(0, np.int64)
    counts = np.zeros(0, np.int64)
    for docs, buckets in subwords(block):
        keys, n = np.unique(np.clip(docs, 0, len(block) - 1) << BUCKET_BITS | buckets, return_counts=True)
        total, where = np.unique(np.concatenate([total, keys]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([counts, n]), len(total)).astype(np.int64)
    cut = np.searchsorted(total, np.arange(len(block) + 1) << BUCKET_BITS)
    return [(total[a:b] & BUCKETS - 1, counts[a:b]) for a, b in pairwise(cut)]


class Model:
    """Logits per bucket, which buckets training met, a bias, the temperature curve, the rejection thresholds."""

    def __init__(self, languages, table, seen, bias, heat, threshold, least_known):
        self.languages, self.table, self.seen, self.bias, self.heat = languages, table, seen, bias, heat
        self.threshold, self.least_known = threshold, least_known

    def probabilities(self, logits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return _softmax(logits / temperature(self.heat, sizes)[:, None])

    def logits(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, number of n-grams and the share of known ones of each document."""
        n, size = len(block), len(self.languages)
        sums, grams, known = np.zeros((n, size)), np.zeros(n), np.zeros(n)
        for docs, buckets in subwords(block):
            if not len(docs):
                continue
            new = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
            owner = np.clip(docs[new], 0, n - 1)
            grams[owner] += np.diff(np.concatenate([new, [len(docs)]]))
            known[owner] += np.add.reduceat(self.seen[buckets], new, dtype=np.int64)
            for k in range(size):
                sums[owner, k] += np.add.reduceat(self.table[k][buckets], new)
        return sums / np.maximum(grams, 1)[:, None] + self.bias, grams, known / np.maximum(grams, 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def temperature(heat: tuple[float, float], sizes: np.ndarray) -> np.ndarray:
    return heat[0] * (1 + heat[1] / np.sqrt(np.maximum(sizes, 1)))


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model | None:
    """Fits on (language, buckets, counts); None if there is nothing to learn from."""
    samples = [s for s in samples if len(s[1])]
    if not samples:
        return None
    languages = sorted({s[0] for s in samples})
    code = {name: i for i, name in enumerate(languages)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    aside = order[: len(samples) // 4] if len(samples) >= 8 else order
    fit = order[len(samples) // 4:] if len(samples) >= 8 else order
    y = np.array([code[s[0]] for s in samples])
    shares = [(s[2] / s[2].sum()).astype(np.float32) for s in samples]

    # buckets that no sample has stay at zero
    seen = np.unique(np.concatenate([samples[i][1] for i in fit]))
    table = np.zeros((BUCKETS, WIDTH), np.float32)
    table[seen] = rng.uniform(-1, 1, (len(seen), WIDTH)).astype(np.float32) / WIDTH
    weights = np.zeros((WIDTH, len(languages)), np.float32)
    weights[:] = rng.normal(0, 0.1, weights.shape)
    bias = np.zeros(len(languages), np.float32)
    steps, total = 0, EPOCHS * -(-len(fit) // BATCH)
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(fit), -(-len(fit) // BATCH)):
            rate = RATE * (1 - steps / total)
            steps += 1
            cut = np.concatenate([[0], np.cumsum([len(samples[i][1]) for i in at])])
            rows = np.concatenate([samples[i][1] for i in at])
            share = np.concatenate([shares[i] for i in at])
            hidden = np.add.reduceat(table[rows] * share[:, None], cut[:-1])
            error = _softmax(hidden @ weights + bias).astype(np.float32)
            error[np.arange(len(at)), y[at]] -= 1
            error /= len(at)
            back = error @ weights.T
            weights -= rate * hidden.T @ error
            bias -= 0.1 * rate * error.sum(0)
            np.subtract.at(table, rows, 8 * rate * share[:, None] * np.repeat(back, np.diff(cut), 0))
    scores = (table @ weights).T.astype(np.float32)
    logits = np.stack([scores[:, samples[i][1]] @ shares[i] + bias for i in aside])
    sizes = np.array([samples[i][2].sum() for i in aside])
    heat = min(((a, b) for a in (0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0) for b in (0.0, 1.0, 2.0, 4.0, 8.0)),
               key=lambda h: (-np.log(np.maximum(_softmax(logits / temperature(h, sizes)[:, None])[np.arange(len(aside)), y[aside]], 1e-9)).mean(), h))
    sure = _softmax(logits / temperature(heat, sizes)[:, None])
    right = sure.argmax(1) == y[aside]
    held = sure.max(1)[right]
    threshold = min(ABOVE_GUESSING / len(languages), float(np.quantile(held, 0.001))) if len(held) else 0.0
    met = np.zeros(BUCKETS, bool)
    met[seen] = True
    least_known = min(KNOWN_SHARE, float(np.quantile([samples[i][2][met[samples[i][1]]].sum() / samples[i][2].sum() for i in aside], 0.001)))
    return Model(languages, scores, met, bias.astype(np.float64), heat, threshold, least_known)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, rows in blocks(batches):
        found = counted(block)
        yield pa.RecordBatch.from_pydict({
            "lang": rows.column("lang"), "buckets": pa.array([b.astype("<i4").tobytes() for b, _ in found], pa.binary()),
            "counts": pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary())})


def fit_language_model(docs: DataFrame, max_sample: int = MAX_SAMPLE) -> Model | None:
    """Learns from the rows of `docs` with a language and a text (columns doc_id, text, lang)."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    each = max_sample // len(counts)
    drawn = F.xxhash64("doc_id", F.lit(11)).alias("draw")
    wanted = F.lit(0.0)
    for row in counts:
        wanted = F.when(F.col("lang") == row["lang"], F.lit(min(1.0, each / row["count"]))).otherwise(wanted)
    sample = labelled.where((F.pmod(drawn, F.lit(1 << 30)) / (1 << 30)) < wanted).orderBy(drawn, "lang", "text").limit(max_sample)
    features = sample.select("text", "lang").mapInArrow(_features, "lang string, buckets binary, counts binary")
    fitted = features.coalesce(1).mapInArrow(_fitted, "model binary").collect()  # one row at most
    return Model(**pickle.loads(fitted[0]["model"])) if fitted else None


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole bounded sample is trained on by one task, which spares the driver."""
    samples = [(r["lang"], np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["counts"], "<i4")) for batch in batches for r in batch.to_pylist()]
    model = train(samples)
    if model is not None:
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(vars(model))], pa.binary())})


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected), one row per row of `docs`, from the text alone.

    A text that is null or has no letter is `und` with score 0 and rejected; so is every text if there
    was nothing to learn from. Texts below one of the model's thresholds keep their best language and are
    marked rejected. More columns are ignored; repeated rows and ids repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS x MAX_LANGUAGES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for block, rows in blocks(batches):
            if held is None:
                names, score, out = [UNKNOWN] * len(block), np.zeros(len(block)), np.ones(len(block), bool)
            else:
                logits, grams, known = held.logits(block)
                sure = held.probabilities(logits, grams)
                empty = grams == 0
                score = np.where(empty, 0.0, sure.max(1))
                names = [UNKNOWN if e else held.languages[k] for k, e in zip(sure.argmax(1), empty, strict=True)]
                out = empty | (score < held.threshold) | (known < held.least_known)
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "lang_pred": pa.array(names, pa.string()),
                                              "score": pa.array(score, pa.float64()), "rejected": pa.array(out, pa.bool_())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def language_query(docs: DataFrame) -> DataFrame:
    model = fit_language_model(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
