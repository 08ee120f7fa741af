"""Quality rules: fixed counts on every text, and a hashed n-gram classifier.

Words, word pairs and characters' trigrams are hashed into a fixed number of
buckets; a text's features are their relative frequencies.  A logistic
regression is trained on labelled rows, a held-out part of them calibrates its
probability (Platt scaling), and every whole text is scored in Arrow batches
against a fixed threshold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, texts_of

#: Buckets of word features, and as many of character features.
BUCKETS = 1 << 16
#: Labelled rows that train and calibrate, at most; the rows with the smallest hashes of doc_id.
TRAIN_ROWS = 2000
#: Share of them that calibrates.
HELD_OUT = 0.25
#: A text is kept from this probability of good quality on.
THRESHOLD = 0.5

SYMBOLS = re.compile(r"[#*$%&|<>]")
SPACES = re.compile(r"[\x20\x09-\x0D]")
A_WORD = re.compile(r"[^\x20\x09-\x0D]")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def repeated_words(words: list, hashes: np.ndarray | None = None) -> int:
    """Words that lie in a window of three words found twice or more.

    Where all windows' hashes differ, all windows do; only else are the words themselves numbered.
    """
    if len(words) < 4:
        return 0
    if hashes is not None:
        h = np.sort(((hashes[:-2] * _MIX ^ hashes[1:-1]) * _MIX ^ hashes[2:]) * _MIX)
        if not (h[1:] == h[:-1]).any():
            return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    n = len(seen) + 1
    pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pair[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    hit = np.zeros(len(words), dtype=bool)
    for k in range(3):
        hit[k : k + len(twice)] |= twice
    return int(hit.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if A_WORD.search(x)]
    return len(lines) - len(set(lines))


def base_counts(text: str) -> tuple[np.ndarray, int, int, int, int, int, bool]:
    """Hashes of the words, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = text.encode().split()
    hashes = word_hashes(words)
    n = len(words)
    repeat = repeated_words(words, hashes)
    return hashes, n, len(text) - len(SPACES.findall(text)), len(SYMBOLS.findall(text)), duplicate_lines(text), repeat, n < 50 or 100 * repeat > 50 * n


def buckets(text: str, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the word features (words, pairs; from their hashes w) and of the character trigrams, repeats included."""
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    pairs = (w[:-1] * _MIX ^ w[1:]) * _MIX
    word = (np.concatenate([w * _MIX, pairs]) >> shift).astype(np.int32)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    tri = c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42)
    return word, (tri * _MIX >> shift).astype(np.int32)


@dataclass
class Model:
    """Weights of both kinds of buckets, bias, and Platt's scale and shift of the margin."""

    word: np.ndarray
    char: np.ndarray
    bias: float
    scale: float
    shift: float

    def margin(self, text: str, words: np.ndarray) -> float:
        w, c = buckets(text, words)
        return self.bias + (float(self.word[w].mean()) if len(w) else 0.0) + (float(self.char[c].mean()) if len(c) else 0.0)

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -500, 500))))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 150, rate: float = 0.5, decay: float = 1e-5) -> Model:
    """rows: (bucket numbers, values) of each training text, character buckets numbered from BUCKETS on; labels 0 or 1.

    The last HELD_OUT of the rows calibrate.  No rows, or one class only: a constant model
    whose probability is the share of good rows (1 without rows).
    """
    if len(labels) < 8 or labels.min() == labels.max():
        p = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6)) if len(labels) else 1 - 1e-6
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    idx = np.concatenate([r[0] for r in rows])
    val = np.concatenate([r[1] for r in rows])
    ends = np.cumsum([len(r[0]) for r in rows])
    doc = np.repeat(np.arange(len(rows)), np.diff(np.concatenate([[0], ends])))
    cut = max(4, int(len(rows) * (1 - HELD_OUT)))
    train = doc < cut
    y = labels.astype(np.float64)
    weight = np.where(y > 0, 0.5 / max(y[:cut].mean(), 1e-9), 0.5 / max(1 - y[:cut].mean(), 1e-9))
    w = np.zeros(2 * BUCKETS)
    sums = np.full(2 * BUCKETS, 1e-8)
    bias, bias_sum = 0.0, 1e-8
    ti, tv, td = idx[train], val[train], doc[train]
    for _ in range(steps):
        m = np.bincount(td, tv * w[ti], minlength=cut) + bias
        g = weight[:cut] * (_sigmoid(m) - y[:cut]) / cut
        grad = np.bincount(ti, tv * g[td], minlength=2 * BUCKETS) + decay * w
        sums += grad**2
        w -= rate * grad / np.sqrt(sums)
        bias_sum += g.sum() ** 2
        bias -= rate * g.sum() / np.sqrt(bias_sum)
    margins = np.bincount(doc, val * w[idx], minlength=len(rows)) + bias
    held, target = margins[cut:], y[cut:]
    if not len(held) or target.min() == target.max():
        held, target = margins, y
    # Platt's targets keep the fit finite where classes part cleanly
    pos, neg = target.sum(), len(target) - target.sum()
    soft = np.where(target > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = _sigmoid(a * held + b)
        r, s = p - soft, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * held * held).sum() + 1e-6, (s * held).sum()], [(s * held).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([(r * held).sum(), r.sum()]))
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
    if a <= 0:
        a, b = 1.0, 0.0
    return Model(w[:BUCKETS].astype(np.float32), w[BUCKETS:].astype(np.float32), float(bias), float(a), float(b))


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    word, char = buckets(text, word_hashes(text.encode().split()))
    out_i, out_v = [], []
    for part, shift in ((word, 0), (char, BUCKETS)):
        if len(part):
            i, n = np.unique(part, return_counts=True)
            out_i.append(i.astype(np.int32) + shift)
            out_v.append((n / len(part)).astype(np.float32))
    return (np.concatenate(out_i) if out_i else np.zeros(0, np.int32)), (np.concatenate(out_v) if out_v else np.zeros(0, np.float32))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Train on at most ``rows`` labelled rows: those whose doc_id hashes lowest, whatever the tables' size.

    labels: doc_id, quality (0 or 1; others and nulls are left out; of labels that disagree about a doc_id, good wins).  Only the features of these rows
    reach the driver (a few kB each).
    """
    chosen = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` ids: a broadcast of proven size
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            f = [_features(t) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality").cast(pa.int32()), pa.array([x[0].tobytes() for x in f], type=pa.binary()), pa.array([x[1].tobytes() for x in f], type=pa.binary())], names=["doc_id", "quality", "idx", "val"])

    got = found.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, idx binary, val binary")
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    return fit([(np.frombuffer(r.idx, np.int32), np.frombuffer(r.val, np.float32)) for r in got], np.array([r.quality for r in got], dtype=np.int64))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept of every row.

    A null text has no words, so it fails the base rules; rows that repeat are judged each for itself.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # two arrays of BUCKETS floats, whatever the input

    def run(batches):
        m = held.value
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        for b in batches:
            rows = []
            for text in texts_of(b):
                words, *counts, failed = base_counts(text)
                p = m.probability(m.margin(text, words))
                rows.append((*counts, failed, p, not failed and p >= threshold))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True))], names=names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def drop_low_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the rules keep, each judged by its own text, with docs' own columns."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in batches:
            keep = []
            for text in texts_of(b):
                words, *_, failed = base_counts(text)
                keep.append(not failed and m.probability(m.margin(text, words)) >= threshold)
            yield b.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
