"""Quality rules: base statistics of a text, and logistic regression on hashed n-grams.

Features are hashed word unigrams and bigrams and character trigrams of the whole text, as shares of the
text. The model is trained on a bounded sample of labelled rows, its scores are calibrated on a held-out
part by Platt's method, and every document is scored in Arrow batches against a fixed threshold.

Null and empty texts have no words and fail the base rule. Ties and repeated rows are scored alike. With
no labelled rows of both classes the verdict is true wherever the base rule holds. An empty table gives an
empty result. A very long text is scored whole, alone in its slice, with some arrays of 8 bytes for each of
its bytes. Only doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, cut, mix64, slices, table, text_bytes, word_hashes

#: Most labelled rows that the model sees; they are chosen by a hash of their id.
SAMPLE = 4000
#: Buckets of the hashed features; at most 2**15, as they are kept in 16 bits.
BUCKETS = 1 << 14
#: Documents below this calibrated probability of good quality are dropped.
KEEP_FROM = 0.4
#: Fixed values of the base rule.
MIN_WORDS, MOST_REPEATED = 50, 0.5
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")


def repeated_words(words: list[str]) -> int:
    """Words that stand in a run of three words found at least twice in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : i + n] |= twice
    return int(covered.sum())


def base_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated_words(words)


def gram_buckets(texts: list[bytes], buckets: int = BUCKETS) -> list[list[np.ndarray]]:
    """For each text the buckets of its words, pairs of words and runs of three bytes, in order."""
    words, starts = word_hashes(texts)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))

    def bucket(x: np.ndarray, seed: int) -> np.ndarray:
        return ((mix64(x + np.uint64(seed)) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)

    def runs(lo: int, hi: int) -> np.ndarray:
        b = raw[lo : hi + 2].astype(np.uint64)
        return bucket(mix64(b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]), 2)

    n = max(0, len(raw) - 2)
    kinds = [
        (bucket(words, 0), starts, 0),
        (bucket(mix64(words[:-1] * np.uint64(3) + words[1:]), 1), starts, 1),
        (np.concatenate([runs(lo, min(n, lo + SLICE_BYTES)) for lo in range(0, n, SLICE_BYTES)] or [np.zeros(0, np.int32)]), offsets, 2),
    ]
    return [[x[begin[i] : max(begin[i], begin[i + 1] - short)] for x, begin, short in kinds] for i in range(len(texts))]


def features(grams: list[np.ndarray], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """A text's grams as (bucket, value): square roots of counts, scaled to length 1 for each kind."""
    where, value = [np.zeros(0, np.int16)], [np.zeros(0, np.float32)]
    for x in grams:
        count = np.bincount(x, minlength=buckets)
        at = np.flatnonzero(count)
        where.append(at.astype(np.int16))
        value.append(np.sqrt(count[at] / max(1, len(x))).astype(np.float32))
    return np.concatenate(where), np.concatenate(value)


def csr(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[pa.Array, pa.Array]:
    """Sparse rows as two list columns."""
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(r[0]) for r in rows]))).astype(np.int32))
    at, value = (np.concatenate([r[k] for r in rows] or [np.zeros(0)]) for k in (0, 1))
    return pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int16))), pa.ListArray.from_arrays(offsets, pa.array(value.astype(np.float32)))


def rows_of(at: pa.ChunkedArray, value: pa.ChunkedArray, order: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the columns of csr(), row by row in the order given; nothing is copied."""
    found = []
    for a, v in zip(at.chunks, value.chunks, strict=True):
        x, y, ends = a.values.to_numpy(), v.values.to_numpy(), a.offsets.to_numpy()
        found += [(x[i:j], y[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return [found[i] for i in order]


def hashed(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """docs (doc_id, text, y) to doc_id, y, at, value for training; used on bounded samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for lo, hi in slices(texts):
                rows = [features(g, buckets) for g in gram_buckets(texts[lo:hi], buckets)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *csr(rows)], names=["doc_id", "y", "at", "value"])

    return docs.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, at array<short>, value array<float>")


class Logistic:
    """Logistic regression on sparse rows, by AdaGrad in mini-batches with a fixed seed."""

    def __init__(self, buckets: int) -> None:
        self.w, self.bias, self.a, self.b = np.zeros(buckets), 0.0, 1.0, 0.0

    @classmethod
    def of(cls, values: dict) -> Logistic:
        """A model from vars() of another; those are plain values, which any worker can load."""
        own = cls(0)
        vars(own).update(values)
        return own

    def raw(self, at: np.ndarray, value: np.ndarray) -> float:
        return float(self.w[at] @ value) + self.bias

    def raw_of(self, grams: list[np.ndarray]) -> float:
        """raw(*features(grams)), without the list of the buckets that have a count."""
        return sum(float(self.w @ np.sqrt(np.bincount(x, minlength=len(self.w)))) / np.sqrt(len(x)) for x in grams if len(x)) + self.bias

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, rate: float = 0.3, l2: float = 1e-5) -> Logistic:
        rng, seen, seen_bias = np.random.default_rng(1), np.full(len(self.w), 1e-3), 1e-3
        share = np.clip(y.mean(), 0.02, 0.98)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for batch in np.array_split(order, max(1, len(order) // 32)):
                at = np.concatenate([rows[i][0] for i in batch])
                value = np.concatenate([rows[i][1] for i in batch])
                own = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
                z = np.bincount(own, self.w[at] * value, len(batch)) + self.bias
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) * weight[batch] / len(batch)
                grad = np.bincount(at, err[own] * value, len(self.w)) + l2 * self.w
                seen += grad * grad
                self.w -= rate * grad / np.sqrt(seen)
                seen_bias += err.sum() ** 2
                self.bias -= rate * err.sum() / np.sqrt(seen_bias)
        return self

    def calibrate(self, raw: np.ndarray, y: np.ndarray) -> Logistic:
        self.a, self.b = platt(raw, y)
        return self

    def probability(self, raw: float | np.ndarray) -> float | np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * raw + self.b, -30, 30)))


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that map scores to probabilities, with Platt's smoothed targets, by Newton steps."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    theta = np.array([0.0, np.log((pos + 1) / (neg + 1))])
    x = np.stack([raw, np.ones_like(raw)], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - goal) + 1e-3 * theta)
        theta = theta - step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, y of at most `most` labelled documents, by hash of their id. Labels of other documents don't count."""
    y = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("y"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    some = cut(y.join(own.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(most))
    return own.join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> Logistic | None:
    """A calibrated model from a bounded sample of labelled rows; None where a class is missing."""
    found = hashed(labelled_sample(docs, labels, sample), buckets).toArrow()
    order = np.argsort(found.column("doc_id").to_numpy())
    y = found.column("y").to_numpy()[order].astype(float)
    rows = rows_of(found.column("at"), found.column("value"), order)
    held = np.arange(len(rows)) % 4 == 0
    if len(rows) < 8 or len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        return None
    model = Logistic(buckets).fit([r for r, h in zip(rows, held, strict=True) if not h], y[~held])
    return model.calibrate(np.array([model.raw(*r) for r, h in zip(rows, held, strict=True) if h]), y[held])


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double"


def score(docs: DataFrame, model: Logistic | None, buckets: int = BUCKETS) -> DataFrame:
    """Base statistics and calibrated probability of every row of docs (doc_id, text); the probability is null without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model) if model else None)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Logistic.of(shared.value) if shared.value else None
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for lo, hi in slices(texts):
                stats = [base_statistics(t.decode("utf-8", "replace")) for t in texts[lo:hi]]
                chance = [float(own.probability(own.raw_of(g))) for g in gram_buckets(texts[lo:hi], buckets)] if own else [None] * (hi - lo)
                columns = [pa.array(x, pa.int64()) for x in zip(*stats, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns, pa.array(chance, pa.float64())], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "probability"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    failed: Callable[[], F.Column] = lambda: (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * int(100 * MOST_REPEATED))
    return scored.withColumn("base_failed", failed()).withColumn("kept", ~F.col("base_failed") & (F.coalesce("probability", F.lit(1.0)) >= KEEP_FROM))
