"""Quality classifier: supervised subword embeddings, trained with numpy.

A document is the mean of learned vectors of its hashed features: each word as
written, its character n-grams, and pairs of neighbouring words that are equal. A
linear layer and softmax give the probability of label 1. Training is stochastic gradient
descent (Adagrad) on a bounded sample of labelled rows. Because the layers are
linear, the trained model folds into one number per feature, which is all that is shipped.

Defined cases: null or empty text has no features and scores by the bias alone;
equal texts score alike; without labels of both classes the score is 0.5
everywhere; repeated rows are scored one by one; an empty table gives an empty result; a very long text is scored whole (one of over
``max_bytes`` isn't learned from); other columns stay out of it, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm.common import fold, per_text, remembered, table
from kinmap.llm.labelled import sample

SIZES = (2, 3)
BUCKETS = 1 << 16
#: The feature of two equal neighbours.
SAME = 0


#: Bytes of a word whose n-grams are hashed one by one; those of longer words by blocks in numpy.
SHORT, BLOCK = 200, 1 << 16
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1).astype(np.uint32)


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """zlib.crc32(gram, n) of each run of n bytes."""
    crc = np.full(len(data) - n + 1, n ^ 0xFFFFFFFF, np.uint32)
    for j in range(n):
        crc = CRC[(crc ^ data[j : len(data) - n + 1 + j]) & 255] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def features(word: bytes) -> Iterator[np.ndarray | list[int]]:
    """Buckets of the word and of all its character n-grams, in blocks."""
    marked = b"<" + word + b">"
    crc = zlib.crc32
    whole = [1 + crc(word, 7) % (BUCKETS - 1)]
    if len(word) <= SHORT:
        yield whole + [1 + crc(marked[i : i + n], n) % (BUCKETS - 1) for n in SIZES for i in range(len(marked) - n + 1)]
        return
    yield whole
    data = np.frombuffer(marked, np.uint8)
    for n in SIZES:
        for at in range(0, len(data) - n + 1, BLOCK):
            yield 1 + (grams(data[at : at + BLOCK + n - 1], n) % np.uint32(BUCKETS - 1)).astype(np.int64)


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of a text and their shares."""
    words = text.split()
    found: Counter = Counter()
    for w, n in Counter(words).items():
        for block in features(w):
            for f, k in Counter(block if isinstance(block, list) else block.tolist()).items():
                found[f] += n * k
    if same := sum(a == b for a, b in zip(words, words[1:], strict=False)):
        found[SAME] += same * 4
    ids = np.fromiter(found.keys(), np.int32, len(found))
    share = np.fromiter(found.values(), np.float32, len(found))
    return ids, share / max(1.0, share.sum())


def train(texts: list[bytes], labels: list[int], dim: int = 8, epochs: int = 12, rate: float = 0.5, batch: int = 32, seed: int = 1) -> tuple[np.ndarray, float]:
    """One number for each bucket and the bias: a document's log-odds are their mean plus the bias."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out = np.zeros((dim, 2), np.float32)
    bias = np.zeros(2, np.float32)
    seen, seen_out, seen_bias = np.full((BUCKETS, 1), 1e-6, np.float32), np.full_like(out, 1e-6), np.full_like(bias, 1e-6)
    weight = (len(y) / (2 * np.bincount(y, minlength=2)))[y].astype(np.float32)
    docs = [counted(t) for t in texts]
    order = rng.permutation(len(y))
    parts = []
    for at in range(0, len(y), batch):
        rows = order[at : at + batch]
        ids = np.concatenate([docs[r][0] for r in rows] or [np.zeros(0, np.int32)])
        share = np.concatenate([docs[r][1] for r in rows])
        row = np.repeat(np.arange(len(rows)), [len(docs[r][0]) for r in rows])
        by = np.argsort(ids, kind="stable")
        buckets, starts = np.unique(ids[by], return_index=True)
        parts.append((rows, ids, share[:, None], row, by, buckets, starts))
    del docs
    for _ in range(epochs):
        for i in rng.permutation(len(parts)):
            rows, ids, share, row, by, buckets, starts = parts[i]
            mean = np.zeros((len(rows), dim), np.float32)
            if len(ids):
                firsts = np.flatnonzero(np.diff(row, prepend=-1))
                mean[row[firsts]] = np.add.reduceat(vectors[ids] * share, firsts, axis=0)
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            g = p * weight[rows][:, None] / len(rows)
            back = g @ out.T
            for value, seen_, grad in ((out, seen_out, mean.T @ g), (bias, seen_bias, g.sum(axis=0))):
                seen_ += grad * grad
                value -= rate * grad / np.sqrt(seen_)
            if len(ids):
                grad = np.add.reduceat((back[row] * share)[by], starts, axis=0)
                seen[buckets] += (grad * grad).mean(axis=1, keepdims=True)
                vectors[buckets] -= rate * grad / np.sqrt(seen[buckets])
    direction = out[:, 1] - out[:, 0]
    return (vectors @ direction).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    """Scores texts with a folded model; remembers sums of words, at most about ``most``."""

    def __init__(self, values: np.ndarray, bias: float, most: int = 250_000):
        self.values, self.bias, self.most = values.astype(np.float64), bias, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.sums, self.counts = np.zeros(1024), np.zeros(1024)

    def places(self, words: list[bytes]) -> np.ndarray:
        if new := set(words).difference(self.place):
            if len(self.place) + len(new) > self.most:
                self.clear()
                new = set(words)
            if len(self.place) + len(new) > len(self.sums):
                size = 2 * (len(self.place) + len(new))
                self.sums, self.counts = np.resize(self.sums, size), np.resize(self.counts, size)
            for w in new:
                at = self.place[w] = len(self.place)
                self.sums[at] = self.counts[at] = 0
                for ids in features(w):
                    self.sums[at] += self.values[ids].sum()
                    self.counts[at] += len(ids)
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def score(self, text: bytes) -> float:
        words, total, count, same, last = text.split(), 0.0, 0.0, 0, None
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            p = self.places(part)
            total += float(self.sums[p].sum())
            count += float(self.counts[p].sum())
            same += int((p[1:] == p[:-1]).sum()) + (part[0] == last)
            last = part[-1]
        z = self.bias + (total + 4 * same * self.values[SAME]) / max(1.0, count + 4 * same)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """``keep`` columns and the probability of label 1. The model is 256 KB, whatever the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    key = uuid.uuid4().hex

    def make():
        scorer = remembered(key, lambda: Scorer(*shared.value))
        return lambda texts: [[scorer.score(t) for t in texts]]

    return per_text(docs, keep, f"`{out}` double", make, text)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, per_class: int = 1000, max_bytes: int = 200_000) -> tuple[np.ndarray, float]:
    """Learn from at most ``per_class`` labelled rows of each class (see ``labelled.sample``)."""
    rows = sample(docs, labels, label, F.lit(True) if learn is None else learn, per_class, max_bytes)
    return train([bytes(r["text"]) for r in rows], [r["label"] for r in rows])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = fit(docs, labels, "quality", ~held_out)
    return score(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
