"""Toxicity: a convolutional text classifier, trained with numpy.

A word's vector is the sum of hashed vectors of the word, its prefixes and
its suffix. Filters of several widths run over the word vectors; each filter's response
is max-pooled over the whole text, and over blocks of ``SPAN`` words whose mean tells
how often it fires. A logistic unit on both gives the score. Training is by minibatch
Adagrad on a bounded sample of labelled rows. Decision thresholds are
calibrated for each language on all label rows, whatever their number, from counts by score bin; a language
without enough of both classes uses the threshold of all.

Defined cases: null or empty text has no words and scores by the bias alone; equal
texts score alike; without labels of both classes every score is 0; a null or unseen
language uses the common threshold; repeated rows are scored one by one; an empty table gives an empty result; a very long text is
scored whole, in parts of whole blocks (one of over ``max_bytes`` isn't learned from); other columns stay out of it, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinmap.llm.common import fold, fresh, materialize, per_text, remembered, table
from kinmap.llm.decontaminate import words_of
from kinmap.llm.labelled import sample

BUCKETS = 1 << 15
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
SPAN = 16
#: (filter width, position in it) of each block of FILTERS columns of a word's responses.
SLOTS = [(w, j) for w in WIDTHS for j in range(w)]
N = FILTERS * len(WIDTHS)


def features(word: bytes) -> tuple[int, ...]:
    crc = zlib.crc32
    return crc(word, 1) % BUCKETS, *(crc(word[:n], n) % BUCKETS for n in (3, 4, 5, 6)), crc(word[-3:], 9) % BUCKETS


def pooled(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """words: responses (len(SLOTS) * FILTERS columns) of distinct words; ids: the text's words. -> activations, one row per word."""
    n = len(ids)
    act = np.zeros((n, N), np.float32)
    for s, (w, j) in enumerate(SLOTS):
        k = WIDTHS.index(w) * FILTERS
        act[: n - j, k : k + FILTERS] += words[ids[j:], s * FILTERS : (s + 1) * FILTERS]
    return act


class Model:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.filters = rng.normal(0, 0.3, (DIM, len(SLOTS) * FILTERS)).astype(np.float32)
        self.shift = np.full(N, -0.1, np.float32)
        self.out = rng.normal(0, 0.3, 2 * N).astype(np.float32)
        self.bias = np.full(1, -1.0, np.float32)
        self.trained = False
        self.thresholds: dict[str | None, float] = {None: 0.5}

    def responses(self, words: list[bytes]) -> np.ndarray:
        ids = np.array([features(w) for w in words], np.int64).reshape(-1, 6)
        return self.vectors[ids].sum(axis=1) @ self.filters

    def logit(self, act: np.ndarray) -> float:
        """act: activations before the shift."""
        if not len(act):
            return float(self.bias[0])
        blocks = np.maximum.reduceat(act, np.arange(0, len(act), SPAN), axis=0)
        high = np.maximum(blocks.max(axis=0) + self.shift, 0)
        often = np.maximum(blocks + self.shift, 0).mean(axis=0)
        return float(high @ self.out[:N] + often @ self.out[N:] + self.bias[0])

    def train(self, texts: list[bytes], labels: list[int], epochs: int = 10, rate: float = 0.08, batch: int = 16, seed: int = 4, least_docs: int = 8, decay: float = 1e-3) -> None:
        """Features in fewer than ``least_docs`` documents say nothing: their vectors are zero."""
        if len(set(labels)) < 2:
            return
        y = np.array(labels, np.float32)
        number: dict[bytes, int] = {}
        docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
        buckets = np.array([features(w) for w in number], np.int32).reshape(-1, 6)
        spread = np.bincount(np.concatenate([np.unique(buckets[np.unique(d)]) for d in docs]), minlength=BUCKETS)
        live_rows = (spread >= least_docs)[:, None]
        self.vectors *= live_rows
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())).astype(np.float32)
        seen = {k: np.full_like(getattr(self, k), 1e-4) for k in ("filters", "shift", "out", "bias")}
        seen_rows = np.full((BUCKETS, 1), 1e-4, np.float32)

        def step(name: str, grad: np.ndarray) -> None:
            seen[name] += grad * grad
            getattr(self, name)[...] -= rate * grad / np.sqrt(seen[name])

        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), batch):
                grads = {k: np.zeros_like(getattr(self, k)) for k in seen}
                rows, gains = [], []
                for d in order[at : at + batch]:
                    ids = docs[d]
                    own, local = np.unique(ids, return_inverse=True)
                    vec = self.vectors[buckets[own]].sum(axis=1)
                    act = pooled(vec @ self.filters, local)
                    n = len(act)
                    if n:
                        starts = np.arange(0, n, SPAN)
                        blocks = np.maximum.reduceat(act, starts, axis=0)
                        top = blocks.argmax(axis=0)
                        high, often = np.maximum(blocks.max(axis=0) + self.shift, 0), np.maximum(blocks + self.shift, 0)
                        z = high @ self.out[:N] + often.mean(axis=0) @ self.out[N:] + self.bias[0]
                    else:
                        z = self.bias[0]
                    g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[d]) * weight[d] / batch
                    grads["bias"] += g
                    if not n:
                        continue
                    grads["out"][:N] += g * high
                    grads["out"][N:] += g * often.mean(axis=0)
                    back = g * self.out[N:] * (often > 0) / len(blocks)
                    back[top, np.arange(N)] += g * self.out[:N] * (high > 0)
                    grads["shift"] += back.sum(axis=0)
                    b, f = np.nonzero(back)
                    if not len(b):
                        continue
                    is_top = act == np.repeat(blocks, np.diff(np.append(starts, n)), axis=0)
                    where = np.maximum.reduceat(np.where(is_top, np.arange(n)[:, None], -1), starts, axis=0)[b, f]
                    value = back[b, f]
                    dvec = np.zeros_like(vec)
                    for s, (w, j) in enumerate(SLOTS):
                        k = WIDTHS.index(w) * FILTERS
                        use = (f >= k) & (f < k + FILTERS) & (where + j < n)
                        if not use.any():
                            continue
                        word = local[where[use] + j]
                        hit = np.zeros((len(own), FILTERS), np.float32)
                        np.add.at(hit, (word, f[use] - k), value[use])
                        cols = slice(s * FILTERS, (s + 1) * FILTERS)
                        grads["filters"][:, cols] += vec.T @ hit
                        dvec += hit @ self.filters[:, cols].T
                    live = np.flatnonzero(dvec.any(axis=1))
                    rows.append(own[live])
                    gains.append(dvec[live])
                for name, grad in grads.items():
                    step(name, grad)
                if rows:
                    ids, gain = buckets[np.concatenate(rows)], np.concatenate(gains)
                    flat, gain = ids.ravel(), np.repeat(gain, 6, axis=0)
                    by = np.argsort(flat, kind="stable")
                    used, first = np.unique(flat[by], return_index=True)
                    total = np.add.reduceat(gain[by], first, axis=0)
                    seen_rows[used] += (total * total).mean(axis=1, keepdims=True)
                    self.vectors[used] -= live_rows[used] * (rate * total / np.sqrt(seen_rows[used]) + decay * self.vectors[used])
        self.trained = True

    def calibrate(self, scores: list[float], labels: list[int], langs: list[str | None], least: int = 20) -> None:
        """For each language the threshold with the best F1 on these rows (the middle of the best gap)."""

        def best(s: np.ndarray, y: np.ndarray) -> float:
            order = np.argsort(-s, kind="stable")
            s, hit = s[order], np.cumsum(y[order])
            f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
            f1[:-1][s[:-1] == s[1:]] = -1  # no threshold separates equal scores
            i = int(np.argmax(f1))
            return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i] / 2)

        s, y = np.array(scores), np.array(labels)
        if 0 < y.sum() < len(y):
            self.thresholds[None] = best(s, y)
        for lang in {x for x in langs if x is not None}:
            own = np.array([x == lang for x in langs])
            if y[own].sum() >= least and (1 - y[own]).sum() >= least:
                self.thresholds[lang] = best(s[own], y[own])


class Scorer:
    """Scores texts; remembers the responses of about ``most`` words."""

    def __init__(self, model: Model, most: int = 150_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.table = np.zeros((4096, len(SLOTS) * FILTERS), np.float32)

    def places(self, words: list[bytes]) -> np.ndarray:
        if new := set(words).difference(self.place):
            if len(self.place) + len(new) > self.most:
                self.clear()
                new = set(words)
            new = list(new)
            n = len(self.place)
            if n + len(new) > len(self.table):
                grown = np.zeros((2 * (n + len(new)), self.table.shape[1]), np.float32)
                grown[:n] = self.table[:n]
                self.table = grown
            self.table[n : n + len(new)] = self.model.responses(new)
            self.place.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def activations(self, words: list[bytes]) -> np.ndarray:
        places = self.places(words)
        return pooled(self.table, places)

    def score(self, text: bytes) -> float:
        model = self.model
        if not model.trained:
            return 0.0
        words = words_of(text)
        if len(words) <= 1000 * SPAN:
            z = model.logit(self.activations(words))
        else:  # in parts of whole blocks that overlap by the widest filter: the same pools
            high, total, count, step = np.full(N, -np.inf, np.float32), np.zeros(N), 0, 1000 * SPAN
            for at in range(0, len(words), step):
                part = words[at : at + step + max(WIDTHS) - 1]
                act = self.activations(part)[:step]
                blocks = np.maximum.reduceat(act, np.arange(0, len(act), SPAN), axis=0)
                high = np.maximum(high, blocks.max(axis=0))
                total += np.maximum(blocks + model.shift, 0).sum(axis=0)
                count += len(blocks)
            z = float(np.maximum(high + model.shift, 0) @ model.out[:N] + (total / count) @ model.out[N:] + model.bias[0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: Column | None = None, per_class: int = 1500, max_bytes: int = 200_000) -> Model:
    """Learn from at most ``per_class`` labelled rows of each class (see ``labelled.sample``). Thresholds: see ``thresholds``."""
    rows = sample(docs, labels, label, F.lit(True) if learn is None else learn, per_class, max_bytes)
    model = Model()
    model.train([bytes(r["text"]) for r in rows], [r["label"] for r in rows])
    return model


#: Score bins in one unit of log-odds, which reach from -30 to 30.
BINS = 64


def thresholds(scored: DataFrame, labels: DataFrame, label: str = "toxic", least: int = 20) -> dict[str | None, float]:
    """Rows of (doc_id, lang, score) -> for each language the threshold with the best F1 on all its label rows, None for all languages.

    Label rows are counted by language and bin of the score's log-odds; only the counts, at most one row a bin, are put in
    order. A threshold is the middle of the gap between two bins' scores. A language with fewer than
    ``least`` rows of a class has none."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    odds = F.log(F.greatest(F.col("score"), F.lit(1e-14))) - F.log(F.greatest(1 - F.col("score"), F.lit(1e-14)))
    slot = F.floor(F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0)) * BINS)
    by = scored.join(known, "doc_id").groupBy("lang", slot.alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("hit"), F.min("score").alias("low"), F.max("score").alias("high"))
    total = by.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.min("low").alias("low"), F.max("high").alias("high"))
    own = by.filter("lang is not null").select(F.lit(False).alias("whole"), "lang", "bin", "n", "hit", "low", "high")
    every = own.union(total.select(F.lit(True), F.lit(None).cast("string"), "bin", "n", "hit", "low", "high"))
    group = W.partitionBy("whole", "lang")
    down = group.orderBy(F.desc("bin"))
    run = down.rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = every.select("*", F.sum("n").over(run).alias("above"), F.sum("hit").over(run).alias("caught"), F.sum("n").over(group).alias("rows"), F.sum("hit").over(group).alias("bad"), F.lead("high").over(down).alias("next"))
    enough = F.when(F.col("whole"), F.lit(1)).otherwise(F.lit(least))
    sums = sums.filter((F.col("bad") >= enough) & (F.col("rows") - F.col("bad") >= enough))
    f1 = 2 * F.col("caught") / (F.col("above") + F.col("bad"))
    at = F.when(F.col("next").isNull(), F.col("low") / 2).otherwise((F.col("low") + F.col("next")) / 2)
    return {r["lang"]: r["at"] for r in sums.groupBy("whole", "lang").agg(F.max_by(at, F.struct(f1, F.col("bin"))).alias("at")).collect()}


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """``keep`` columns and the probability of label 1. The model is about 2 MB, whatever the corpus."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def make():
        scorer = remembered(key, lambda: Scorer(shared.value))
        return lambda texts: [[scorer.score(t) for t in texts]]

    return per_text(docs, keep, f"`{out}` double", make, text)


def threshold(model: Model, lang: Column) -> Column:
    """The calibrated threshold of each row's language."""
    known = {k: v for k, v in model.thresholds.items() if k is not None}
    common = F.lit(model.thresholds[None])
    if not known:
        return common
    by = F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv])
    return F.coalesce(F.try_element_at(by, lang), common)


def drop_toxic(docs: DataFrame, model: Model, labels: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """The documents whose score is below their language's threshold, all columns kept.

    Every document is scored once; the label rows among them set the thresholds, which the written scores then meet."""
    name = fresh(docs, "_score")
    scored = materialize(score(docs, model, docs.columns, text, name))
    if model.trained:
        by = F.col(f"`{lang}`").cast("string") if lang in docs.columns else F.lit(None).cast("string")
        model.thresholds |= thresholds(scored.select(F.col(f"`{doc_id}`").alias("doc_id"), by.alias("lang"), F.col(name).alias("score")), labels)
    at = threshold(model, F.col(f"`{lang}`")) if lang in docs.columns else F.lit(model.thresholds[None])
    return scored.filter(F.col(name) < at).drop(name)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = fit(docs, labels, "toxic", ~held_out)
    return score(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
