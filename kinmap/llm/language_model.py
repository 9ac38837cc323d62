"""LM scoring: a weighted backoff automaton over words, learned from and scored on a whole corpus.

States are histories of up to order - 1 words that were seen in training. A state's arc for a word that followed it
in training has the smoothed probability
    P(w | h) = (c(h w) + K P(w | h')) / (c(h) + K)
and leads to the longest state that the words read so far end with; its failure arc leads to the state h' without the
oldest word and weighs K / (c(h) + K); the root has an arc for every word, (c + 0.5) / (N + 0.5 (V + 1)), also for
unseen ones. So a missing arc costs just the failure weight, and every state's probabilities sum to one. A text is
read once from left to right: where the state has no arc for a word, failure arcs are taken until one has; the state is
carried along and log10 weights are added. Texts of a bucket are read side by side, long ones in
stretches: the state before a stretch is the longest seen history there, which is the one that is carried to it.

The automaton has as many arcs as the corpus has distinct n-grams, more than any worker
holds. So texts are scored in buckets of about ``bucket_bytes`` of text (one text at least), and each bucket gets just the part of
the automaton that it can reach:
  1. each bucket counts its distinct n-grams (in training rows; others with count 0) and sends
     them, sorted and cut by hash range, to shards (a range without n-grams sends nothing: no more rows than n-grams);
  2. a shard adds up the counts and answers every bucket in the order in which it asked;
  3. buckets of texts meet their answers, build their states and arcs and are read.
The number of shards follows the bytes of text, so a shard's size doesn't grow. Words are 63-bit hashes, longer n-grams 48-bit
ones; counts are exact but for collisions (about n^2 / 2^64 pairs of n words). A bucket is known by partition and row order of
the input, which must be the same in both reads; if it isn't, the sizes differ and the run fails. Read the input from files, or materialize it.

Defined cases: null or empty text is the end token alone; words of A-Z in either case are equal;
without training rows N and V are 0, every history is unseen and P is 1 for each token (0.5 / 0.5);
repeated rows count and are scored one by one; a very long text is a bucket of its own, all of its tokens are read; an empty table
gives an empty result. Columns that aren't kept don't matter, whatever their names; the query overwrites one named held_out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm.common import fold, give_back, materialize, small_batches, table, text_bytes

EVEN = np.uint64(0xFFFFFFFFFFFFFFFE)
#: Longer n-grams keep 48 bits: less to send, and n distinct ones make a given one collide with probability n / 2^48.
GRAM = np.uint64(0xFFFFFFFFFFFF0000)
#: No word is empty, so the empty word's hash marks the end of a text.
FINISH = np.frombuffer(xxhash.xxh64_digest(b""), ">u8").astype(np.uint64) & EVEN
START = np.uint64(0x2545F4914F6CDD1C)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def tokens(text: bytes) -> np.ndarray:
    """Hashes (even numbers) of the words and the end."""
    words = text.lower().split()
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64) & EVEN
    return np.concatenate([h, FINISH])


def grams(ids: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to ``order``: the hash of the n-gram that ends at each token. Texts follow each other in ``ids``;
    words before a text are START."""
    out, history = [ids], np.full(len(ids), START)
    first = np.cumsum(sizes) - sizes
    back = ids
    for n in range(2, order + 1):
        back = np.concatenate([[START], back[:-1]])
        back[first] = START
        x = (back ^ (history * M2)) * M1
        x ^= x >> np.uint64(31)
        history = x * M2 + np.uint64(n)
        y = (history ^ ids) * M1
        out.append((y ^ (y >> np.uint64(29))) & GRAM)
    return out


def tallied(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and how often each occurs in training."""
    both = np.sort(keys | train.astype(np.uint64))
    clean = both & EVEN
    first = np.flatnonzero(np.concatenate([[True], clean[1:] != clean[:-1]])) if len(clean) else np.zeros(0, np.int64)
    return clean[first], np.add.reduceat(both & np.uint64(1), first) if len(first) else np.zeros(0, np.uint64)


def planes(x: np.ndarray, drop: int = 0) -> bytes:
    """Numbers byte by byte: all first bytes, all second bytes, ... Sorted or small numbers compress well so. The lowest ``drop`` bytes are 0 and left out."""
    return x.view("u1").reshape(len(x), x.itemsize)[:, drop:].T.tobytes()


def unplanes(data: bytes, kind: str, drop: int = 0) -> np.ndarray:
    width = np.dtype(kind).itemsize
    rows = np.frombuffer(data, "u1").reshape(width - drop, -1)
    out = np.zeros((rows.shape[1], width), "u1")
    out[:, drop:] = rows.T
    return out.view(kind).ravel()


def buckets(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of the batches and the number of the bucket that each belongs to. A bucket's texts (in ``column``) hold ``most``
    bytes together, or are one text; it is the same wherever the batches end."""
    bucket, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        start = 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if held and held + n > most:
                if i > start:
                    yield bucket, batch.slice(start, i - start)
                bucket, held, start = bucket + 1, 0, i
            held += n + 1
        if start < batch.num_rows:
            yield bucket, batch.slice(start)


def requests(rows: DataFrame, order: int, shard_bits: int, bucket_bytes: int) -> DataFrame:
    """(train, text) -> for each bucket and shard the distinct n-grams and their training counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(bucket: int, parts: list[np.ndarray], train: list[bool]) -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(p) for p in parts])
            learn = np.repeat(np.array(train), sizes)
            found: dict[int, list[bytes]] = {}
            for g, keys in enumerate(grams(np.concatenate(parts), sizes, order)):
                own, n = tallied(keys, learn)
                n = n.astype("<u4")
                shard = (own >> np.uint64(64 - shard_bits)).astype(np.int64)
                at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
                for i, a, b in zip(shard[at[:-1]].tolist(), at.tolist(), at[1:].tolist(), strict=False):
                    row = found.setdefault(i, [b""] * (2 * order))
                    row[2 * g], row[2 * g + 1] = planes(own[a:b], 2 * (g > 0)), planes(n[a:b])
            for at in range(0, len(found), 32):
                some = sorted(found)[at : at + 32]
                cols = [pa.array([found[i][c] for i in some], pa.binary()) for c in range(2 * order)]
                yield pa.record_batch([pa.array(some, pa.int32()), pa.array([bucket] * len(some), pa.int64()), *cols], names)

        bucket, parts, train = None, [], []
        for own, b in buckets(batches, 1, bucket_bytes):
            if own != bucket and parts:
                yield from finished(bucket, parts, train)
                parts, train = [], []
            bucket = own
            train += b.column(0).to_pylist()
            parts += map(tokens, b.column(1).to_pylist())
        if parts:
            yield from finished(bucket, parts, train)
        give_back()

    small_batches(rows.sparkSession)
    pairs = [x for n in range(1, order + 1) for x in (f"keys{n}", f"counts{n}")]
    names = ["shard", "bucket", *pairs]
    return rows.mapInArrow(count, "shard int, bucket long, " + ", ".join(f"{p} binary" for p in pairs))


def answers(asked: DataFrame, order: int) -> DataFrame:
    """A shard's requests -> for each bucket the total training counts of its n-grams, in the order of the request,
    and once in a shard its numbers of training tokens and of distinct training words."""
    names = ["bucket", "shard", *[f"totals{n}" for n in range(1, order + 1)], "n", "v"]

    def add(t: pa.Table) -> pa.Table:
        rows = t.num_rows
        cols, n, v = [], 0, 0
        for g in range(1, order + 1):
            keys = [unplanes(x, "<u8", 2 * (g > 1)) for x in t.column(f"keys{g}").to_pylist()]
            counts = np.concatenate([unplanes(x, "<u4") for x in t.column(f"counts{g}").to_pylist()])
            sizes = [len(k) for k in keys]
            _, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(place, counts).astype(np.int64) if len(place) else np.zeros(0, np.int64)
            if g == 1:
                n, v = int(total.sum()), int((total > 0).sum())
            own = total[place].astype("<u8")
            cols.append(pa.array([planes(x) for x in np.split(own, np.cumsum(sizes)[:-1])], pa.binary()))
        only = np.arange(rows) == 0
        return pa.table([t.column("bucket"), t.column("shard"), *cols, pa.array(only * n), pa.array(only * v)], names)

    totals = ", ".join(f"totals{n} binary" for n in range(1, order + 1))
    return asked.groupBy("shard").applyInArrow(add, f"bucket long, shard int, {totals}, n long, v long")


#: Tokens of a text that are read in one go, and an odd factor that spreads keys over the arcs' table.
STRETCH, SPREAD = 128, np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """The part of the automaton that one bucket of texts can reach: states by number (root 0, then one for each distinct
    n-gram of each order below the last, unseen ones being idle, and one for the beginning of a text), the root's arcs by
    word, the other arcs in a hash table keyed by state and word, and failure arcs by state."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, answered: list[np.ndarray], n: int, v: int, texts: int, strength: tuple[float, ...]):
        """ids: the tokens of texts, one after the other, whose numbers of tokens are ``sizes``; answered: for each order the training
        counts of their distinct n-grams in ascending order of the hash."""
        order = len(strength) + 1
        self.sizes, self.first = sizes, np.cumsum(sizes) - sizes
        begins = np.zeros(len(ids), bool)
        begins[self.first] = True
        src, word, logp, to = [], [], [], []
        self.states = (0, np.zeros(0, np.int64), np.zeros(0))
        offset, self.begin, held = 0, 0, 1  # of the last order's states; state before a text; states so far
        place = total = p = np.zeros(0)
        fail, weight = [np.zeros(1, np.int64)], [np.zeros(1)]
        for g, keys in enumerate(grams(ids, sizes, order)):
            by = np.argsort(keys)
            new = np.flatnonzero(np.concatenate([[True], keys[by[1:]] != keys[by[:-1]]]))
            at = by[new]  # a token that each distinct n-gram ends at
            shorter, shorter_total, shorter_p, shorter_offset = place, total, p, offset
            total = answered[g].astype(np.float64)
            if len(total) != len(at):
                raise RuntimeError("the input was read with other partitions than before: materialize it first")
            if g < order - 1:
                place = np.empty(len(ids), np.int64)  # of each token's n-gram
                place[by] = np.repeat(np.arange(len(at)), np.diff(np.append(new, len(ids))))
                offset, held = held, held + len(at) + 1
            if not g:
                p = (total + 0.5) / (n + 0.5 * (v + 1))
                self.root, self.known, self.word = np.log10(p), total > 0, place
                self.root_to = np.where(self.known, offset + np.arange(len(at)), 0) if order > 1 else np.zeros(len(at), np.int64)
            else:
                k = strength[g - 1]
                before = np.where(begins[at], len(shorter_total), shorter[at - 1])  # the history's number among its order's states
                history = np.append(shorter_total, texts)[before]
                p = (total + k * shorter_p[shorter[at]]) / (history + k)
                seen = np.flatnonzero(total > 0)
                src.append(shorter_offset + before[seen])
                word.append(self.word[at[seen]])
                logp.append(np.log10(p[seen]))
                to.append(offset + seen if g < order - 1 else shorter_offset + shorter[at[seen]])
            if g < order - 1:  # failure arcs of this order's states
                fail += [shorter_offset + shorter[at] if g else np.zeros(len(at), np.int64), [self.begin]]
                k = strength[g]
                weight += [np.log10(k / (total + k)), [math.log10(k / (texts + k))]]
                self.begin = held - 1
                self.states = (offset, place, total)  # of the last order that has states
        self.fail, self.weight = np.concatenate(fail).astype(np.int64), np.concatenate(weight)
        if order > 1:
            self.keys = (np.concatenate(src).astype(np.uint64) << np.uint64(32)) | np.concatenate(word).astype(np.uint64)
            self.logp, self.to = np.concatenate(logp), np.concatenate(to)
        else:
            self.keys, self.logp, self.to = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)
        self.levels = order - 1
        self.hash()

    def hash(self) -> None:
        """Arcs into slots: an arc whose slot is taken goes to the next one."""
        self.bits = max(4, (2 * len(self.keys) + 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(self.keys), dtype=np.int32)
        slot = self.slot(self.keys)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def arcs(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The arc of each state for a word, -1: none."""
        keys = (state.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)
        slot = self.slot(keys)
        arc = self.slots[slot]
        other = np.flatnonzero(arc >= 0)
        other = other[self.keys[arc[other]] != keys[other]]
        while len(other):
            slot[other] = (slot[other] + 1) & ((1 << self.bits) - 1)
            arc[other] = self.slots[slot[other]]
            other = other[arc[other] >= 0]
            other = other[self.keys[arc[other]] != keys[other]]
        return arc

    def carried(self, at: np.ndarray) -> np.ndarray:
        """The state before each of these tokens: the longest seen history, or that of a text's beginning."""
        state = np.full(len(at), self.begin)
        inside = np.flatnonzero(~np.isin(at, self.first))
        offset, place, total = self.states
        if self.levels and len(inside):
            last = place[at[inside] - 1]
            own = offset + last
            unseen = np.flatnonzero(total[last] == 0)
            while len(unseen):  # an unseen history's state is idle: its failure arcs lead to one that isn't
                own[unseen] = self.fail[own[unseen]]
                unseen = unseen[self.idle(own[unseen])]
            state[inside] = own
        return state

    def idle(self, state: np.ndarray) -> np.ndarray:
        """States of histories without training count: their failure arcs weigh nothing."""
        return (state > 0) & (self.weight[state] == 0)

    def read(self) -> np.ndarray:
        """log10 probability of each text."""
        pieces = -(-self.sizes // STRETCH)
        text = np.repeat(np.arange(len(self.sizes)), pieces)
        start = self.first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
        length = np.minimum((self.first + self.sizes)[text] - start, STRETCH)
        by = np.argsort(-length, kind="stable")
        text, start, length = text[by], start[by], length[by]
        state, sums = self.carried(start), np.zeros(len(start))
        lanes = np.searchsorted(-length, -np.arange(STRETCH + 1), side="left")  # stretches longer than t tokens
        for t in range(STRETCH):
            m = int(lanes[t])
            if not m:
                break
            word, own = self.word[start[:m] + t], state[:m]
            left = np.flatnonzero(own > 0)
            while len(left):
                arc = self.arcs(own[left], word[left])
                hit = arc >= 0
                who, arc = left[hit], arc[hit]
                sums[who] += self.logp[arc]
                own[who] = self.to[arc]
                word[who] = -1
                left = left[~hit]
                sums[left] += self.weight[own[left]]
                own[left] = self.fail[own[left]]
                left = left[own[left] > 0]
            at_root = np.flatnonzero(word >= 0)
            sums[at_root] += self.root[word[at_root]]
            own[at_root] = self.root_to[word[at_root]]
        return np.bincount(text, sums, len(self.sizes))


def score(docs: DataFrame, learn: Column, keep: tuple[str, ...] = ("doc_id",), text: str = "text", strength: tuple[float, ...] = (400.0, 10.0), bucket_bytes: int = 4 << 20, shard_bytes: int = 4 << 20) -> DataFrame:
    """``keep`` columns, n_tokens, n_known, train_tokens, base_score and score of every row, learned from the rows of ``learn``.

    ``strength``: K of the histories of one word, of two, ...; their number gives the order. ``shard_bytes``: bytes of text for each shard of n-grams."""
    spark, order = docs.sparkSession, len(strength) + 1
    cols = {f"_k{i}": F.col(f"`{c}`") for i, c in enumerate(keep)}
    rows = docs.select(*[c.alias(k) for k, c in cols.items()], F.coalesce(learn, F.lit(False)).alias("_train"), text_bytes(F.col(f"`{text}`")).alias("_text"))
    size, learned = rows.agg(F.coalesce(F.sum(F.length("_text") + 1), F.lit(0)), F.count_if("_train")).first()
    shard_bits = max(4, math.ceil(math.log2(max(1, size / shard_bytes))))
    asked = requests(rows.select("_train", "_text"), order, shard_bits, bucket_bytes)
    told = materialize(answers(asked, order))
    n, v = told.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kept = [rows.schema[k] for k in cols]
    carried = [*kept, *_parse_datatype_string("_text binary, _bucket long").fields]
    passed = to_arrow_schema(StructType(carried), prefers_large_types=False)
    out = StructType([*kept, *_parse_datatype_string("n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    arrow = to_arrow_schema(out, prefers_large_types=False)
    names = list(cols)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, b in buckets(batches, len(names), bucket_bytes):
            own = [b.column(i).cast(passed.field(i).type) for i in range(len(names) + 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(b.num_rows, bucket))], schema=passed)

    def read(texts: pa.Table, told_: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return arrow.empty_table()
        parts = [tokens(t) for t in texts.column("_text").to_pylist()]
        sizes, ids = np.array([len(p) for p in parts]), np.concatenate(parts)
        by_shard = np.argsort(told_.column("shard").to_numpy()).tolist()
        totals = []
        for g in range(1, order + 1):
            blobs = told_.column(f"totals{g}").to_pylist()
            totals.append(np.concatenate([unplanes(blobs[i], "<u8") for i in by_shard]) if blobs else np.zeros(0, np.uint64))
        a = Automaton(ids, sizes, totals, n, v, learned, strength)
        base = np.add.reduceat(a.root[a.word], a.first)
        known = np.add.reduceat(a.known[a.word].astype(np.int64), a.first)
        made = [pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), n)), pa.array(base), pa.array(a.read())]
        return pa.Table.from_arrays([texts.column(k).cast(arrow.field(k).type) for k in names] + made, schema=arrow)

    numbered = rows.select(*names, "_text").mapInArrow(number, StructType(carried))
    made = numbered.groupBy("_bucket").cogroup(told.withColumnRenamed("bucket", "_bucket").groupBy("_bucket")).applyInArrow(read, out)
    return made.select(*[F.col(k).alias(c) for k, c in zip(cols, keep, strict=True)], "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of logarithms are rounded to 6 places: engines add them in another order."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 1
    found = score(docs.withColumn("held_out", held_out), ~held_out, keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


#: The same by counts of n-grams and joins. The crc32 of the id goes bit by bit; a blank stands for the words before a text.
OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ['']) AS w FROM documents),
crc AS (SELECT DISTINCT id, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], [CAST(ascii(x) AS BIGINT) FOR x IN string_split(id, '') IF x <> '']),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda e, z: CASE WHEN e & 1 = 1 THEN xor(e >> 1, CAST(3988292384 AS BIGINT)) ELSE e >> 1 END)) AS c FROM d),
f AS (SELECT k, doc_id, w, xor(c, CAST(4294967295 AS BIGINT)) % 5 = 1 AS held_out FROM d JOIN crc USING (id)),
t AS (SELECT k, held_out, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] ELSE ' ' END AS b, CASE WHEN i > 2 THEN w[i - 2] ELSE ' ' END AS a
  FROM (SELECT k, held_out, w, unnest(range(1, len(w) + 1)) AS i FROM f)),
g1 AS (SELECT c, count(*) AS n FROM t WHERE NOT held_out GROUP BY 1),
g2 AS (SELECT b, c, count(*) AS n FROM t WHERE NOT held_out GROUP BY 1, 2),
g3 AS (SELECT a, b, c, count(*) AS n FROM t WHERE NOT held_out GROUP BY 1, 2, 3),
z AS (SELECT (SELECT coalesce(sum(n), 0) FROM g1) AS n, (SELECT count(*) FROM g1) AS v, (SELECT count(*) FROM f WHERE NOT held_out) AS texts),
p AS (SELECT t.k, g1.n IS NOT NULL AS known, (coalesce(g1.n, 0) + 0.5::DOUBLE) / (z.n + 0.5::DOUBLE * (z.v + 1)) AS p1,
    coalesce(g2.n, 0) AS n2, CASE WHEN t.b = ' ' THEN z.texts ELSE coalesce(h1.n, 0) END AS m1,
    coalesce(g3.n, 0) AS n3, CASE WHEN t.b = ' ' THEN z.texts ELSE coalesce(h2.n, 0) END AS m2
  FROM t CROSS JOIN z LEFT JOIN g1 ON g1.c = t.c LEFT JOIN g2 ON g2.b = t.b AND g2.c = t.c LEFT JOIN g3 ON g3.a = t.a AND g3.b = t.b AND g3.c = t.c
  LEFT JOIN g1 h1 ON h1.c = t.b LEFT JOIN g2 h2 ON h2.b = t.a AND h2.c = t.b),
s AS (SELECT k, count(*) AS n_tokens, count(*) FILTER (WHERE known) AS n_known, sum(log10(p1)) AS base, sum(log10((n3 + 10 * (n2 + 400 * p1) / (m1 + 400)) / (m2 + 10))) AS score FROM p GROUP BY k)
SELECT doc_id, held_out, n_tokens, n_known, CAST(z.n AS BIGINT) AS train_tokens, round(base, 6) AS base_score, round(score, 6) AS score FROM f JOIN s USING (k) CROSS JOIN z
"""
