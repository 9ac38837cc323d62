"""Benchmark decontamination by exact word windows.

The benchmark's normalised windows are a broadcast hash set whose size is
checked before and after it is built. Documents are scanned where they lie: words become numbers of
the benchmark's vocabulary, a rolling hash of each run of known words is looked
up, and every hit is verified word by word. A benchmark beyond ``max_bytes`` is cut into
slices of that size, each scanned in a pass of its own; no window is dropped.

Words: A-Z lower-cased, then maximal runs of ASCII letters, digits and
characters beyond ASCII. A window is ``size`` consecutive words of an item; an
item with fewer words, but not none, is one window.

Defined cases: null or empty texts have no words, spans or items; items without words and
null item texts give no window; items without an id can't be named and give none either; items with the same words all count; an empty
benchmark hits nothing; repeated rows are judged one by one; columns outside
``keep`` are not carried along, and those within keep their names and values; a very long text is scanned whole, in one go.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm.common import fresh, materialize, per_text, table

#: Bytes of words: digits, letters, and all of characters beyond ASCII.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of an index for each byte of its items, at most: a word takes two bytes at least, and a window 20, a number 4, a vocabulary entry 122.
MOST = 100
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


class Windows:
    """The benchmark's windows in flat arrays: word numbers of all items, and for each length of window the sorted hashes, where each
    window begins and whose it is. Built without a step for each window."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        words = [words_of(text) for _, text in items]
        self.names = [name for name, _ in items]
        lengths = np.array([len(w) for w in words], np.int64)
        self.ids = np.array([number(w, len(self.vocabulary)) for own in words for w in own], np.int32)
        begins = np.cumsum(lengths) - lengths
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({min(size, x) for x in lengths.tolist() if x}):
            own = np.flatnonzero(lengths >= n if n == size else lengths == n)
            counts = lengths[own] - n + 1
            item = np.repeat(own, counts).astype(np.int32)
            at = begins[item] + np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)
            h = self.rolled(self.ids, n)[at]
            by = np.argsort(h, kind="stable")
            self.windows[n] = h[by], at[by], item[by]

    def nbytes(self) -> int:
        """What the index holds: arrays, and about 120 bytes and its letters for a word of the vocabulary."""
        arrays = self.ids.nbytes + sum(x.nbytes for w in self.windows.values() for x in w)
        return arrays + sum(120 + len(w) for w in self.vocabulary)

    def owners(self, n: int, place: int, key: np.ndarray) -> set[str]:
        """The items whose window from this place of the sorted hashes on is really the key."""
        hashes, at, item = self.windows[n]
        h, found = hashes[place], set()
        while place < len(hashes) and hashes[place] == h:
            if np.array_equal(self.ids[at[place] : at[place] + n], key):
                found.add(self.names[item[place]])
            place += 1
        return found

    @staticmethod
    def rolled(ids: np.ndarray, n: int) -> np.ndarray:
        """A hash of each run of n numbers."""
        x = (ids.astype(np.int64) + 1).astype(np.uint64) * MULTIPLIER
        x ^= x >> np.uint64(29)
        h = np.zeros(len(ids) - n + 1, np.uint64)
        for j in range(n):
            h = h * MULTIPLIER + x[j : len(ids) - n + 1 + j]
        return h

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, merged spans of hit words, and the items that occur."""
        words = words_of(data)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        items: set[str] = set()
        edges = np.zeros(len(words) + 1, np.int64)
        for n, (hashes, _, _) in self.windows.items():
            if len(words) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            spread = np.unique((at[:, None] + np.arange(n)).ravel()) if len(at) * n < len(words) else np.arange(len(words))
            starts = at if len(spread) == len(words) else np.searchsorted(spread, at)
            h = self.rolled(ids[spread], n)[starts]
            slot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[slot] == h)
            for i, place in zip(at[hit].tolist(), slot[hit].tolist(), strict=True):
                own = self.owners(n, place, ids[i : i + n])
                if own:
                    items.update(own)
                    edges[i] += 1
                    edges[i + n] -= 1
        hit = np.cumsum(edges[:-1]) > 0
        turns = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        return len(words), list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)), sorted(items)


def sliced(benchmark: DataFrame, max_bytes: int, id_col: str, text: str) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """The benchmark's items in lists of about ``max_bytes`` at most, one item at least, and their number."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("t")).filter("i is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("t") + F.length("i")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / max_bytes))
    part = lambda s: rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == s) if n > 1 else rows
    return n, ([(r.i, bytes(r.t)) for r in part(s).collect()] for s in range(n))


def mark(docs: DataFrame, benchmark: DataFrame, keep: list[str], size: int = 8, max_bytes: int = 8 << 20, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "found") -> DataFrame:
    """``keep`` columns and a struct ``out`` of n_words, spans (merged word numbers, end exclusive) and items (sorted as strings)."""
    spark = docs.sparkSession
    n, parts = sliced(benchmark, max_bytes, item_id, item_text)
    kind = "struct<n_words:long,spans:array<struct<start:long,end:long>>,items:array<string>>"
    col = lambda c: F.col(f"`{c}`")
    made, own = docs.select(*map(col, dict.fromkeys([*keep, text]))), []
    for s, items in enumerate(parts):
        index = Windows(items, size)
        if index.nbytes() > MOST * max(max_bytes, sum(len(t) + len(i.encode()) for i, t in items)):
            raise RuntimeError("the window index is larger than its bound")
        shared = spark.sparkContext.broadcast(index)

        def make(shared=shared):
            def scan(texts):
                found = [shared.value.scan(t) for t in texts]
                return [[{"n_words": a, "spans": [{"start": x, "end": y} for x, y in b], "items": c} for a, b, c in found]]

            return scan

        carry = [*(made.columns if s < n - 1 else [*keep, *own])]
        own.append(fresh(docs, f"_slice{s}"))
        made = per_text(made, carry, f"`{own[-1]}` {kind}", make, text)
        if s < n - 1:
            made = materialize(made)
    if n == 1:
        return made.withColumnRenamed(own[0], out)
    every = lambda field: F.flatten(F.array(*[F.col(c)[field] for c in own]))

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def merged(spans: pd.Series) -> pd.Series:
        return pd.Series([union([(s["start"], s["end"]) for s in x]) for x in spans])

    return made.select(*map(col, keep), F.struct(F.col(own[0])["n_words"].alias("n_words"), merged(every("spans")).alias("spans"), F.array_sort(F.array_distinct(every("items"))).alias("items")).alias(out))


def union(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Spans that overlap or touch made one, in order."""
    made: list[dict[str, int]] = []
    for a, b in sorted(spans):
        if made and made[-1]["end"] >= a:
            made[-1]["end"] = max(made[-1]["end"], b)
        else:
            made.append({"start": a, "end": b})
    return made


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the hit words and what stands between them."""
    places = [m.span() for m in WORD.finditer(data)]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]])


def without(text: Column, spans: Column, bad: Column) -> Column:
    """The text, where ``bad`` without the hit words. Other texts don't go to Python."""

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut(t.encode(), [(s["start"], s["end"]) for s in x]).decode("utf-8", "replace") for t, x in zip(texts, spans, strict=True)], dtype=object)

    return F.when(bad, cut_out(F.when(bad, text), F.when(bad, spans))).otherwise(text)


def n_hit(found: str) -> Column:
    return F.aggregate(F.col(found)["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 1, remove: str = "documents", size: int = 8, text: str = "text") -> DataFrame:
    """The documents without benchmark passages, all columns kept.

    A document with occurring windows of ``min_items`` items or more is contaminated.
    remove="documents" drops it; remove="spans" keeps it without the hit words.
    """
    found = fresh(docs, "_found")
    marked = mark(docs, benchmark, docs.columns, size, text=text, out=found)
    bad = F.size(f"{found}.items") >= min_items
    if remove == "documents":
        return marked.filter(~bad).drop(found)
    if remove != "spans":
        raise ValueError(remove)

    return marked.withColumn(text, without(F.col(f"`{text}`"), F.col(f"{found}.spans"), bad)).drop(found)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_items = F.size("found.items").cast("long")
    return marked.select("doc_id", F.col("found.n_words").alias("n_words"), n_hit("found").alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


_UPPER, _LOWER, _WORD = string.ascii_uppercase, string.ascii_lowercase, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}')"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bi AS (SELECT item_id, w, least(len(w), 8) AS n, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM di),
hits AS (SELECT doc_id, item_id, n, i FROM dw JOIN bw USING (n, g)),
per AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY doc_id),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN pos USING (doc_id)"""
