"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distances, components.

``near_duplicates`` links 64-bit fingerprints of shingles by their exact distance.
``drop_near_duplicates`` finds texts whose sets of five-word shingles have a Jaccard
similarity of about 0.8 or more. 64 bits can't tell that: such pairs differ in some 10 of
them. So candidates come from MinHash values of the distinct shingles, in BANDS bands of ROWS values: two texts
share a value with the probability of their similarity j, wherever they differ, and so some band with probability
1 - (1 - j^ROWS)^BANDS: 0.99999 at 0.8 and 0.9999 at 0.76, where the verified distance ends on average. A
fingerprint of 512 bits of the same shingles verifies candidates by its Hamming distance.

Two fingerprints that differ in at most ``distance`` bits agree on all but
``distance`` of ``distance + extra`` blocks. For each choice of ``extra`` blocks there is a
table keyed by those blocks' bits; with 7 blocks, 35 tables of about 27 bits, so
that buckets of unrelated fingerprints stay small up to hundreds of millions of fingerprints.
Equal fingerprints are one row. Within a bucket a breadth-first search over verified distances
links each fingerprint to its group's smallest, so a bucket of n gives fewer
than n links, never all pairs. A bucket beyond ``cell`` fingerprints is cut into
chunks, and each pair of chunks is searched in a task of its own: no pair is skipped.

Defined cases: a text without words has fingerprint 0; a text of fewer words than a
shingle is one shingle; equal texts share a fingerprint; null text counts as empty;
a null doc_id never names a group that has another id; an empty table gives an empty result. All words of a very long text count; its
hashes are made 65536 shingles at a time. Other columns aren't read (``near_duplicates``) or stay as they are, whatever their
names (``drop_near_duplicates``); repeated rows are one group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm.common import fresh, materialize, per_text, spread, table
from kinmap.llm.components import components

SEED = 42


def fingerprint(text: bytes, shingle: int) -> int:
    """64 bits, each set if it is set in over half the shingles' hashes."""
    words = text.lower().split()  # of bytes: A-Z, and white space \x20 \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(starts), 1 << 16):
        hashes = b"".join([digest(line[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, "u1").reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = 5, text: str = "text", out: str = "fingerprint") -> DataFrame:
    return per_text(docs, keep, f"`{out}` long", lambda: lambda texts: [[fingerprint(t, shingle) for t in texts]], text)


def block_masks(distance: int, extra: int) -> list[int]:
    """Masks (as signed 64-bit) of every choice of ``extra`` of ``distance + extra`` blocks."""
    n = distance + extra
    cuts = [round(64 * i / n) for i in range(n + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, extra)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def linked(nodes: np.ndarray, prints: np.ndarray, distance: int) -> np.ndarray:
    """For each node the smallest that it reaches over links of ``distance`` at most, all within the given ones.

    prints: one row of 64-bit words for each node."""
    root = nodes.copy()
    left = np.arange(len(nodes))
    while len(left):
        group, frontier, left = [left[:1]], left[:1], left[1:]
        while len(frontier) and len(left):
            reached = np.zeros(len(left), bool)
            for at in range(0, len(frontier), 64):
                open_ = np.flatnonzero(~reached)
                bits = np.bitwise_count(prints[frontier[at : at + 64], None, :] ^ prints[left[open_]][None, :, :])
                reached[open_[(bits.sum(axis=2, dtype=np.int32) <= distance).any(axis=0)]] = True
            frontier, left = left[reached], left[~reached]
            group.append(frontier)
        group = np.concatenate(group)
        root[group] = nodes[group].min()
    return root


def cells(keyed: DataFrame, cell: int) -> DataFrame:
    """(node, k) rows -> (k, i, j, node): buckets of two nodes and more; each pair of a large bucket's chunks is a cell."""
    counts = keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    shared = spread(keyed, counts, "k", "node")
    cut = shared.withColumn("chunks", F.ceil(F.col("n") / F.lit(cell)).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node", "k"), F.col("chunks")).cast("int"))
    every = cut.select("k", "node", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"), "own")
    return every.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node")


def search(found: DataFrame, distance: int, words: int) -> DataFrame:
    """(k, i, j, node, print: binary of 64-bit words) -> (a, b): links within each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: np.ndarray | None = None
        kind = np.dtype([("k", "i8"), ("i", "i4"), ("j", "i4"), ("node", "i8"), ("print", "u8", (words,))])

        def one(x: np.ndarray) -> pa.RecordBatch:
            """x: whole cells."""
            cut = np.flatnonzero((x["k"][1:] != x["k"][:-1]) | (x["i"][1:] != x["i"][:-1]) | (x["j"][1:] != x["j"][:-1])) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(x)]])
            size = ends - starts
            two = starts[size == 2]
            near = two[np.bitwise_count(x["print"][two] ^ x["print"][two + 1]).sum(axis=1, dtype=np.int32) <= distance]
            a, b = [x["node"][near]], [x["node"][near + 1]]
            for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
                nodes = x["node"][s:e]
                r = linked(nodes, x["print"][s:e], distance)
                a.append(nodes[nodes != r])
                b.append(r[nodes != r])
            return pa.record_batch([pa.array(np.concatenate(v)) for v in (a, b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.empty(batch.num_rows, kind)
            for c, name in enumerate(("k", "i", "j", "node")):
                x[name] = batch.column(c).to_numpy()
            x["print"] = np.frombuffer(b"".join(batch.column(4).to_pylist()), ">u8").reshape(-1, words)
            x = x if rest is None else np.concatenate([rest, x])
            same = (x["k"] == x["k"][-1]) & (x["i"] == x["i"][-1]) & (x["j"] == x["j"][-1])
            split = 0 if same.all() else len(x) - int(np.argmin(same[::-1]))
            rest = x[split:].copy()
            if split:
                yield one(x[:split])
        if rest is not None and len(rest):
            yield one(rest)

    return found.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(run, "a long, b long").distinct()


def links(prints: DataFrame, distance: int = 4, extra: int = 3, cell: int = 4096) -> DataFrame:
    """Distinct fingerprints (column fp) -> (a, b): links that connect all fingerprints within ``distance``."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(block_masks(distance, extra))])
    found = cells(prints.select(F.col("fp").alias("node"), F.explode(keys).alias("k")), cell)
    return search(found.withColumn("print", F.unhex(F.lpad(F.hex("node"), 16, "0"))), distance, 1)


def groups(prints: DataFrame, doc_id: str = "doc_id", fingerprint: str = "fingerprint", distance: int = 4, extra: int = 3) -> DataFrame:
    """Rows of (doc_id, fingerprint) -> (fp, component_id): every distinct fingerprint with its group's smallest doc_id."""
    distinct = prints.groupBy(F.col(fingerprint).alias("fp")).agg(F.min(doc_id).alias("least"))
    roots = components(links(distinct.select("fp"), distance, extra))
    rooted = distinct.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return spread(rooted, named, "root", "fp").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (long) and component_id, the smallest doc_id reachable over links."""
    prints = materialize(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], shingle))
    found = groups(prints, distance=distance).withColumnRenamed("fp", "fingerprint")
    return spread(prints, found, "fingerprint", "doc_id").select("doc_id", "fingerprint", "component_id")


#: Bands of MinHash values, values in a band, and 64-bit words of a fingerprint.
BANDS, ROWS, WORDS = 24, 4, 8
_rng = np.random.default_rng(SEED)
#: A factor (odd) and a shift for each MinHash value.
FACTORS = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)


def majority(hashes: np.ndarray) -> bytes:
    """512 bits, each set if it is set in over half of the hashes, which are 64-bit seeds of 512 bits each."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        z = hashes[at : at + (1 << 13), None] + STEPS
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        counts += np.unpackbits(z.view("u1"), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


STEPS = np.arange(1, WORDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band: a hash of the MinHash values of ROWS permutations of the hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        z = hashes[None, at : at + (1 << 12)] * FACTORS + SHIFTS
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum(least, z.min(axis=1))
    return [int.from_bytes(xxhash.xxh3_64_digest(b.tobytes(), i), "big", signed=True) for i, b in enumerate(least.reshape(BANDS, ROWS))]


def wide_fingerprints(text: bytes, shingle: int) -> tuple[int, list[int], bytes]:
    """The text's node (a hash of its words), the band keys of its shingles and their fingerprint."""
    words = text.lower().split()
    line = b" ".join(words)
    node = int.from_bytes(xxhash.xxh3_64_digest(line), "big", signed=True)
    if not words:
        return node, bands(np.zeros(0, np.uint64)), b"\0" * 64
    digest = xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    runs = b"".join([digest(line[s:e]) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)])
    own = np.unique(np.frombuffer(runs, ">u8").astype(np.uint64))
    return node, bands(own), majority(own)


def bits_at(similarity: float) -> int:
    """Differing bits of 512 that two sets of this Jaccard similarity have on average, sizes being equal, and
    one standard deviation more, so that most pairs of just this similarity are caught."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * WORDS
    return round(n * p + math.sqrt(n * p * (1 - p)))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text", cell: int = 4096) -> DataFrame:
    """One document of each group, the one with the smallest doc_id (ties: the first row), all columns kept.

    Texts of equal words are one node before bands are made. Rows are numbered when they are
    written with their fingerprints; the numbers of the rows that stay are found without the texts, which cross
    the network once, for the final semi-join.
    """
    node, keys, wide, row = (fresh(docs, f"_{x}") for x in ("node", "keys", "print", "row"))
    make = lambda: lambda texts: list(zip(*[wide_fingerprints(t, shingle) for t in texts], strict=True)) if texts else [[], [], []]
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    marked = materialize(per_text(numbered, [*docs.columns, row], f"`{node}` long, `{keys}` array<long>, `{wide}` binary", make, text))
    lite = marked.select(F.col(node).alias("node"), F.col(row).alias("row"), F.col(f"`{doc_id}`").alias("id"))
    nodes = marked.groupBy(F.col(node).alias("node")).agg(F.first(keys).alias("keys"), F.first(wide).alias("print"))
    nodes = materialize(nodes)
    found = cells(nodes.select("node", F.explode("keys").alias("k")), cell)
    roots = components(search(found.join(nodes.select("node", "print"), "node").select("k", "i", "j", "node", "print"), bits_at(similarity), WORDS))
    rooted = spread(lite, roots, "node", "row", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("row").alias("c"))
    stay = rooted.groupBy("root").agg(F.min_by("row", order).alias(row)).select(row)
    return marked.join(stay, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
