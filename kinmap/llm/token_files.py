"""Token ids in flat binary files with 64-bit document offsets.

A folder of part files in ascending document order. Each part is

    ids      n_tokens unsigned little-endian integers of ``width`` bytes: memory-map this
    pad      zeros up to a multiple of 8 bytes
    offsets  n_docs int64: first token of each document, counted within the part
    doc_ids  n_docs int64
    known    n_docs bytes: 0 where the doc_id is null
    tail     n_docs int64, n_tokens int64, width (1 byte), magic (6 bytes), last byte

``manifest`` beside the parts holds each part's first document and first
token: prefix sums over the parts. A document's global start is its part's base
plus its offset.

Parts are written by Spark's own text sink, so its commit protocol applies:
lost executors and second attempts leave no double or torn parts, and any store
that Spark writes to will do. The sink ends each row with a line separator;
here that is the last byte of the end-of-document id, which every document ends
with, so the bytes on disk are the flat ids and nothing else.

Defined cases: null or empty text has the end id alone; rows that share a
doc_id are all kept, ordered by the text's hash; a null doc_id comes first; an empty
table gives an empty result; other columns aren't read, whatever their names; a very long text is encoded whole and lies in one part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm.common import blocks, give_back, shared_dir, small_batches, table, text_bytes
from kinmap.llm.pieces import Ids, cached

MAGIC = b"KMIDS1"
TAIL = 24


def layout(end_id: int, n_ids: int) -> tuple[int, int]:
    """Bytes of an id, and the last byte of the end id (below 128, so that the sink can write it)."""
    width = 2 if max(end_id, n_ids - 1) < 1 << 16 and end_id >> 8 < 128 else 4
    return width, end_id >> 8 * (width - 1)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text: str = "text", part_bytes: int = 128 << 20) -> None:
    """Encode every whole text, append ``end_id``, and write parts and manifest to ``path``.

    The texts cross the network once, range-partitioned by (id, hash of the text), so that one
    id with very many rows is spread too. A task holds one block of texts and 17 bytes a document. There are as many parts as
    keep their texts at about ``part_bytes``, at any size of the corpus; small ones have a few for each core.
    """
    from kinmap.llm.pieces import load

    spark = docs.sparkSession
    width, last = layout(end_id, load(tokenizer).get_vocab_size(with_added_tokens=True))
    end = int(end_id).to_bytes(width, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = cached(Ids, tokenizer, width)
        ids, sizes = [], []
        for b in blocks(batches, 1):
            rows = []
            for t in b.column(1).to_pylist():
                data = b"".join(memo.values(t)) + end
                sizes.append(len(data) // width)
                rows.append(data[:-1])
            ids.append(b.column(0))
            yield pa.record_batch([pa.array(rows, pa.binary())], ["row"])
        n = np.array(sizes, "<i8")
        known = pa.chunked_array(ids, pa.int64()).combine_chunks()
        total = int(n.sum())
        foot = b"\0" * (-total * width % 8) + (np.cumsum(n) - n).astype("<i8").tobytes()
        foot += known.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + known.is_valid().to_numpy(zero_copy_only=False).astype("u1").tobytes()
        foot += np.array([len(n), total], "<i8").tobytes() + bytes([width]) + MAGIC
        yield pa.record_batch([pa.array([foot], pa.binary())], ["row"])
        give_back()

    small_batches(spark)
    tie = F.xxhash64("_text")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text_bytes(F.col(f"`{text}`")).alias("_text"))
    size = rows.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()[0]
    n = max(1, -(-size // part_bytes), min(2 * spark.sparkContext.defaultParallelism, -(-size // (part_bytes // 16))))
    rows = rows.repartitionByRange(n, "_id", tie).sortWithinPartitions("_id", tie)
    rows.mapInArrow(encode, "row binary").select(F.col("row").cast("string").alias("value")).write.option("lineSep", chr(last)).text(f"{path}/ids")
    manifest(spark, path).write.parquet(f"{path}/manifest")


def parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/ids").select(F.element_at(F.split("path", "/"), -1).alias("part"), "content")


def tails(spark: SparkSession, path: str) -> list[tuple[str, bytes]]:
    """The parts' names, in order, and their last bytes: nothing else of them is read. The empty file that an empty table leaves is no part."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/ids")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def tail(status) -> tuple[str, bytes]:
        stream = fs.open(status.getPath())
        try:
            stream.seek(status.getLen() - TAIL)
            return status.getPath().getName(), bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, TAIL))
        finally:
            stream.close()

    with ThreadPoolExecutor(16) as pool:
        return sorted(pool.map(tail, [s for s in fs.listStatus(where) if s.getPath().getName().startswith("part-") and s.getLen()]))


def local_path(spark: SparkSession, path: str) -> str | None:
    """The folder as the machines' own file system has it, if that is where it lies; else None."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    return at.getPath() if at.getScheme() == "file" else None


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Bases of the parts: prefix sums of their tails. One short row for each part file comes to the driver."""
    rows, docs, tokens = [], 0, 0
    for part, tail in tails(spark, path):
        if tail[17:23] != MAGIC:
            raise ValueError(f"not a token part: {part}")
        n, total = np.frombuffer(tail, "<i8", 2).tolist()
        rows.append((part, docs, tokens))
        docs, tokens = docs + n, tokens + total
    return spark.createDataFrame(rows, "part string, first_doc long, first_token long").coalesce(1)


def unpack(content) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, offsets (one more than documents), doc_ids and known of a part (any buffer of bytes): views, not copies."""
    content = np.frombuffer(content, "u1")
    n, total = np.frombuffer(content, "<i8", 2, len(content) - TAIL).tolist()
    width = int(content[-8])
    at = total * width + (-total * width % 8)
    offsets = np.append(np.frombuffer(content, "<i8", n, at), total)
    return np.frombuffer(content, f"<u{width}", total), offsets, np.frombuffer(content, "<i8", n, at + 8 * n), np.frombuffer(content, "u1", n, at + 16 * n)


def map_part(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``unpack``, over a memory-mapped local file."""
    return unpack(np.memmap(path, "u1", "r"))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, position, start, n_tokens, ids_crc32 and, if asked, ids (array of int).

    Parts in a shared file system are memory-mapped, one task each; from other stores Spark reads them."""
    schema = "doc_id long, position long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    local = local_path(spark, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part = b.column(0)[i]
                ids, offsets, doc_ids, known = map_part(f"{local}/ids/{part.as_py()}") if local else unpack(part.as_buffer())
                first_doc, first_token = b.column(1)[i].as_py(), b.column(2)[i].as_py()
                for lo in range(0, len(doc_ids), 5_000):
                    o = offsets[lo : lo + 5_001]
                    own = ids[o[0] : o[-1]].astype("<u4")
                    k = len(o) - 1
                    crc = [zlib.crc32(own[s:e]) for s, e in zip((o[:-1] - o[0]).tolist(), (o[1:] - o[0]).tolist(), strict=True)]
                    cols = [pa.array(doc_ids[lo : lo + k], pa.int64(), mask=known[lo : lo + k] == 0), pa.array(first_doc + lo + np.arange(k)), pa.array(first_token + o[:-1]), pa.array(np.diff(o)), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array((o - o[0]).astype("i4")), pa.array(own.astype("i4"))))
                    yield pa.record_batch(cols, names)

    base = spark.read.parquet(f"{path}/manifest")
    if local:
        return base.repartition(max(1, base.count())).select("part", "first_doc", "first_token").mapInArrow(decode, schema)
    return parts(spark, path).join(F.broadcast(base), "part").select("content", "first_doc", "first_token").mapInArrow(decode, schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, path)
    return read_token_files(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
