"""Media columns: bytes with a declared type, sniffed, validated and carved.

An Aho-Corasick automaton finds every magic number in one scan. At each hit a
format validator walks the structure (chunks, segments, pages, checksums) and
gives the length, so a chance hit in text counts for nothing. The valid format
at offset 0 corrects the declared type; valid formats elsewhere are carved as
embedded media, the longest first at any place.

Texts are stored as 8-bit mono samples in a WAVE container.

Defined cases: null or empty text is one block of 64 zero samples; null media has
no type and nothing carved; bytes of no known format keep their declared type with
valid = false; equal bytes give equal results; repeated rows are treated one by one; an empty table gives an empty result; a very long text is one
object of as many samples; columns outside ``keep`` aren't read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm.common import blocks, give_back, per_text, table

#: Rate of stored texts, in samples a second.
RATE = 8000
BLOCK = 64


# Validators: (data, start) -> length of the valid object that starts there, or 0.


def png(d: bytes, at: int) -> int:
    p = at + 8
    while p + 12 <= len(d):
        n = int.from_bytes(d[p : p + 4], "big")
        if p + 12 + n > len(d) or zlib.crc32(d[p + 4 : p + 8 + n]) != int.from_bytes(d[p + 8 + n : p + 12 + n], "big"):
            return 0
        kind, p = d[p + 4 : p + 8], p + 12 + n
        if p - at == 33 and kind != b"IHDR":
            return 0
        if kind == b"IEND":
            return p - at
    return 0


def gif(d: bytes, at: int) -> int:
    if at + 13 > len(d):
        return 0
    p = at + 13 + (3 << (d[at + 10] & 7) + 1 if d[at + 10] & 128 else 0)

    def sub(p: int) -> int:
        while p < len(d) and d[p]:
            p += 1 + d[p]
        return p + 1

    while p < len(d):
        if d[p] == 0x3B:
            return p + 1 - at
        if d[p] == 0x21:
            p = sub(p + 2)
        elif d[p] == 0x2C and p + 10 < len(d):
            p = sub(p + 11 + (3 << (d[p + 9] & 7) + 1 if d[p + 9] & 128 else 0))
        else:
            return 0
    return 0


def jpeg(d: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(d) and d[p] == 0xFF:
        mark = d[p + 1]
        if mark == 0xD9:
            return p + 2 - at
        n = int.from_bytes(d[p + 2 : p + 4], "big")
        if n < 2 or p + 2 + n > len(d):
            return 0
        p += 2 + n
        if mark == 0xDA:  # entropy-coded data: up to the next marker that is neither stuffed nor a restart
            while (p := d.find(b"\xff", p)) >= 0 and p + 1 < len(d) and (d[p + 1] == 0 or 0xD0 <= d[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return 0
    return p + 2 - at if d[p : p + 2] == b"\xff\xd9" else 0


def riff(d: bytes, at: int) -> int:
    n = int.from_bytes(d[at + 4 : at + 8], "little") + 8
    if d[at + 8 : at + 12] not in (b"WAVE", b"AVI ", b"WEBP") or n < 20 or at + n > len(d):
        return 0
    p, seen = at + 12, set()
    while p + 8 <= at + n:
        seen.add(d[p : p + 4])
        size = int.from_bytes(d[p + 4 : p + 8], "little")
        p += 8 + size + size % 2
    if p - (p > at + n) != at + n:
        return 0
    return n if d[at + 8 : at + 12] != b"WAVE" or {b"fmt ", b"data"} <= seen else 0


def bmp(d: bytes, at: int) -> int:
    if at + 26 > len(d):
        return 0
    n, spare, first, head = struct.unpack_from("<IIII", d, at + 2)
    return n if spare == 0 and 26 <= first <= n <= len(d) - at and head in (12, 40, 52, 56, 108, 124) else 0


def gz(d: bytes, at: int) -> int:
    z = zlib.decompressobj(31)
    p = at
    try:
        while p < len(d) and not z.eof:
            z.decompress(d[p : p + 65536], 1 << 20)
            while z.unconsumed_tail:
                z.decompress(z.unconsumed_tail, 1 << 20)
            p += 65536
    except zlib.error:
        return 0
    return min(p, len(d)) - len(z.unused_data) - at if z.eof else 0


def zipped(d: bytes, at: int) -> int:
    end = d.find(b"PK\x05\x06", at)
    while 0 <= end and end + 22 <= len(d):
        size, first, comment = struct.unpack_from("<IIH", d, end + 12)
        if at + first + size == end and end + 22 + comment <= len(d):
            return end + 22 + comment - at
        end = d.find(b"PK\x05\x06", end + 4)
    return 0


def pdf(d: bytes, at: int) -> int:
    end = d.find(b"%%EOF", at)
    return end + 5 - at if end > 0 and d[at + 5 : at + 6].isdigit() and d.find(b"startxref", at, end) > 0 else 0


def ogg(d: bytes, at: int) -> int:
    p = at
    while d[p : p + 5] == b"OggS\0" and p + 27 <= len(d):
        table_end = p + 27 + d[p + 26]
        end = table_end + sum(d[p + 27 : table_end])
        if end > len(d):
            return 0
        last, p = d[p + 5] & 4, end
        if last:
            return p - at
    return 0


def flac(d: bytes, at: int) -> int:
    p, first = at + 4, True
    while p + 4 <= len(d):
        kind, n = d[p], int.from_bytes(d[p + 1 : p + 4], "big")
        if first and (kind & 127 or n != 34) or p + 4 + n > len(d):
            return 0
        first, p = False, p + 4 + n
        if kind & 128:  # frames have no length: they go to the end
            return len(d) - at if d[p : p + 1] == b"\xff" else 0
    return 0


#: Magic bytes at the start of each format.
FORMATS: list[tuple[bytes, str, Callable[[bytes, int], int]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", png),
    (b"GIF87a", "image/gif", gif),
    (b"GIF89a", "image/gif", gif),
    (b"\xff\xd8\xff", "image/jpeg", jpeg),
    (b"RIFF", "riff", riff),
    (b"BM", "image/bmp", bmp),
    (b"\x1f\x8b\x08", "application/gzip", gz),
    (b"PK\x03\x04", "application/zip", zipped),
    (b"%PDF-", "application/pdf", pdf),
    (b"OggS", "audio/ogg", ogg),
    (b"fLaC", "audio/flac", flac),
]
RIFF = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}


@functools.cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, (magic, _, _) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), i)
    a.make_automaton()
    return a


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every valid object, outermost first. Objects inside another count as well."""
    found = []
    for end, i in automaton().iter(data.decode("latin-1")):
        magic, kind, length = FORMATS[i]
        at = end + 1 - len(magic)
        if n := length(data, at):
            found.append((RIFF[data[at + 8 : at + 12]] if kind == "riff" else kind, at, n))
    return sorted(found, key=lambda x: (x[1], -x[2], x[0]))


def to_wave(payload: bytes) -> bytes:
    """Bytes as unsigned 8-bit mono samples."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)
    return head + payload + b"\0" * (n % 2)


def from_wave(data: bytes) -> tuple[np.ndarray, int]:
    """The samples and their rate."""
    if riff(data, 0) == 0 or data[8:12] != b"WAVE":
        raise ValueError("not a wave")
    p, rate = 12, 0
    while p + 8 <= len(data):
        kind, n = data[p : p + 4], int.from_bytes(data[p + 4 : p + 8], "little")
        if kind == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, p + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono")
        elif kind == b"data":
            return np.frombuffer(data, "u1", n, p + 8), rate
        p += 8 + n + n % 2
    raise ValueError("no samples")


def padded(text: bytes) -> bytes:
    return text + b"\0" * (BLOCK - len(text) % BLOCK if len(text) % BLOCK or not text else 0)


def store(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Texts as media: ``keep`` columns, n_bytes, declared (always a general type here) and media."""

    def make():
        return lambda texts: [[len(t) for t in texts], ["application/octet-stream"] * len(texts), [to_wave(padded(t)) for t in texts]]

    return per_text(docs, keep, "n_bytes long, declared string, media binary", make, text)


def inspect(media: DataFrame, keep: list[str], content: str = "media", declared: str = "declared") -> DataFrame:
    """``keep`` columns, detected (the corrected type), valid, media_bytes, media_sha256 and
    carved: array of (type, offset, length, sha256) of media inside or behind the first."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    new = _parse_datatype_string("detected string, valid boolean, media_bytes long, media_sha256 string, carved array<struct<type:string,offset:long,length:long,sha256:string>>, samples struct<n:long,rate:long,sha256:string,tail_crc32:long,peak:long,total:long>")
    out = StructType([*(StructField(c, media.schema[c].dataType) for c in keep), *new.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out, prefers_large_types=False)
    n = len(keep)

    def one(data: bytes | None, said: str | None) -> tuple:
        if data is None:
            return said, False, None, None, [], None
        found = sniff(data)
        first = next((x for x in found if x[1] == 0), None)
        kind = first[0] if first else said
        carved = [{"type": t, "offset": a, "length": m, "sha256": hashlib.sha256(data[a : a + m]).hexdigest()} for t, a, m in found if (t, a, m) != first]
        samples = None
        if kind == "audio/wav" and first:
            try:
                wave, rate = from_wave(data)
                samples = {"n": len(wave), "rate": rate, "sha256": hashlib.sha256(wave).hexdigest(), "tail_crc32": zlib.crc32(wave[-BLOCK:]), "peak": int(wave.max(initial=0)), "total": int(wave.sum(dtype=np.int64))}
            except ValueError:
                pass
        return kind, first is not None, len(data), hashlib.sha256(data).hexdigest(), carved, samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, n):
            rows = [one(d, s) for d, s in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)]
            made = [pa.array([r[i] for r in rows], arrow.field(n + i).type) for i in range(len(new.fields))]
            yield pa.RecordBatch.from_arrays([b.column(i).cast(arrow.field(i).type) for i in range(n)] + made, schema=arrow)
        give_back()

    return media.select(*[F.col(f"`{c}`") for c in keep], F.col(content).alias("_content"), F.col(declared).alias("_declared")).mapInArrow(run, out)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = inspect(store(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id", "n_bytes"])
    s = F.col("samples")
    feature = F.concat_ws(";", "detected", *[F.concat(F.lit(f"{k}="), s[k]) for k in ("rate", "n", "peak", "total")], F.concat(F.lit("carved="), F.array_join(F.transform("carved", lambda x: F.concat_ws(":", x["type"], x["offset"], x["length"])), ",")))
    return seen.select("doc_id", "n_bytes", s["n"].alias("payload_bytes"), s["sha256"].alias("payload_sha256"), s["tail_crc32"].alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"))
