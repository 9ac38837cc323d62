"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import resource
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one Arrow batch or one numpy block may hold, roughly.
BLOCK_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name under the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only where it
    is unset, as in local tests, one beside the warehouse is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{base.rstrip('/')}/kinmap-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by this module."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(col: str | Column = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit("")).cast("binary")


def fold(keyed: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(keyed.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def blocks(batches: Iterator[pa.RecordBatch], column: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` (binary) holds about ``most`` bytes at most, one row at least."""
    for batch in batches:
        start, held = 0, 0
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(sizes):
            if i > start and held + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def spread(rows: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner", salts: int = 8) -> DataFrame:
    """``rows`` joined with ``one`` (one row for each ``key``), a hot key's rows in ``salts`` shares: by the hash of column ``by``, so
    that a task that runs again deals them out alike. ``one`` crosses the network ``salts`` times. It has as many rows as there are
    keys, so it is never broadcast, however small its files are: the driver's memory would bound the input."""
    salt = fresh(rows, "_salt")
    a = rows.withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{by}`")), F.lit(salts)).cast("int"))
    b = one.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b.hint("merge"), [key, salt], how).drop(salt)


#: Texts in one Arrow batch between the JVM and Python, which hold a batch in memory twice.
BATCH_ROWS = 1000

_KEPT: dict = {}


def remembered(key, build: Callable[[], object]) -> object:
    """What ``build`` made last under this key in this Python worker, so that later tasks find memos filled.
    One thing at a time: another key frees it."""
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            trim()
        _KEPT[key] = build()
    return _KEPT[key]


def give_back(most: int = 500 << 20) -> None:
    """Return free memory to the system, and what is remembered too if the worker holds over ``most`` bytes:
    workers live on after a task, beside those of the next stage."""
    with contextlib.suppress(OSError, ValueError), open("/proc/self/statm") as f:
        if int(f.read().split()[1]) * resource.getpagesize() > most:
            _KEPT.clear()
    trim()


def trim() -> None:
    """Return free memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Hold this session's Arrow batches to BATCH_ROWS rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def per_text(df: DataFrame, keep: list[str], schema: str, make: Callable[[], Callable[..., list]], text: str = "text", also: str | None = None) -> DataFrame:
    """Columns computed from each whole text, beside the ``keep`` columns.

    ``make()`` runs once in a task and returns a function from a list of texts
    (UTF-8 bytes, null as empty) to a list of Arrow arrays or sequences, in
    the order of ``schema`` (DDL of the new columns). ``also`` names a column whose values the
    function gets as a second list. Rows stay where they are: no shuffle.
    """
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    new = T._parse_datatype_string(schema)
    # names go over as numbers: Spark would look for a column with a dot in its name inside another one
    out = T.StructType([T.StructField(f"_c{i}", df.schema[c].dataType, df.schema[c].nullable) for i, c in enumerate(keep)] + list(new.fields))
    arrow = to_arrow_schema(out, prefers_large_types=False)
    n, kept = len(keep), text in keep
    at = keep.index(text) if kept else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in blocks(batches, at):
            texts = [x or b"" for x in b.column(at).to_pylist()]
            made = f(texts, *([b.column(b.num_columns - 1).to_pylist()] if also else []))
            cols = [b.column(i).cast(arrow.field(i).type) for i in range(n)]
            cols += [x.cast(arrow.field(n + i).type) if isinstance(x, pa.Array) else pa.array(x, arrow.field(n + i).type) for i, x in enumerate(made)]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)
        give_back()

    body = F.col(f"`{text}`").cast("binary")  # goes over once, also where it is kept
    columns = [(body if c == text else F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(keep)]
    sent = df.select(*columns, *([] if kept else [body.alias("_text")]), *([F.col(f"`{also}`").alias("_also")] if also else []))
    return sent.mapInArrow(run, out).toDF(*keep, *[f.name for f in new.fields])
