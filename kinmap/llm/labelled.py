"""Bounded samples of labelled texts for training on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmap.llm.common import text_bytes


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, max_bytes: int, also: tuple[str, ...] = ()) -> list:
    """Rows (text as bytes, label, *also) for training, the same at each call.

    Of the label rows that ``learn`` allows, the ``per_class`` of each class (0 and 1) with the
    smallest hash of doc_id; of their texts, those of ``max_bytes`` at most (a bound of what is learned from; every text is scored whole). So at most
    2 * per_class ids are broadcast, and at most that many texts come to the driver
    (more only where documents repeat a doc_id; the count is held to 4 * per_class).
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn)
    known = known.select("doc_id", F.col(label).cast("int").alias("label")).distinct().withColumn("order", F.xxhash64("doc_id"))
    ids = [r for c in (0, 1) for r in known.filter(F.col("label") == c).orderBy("order", "doc_id").limit(per_class).collect()]
    if not ids:
        return []
    wanted = docs.sparkSession.createDataFrame([(r.doc_id, r.label, r.order) for r in ids], "_id long, label int, _order long")
    body = text_bytes("text").alias("text")
    rows = docs.join(F.broadcast(wanted), F.col("doc_id") == F.col("_id")).select(body, "label", "_order", *also).filter(F.length("text") <= max_bytes)
    return rows.orderBy("_order", "label", "text").limit(4 * per_class).collect()
