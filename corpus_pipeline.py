"""A corpus pipeline of five stages: each reads the whole output of the one before.

Defined cases, for every stage: an empty table gives an empty result; repeated rows are judged one by one, but for near copies; very long texts are
read whole; further columns of documents are carried along, whatever their names, by all but the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm.common import fresh, materialize, shared_dir, table
from kinmap.llm.decontaminate import mark, without
from kinmap.llm.secret_scan import findings, update_ledger
from kinmap.llm.segmentation import sampled_segmentations
from kinmap.llm.simhash import drop_near_duplicates
from kinmap.llm.toxicity import drop_toxic, fit

#: Segmentations that the last stage draws for each document.
SEGMENTATIONS = 2
#: Words whose lattices one of its workers remembers, and bytes of text that it works on at once: little, beside what earlier stages left in executors.
LATTICES, BLOCK = 80_000, 1 << 17


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above their language's toxicity threshold go. Learns from at most 1500 label rows of each class; all label rows set the thresholds.

    A null or empty text is scored by the model's bias alone; a null language, or one without enough label rows, has the threshold of
    all; a score at the threshold goes; without label rows of both classes nothing goes."""
    labels = table(spark, sf_dir, "labels")
    return drop_toxic(docs, fit(docs, labels), labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest doc_id stays.

    Candidates share one of 24 bands of MinHash values, which pairs of 0.8 do with probability 0.99999; fingerprints of 512 bits verify them at the
    distance that such pairs have on average and a standard deviation more (the README has measured recall by similarity). Null and empty texts are
    equal and so one group; a text of fewer than five words is one shingle; equal doc_ids: the first row stays; a null doc_id comes last."""
    return drop_near_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage of eight words or more, or windows of two items, go.

    An item of fewer than eight words is a window that clean documents may hold by chance: alone it is cut out of
    the text, and the document stays. n_chars, if there, is renewed. Null texts and texts without words stay; null items hit nothing."""
    found = fresh(docs, "_found")
    marked = mark(docs, table(spark, sf_dir, "benchmark"), docs.columns, out=found)
    long = F.exists(f"{found}.spans", lambda s: s["end"] - s["start"] >= 8)
    hit = F.size(f"{found}.spans") > 0
    left = marked.filter(~(long | (F.size(f"{found}.items") >= 2)))
    clean = left.withColumn("text", without(F.col("text"), F.col(f"{found}.spans"), hit))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.drop(found)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret in a text is replaced by its kind in brackets; no document goes. n_chars, if there, is renewed. Spans that
    overlap are replaced as one each from the left; of two that start at one place the rule listed first comes first. A null text stays null."""
    spans = fresh(docs, "_spans")
    found = findings(docs, update_ledger(docs, shared_dir(spark), fresh=True), keep=(*docs.columns,), out=spans)
    merged = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))).otherwise(
            F.struct(F.concat(acc["out"], F.substr("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))
        ),
        lambda acc: F.concat(acc["out"], F.substr("text", (acc["at"] + 1).cast("int"))),
    )
    clean = found.withColumn("text", F.when(F.size(spans) > 0, merged).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document and sampled segmentation: doc_id, sample, n_pieces, log_prob, perturbed, log_inclusion, ids_crc32, decoded, ids.

    A null or empty text has one segmentation, without pieces; one with fewer segmentations than are drawn has them all; rows with equal doc_id and
    text have equal samples."""
    import public_tokenizers

    found = sampled_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), k=SEGMENTATIONS, block=BLOCK, words=LATTICES)
    return found.select("doc_id", F.inline("samples"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("secrets", secrets),
    ("segmentation", segmentation),
]

#: Training, hashing and sampling can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
