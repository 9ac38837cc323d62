"""Exact token counts of whole texts; huge texts by overlap resynchronisation.

Texts up to ``chunk`` bytes are counted from remembered pieces (``pieces.py``).
A longer text is encoded in chunks that overlap. In each overlap the two
encodings are spliced at a boundary that is proven stable: both have a token
boundary there, and the pre-tokenizer always cuts there (a blank between ASCII
letters or digits), so nothing before it can change what follows. An overlap without such a place is doubled, up to the whole text.

Defined cases: null or empty text has 0 bytes and 0 tokens; repeated rows are
counted one by one; an empty table gives an empty result; special strings have no blanks, so that no cut falls into one (with a tokenizer
that has such strings, texts are encoded whole); only ``keep`` columns
are carried along, so other columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm.common import per_text, table
from kinmap.llm.pieces import Counts, cached

SPACE = " \t\n\r\x0b\x0c"


def spliced(tokenizer, text: str, chunk: int, overlap: int) -> tuple[int, int]:
    """Number of tokens of ``text``, and how often an overlap had to be widened."""
    if any(" " in t.content for t in tokenizer.get_added_tokens_decoder().values()):  # a cut could fall into such a string
        return len(tokenizer.encode(text, add_special_tokens=False).ids), 0
    n, total, widened = len(text), 0, 0
    begin, spliced_at, end = 0, 0, min(len(text), chunk + overlap)
    left = places(tokenizer, text, begin, end)
    while end < n:
        start, span, cut = end - overlap, overlap, None
        while True:
            far = min(n, start + chunk + span)
            right = places(tokenizer, text, start, far)
            cut = stable(text, left, right, start, end)
            if cut is not None or end >= n:
                break
            widened, span = widened + 1, 2 * span
            end = min(n, start + span)
            left = places(tokenizer, text, begin, end)
        if cut is None:
            break
        total += bisect_left(left[0], cut) - bisect_left(left[0], spliced_at)
        left, begin, spliced_at, end = right, start, cut, far
    return total + len(left[0]) - bisect_left(left[0], spliced_at), widened


def places(tokenizer, text: str, begin: int, end: int) -> tuple[list[int], list[int]]:
    """Where the tokens of text[begin:end] start and end, as positions in the whole text."""
    offsets = tokenizer.encode(text[begin:end], add_special_tokens=False).offsets
    return [a + begin for a, _ in offsets], [b + begin for _, b in offsets]


def stable(text: str, left: tuple, right: tuple, start: int, end: int) -> int | None:
    """The last stable common boundary in text[start:end]: a single blank between
    ASCII letters or digits, before which a token ends in both encodings."""
    for p in range(end - 2, start, -1):
        if text[p] == " " and plain(text[p - 1]) and plain(text[p + 1]):
            i, j = bisect_left(left[0], p), bisect_left(right[0], p)
            if i and j and left[1][i - 1] == p == right[1][j - 1]:
                return p
    return None


def plain(c: str) -> bool:
    return c.isascii() and c.isalnum()


def count(data: bytes, memo, chunk: int, overlap: int) -> int:
    if len(data) <= chunk or not memo.way:
        return sum(memo.values(data))
    return spliced(memo.tokenizer, data.decode("utf-8", "replace"), chunk, overlap)[0]


def piece_counter(path: str):
    """The counter for a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda data: len(model.encode(data.decode("utf-8", "replace"), num_threads=1))


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 1024, chunk: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """``keep`` columns, n_bytes (UTF-8), n_tokens as the tokenizer's own library
    counts them, and over_limit (more than ``limit`` tokens).

    One pass over the scan's partitions, without a shuffle; a worker holds one
    block of texts and a memo of bounded size.
    """

    def make():
        if tokenizer.endswith(".model"):
            one = piece_counter(tokenizer)
        else:
            memo = cached(Counts, tokenizer)
            one = lambda data: count(data, memo, chunk, overlap)
        return lambda texts: [[len(t) for t in texts], [one(t) for t in texts]]

    made = per_text(docs, list(keep), "n_bytes long, n_tokens long", make, text)
    return made.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
