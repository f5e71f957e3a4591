"""Token counts: overlapping chunks of long texts, spliced where both chunks agree on a boundary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from pagemill.llm.common import row_blocks
from pagemill.llm.words_bpe import BLOCK, encoder

CHUNK = 32_768
OVERLAP = 256
AGREE = 8
"""Tokens that both chunks must share from a boundary on."""
BLANKS = " \t\n\r\x0b\x0c"


class Encoded:
    """One chunk, encoded by the library on its own: its ids, and where each starts and stops in the whole text."""

    def __init__(self, tokenizer: Tokenizer, text: str, lo: int, hi: int):
        got = tokenizer.encode(text[lo:hi], add_special_tokens=False)
        self.lo, self.hi = lo, hi
        self.ids = np.array(got.ids, np.int64)
        at = np.array(got.offsets, np.int64).reshape(-1, 2) + lo
        self.starts, self.stops = at[:, 0], at[:, 1]


def splice(left: Encoded, right: Encoded, text: str, agree: int = AGREE) -> int | None:
    """A boundary at which both chunks may be joined: the start of ``agree`` tokens that both have, with equal ids and
    offsets, and with white space right before it.

    The library splits at white space before anything else, so there neither chunk's cut can reach the tokens on the
    other side: those left of the boundary are the left chunk's, the others the right one's. Tokens next to a cut may be
    halves of words; they differ between the chunks or have no white space before them. Without such a run there is no
    boundary.
    """
    i = np.searchsorted(left.starts, max(right.lo, left.lo))
    starts, inverse = np.unique(left.starts[i:], return_index=True)
    for start, k in zip(starts.tolist(), (inverse + i).tolist()):
        if start <= right.lo or text[start - 1] not in BLANKS:
            continue
        j = int(np.searchsorted(right.starts, start))
        n = min(agree, len(left.ids) - k)
        same = n == agree and len(right.ids) - j >= n and all(
            np.array_equal(a[k : k + n], b[j : j + n])
            for a, b in ((left.ids, right.ids), (left.starts, right.starts), (left.stops, right.stops))
        )
        if same:
            return start
    return None


def count_long(tokenizer: Tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int, int]:
    """(tokens, chunks, widenings) of one text. Where chunks share no boundary, their overlap is doubled."""
    total, chunks, widened = 0, 1, 0
    left, begin = Encoded(tokenizer, text, 0, min(chunk, len(text))), 0
    while left.hi < len(text):
        width, at = overlap, None
        while at is None:
            lo = max(left.lo, left.hi - width)
            right = Encoded(tokenizer, text, lo, min(lo + width + chunk, len(text)))
            if lo == left.lo:  # the left chunk as a whole is part of the right one
                break
            at = splice(left, right, text)
            if at is None or at < begin:
                at, width, widened = None, 2 * width, widened + 1
        if at is not None:
            total += int(((left.starts >= begin) & (left.starts < at)).sum())
            begin = at
        left, chunks = right, chunks + 1
    return total + int((left.starts >= begin).sum()), chunks, widened


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_chunks, n_widened) for each row; a null text counts as empty.

    Texts of up to ``chunk`` bytes are one chunk, encoded word by word (:class:`WordEncoder`). Longer ones are cut into
    chunks that overlap; the library encodes each chunk on its own, and it is spliced to the one before at a boundary
    that both prove. A text without white space has no such boundary, and its chunks widen until they are the whole
    text. Only doc_id and text are read; repeated rows are counted each. No shuffle.
    """
    keys = docs.select("doc_id", "text")
    names = ["n_bytes", "n_tokens", "n_chunks", "n_widened"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo, hi in row_blocks(batch.column(1), BLOCK):
                rows = batch.slice(lo, hi - lo)
                sizes = pc.fill_null(pc.binary_length(rows.column(1)), 0).to_numpy(zero_copy_only=False)
                long = np.flatnonzero(sizes > chunk)
                slots, n_words = enc.rows(pc.if_else(pa.array(sizes > chunk), "", rows.column(1)))
                tokens = np.diff(np.append(0, np.cumsum(enc.size[slots], dtype=np.int64))[np.append(0, np.cumsum(n_words))])
                chunks, widened = np.ones(len(rows), np.int64), np.zeros(len(rows), np.int64)
                for i in long.tolist():
                    text = rows.column(1)[i].as_py()
                    tokens[i], chunks[i], widened[i] = count_long(enc.tokenizer, text, chunk, overlap)
                n_bytes = pc.fill_null(pc.binary_length(rows.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), n_bytes, *map(pa.array, (tokens, chunks, widened))], ["doc_id", *names]
                )

    out = StructType([keys.schema["doc_id"], *(StructField(n, LongType()) for n in names)])
    return keys.mapInArrow(count, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn(
        "over_limit", F.col("n_tokens") > 2048
    )
