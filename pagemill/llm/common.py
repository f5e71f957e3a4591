"""Helpers the operators share: running sums over hot groups, row keys, words as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import cut_lineage, new_table_path

WORD = r"[^\x20\x09-\x0D]+"
"""A word: a run of anything but ASCII white space."""

def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: unlike a checkpoint it has a known size, by which Spark may choose
    to broadcast it instead of shuffling what it is joined with."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, group: list[str], order: list[str], weight: str, name: str = "before") -> DataFrame:
    """Add the sum of ``weight`` over the rows that come earlier in their group.

    Rows are dealt out by ranges of (group, order), so a hot group is spread over many tasks: each task sums its own
    range, and one small row per range and group carries what lies before it. The dealt rows are stored, because
    range borders may differ when they are drawn again. Group columns must not be null.
    """
    dealt = cut_lineage(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    keys = [*group, "_part"]
    over_parts = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut_lineage(
        dealt.groupBy(*keys)
        .agg(F.sum(weight).alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(over_parts), F.lit(0)))
        .drop("_sum")
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return local.join(parts, keys).withColumn(name, F.col("_base") + F.col("_local")).drop("_part", "_base", "_local")


def text_hash(text: Column) -> Column:
    """Tells rows with one doc_id apart: 64 bits of the text, null and empty alike."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


# Words as numpy arrays.

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = 2**64
_CHAR = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Texts:
    """Some rows' texts as one byte array; null is empty. ``lower`` lower-cases A-Z."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = pc.fill_null(column, "").cast(pa.large_string())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = raw[at[0] : at[-1]]
        self.offsets = at - at[0]
        if lower:
            upper = (self.data >= 65) & (self.data <= 90)
            self.data = self.data + (upper.view(np.uint8) << np.uint8(5))

    def words(self) -> Words:
        return Words(self)


class Words:
    """Words of some texts: byte spans, and ``first[i]:first[i+1]`` as the words of row i."""

    def __init__(self, texts: Texts):
        data, offsets = texts.data, texts.offsets
        n = len(data)
        self.data = data
        solid = np.empty(n + 2, bool)  # shifted by one, with white space at both ends
        solid[0] = solid[-1] = False
        np.logical_not(_SPACE[data], out=solid[1:-1])
        begins = solid[1:-1] & ~solid[:-2]
        ends = solid[1:-1] & ~solid[2:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        begins[inner] |= solid[inner + 1]
        ends[inner - 1] |= solid[inner]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def row_end(self) -> np.ndarray:
        """For each word, the index after its row's last word."""
        return np.repeat(self.first[1:], self.count)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, block: int = 1 << 19) -> np.ndarray:
        """64 bits for each word, worked out a block of bytes at a time."""
        out = np.empty(len(self.start), np.uint64)
        lo = 0
        while lo < len(out):
            hi = max(int(np.searchsorted(self.end, self.start[lo] + block)), lo + 1)
            begin, stop = self.start[lo], self.end[hi - 1]
            start, end = self.start[lo:hi] - begin, self.end[lo:hi] - begin
            length = end - start
            seg = self.data[begin:stop]
            place = np.arange(len(seg)) - np.repeat(start, np.diff(np.append(start, len(seg))))
            inside = ~_SPACE[seg]
            values = np.zeros(len(seg), np.uint64)
            values[inside] = (seg[inside].astype(np.uint64) + np.uint64(1)) * powers(_CHAR, int(length.max()))[place[inside]]
            out[lo:hi] = mix64(np.add.reduceat(values, start) + length.astype(np.uint64))
            lo = hi
        return out


class Spans:
    """Hashes of any span of a sequence of word hashes, from prefix sums."""

    def __init__(self, word_hashes: np.ndarray, base: int):
        n = len(word_hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(word_hashes * powers(base, n)[:n], out=self.sums[1:])
        self.undo = powers(pow(base, -1, _MASK), n + 1)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix64((self.sums[hi] - self.sums[lo]) * self.undo[lo] + (hi - lo).astype(np.uint64))


def row_blocks(column: pa.Array, target: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``target`` bytes of text each (a longer text stands alone), to bound memory."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    lo, total = 0, 0
    for i, size in enumerate(sizes):
        if i > lo and total + size > target:
            yield lo, i
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)
