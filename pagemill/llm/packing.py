"""Packing documents into sequences: cutting-stock patterns by column generation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from pagemill.llm.common import row_blocks, running
from pagemill.llm.words_bpe import BLOCK, encoder
from pagemill.session import cut_lineage

LENGTH = 4096
GRAIN = 16
"""Piece lengths are rounded up to multiples of this for the patterns: LENGTH / GRAIN kinds at most."""
END = 2


def best_pattern(value: np.ndarray, kinds: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: the most valuable multiset of kinds (sizes) that fits into ``room``."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        n = int(np.searchsorted(kinds, c, side="right"))
        best[c] = best[c - 1]
        if n:
            got = best[c - kinds[:n]] + value[:n]
            i = int(got.argmax())
            if got[i] > best[c]:
                best[c], last[c] = got[i], i
    counts, c = np.zeros(len(kinds)), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= kinds[last[c]]
    return float(best[room]), counts


def patterns(histogram: dict[int, int], room: int = LENGTH // GRAIN) -> list[tuple[dict[int, int], int]]:
    """How to fill sequences of ``room`` with ``histogram`` (size -> pieces): [(pattern, times)].

    The linear program minimises the number of sequences over patterns that cover the histogram. It starts with one
    pattern per size; the duals of the current basis price further patterns in a knapsack, and the best one enters by
    the simplex rule until none pays. Whole parts of the solution are taken; the pieces that remain, a few for each
    pattern, are filled in by size. Only counts are handled, room kinds at most.
    """
    kinds = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    if not len(kinds):
        return []
    need = np.array([histogram[int(k)] for k in kinds], float)
    columns = [np.eye(len(kinds))[i] * (room // k) for i, k in enumerate(kinds)]
    cost = np.ones(len(kinds))
    inverse = np.diag([1.0 / (room // k) for k in kinds])
    level = inverse @ need
    for step in range(40 * len(kinds)):
        if step % 200 == 199:  # rounding errors do not pile up
            inverse = np.linalg.inv(np.array(columns).T)
            level = np.maximum(inverse @ need, 0)
        dual = cost @ inverse
        worst = int(dual.argmin())
        if dual[worst] < -1e-9:  # covering more than needed is free
            enter, price = -np.eye(len(kinds))[worst], 0.0
        else:
            gain, enter = best_pattern(dual, kinds, room)
            price = 1.0
            if gain <= 1 + 1e-9:
                break
        move = inverse @ enter
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(move > 1e-9, level / move, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        pivot = inverse[out] / move[out]
        inverse = inverse - np.outer(move, pivot)
        inverse[out] = pivot
        level = np.maximum(level - move * ratio[out], 0)
        level[out] = ratio[out]
        columns[out], cost[out] = enter, price
    found, rest = [], need.copy()
    for column, price, times in sorted(zip(columns, cost, level), key=lambda x: -x[2]):
        used = column > 0
        if price and used.any():
            whole = int(min(np.floor(times + 1e-6), (rest[used] // column[used]).min()))
            if whole > 0:
                found.append(({int(k): int(c) for k, c in zip(kinds, column) if c}, whole))
                rest -= whole * column
    while rest.any():
        left, pattern = room, {}
        for i in range(len(kinds) - 1, -1, -1):
            n = int(min(rest[i], left // kinds[i]))
            if n:
                pattern[int(kinds[i])] = n
                left -= n * int(kinds[i])
        times = int(min(rest[np.searchsorted(kinds, k)] // n for k, n in pattern.items()))
        for k, n in pattern.items():
            rest[np.searchsorted(kinds, k)] -= times * n
        found.append((pattern, times))
    return found


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, nth): each row's ids and ``end``, cut every ``length`` ids.

    ``nth`` counts the pieces of one task, which tells repeated rows apart.
    """
    keys = docs.select("doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, nth = encoder(path), 0
        for batch in batches:
            for lo, hi in row_blocks(batch.column(1), BLOCK):
                rows = batch.slice(lo, hi - lo)
                slots, n_words = enc.rows(rows.column(1))
                ids, sizes = enc.gather(slots)
                bounds = np.append(0, np.cumsum(sizes, dtype=np.int64))[np.append(0, np.cumsum(n_words))]
                # All rows' ids in one array, each row's followed by its end.
                own = np.diff(bounds)
                joined = np.full(len(ids) + len(own), end, "<u4")
                joined[np.arange(len(ids)) + np.repeat(np.arange(len(own)), own)] = ids
                whole = own + 1
                many = -(-whole // length)
                row = np.repeat(np.arange(len(own)), many)
                start = length * (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many))
                size = np.minimum(whole[row] - start, length)
                at = (bounds[:-1] + np.arange(len(own)))[row] + start
                crc = [zlib.crc32(joined[x : x + n]) for x, n in zip(at.tolist(), size.tolist())]
                whole = whole[row]
                longs = [pa.array(x, pa.int64()) for x in (start, size, crc, whole, range(nth, nth + len(row)))]
                nth += len(row)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(row, pa.int64())), *longs], ["doc_id", *names]
                )

    names = ["start", "length", "ids_crc32", "doc_tokens", "nth"]
    return keys.mapInArrow(cut, StructType([keys.schema["doc_id"], *(StructField(n, LongType()) for n in names)]))


def pack(docs: DataFrame, path: str, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): all pieces in their sequences.

    Rows are tokenized once; what moves afterwards are pieces without their ids. A histogram of rounded lengths goes to
    the driver (length / grain numbers), the patterns come back as a small table, and pieces take their places by rank
    within their kind. A null text is one end id. Repeated rows are packed as often as they come.
    """
    spark = docs.sparkSession
    cut = cut_lineage(
        pieces(docs, path, length)
        .withColumn("kind", F.ceil(F.col("length") / grain).cast("int"))
        .withColumn("_mark", F.xxhash64("doc_id", "start", "ids_crc32", "nth"))
        .withColumn("_one", F.lit(1).cast("long"))
    )
    histogram = {r["kind"]: r["n"] for r in cut.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken, runs, sequence = dict.fromkeys(histogram, 0), [], 0
    for pattern, times in patterns(histogram, length // grain):
        for kind, n in pattern.items():
            runs.append((kind, taken[kind], taken[kind] + n * times, n, sequence))
            taken[kind] += n * times
        sequence += times
    schema = StructType(
        [StructField("kind", IntegerType()), *(StructField(n, LongType()) for n in ("_lo", "_hi", "_each", "_first"))]
    )
    plan = spark.createDataFrame(runs, schema)
    ranked = running(cut, ["kind"], ["length", "_mark"], "_one")
    at = F.col("before") - F.col("_lo")
    placed = ranked.join(F.broadcast(plan), "kind").where(
        (F.col("before") >= F.col("_lo")) & (F.col("before") < F.col("_hi"))
    )
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "before", "kind").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return placed.withColumn("sequence_id", F.col("_first") + F.floor(at / F.col("_each"))).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
