"""Exact top-k search by inner product, with bounds from segment means and deviations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

LEVELS = (1, 4, 16)
"""Numbers of segments, from coarse to fine."""
BLOCK = 8192
"""Queries that one pass over the vectors serves: 4 MB of 64 numbers each."""
PILOT = 1024
ROWS = 2048


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component; null for a vector with a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(whole, F.transform(x, lambda v: F.floor(v * 256).cast("long")))


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Mean and deviation of each segment, scaled so that their inner product bounds that of the vectors.

    Within a segment of n numbers, q.v is n times the product of the means plus the product of the parts around the
    means, which is at most the product of their norms (n times the product of the deviations).
    """
    cuts = np.linspace(0, vectors.shape[1], min(segments, max(vectors.shape[1], 1)) + 1).astype(int)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = vectors[:, a:b]
        mean = part.mean(axis=1) if b > a else np.zeros(len(part))
        out += [mean * np.sqrt(b - a), np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(out, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where all sums fit, else in Python's integers, cut to long."""
    peak = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if peak < 2**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if peak < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, 1 - 2**63, 2**63 - 1).astype(np.int64)


class Queries:
    """Some queries of one dimension, their statistics at all levels, and the best score each is sure to reach."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        real = vectors.astype(float)
        self.levels = [segment_statistics(real, s) for s in LEVELS]
        self.norms = np.sqrt((real**2).sum(axis=1))
        # Queries are vectors too: the k-th best of some of them is a bound for the result.
        self.least = np.full(len(ids), np.iinfo(np.int64).min)
        for lo in range(0, len(ids), ROWS):
            score = products(vectors[lo : lo + ROWS], vectors[:PILOT])
            score[ids[lo : lo + ROWS, None] == ids[None, :PILOT]] = np.iinfo(np.int64).min
            if score.shape[1] >= k:
                self.least[lo : lo + ROWS] = np.partition(score, -k, axis=1)[:, -k]


def search_block(queries: Queries, least: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
    """(query, row, score) of all pairs that may be among the best k; raises ``least`` by what it sees."""
    real = vectors.astype(float)
    slack = 1e-6 + 1e-9 * queries.norms.max(initial=0) * np.sqrt((real**2).sum(axis=1)).max(initial=0)
    need = least.astype(float) - slack
    q = np.arange(len(queries.ids))
    row = None
    for stats, segments in zip(queries.levels, LEVELS):
        own = segment_statistics(real, segments)
        if row is None:  # the coarsest bounds of all pairs; finer ones of the survivors only
            q, row = np.nonzero(stats @ own.T >= need[:, None])
        elif len(q):
            bound = np.concatenate(
                [np.einsum("ij,ij->i", stats[q[i : i + 65536]], own[row[i : i + 65536]]) for i in range(0, len(q), 65536)]
            )
            stay = bound >= need[q]
            q, row = q[stay], row[stay]
    apart = queries.ids[q] != ids[row]
    q, row = q[apart], row[apart]
    if not len(q):
        return q, row, np.zeros(0, np.int64)
    seen, back = np.unique(q, return_inverse=True)
    score = products(queries.vectors[seen], vectors)[back, row]
    stay = score >= least[q]
    return q[stay], row[stay], score[stay]


def best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, ties to the smaller id."""
    order = np.lexsort((ids, -score, q))
    first = np.searchsorted(q[order], q[order], side="left")
    return order[np.arange(len(order)) - first < k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) over ``vectors`` (vec_id, embedding): the k highest inner products of each query.

    Queries go through the driver in blocks of about ``block``; each block is one pass over all vectors, in which every
    task keeps k rows per query and Spark ranks what the tasks kept. A task drops a vector as soon as a bound shows
    that the query has k better ones; the finest survivors get exact integer scores. Vectors of another dimension than
    the query's, rows without an id, and vectors that are null or hold a null or non-finite component take no part.
    Rows with the query's own id are not its candidates; other repeated rows count as often as they come.
    """
    ready = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("v")).where(
        "vec_id is not null and v is not null"
    )
    asked = ready.where(is_query)
    blocks = max(1, -(-asked.count() // block))
    out_type = StructType([StructField(n, LongType()) for n in ("nth", "query_id", "vec_id", "score")])
    results = None
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id").collect()
        by_size: dict[int, list] = {}
        for row in rows:
            by_size.setdefault(len(row["v"]), []).append(row)
        groups = {}
        for size, own in by_size.items():
            matrix = np.array([r["v"] for r in own], np.int64).reshape(len(own), size)
            groups[size] = Queries(np.array([r["vec_id"] for r in own], np.int64), matrix, k)

        def run(batches: Iterator[pa.RecordBatch], groups=groups) -> Iterator[pa.RecordBatch]:
            least = {size: g.least.copy() for size, g in groups.items()}
            held: dict[int, tuple[np.ndarray, ...]] = {}
            for batch in batches:
                sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
                for size in np.intersect1d(np.unique(sizes), list(groups)):
                    part = batch.filter(pa.array(sizes == size))
                    ids = part.column(0).to_numpy()
                    matrix = part.column(1).flatten().to_numpy().reshape(len(ids), size)
                    for lo in range(0, len(ids), ROWS):
                        own = ids[lo : lo + ROWS]
                        q, at, score = search_block(groups[size], least[size], own, matrix[lo : lo + ROWS])
                        found = (q, own[at], score)
                        if size in held:
                            found = tuple(np.concatenate(x) for x in zip(held[size], found))
                        top = best(*found, k)
                        q, at, score = held[size] = tuple(x[top] for x in found)
                        count = np.bincount(q, minlength=len(least[size]))
                        full = count >= k
                        kth = np.cumsum(count)[full] - 1
                        least[size][full] = np.maximum(least[size][full], score[kth])
            for size, (q, at, score) in held.items():
                nth = q + (int(size) << 32)
                columns = (nth, groups[size].ids[q], at, score)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], out_type.names)

        found = ready.mapInArrow(run, out_type)
        order = Window.partitionBy("nth").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        results = ranked if results is None else results.unionByName(ranked)
    return results.select("query_id", F.col("rank").cast(IntegerType()).alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1]::hugeint * p[2]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
