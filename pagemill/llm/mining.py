"""Hard negatives: anchors in clusters, each cluster with one list of candidates sorted by an angular bound."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from pagemill.llm.common import table
from pagemill.llm.topk import integers, products
from pagemill.session import new_table_path

BLOCK = 4096
"""Anchors that one pass over the vectors serves: 2 MB of 64 numbers each."""
CLUSTER = 32
"""Anchors per cluster, on average."""
ROWS = 4096
"""Candidates whose list is sorted at a time."""
STEP = 256
"""Entries of a list that are scored together."""
LOW, HIGH = 30, 90
"""A negative's score in per cent of its positive's."""
_NONE = np.iinfo(np.int64).min


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one (zero stays zero), and their lengths."""
    real = vectors.astype(float)
    norm = np.sqrt((real**2).sum(axis=1))
    return real / np.where(norm > 0, norm, 1)[:, None], norm


class Anchors:
    """Some anchors of one dimension in clusters: centres, members, and the widest angle of a member to its centre."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.unit, self.norm = unit(vectors)
        self.own = np.array([int(products(v[None], v[None])[0, 0]) for v in vectors], np.int64)
        count = max(1, len(ids) // CLUSTER)
        rng = np.random.default_rng(11)
        centres = self.unit[rng.permutation(len(ids))[:count]]
        for _ in range(4):
            near = (self.unit @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, self.unit)
            length = np.sqrt((sums**2).sum(axis=1))
            centres = np.where(length[:, None] > 0, sums / np.where(length > 0, length, 1)[:, None], centres)
        near = (self.unit @ centres.T).argmax(axis=1)
        self.members = [np.flatnonzero(near == c) for c in range(count)]
        self.members, kept = [m for m in self.members if len(m)], [len(m) > 0 for m in self.members]
        self.centres = centres[np.array(kept, bool)]
        # A zero vector scores zero with everything; its angle does not count.
        angle = np.arccos(np.clip((self.unit * centres[near]).sum(axis=1), -1, 1))
        self.wide = np.array([angle[m][self.norm[m] > 0].max(initial=0.0) for m in self.members])


class Best:
    """The k best (score, then smaller id) of each entry so far, and the score that a further row must reach.

    Entries are kept cluster by cluster, so that a step of one list only sorts what belongs to its cluster.
    """

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor, self.need = k, floor, floor.copy()
        self.pools: dict[int, tuple[np.ndarray, ...]] = {}

    def add(self, cluster: int, entry: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(entry):
            return
        new = (entry, ids, score)
        if cluster in self.pools:
            new = tuple(np.concatenate(x) for x in zip(self.pools[cluster], new))
        entry, ids, score = new
        order = np.lexsort((ids, -score, entry))
        entry, ids, score = entry[order], ids[order], score[order]
        place = np.arange(len(entry)) - np.searchsorted(entry, entry)
        self.pools[cluster] = tuple(x[place < self.k] for x in (entry, ids, score))
        last = place == self.k - 1
        self.need[entry[last]] = np.maximum(self.floor[entry[last]], score[last])

    def all(self) -> tuple[np.ndarray, ...]:
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *x]) for x in zip(*self.pools.values())) if self.pools else (none,) * 3


def walk(anchors: Anchors, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, wanted, need) -> int:
    """Every cluster's list over some candidates: sorted by the angular bound once, walked by all members together.

    A member at an angle of at most ``wide`` to the centre scores at most |a| |x| cos(angle of x to the centre - wide).
    Members walk on while the next bound reaches what ``need`` says they still need; ``wanted`` takes scores.
    """
    directions, norm = unit(vectors)
    slack = 1e-6 + 1e-9 * anchors.norm.max(initial=0) * norm.max(initial=0)
    scored = 0
    for cluster, (members, centre, wide) in enumerate(zip(anchors.members, anchors.centres, anchors.wide)):
        angle = np.arccos(np.clip(directions @ centre, -1, 1))
        bound = norm * np.cos(np.maximum(angle - wide - 1e-7, 0))  # for a member of length one
        order = np.argsort(-bound, kind="stable")
        at = 0
        while at < len(order) and len(members):
            # A bound below zero is largest for the shortest member: each member's own bound counts.
            members = members[anchors.norm[members] * bound[order[at]] + slack >= need(members)]
            if not len(members):
                break
            part = order[at : at + STEP]
            wanted(cluster, members, ids[part], labels[part], products(anchors.vectors[members], vectors[part]))
            scored += len(members) * len(part)
            at += STEP
    return scored


def slices(batches: Iterator[pa.RecordBatch], groups: dict[int, Anchors]) -> Iterator[tuple]:
    """(dimension, ids, labels, vectors) of the candidates (vec_id, label, v), at most ROWS at a time."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
        for size in np.intersect1d(np.unique(sizes), list(groups)):
            part = batch.filter(pa.array(sizes == size))
            ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
            matrix = part.column(2).flatten().to_numpy().reshape(len(ids), size)
            for lo in range(0, len(ids), ROWS):
                yield int(size), ids[lo : lo + ROWS], labels[lo : lo + ROWS], matrix[lo : lo + ROWS]


FOUND = StructType([StructField(n, LongType()) for n in ("entry", "vec_id", "score")])


def emit(held: dict[int, Best], base: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for size, best in held.items():
        entry, ids, score = best.all()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (entry + base[size], ids, score)], FOUND.names)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("entry").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives(ready: DataFrame, groups: dict[int, Anchors], base: dict[int, int], k: int) -> dict[int, list[tuple]]:
    """For each anchor (by number) its k best other rows of the same label: [(vec_id, score)].

    One more is looked for, as the anchor itself is among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: Best(np.full(len(g.ids), _NONE, np.int64), k + 1) for n, g in groups.items()}
        for size, ids, labels, vectors in slices(batches, groups):
            g, best = groups[size], held[size]

            def wanted(cluster, members, own, marks, score):
                q, i = np.nonzero((g.labels[members][:, None] == marks) & (score >= best.need[members][:, None]))
                best.add(cluster, members[q], own[i], score[q, i])

            walk(g, ids, labels, vectors, wanted, lambda members: best.need[members])
        yield from emit(held, base)

    own = {base[n] + i: (int(g.ids[i]), int(g.own[i])) for n, g in groups.items() for i in range(len(g.ids))}
    out: dict[int, list[tuple]] = {i: [] for i in own}
    rows = ranked(ready.mapInArrow(run, FOUND), k + 1).orderBy("entry", "rank").collect()  # k + 1 for each anchor of the block
    for row in rows:
        out[row["entry"]].append((row["vec_id"], row["score"]))
    for i, itself in own.items():
        if itself in out[i]:  # not if k + 1 better ones were found
            out[i].remove(itself)
        out[i] = out[i][:k]
    return out


def negatives(
    ready: DataFrame, groups: dict[int, Anchors], base: dict[int, int], chosen: dict[int, list[tuple]], k: int, per: int
) -> DataFrame:
    """(entry, vec_id, score, rank): the first k rows of other labels in the band of each positive; entry is the anchor's
    number times ``per`` plus the positive's place."""
    low = {n: np.full((len(g.ids), per), np.iinfo(np.int64).max, np.int64) for n, g in groups.items()}
    high = {n: np.full((len(g.ids), per), _NONE, np.int64) for n, g in groups.items()}
    for n, g in groups.items():
        for i in range(len(g.ids)):
            for j, (_, score) in enumerate(chosen[base[n] + i]):
                low[n][i, j], high[n][i, j] = -(-LOW * score // 100), HIGH * score // 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: Best(low[n].reshape(-1).copy(), k) for n in groups}
        for size, ids, labels, vectors in slices(batches, groups):
            g, best, top = groups[size], held[size], high[size]

            def need(members):
                """The least that any positive with a band still needs."""
                level = best.need.reshape(-1, per)[members]
                return np.where(level <= top[members], level, np.iinfo(np.int64).max).min(axis=1)

            def wanted(cluster, members, own, marks, score):
                level, most = best.need.reshape(-1, per)[members], top[members]
                least = np.where(level <= most, level, np.iinfo(np.int64).max).min(axis=1)
                # Scores below all bands or above them are out for every positive at once.
                some = (g.labels[members][:, None] != marks) & (score >= least[:, None]) & (score <= most.max(axis=1)[:, None])
                q, i = np.nonzero(some)
                got = score[q, i][:, None]
                n, j = np.nonzero((got >= level[q]) & (got <= most[q]))
                best.add(cluster, members[q[n]] * per + j, own[i[n]], got[n, 0])

            walk(g, ids, labels, vectors, wanted, need)
        yield from emit(held, {n: base[n] * per for n in groups})

    return ranked(ready.mapInArrow(run, FOUND), k)


def mine(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, block: int = BLOCK
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over (vec_id, embedding, label).

    An anchor's positives are its best ``n_positives`` other rows of its label by inner product; for each of them the
    best ``n_negatives`` rows of other labels whose score is 30 to 90 per cent of the positive's. Ties go to the smaller
    vec_id. Anchors are taken in blocks of about ``block``, each in two passes over all vectors, and what a block found is
    stored before the next one starts. In a pass every task has the clusters of the block's anchors, sorts each cluster's
    list over its own vectors, and ends a member's walk when no later entry can be among its best; Spark ranks what the
    tasks kept.

    Rows without an id or a label, and vectors that are null or hold a null or non-finite component, take no part;
    vectors are compared with those of the same dimension. Repeated rows are rows of their own: each anchor row is mined,
    and only itself is excluded, so that other rows with its id may be among its positives. Other columns are not read.
    """
    spark = vectors.sparkSession
    ready = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), integers(F.col("embedding")).alias("v")
    ).where("vec_id is not null and label is not null and v is not null")
    # Equal anchor rows are mined once and unfolded at the end.
    asked = ready.where(is_anchor).groupBy("vec_id", "label", "v").agg(F.count(F.lit(1)).alias("times"))
    asked_path = new_table_path(spark, "anchors")
    asked.write.parquet(asked_path)
    asked = spark.read.parquet(asked_path)
    blocks = max(1, -(-asked.count() // block))
    paths = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks)) == b).collect()
        rows.sort(key=lambda r: (len(r["v"]), r["vec_id"], r["label"], r["v"]))
        groups, base = {}, {}
        for at, row in enumerate(rows):
            base.setdefault(len(row["v"]), at)
        for size, at in base.items():
            own = [r for r in rows if len(r["v"]) == size]
            matrix = np.array([r["v"] for r in own], np.int64).reshape(len(own), size)
            groups[size] = Anchors(*(np.array([r[c] for r in own], np.int64) for c in ("vec_id", "label")), matrix)
        chosen = positives(ready, groups, base, n_positives)
        names = [
            (i * n_positives + j, row["vec_id"], int(positive), int(score), row["times"])
            for i, row in enumerate(rows)
            for j, (positive, score) in enumerate(chosen[i])
        ]
        fields = ("entry", "anchor_id", "positive_id", "positive_score", "times")
        named = spark.createDataFrame(names, StructType([StructField(n, LongType()) for n in fields]))
        found = negatives(ready, groups, base, chosen, n_negatives, n_positives)
        out = (
            found.join(F.broadcast(named), "entry")  # a block's anchors times n_positives
            .withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
            .select(
                "anchor_id",
                "positive_id",
                F.col("rank").cast(IntegerType()).alias("rank"),
                F.col("vec_id").alias("negative_id"),
                "positive_score",
                F.col("score").alias("negative_score"),
            )
        )
        paths.append(new_table_path(spark, "negatives"))
        out.write.parquet(paths[-1])
    return reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in paths])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
    list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1]::hugeint * p[2]))::bigint as score
  from v a join v c on a.vec_id % 100 = 0 and c.vec_id <> a.vec_id and len(c.v) = len(a.v)),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) <= 10
"""
