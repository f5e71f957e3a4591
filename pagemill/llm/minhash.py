"""Near-duplicate documents: fast similarity sketches, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from pagemill.llm.common import WORD, Texts, Words, mix64, powers, row_blocks, text_hash
from pagemill.llm.components import components
from pagemill.session import cut_lineage, in_few_tasks

BANDS, ROWS = 20, 4
"""A pair at similarity 0.85 shares no band with probability (1 - 0.85**4)**20 = 4e-7."""
BANDS_80 = 28
"""The same for similarity 0.8: (1 - 0.8**4)**28 = 4e-7."""
BLOCK = 512
"""Members of a bucket that one task compares with each other or with another block."""
_SALT = 0xC2B2AE3D27D4EB4F
_TOP = np.iinfo(np.int64).max


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles as sorted 64-bit hashes, one row after another, and where rows begin.

    A row with fewer than ``width`` words has its whole sequence as one shingle; one without words has none.
    """
    h = words.hashes()
    factor = powers(_SALT, width + 1)[1:]
    n = len(h)
    full = np.zeros(n, np.uint64)
    for j in range(min(width, n)):
        full[: n - j] += h[j:] * factor[j]
    ends = words.row_end()
    inside = np.arange(n) + width <= ends
    out = mix64(full[inside])
    count = np.maximum(words.count - width + 1, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    short = np.flatnonzero((words.count > 0) & (words.count < width))
    for a, b in zip(first[:-1][count > 1], first[1:][count > 1]):
        out[a:b].sort()
    row = np.repeat(np.arange(len(count)), count)
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[new], row[new]
    if len(short):
        whole = np.array(
            [
                int((h[words.first[i] : words.first[i + 1]] * factor[: words.count[i]]).sum(dtype=np.uint64))
                ^ int(words.count[i])
                for i in short
            ],
            np.uint64,
        )
        out, row = np.concatenate([out, mix64(whole)]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        out, row = out[order], row[order]
    return out, np.searchsorted(row, np.arange(len(words.count) + 1))


def sketches(sets: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketches, one row of ``size`` coordinates per set; equal coordinates estimate the similarity.

    In round i every element throws a value of [i, i + 1) into one hashed bin, and a bin keeps its smallest value. As
    many further rounds throw at one bin each, so that every coordinate of a set with elements is filled. A set takes
    part in a round only while it has an empty bin: large sets are done after one round.
    """
    count = np.diff(first)
    out = np.full((len(count), size), _TOP, np.int64)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(len(count)), count)
    open_rows = count > 0
    for i in range(2 * size):
        if not open_rows.any():
            break
        take = open_rows[row]
        own = row[take]
        thrown = mix64(sets[take] ^ np.uint64((i + 1) * _SALT % 2**64))
        value = ((thrown & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32)).view(np.int64)
        if i < size:
            spot = ((thrown >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        else:
            spot = np.full(len(own), i - size)
        np.minimum.at(flat, own * size + spot, value)
        open_rows = open_rows & (out == _TOP).any(axis=1)
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketch.view(np.uint64).reshape(len(sketch), bands, rows)
    key = np.zeros((len(sketch), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        key = mix64(key * np.uint64(_SALT) + parts[:, :, j])
    return key.view(np.int64)


def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))


def sketch_table(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, hash, n_shingles, d1, d2, keys): each row's set size, 128-bit set digest and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_blocks(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                sets, first = shingles(Texts(part.column("text"), lower=True).words(), width)
                count = np.diff(first)
                sums = [np.append(np.uint64(0), np.cumsum(s, dtype=np.uint64)) for s in (sets, mix64(sets ^ np.uint64(_SALT)))]
                digest = [mix64(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]
                keys = band_keys(sketches(sets, first, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("hash"),
                        *map(pa.array, (count, *digest)),
                        lists(keys.reshape(-1), np.arange(len(count) + 1) * bands),
                    ],
                    names,
                )

    names = ["doc_id", "hash", "n_shingles", "d1", "d2", "keys"]
    keyed = docs.select("doc_id", text_hash(F.col("text")).alias("hash"), "text")
    fields = [keyed.schema["doc_id"], *(StructField(n, LongType()) for n in names[1:-1])]
    return keyed.mapInArrow(run, StructType([*fields, StructField("keys", ArrayType(LongType()))]))


def set_table(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, set): the full shingle sets of some documents, given by node (doc_id) and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_blocks(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                sets, first = shingles(Texts(part.column("text"), lower=True).words(), width)
                yield pa.RecordBatch.from_arrays([part.column("node"), lists(sets, first)], ["node", "set"])

    keyed = docs.select(F.col("doc_id").alias("node"), text_hash(F.col("text")).alias("hash"), "text")
    fields = [StructField("node", LongType()), StructField("set", ArrayType(LongType()))]
    return (
        keyed.join(nodes.select("node", "hash"), ["node", "hash"])
        .dropDuplicates(["node", "hash"])  # repeated rows; dealt out as the join left them
        .select(F.col("node").cast("long").alias("node"), "text")
        .mapInArrow(run, StructType(fields))
    )


def similar(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def compare_block(group: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between different components within one block task, as few as connect them.

    Rows with side 0 and 1 are two blocks; if all have side 0, the block is compared with itself. Intersections of all
    pairs come from products of 0/1 matrices over the shingles that occur more than once, some columns at a time.
    """
    group = group.sort_values("node", ignore_index=True)
    sets = group["set"].tolist()
    sizes = np.array([len(s) for s in sets])
    own = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    renumber = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    own, column = own[shared], renumber[column[shared]]
    side = group["side"].to_numpy()
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    inter = np.zeros((len(left), len(right)), np.float64)
    step = 4096
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        cells = np.zeros((len(sets), step), np.float32)
        cells[own[a:b], column[a:b] - lo] = 1
        inter += cells[left] @ cells[right].T
    hit = similar(inter, sizes[left][:, None], sizes[right][None, :], percent)
    comp = np.unique(group["component"].to_numpy(), return_inverse=True)[1]
    root = np.arange(comp.max() + 1)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    node, out = group["node"].to_numpy(), []
    i, j = np.nonzero(hit & (comp[left][:, None] != comp[right][None, :]))
    for a, b in zip(left[i], right[j]):
        x, y = find(comp[a]), find(comp[b])
        if x != y:
            root[x] = y
            out.append((int(node[a]), int(node[b])))
    return out


def link_classes(docs: DataFrame, percent: int, width: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their set digests, and (n_shingles, d1, d2, component) for each set that more than one row has or that
    is linked."""
    table = cut_lineage(sketch_table(docs, width, bands, rows))
    same = ["n_shingles", "d1", "d2"]
    classes = cut_lineage(
        table.where("n_shingles > 0 and doc_id is not null")
        .groupBy(*same)
        .agg(
            F.min("doc_id").cast("long").alias("node"),
            F.min_by("hash", "doc_id").alias("hash"),
            F.first("keys").alias("keys"),
        )
    )
    banded = classes.select("node", "hash", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    buckets = cut_lineage(banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    n = buckets.agg(F.sum("members")).first()[0] or 0  # what follows has as many small rows at most
    members = cut_lineage(in_few_tasks(banded.join(buckets, "key"), n))
    # The hub of a bucket is the member that meets most others over all bands: the original among its copies.
    worth = members.groupBy("node").agg(F.sum("members").alias("worth"), F.first("n").alias("n"))
    worth = cut_lineage(in_few_tasks(worth, n))
    ranked = in_few_tasks(members.select("key", "node").join(worth, "node"), n)
    hubs = (
        ranked.groupBy("key")
        .agg(F.max(F.struct("worth", F.negate("node").alias("back"), "n")).alias("top"))
        .select("key", F.negate("top.back").alias("hub"), F.col("top.n").alias("hub_n"))
    )
    hubs = cut_lineage(in_few_tasks(hubs, n))
    pairs = (
        members.join(hubs, "key")
        .where("node <> hub")
        .where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
        .select("node", "hub")
    )
    pairs = cut_lineage(in_few_tasks(in_few_tasks(pairs, n).distinct(), n))
    own = in_few_tasks(members.select("node", "hash").distinct(), n)
    sets = cut_lineage(set_table(docs, own, width))
    theirs = sets.select(F.col("node").alias("hub"), F.col("set").alias("hub_set"))
    shared = F.size(F.array_intersect("set", "hub_set"))
    stars = cut_lineage(
        pairs.join(sets, "node")
        .join(theirs, "hub")
        .withColumn("shared", shared)
        .where(100 * F.col("shared") >= percent * (F.size("set") + F.size("hub_set") - F.col("shared")))
        .select(F.col("node").alias("a"), F.col("hub").alias("b"))
    )
    known = cut_lineage(in_few_tasks(components(stars), n))
    # Buckets that still hold several components: all their pairs, block by block.
    marked = (
        members.where("members > 2")
        .select("key", "node", "members")
        .join(known, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    marked = cut_lineage(in_few_tasks(marked, n))
    mixed = marked.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = cut_lineage(in_few_tasks(mixed.where("low < high").select("key"), n))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    tasks = (
        marked.join(mixed, "key")
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "node",
            "component",
            "key",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
        )
        .join(sets, "node")
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(compare_block(group, percent), columns=["a", "b"], dtype="int64")

    crossed = tasks.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")
    found = known.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = cut_lineage(in_few_tasks(components(found.unionByName(crossed)), n))
    named = classes.select(*same, "node").join(final, "node", "left")
    return table, cut_lineage(named.select(*same, F.coalesce("component", "node").alias("component")))


def verdicts(table: DataFrame, named: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``table``, from what :func:`link_classes` found."""
    joined = table.drop("keys", "hash").join(named, ["n_shingles", "d1", "d2"], "left")
    component = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return joined.select(
        "doc_id",
        "n_shingles",
        component.cast("long").alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def near_duplicates(
    docs: DataFrame, percent: int = 85, width: int = 3, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row.

    Two documents are linked if their sets of distinct ``width``-word shingles, in lower case, agree in at least
    ``percent`` per cent of their union; a component is named by its smallest doc_id. Rows with equal sets are one
    class from the start. Classes that share a band are compared with their bucket's hub on full sets; where a bucket
    still holds several components, all its pairs are compared, so no link between bucket members is lost.

    Null and empty texts have no shingles and are linked with nothing. A row without a doc_id is linked with nothing
    and has no component; it is kept. Rows that share a doc_id are the same document and share their component.
    """
    return verdicts(*link_classes(docs, percent, width, bands, rows))


def keep_one(
    docs: DataFrame, percent: int = 85, width: int = 3, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``docs`` without the rows that a kept one of their component stands for.

    Of rows that share the kept doc_id and their set of shingles one stays. Rows without a doc_id take part under an
    id made from their text, so equal ones are one document, and beyond the ids of most tables, so that documents with
    an id are kept before them. Without a doc_id and without words a row is linked with nothing and stays.
    """
    text = text_hash(F.col("text"))
    spare = F.when(F.col("text").rlike(WORD), F.lit(2**62) + F.pmod(text, F.lit(2**62)))
    own = F.coalesce(F.col("doc_id").cast("long"), spare)
    table, named = link_classes(docs.select(own.alias("doc_id"), "text"), percent, width, bands, rows)
    gone = cut_lineage(verdicts(table, named).where("not kept").select(F.col("doc_id").alias("gone")).distinct())
    whole = docs.select(F.struct(*docs.columns).alias("doc"), own.alias("own_id"), text.alias("own_hash"))
    out = whole.join(gone, F.col("own_id") == F.col("gone"), "left_anti")
    # Of rows that share doc_id and set, those with the smallest text hash stay; if they are several, one of them.
    same = ["doc_id", "n_shingles", "d1", "d2"]
    times = table.where("doc_id is not null").groupBy(*same, "hash").agg(F.count(F.lit(1)).alias("times"))
    listed = cut_lineage(
        times.withColumn("first", F.col("hash") == F.min("hash").over(Window.partitionBy(*same)))
        .where("not first or times > 1")
        .select(F.col("doc_id").alias("twice"), F.col("hash").alias("twice_hash"), "first")
    )
    if listed.isEmpty():
        return out.select("doc.*")
    listed_row = (F.col("own_id") == F.col("twice")) & (F.col("own_hash") == F.col("twice_hash"))
    one = out.join(listed.where("first"), listed_row, "left_semi").dropDuplicates(["own_id", "own_hash"])
    return out.join(listed, listed_row, "left_anti").unionByName(one).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sh as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 2), ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)
  union all select doc_id, array_to_string(w, ' ') from d where len(w) in (1, 2)),
n as (select doc_id, count(*) as n from sh group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as inter from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * inter >= 85 * (nx.n + ny.n - inter)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id, doc_id as seen from d union select r.doc_id, e.y from r join e on e.x = r.seen),
c as (select doc_id, min(seen) as component_id from r group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from d join c on c.doc_id = d.doc_id left join n on n.doc_id = d.doc_id
"""
