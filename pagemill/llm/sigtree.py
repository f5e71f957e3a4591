"""Jaccard join of word n-gram sets: signature trees, traversed two nodes at a time."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from pagemill.llm.common import Texts, mix64, row_blocks, stored, text_hash
from pagemill.llm.components import components
from pagemill.llm.minhash import lists, shingles
from pagemill.session import cut_lineage

LEAF = 16
"""Sets under a leaf."""
FAN = 8
"""Children of an inner node."""
MEMBERS, TOKENS = 1024, 1 << 20
"""A tree with more sets or tokens is dealt out over several tasks."""
COUNTERS = 1 << 20
"""Tokens are ranked by how often their counter was hit; the table of counters has this size for any input."""
_SLICE = 1 << 14
_SALT = 0x9FB21C651E98DF25


# One tree, within a task.


class Node:
    """An OR of token bitmaps, the range of set sizes, and what lies below: child nodes, or positions of sets."""

    __slots__ = ("bits", "low", "high", "clash", "children", "own")

    def __init__(self, bits, low, high, clash, children, own):
        self.bits, self.low, self.high, self.clash, self.children, self.own = bits, low, high, clash, children, own


def needed(a, b, percent: int):
    """The smallest intersection of sets of sizes a and b that reaches the similarity."""
    return -(-percent * (a + b) // (100 + percent))


def width_of(tokens: int) -> int:
    """Bits of a bitmap: a power of two, at least two bits for each token."""
    return max(64, 1 << int(2 * tokens - 1).bit_length())


def bitmap(tokens: np.ndarray, width: int) -> np.ndarray:
    """The tokens' bitmap, packed into 64-bit words. One of half the width is the OR of neighbouring bits."""
    bits = np.zeros(width, bool)
    spots = mix64(tokens ^ np.uint64(_SALT)) >> np.uint64(64 - width.bit_length() + 1)
    bits[spots.astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


def narrowed(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap brought to a smaller width."""
    while 64 * len(bits) > width:
        flat = np.unpackbits(bits.view(np.uint8)).reshape(-1, 2)
        bits = np.packbits(flat.any(axis=1)).view(np.uint64)
    return bits


def ones(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum(dtype=np.int64))


class Tree:
    """A signature tree over some bitmaps and the sizes of their sets.

    Sets lie next to each other by size and, within a factor of 5/4, by a key that near copies mostly share. A node has
    the width of the narrowest bitmap below; several tokens of a set may share a bit, and ``clash`` is the most that any
    set below loses that way, so that a bound from bits stays a bound.
    """

    def __init__(self, bits: list[np.ndarray], sizes: np.ndarray, near: np.ndarray):
        self.bits, self.sizes = bits, sizes
        self.clash = np.array([n - ones(b) for n, b in zip(sizes, bits)])
        order = np.lexsort((near, np.floor(np.log(sizes) / np.log(1.25))))
        level = [self.join([Node(bits[i], sizes[i], sizes[i], self.clash[i], [], [i]) for i in order[lo : lo + LEAF]], True) for lo in range(0, len(order), LEAF)]
        while len(level) > 1:
            level = [self.join(level[lo : lo + FAN], False) for lo in range(0, len(level), FAN)]
        self.root = level[0]

    @staticmethod
    def join(part: list[Node], leaf: bool) -> Node:
        width = 64 * min(len(n.bits) for n in part)
        bits = np.bitwise_or.reduce([narrowed(n.bits, width) for n in part])
        clash = max(n.high - ones(narrowed(n.bits, width)) if leaf else n.clash + 64 * (len(n.bits) - len(bits)) for n in part)
        own = [i for n in part for i in n.own]
        return Node(bits, min(n.low for n in part), max(n.high for n in part), clash, [] if leaf else part, own)

    def most(self, a: np.ndarray, b: np.ndarray, clash_a: int, clash_b: int) -> int:
        """The largest intersection that two bitmaps allow."""
        if len(a) == len(b):
            return ones(a & b) + min(clash_a, clash_b)
        width = 64 * min(len(a), len(b))
        lost = [c + ones(x) - ones(narrowed(x, width)) for x, c in ((a, clash_a), (b, clash_b))]
        return ones(narrowed(a, width) & narrowed(b, width)) + min(lost)

    def may_reach(self, p: Node, q: Node, percent: int) -> bool:
        """Whether any set below p and any below q can be similar: by their sizes, then by the bits both have."""
        if 100 * p.high < percent * q.low or 100 * q.high < percent * p.low:
            return False
        if p is q:
            return True
        least = max(needed(p.low, q.low, percent), -(-percent * max(p.low, q.low) // 100))
        # Narrower than it was, a node's own bound on clashes grows by no more than the bits that may have met.
        width = min(len(p.bits), len(q.bits))
        clash = min(n.clash + (64 * (len(n.bits) - width)) for n in (p, q))
        return ones(narrowed(p.bits, 64 * width) & narrowed(q.bits, 64 * width)) + clash >= least

    def pairs(self, percent: int, same, side: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """Pairs of sets that may be similar. Pairs of nodes are taken apart from (root, root) on.

        A pair goes when its largest possible overlap is too small, or when ``same`` says that all sets below it need
        not be told apart any more. ``side`` (0 or 1) limits this to pairs of different sides.
        """
        stack = [(self.root, self.root)]
        while stack:
            p, q = stack.pop()
            if same(p.own if p is q else p.own + q.own) or not self.may_reach(p, q, percent):
                continue
            if p.children or q.children:
                if p is q:
                    kids = p.children
                    stack += [(a, b) for i, a in enumerate(kids) for b in kids[i + 1 :]]
                    stack += [(a, a) for a in kids]  # taken first: near copies lie next to each other
                elif p.children and (not q.children or len(p.own) >= len(q.own)):
                    stack += [(a, q) for a in p.children]
                else:
                    stack += [(p, b) for b in q.children]
                continue
            for i, a in enumerate(p.own):
                for b in p.own[i + 1 :] if p is q else q.own:
                    if (side is not None and side[a] == side[b]) or same([a, b]):
                        continue
                    least = needed(self.sizes[a], self.sizes[b], percent)
                    if min(self.sizes[a], self.sizes[b]) < least:
                        continue
                    if self.most(self.bits[a], self.bits[b], self.clash[a], self.clash[b]) >= least:
                        yield a, b


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


def links(
    sets: list[np.ndarray], known: np.ndarray, percent: int, side: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Links between sets (sorted tokens) of different components (``known``), as few as connect them."""
    sizes = np.array([len(s) for s in sets])
    tree = Tree([bitmap(s, width_of(len(s))) for s in sets], sizes, np.array([s[0] for s in sets]))
    root = np.unique(known, return_inverse=True)[1]
    out = []
    for a, b in tree.pairs(percent, lambda own: (root[own] == root[own[0]]).all(), side):
        if overlap(sets[a], sets[b]) >= needed(sizes[a], sizes[b], percent):
            low, high = sorted((root[a], root[b]))
            root[root == high] = low
            out.append((int(a), int(b)))
    return out


def partners(bits: list[np.ndarray], sizes: np.ndarray, near: np.ndarray, percent: int) -> np.ndarray:
    """Which sets may be similar to any other, by their bitmaps alone."""
    has = np.zeros(len(bits), bool)
    for a, b in Tree(bits, sizes, near).pairs(percent, lambda own: has[own].all()):
        has[[a, b]] = True
    return has


# From texts to trees.


def hits(docs: DataFrame, width: int) -> DataFrame:
    """(slice, counts): how often counters were hit by the tokens of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for lo, hi in row_blocks(batch.column("text")):
                sets, _ = shingles(Texts(batch.column("text").slice(lo, hi - lo), lower=True).words(), width)
                found += np.bincount((sets >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
        used = [i for i in range(COUNTERS // _SLICE) if found[i * _SLICE : (i + 1) * _SLICE].any()]
        cells = [zlib.compress(found[i * _SLICE : (i + 1) * _SLICE].tobytes(), 1) for i in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(cells, pa.binary())], ["slice", "counts"])

    return docs.select("text").mapInArrow(run, COUNTS)


COUNTS = StructType([StructField("slice", IntegerType()), StructField("counts", BinaryType())])


def commonness(counts: DataFrame) -> np.ndarray:
    """For each counter a level 0..255 that rises with its hits (a quarter of a power of two each)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(zlib.decompress(cells), np.int64)
                sums[i] = sums[i] + got if i in sums else got
        if sums:
            levels = [np.minimum(4 * np.log2(s + 1.0), 255).astype(np.uint8).tobytes() for s in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["slice", "counts"])

    out = np.zeros(COUNTERS, np.uint8)
    for row in counts.repartition("slice").mapInArrow(add, COUNTS).collect():  # COUNTERS bytes
        out[row["slice"] * _SLICE : (row["slice"] + 1) * _SLICE] = np.frombuffer(row["counts"], np.uint8)
    return out


def signature_table(docs: DataFrame, levels: np.ndarray, width: int, percent: int) -> DataFrame:
    """(doc_id, hash, n, tag, d1, near, bits, rare) for each row: its set's size, digest (tag, d1), smallest token, bitmap
    and rarest tokens: as many as it may lack in a similar set, and one more.

    Two similar sets have one of these in common, whatever the order of tokens, as long as all sets use the same one.
    Rare tokens first keeps frequent lines and passages from bringing documents together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_blocks(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                sets, first = shingles(Texts(part.column("text"), lower=True).words(), width)
                size = np.diff(first)
                sums = [np.append(np.uint64(0), np.cumsum(s, dtype=np.uint64)) for s in (sets, mix64(sets ^ np.uint64(_SALT)))]
                tag, d1 = (mix64(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
                own = [sets[a:b] for a, b in zip(first[:-1], first[1:])]
                near = np.array([s[0] if len(s) else 0 for s in own], np.uint64).view(np.int64)
                bits = [bitmap(s, width_of(len(s))).tobytes() if len(s) else b"" for s in own]
                row = np.repeat(np.arange(len(size)), size)
                level = levels[(sets >> np.uint64(44)).astype(np.int64)].astype(np.int64)
                order = np.argsort(row << 8 | level, kind="stable")
                take = size - -(-percent * size // 100) + 1
                take[size == 0] = 0
                picked = order[np.arange(len(order)) - first[row] < take[row]]
                rare = lists(sets[picked], np.append(0, np.cumsum(take)))
                columns = [part.column("doc_id"), part.column("hash"), *map(pa.array, (size, tag, d1, near))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bits, pa.binary()), rare], names)

    names = ["doc_id", "hash", "n", "tag", "d1", "near", "bits", "rare"]
    fields = [StructField(n, LongType()) for n in names[:6]]
    fields += [StructField("bits", BinaryType()), StructField("rare", ArrayType(LongType()))]
    return keyed(docs).mapInArrow(run, StructType(fields))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("hash"), "text")


def trees(table: DataFrame) -> DataFrame:
    """(tree, tag): which sets meet in which tree; a set may stand in several.

    All sets that share a rare token meet. Tokens with the same sets count once, and all tokens of one hub (the set that
    meets most others: the original among its copies) make one tree.
    """
    rows = table.select("tag", F.explode("rare").alias("token"))
    often = stored(rows.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("token"), "often")
    met = stored(rows.join(often, "token").distinct(), "met")  # copies have the same tag
    alike = stored(
        met.groupBy("token")
        .agg(F.bit_xor("tag").alias("x"), F.min("tag").alias("low"), F.count(F.lit(1)).alias("members"))
        .where("members > 1")
        .groupBy("x", "low", "members")
        .agg(F.min("token").alias("token")),
        "alike",
    )
    met = stored(met.join(alike.select("token", "members"), "token"), "meetings")
    worth = stored(met.groupBy("tag").agg(F.sum("members").alias("worth")), "worth")
    hubs = stored(
        met.join(worth, "tag").groupBy("token").agg(F.max(F.struct("worth", "tag")).alias("top")).select("token", F.col("top.tag").alias("tree")),
        "hubs",
    )
    return met.join(hubs, "token").select("tree", "tag").distinct()


def grouped(rows: DataFrame, keys: list[str], columns: list[str], work, schema: StructType) -> DataFrame:
    """``work`` on each group of rows with equal ``keys``: groups lie one after another in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            marks = [batch.column(n).to_numpy(zero_copy_only=False) for n in keys]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in marks], axis=0)) + 1
            cuts = [0, *new.tolist(), len(batch)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi == lo:
                    continue
                key = tuple(k[lo] for k in marks)
                if held and key != last:
                    yield work(pa.Table.from_batches(held).combine_chunks())
                    held = []
                last = key
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    ordered = rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, schema)


def promising(dealt: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """(tree, i, tag): the sets that have a partner in their part of a tree, as far as bitmaps tell."""

    def work(group: pa.Table) -> pa.RecordBatch:
        bits = [np.frombuffer(b, np.uint64) for b in group.column("bits").to_pylist()]
        has = partners(bits, group.column("n").to_numpy(), group.column("near").to_numpy(), percent)
        kept = group.select(["tree", "i", "tag"]).filter(pa.array(has)).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in kept.columns], kept.column_names)

    schema = StructType([StructField("tree", LongType()), StructField("i", IntegerType()), StructField("tag", LongType())])
    return grouped(dealt.join(table, "tag"), ["tree", "i"], ["tag", "n", "near", "bits"], work, schema)


LINKS = StructType([StructField("a", LongType()), StructField("b", LongType())])


def traverse(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links within each group (tree, i, j) of rows (tree, i, j, side, node, component, text).

    Groups are bounded by MEMBERS and TOKENS (twice, if they have two sides). Texts travel instead of their sets, which
    are twice as large.
    """

    def work(group: pa.Table) -> pa.RecordBatch:
        node = group.column("node").to_numpy()
        texts = pa.concat_arrays([c.cast(pa.large_string()) for c in group.column("text").chunks])
        flat, at = shingles(Texts(texts, lower=True).words(), width)
        side = group.column("side").to_numpy()
        two = side if (side != side[0]).any() else None
        got = links([flat[a:b] for a, b in zip(at[:-1], at[1:])], group.column("component").to_numpy(), percent, two)
        ends = [pa.array([int(node[x[k]]) for x in got], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(ends, ["a", "b"])

    return grouped(rows, ["tree", "i", "j"], ["side", "node", "component", "text"], work, LINKS)


def single_texts(docs: DataFrame, own: DataFrame) -> DataFrame:
    """(node, hash, text): the texts of all rows, those of rows that repeat both doc_id and text once."""
    again = own.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    again = stored(again, "again")
    texts = keyed(docs)
    if not again.isEmpty():
        once = texts.join(again, ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id", "hash"])
        texts = texts.join(again, ["doc_id", "hash"], "left_anti").unionByName(once)
    return texts.withColumnRenamed("doc_id", "node")


def jaccard_join(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row.

    Two documents are linked if their sets of distinct ``width``-word shingles, in lower case, agree in at least
    ``percent`` per cent of their union; a component is named by its smallest doc_id. Rows with equal sets are one class
    from the start. Classes that share a rare token meet in a signature tree; no pair outside of them can be similar, so
    no link is lost. Trees are traversed over bitmaps first; only sets that may have a partner come with their texts and
    are compared in full. A tree too large for one task is dealt out: its parts are traversed on their own, each with
    the hub; only trees that still hold several components afterwards compare their parts with each other.

    ``doc_id`` is an integer. Null and empty texts have no shingles and are linked with nothing. A row without a doc_id
    is linked with nothing and has no component. Rows that share a doc_id are the same document and share their
    component. Other columns are not read.
    """
    levels = commonness(hits(docs, width))
    table = cut_lineage(signature_table(docs, levels, width, percent))
    same = ["n", "tag", "d1"]
    own = table.where("n > 0 and doc_id is not null")
    classes = stored(
        own.groupBy(*same)
        .agg(F.min(F.struct("doc_id", "hash")).alias("one"), F.count(F.lit(1)).alias("copies"))
        .select(*same, F.col("one.doc_id").alias("node"), F.col("one.hash").alias("hash"), "copies"),
        "classes",
    )
    grown = trees(own)
    sized = stored(grown.join(classes.select("tag", "n", "node", "hash"), "tag"), "grown")
    parts = sized.groupBy("tree").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens"))
    parts = stored(
        parts.select("tree", F.ceil(F.greatest(F.col("members") / MEMBERS, F.col("tokens") / TOKENS)).cast("int").alias("parts")),
        "parts",
    )
    part = F.when(F.col("tag") == F.col("tree"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("tag"), F.col("parts")).cast("int"))
    )
    dealt = stored(sized.join(parts, "tree").withColumn("i", F.explode(part)), "dealt")
    # Sets of trees in one part that have no partner there need no text.
    signed = own.groupBy("tag").agg(F.first("n").alias("n"), F.first("near").alias("near"), F.first("bits").alias("bits"))
    kept = promising(dealt.where("parts = 1").select("tree", "i", "tag"), signed, percent)
    chosen = dealt.where("parts = 1").join(stored(kept, "promising"), ["tree", "i", "tag"], "left_semi")
    chosen = stored(chosen.unionByName(dealt.where("parts > 1")), "chosen")
    first = chosen.withColumn("j", F.col("i")).withColumn("side", F.lit(0)).withColumn("component", F.col("tag"))
    texts = single_texts(docs, own)
    # The texts are the larger side and grow with the rest, so they are dealt out by key at any size.
    found = cut_lineage(traverse(first.hint("merge").join(texts, ["node", "hash"]), width, percent))
    if not parts.where("parts > 1").isEmpty():
        found = found.unionByName(across_parts(dealt.where("parts > 1"), texts, found, width, percent))
    # Classes of one doc_id are one document.
    ids = own.select("doc_id", *same).distinct().join(classes, same).select("doc_id", "node")
    doubled = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    ties = ids.join(doubled.select("doc_id"), "doc_id").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    final = cut_lineage(components(found.unionByName(ties)))
    named = classes.join(final, "node", "left").select(*same, F.coalesce("component", "node").alias("component"))
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    rows = table.select("doc_id", *same).join(stored(named, "named"), same, "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def across_parts(dealt: DataFrame, texts: DataFrame, found: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between the parts of trees that were dealt out and still hold several components."""
    known = cut_lineage(components(found))
    marked = cut_lineage(
        dealt.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("n")
    )
    mixed = (
        marked.groupBy("tree")
        .agg(F.min("component").alias("least"), F.max("component").alias("most"))
        .where("least < most")
        .select("tree")
    )
    pairs = (
        marked.join(cut_lineage(mixed), "tree")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where("other <> i")
        .select(
            "tree",
            F.least("i", "other").alias("lo"),
            F.greatest("i", "other").alias("j"),
            (F.col("i") > F.col("other")).cast("int").alias("side"),
            "node",
            "hash",
            "component",
        )
    )
    # Of a pair of parts only what may still be linked goes on: parts that are one and the same component do not.
    both = Window.partitionBy("tree", "lo", "j")
    apart = pairs.withColumn("least", F.min("component").over(both)).withColumn("most", F.max("component").over(both))
    ready = apart.where("least < most").withColumnRenamed("lo", "i")
    return cut_lineage(traverse(ready.join(texts, ["node", "hash"]), width, percent))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sh as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d)
  union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 4),
n as (select doc_id, count(*) as n from sh group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as inter from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * inter >= 80 * (nx.n + ny.n - inter)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id, doc_id as seen from d union select r.doc_id, e.y from r join e on e.x = r.seen),
c as (select doc_id, min(seen) as component_id from r group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
from d join c on c.doc_id = d.doc_id left join n on n.doc_id = d.doc_id
"""
