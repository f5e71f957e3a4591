"""Prefix trie of conversations: a z-fast trie, filled in batches and unfolded into one row per depth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pagemill.llm.common import running, stored, table

CHUNK = 4096
"""Turns of one conversation, or ids of one node, that are handled together."""
MARK = ["p", "q"]
"""Two 64-bit hashes that stand for a whole prefix."""


def kept(df: DataFrame) -> DataFrame:
    """Every step is stored as a table of known size, so that small ones are broadcast and unions stay few files."""
    return stored(df, "trie")


def fattest(lo: str, hi: str) -> Column:
    """The number of (lo, hi] that is divisible by the highest power of two."""
    return F.expr(f"{hi} & shiftleft(cast(-1 as bigint), cast(length(bin({lo} ^ {hi})) - 1 as int))")


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): the turns of each conversation, numbered from 0 by turn (null first), role and text.

    Null roles and texts become empty. Equal rows are turns of their own. Rows without a conv_id take no part.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("_nth"),  # parts equal rows
        F.lit(1).cast("long").alias("_one"),
    ).where("conv_id is not null")
    order = ["turn", "role", "text", "_nth"]
    return running(rows, ["conv_id"], order, "_one", "pos").select("conv_id", "pos", "role", "text")


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, depth, role, text): each conversation with its first turns taken from its base.

    Conversation c takes the first h = crc32(c) % ``most`` turns of conversation c - c % ``every`` (all if it has fewer,
    none if there is no such conversation) in place of its own first h. Depths count from 1.
    """
    heads = turns.where(F.col("pos") < most - 1)
    convs = (
        turns.select("conv_id")
        .distinct()
        .withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
        .withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    )
    heads = heads.withColumnRenamed("conv_id", "base")
    lent = convs.join(heads, "base").where(F.col("pos") < F.col("h"))
    held = heads.groupBy("base").agg(F.count(F.lit(1)).alias("held"))
    shift = convs.join(held, "base", "left").select(
        F.col("conv_id"), "h", (F.least(F.coalesce("held", F.lit(0)), "h") - F.col("h")).alias("shift")
    )
    own = turns.join(kept(shift), "conv_id").where(F.col("pos") >= F.col("h"))
    return lent.select("conv_id", (F.col("pos") + 1).alias("depth"), "role", "text").unionByName(
        own.select("conv_id", (F.col("pos") + F.col("shift") + 1).alias("depth"), "role", "text")
    )


def prefix_marks(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p, q, size): hashes of each conversation's first ``depth`` turns, and its last text's length.

    Each turn is hashed with its depth, and a prefix is the exclusive or of its turns: chunks of a long conversation are
    summed up apart, and one small row per chunk is carried over.
    """
    spots = [F.xxhash64(F.lit(i), "depth", "role", "text").alias(n) for i, n in enumerate(MARK)]
    rows = kept(turns.select("conv_id", "depth", *spots, F.length("text").cast("long").alias("size")))
    chunk = F.floor((F.col("depth") - 1) / CHUNK).alias("chunk")
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv_id", chunk).agg(*(F.bit_xor(n).alias(n) for n in MARK))
    carried = parts.select(
        "conv_id", "chunk", *(F.coalesce(F.bit_xor(n).over(before), F.lit(0)).alias(f"{n}0") for n in MARK)
    )
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("chunk", chunk).select(
        "conv_id", "chunk", "depth", "size", *(F.bit_xor(n).over(inside).alias(n) for n in MARK)
    )
    return local.join(carried, ["conv_id", "chunk"]).select(
        "conv_id", "depth", "size", *(F.col(n).bitwiseXOR(F.col(f"{n}0")).alias(n) for n in MARK)
    )


def compacted(paths: DataFrame, ends: DataFrame, marks: DataFrame) -> DataFrame:
    """The compacted nodes: (path, depth, low, f, p_f, q_f, p_e, q_e, p_c, q_c, up, up_depth).

    A node is a place where a path ends, others branch off, or conversations end; its edge covers the depths in
    (low, depth]. It is found by the mark at its handle, the two-fattest depth f of the edge; the marks at its end
    (its extent) and at its first turn come along. (up, up_depth) is its parent.
    """
    spots = (
        paths.where("path is not null")
        .select("path", F.col("length").alias("depth"))
        .unionByName(paths.where("parent is not null").select(F.col("parent").alias("path"), F.col("branch").alias("depth")))
        .unionByName(ends.select("path", "depth"))
        .distinct()
        .join(paths.select("path", "branch", "parent"), "path")
        .where("depth > branch")
    )
    along = Window.partitionBy("path").orderBy("depth")
    edges = spots.withColumn("previous", F.lag("depth").over(along)).select(
        "path",
        "depth",
        F.coalesce("previous", "branch").alias("low"),
        F.when(F.col("previous").isNull(), F.col("parent")).otherwise(F.col("path")).alias("up"),
    )
    edges = kept(edges.withColumn("f", fattest("low", "depth")))
    out = edges
    for name, at in (("f", F.col("f")), ("e", F.col("depth")), ("c", F.col("low") + 1)):
        there = marks.select(F.col("conv_id").alias("path"), F.col("depth").alias("_at"), *(F.col(n).alias(f"{n}_{name}") for n in MARK))
        out = out.withColumn("_at", at).join(there, ["path", "_at"]).drop("_at")
    return out.withColumnRenamed("low", "up_depth")


def locate(active: DataFrame, nodes: DataFrame, marks: DataFrame) -> DataFrame:
    """Add (at, lo): the deepest compacted node that is a prefix of each conversation, by fat binary search.

    ``active`` has (conv_id, length, at, lo) with a node known to be a prefix. In each step the two-fattest depth of what
    is left of the interval is looked up among the handles: a node whose whole extent agrees becomes the lower end, one
    whose extent does not is the exit, whose parent is the result; without a node the upper end sinks.
    """
    open_, done = active.withColumn("hi", F.col("length")), []
    while True:
        asked = open_.withColumn("f", F.when(F.col("lo") < F.col("hi"), fattest("lo", "hi")))
        own = marks.select("conv_id", F.col("depth").alias("f"), *(F.col(n).alias(f"{n}_f") for n in MARK))
        asked = asked.join(own, ["conv_id", "f"], "left").join(
            nodes.select("f", "p_f", "q_f", "p_e", "q_e", "path", F.col("depth").alias("extent"), "up", "up_depth"),
            ["f", "p_f", "q_f"],
            "left",
        )
        end = marks.select("conv_id", F.col("depth").alias("extent"), *(F.col(n).alias(f"own_{n}") for n in MARK))
        asked = asked.join(end, ["conv_id", "extent"], "left")
        hit = F.col("path").isNotNull()
        whole = hit & F.col("own_p").eqNullSafe(F.col("p_e")) & F.col("own_q").eqNullSafe(F.col("q_e"))
        hi = F.when(whole, F.col("hi")).when(hit, F.col("up_depth")).when(F.col("f").isNotNull(), F.col("f") - 1)
        stepped = kept(
            asked.select(
                "conv_id",
                "length",
                F.when(whole, F.col("path")).when(hit, F.col("up")).otherwise(F.col("at")).alias("at"),
                F.when(whole, F.col("extent")).when(hit, F.col("up_depth")).otherwise(F.col("lo")).alias("lo"),
                F.coalesce(hi, F.col("hi")).alias("hi"),
            )
        )
        done.append(stepped.where("lo >= hi").drop("hi"))
        open_ = stepped.where("lo < hi")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)


def exits(found: DataFrame, nodes: DataFrame, marks: DataFrame) -> DataFrame:
    """(conv_id, length, at, lo): where each located conversation leaves the trie: the path and the depth up to which
    it agrees with it, on the edge below its deepest node if that has its next turn."""
    ahead = marks.select("conv_id", (F.col("depth") - 1).alias("lo"), *(F.col(n).alias(f"{n}_c") for n in MARK))
    below = nodes.select(F.col("up_depth").alias("lo"), "p_c", "q_c", "path", F.col("depth").alias("extent"))
    on_edge = kept(
        found.join(ahead, ["conv_id", "lo"]).join(below, ["lo", "p_c", "q_c"]).select("conv_id", "lo", "path", "extent")
    )
    mine = marks.select("conv_id", "depth", *MARK)
    theirs = marks.select(F.col("conv_id").alias("path"), "depth", *(F.col(n).alias(f"{n}_t") for n in MARK))
    shared = (
        on_edge.join(mine, "conv_id")
        .where("depth > lo and depth <= extent")
        .join(theirs, ["path", "depth"])
        .where("p = p_t and q = q_t")
        .groupBy("conv_id")
        .agg(F.max("depth").alias("agreed"), F.first("path").alias("path"))
    )
    return found.join(shared, "conv_id", "left").select(
        "conv_id", "length", F.coalesce("path", "at").alias("at"), F.coalesce("agreed", "lo").alias("lo")
    )


def grow(convs: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, ends): the trie of all conversations (conv_id, length).

    A path is the part of one conversation that it was the first to bring: depths in (branch, length], hanging at depth
    ``branch`` of the path ``parent``; the empty root is path -1. Each batch locates all conversations that are not in the
    trie yet. Those that agree with it to their end are noted in ``ends`` (conv_id, path, depth). The others branch off:
    of all that leave at one place with the same next turn, the one with the smallest hash brings a new path, the rest
    wait. The choice is a random one, so the number of batches grows with the logarithm of the number of conversations.
    """
    spark = convs.sparkSession
    path_type = StructType([StructField(n, LongType()) for n in ("path", "parent", "branch", "length", "batch")])
    # Conversation ids may be any number, so the root gets none of them: it is null as a parent.
    paths = spark.createDataFrame([], path_type)
    ends = kept(convs.where("length = 0").select("conv_id", F.lit(None).cast("long").alias("path"), F.lit(0).cast("long").alias("depth")))
    none = F.lit(None).cast("long")
    active = kept(convs.where("length > 0").withColumn("at", none).withColumn("lo", F.lit(0).cast("long")))
    batch = 0
    while not active.isEmpty():
        if batch:
            nodes = kept(compacted(paths, ends.where("path is not null"), marks))
            left = kept(exits(locate(active, nodes, marks), nodes, marks))
        else:
            left = active
        over = left.where("lo = length").select("conv_id", F.col("at").alias("path"), F.col("lo").alias("depth"))
        ends = kept(ends.unionByName(over))
        ahead = marks.select("conv_id", (F.col("depth") - 1).alias("lo"), *MARK)
        more = kept(left.where("lo < length").join(ahead, ["conv_id", "lo"]))
        # What leaves at one place with one next turn shares a prefix, and only that.
        rank = F.struct(F.xxhash64("conv_id").alias("rank"), "conv_id", "length", "at", "lo")
        won = more.groupBy(*MARK).agg(F.min(rank).alias("w")).select("w.*")
        fresh = won.select(
            F.col("conv_id").alias("path"), F.col("at").alias("parent"), F.col("lo").alias("branch"), "length", F.lit(batch).cast("long").alias("batch")
        )
        paths = kept(paths.unionByName(fresh))
        fresh_ids = paths.where(F.col("batch") == batch).select(F.col("path").alias("conv_id"))
        active = kept(more.drop(*MARK).join(fresh_ids, "conv_id", "left_anti"))
        batch += 1
    return paths, ends


def suffix(rows: DataFrame, **how) -> DataFrame:
    """Rows (path, depth, ...) with the named columns summed up (or their minimum taken) over the path from each depth to
    its end, chunk by chunk."""
    after = Window.partitionBy("path").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("path", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("chunk", F.floor(F.col("depth") / CHUNK))
    parts = rows.groupBy("path", "chunk").agg(*(f(c).alias(c) for c, f in how.items()))
    parts = parts.select("path", "chunk", *(f(c).over(after).alias(f"{c}_rest") for c, f in how.items()))
    kept_columns = [c for c in rows.columns if c not in how]
    local = rows.select(*kept_columns, *(f(c).over(below).alias(c) for c, f in how.items()))
    both = [
        (F.col(c) + F.coalesce(f"{c}_rest", F.lit(0)) if f is F.sum else F.least(c, f"{c}_rest")).alias(c) for c, f in how.items()
    ]
    return local.join(parts, ["path", "chunk"]).select(*(c for c in kept_columns if c != "chunk"), *both)


def end_hashes(ended: DataFrame) -> DataFrame:
    """(path, depth, ends_sha256): of the ids (conv_id) that end at each node, ascending and joined by commas.

    Ids are joined in chunks of their order first; then each node's chunks pass through one hash in turn, so memory
    stays small however many conversations end there.
    """
    keyed = ended.withColumn("_path", F.struct("path", "depth").cast("string")).withColumn("_one", F.lit(1).cast("long"))
    ranked = running(keyed, ["_path"], ["conv_id"], "_one", "rank")
    chunks = (
        ranked.groupBy("path", "depth", F.floor(F.col("rank") / CHUNK).alias("chunk"))
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
        .select("path", "depth", "chunk", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for path, depth, ids in zip(*(batch.column(n).to_pylist() for n in ("path", "depth", "ids"))):
                if state is not None and (path, depth) == key:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (path, depth), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], out_type.names)
                out = []
        if state is not None:
            out.append((*key, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], out_type.names)

    types = [pa.int64(), pa.int64(), pa.string()]
    out_type = StructType([StructField("path", LongType()), StructField("depth", LongType()), StructField("ends_sha256", StringType())])
    return chunks.repartition("path", "depth").sortWithinPartitions("path", "depth", "chunk").mapInArrow(run, out_type)


def unfold(paths: DataFrame, ends: DataFrame, marks: DataFrame) -> DataFrame:
    """One row per depth of every path, and the root: the nodes of the whole trie with their counts.

    A path's nodes sum up what ends and what branches off at their depth or deeper on the path. Paths of the last batch
    have none below them, so batches are summed up from the last to the first; the number of steps is that of batches.
    """
    spark = paths.sparkSession
    root = spark.createDataFrame([(0, 0)], "depth long, size long").select(F.lit(None).cast("long").alias("path"), "depth", "size")
    every = paths.join(marks.withColumnRenamed("conv_id", "path"), "path").where("depth > branch")
    every = kept(every.select("path", "batch", "depth", "size"))
    ended = kept(ends.unionByName(paths.select(F.col("path").alias("conv_id"), "path", F.col("length").alias("depth"))))
    here = kept(ended.groupBy("path", "depth").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low")))
    last = paths.agg(F.max("batch")).first()[0]
    done, hung = [], None  # rows of finished batches; what paths hand to the place they hang at

    def totals(rows: DataFrame) -> DataFrame:
        """Sums at and below each place of ``rows`` (path, depth, size), given what ends there and what hangs there."""
        rows = rows.join(here.select(F.col("path").alias("h"), F.col("depth").alias("hd"), "n", "low"), (F.col("path").eqNullSafe(F.col("h"))) & (F.col("depth") == F.col("hd")), "left")
        if hung is not None:
            below = hung.groupBy(F.col("parent").alias("k"), F.col("branch").alias("kd")).agg(
                F.sum("n_convs").alias("kn"),
                F.min("first").alias("klow"),
                F.sum("n_leaves").alias("kleaves"),
                F.sum("saved").alias("ksaved"),
                F.count(F.lit(1)).alias("kids"),
            )
            rows = rows.join(below, F.col("path").eqNullSafe(F.col("k")) & (F.col("depth") == F.col("kd")), "left")
        else:
            rows = rows.select("*", *(F.lit(None).cast("long").alias(c) for c in ("kn", "klow", "kleaves", "ksaved", "kids")))
        zero = F.lit(0).cast("long")
        return kept(
            rows.select(
                "path",
                "depth",
                "size",
                (F.coalesce("n", zero) + F.coalesce("kn", zero)).alias("n_convs"),
                F.least("low", "klow").alias("first"),
                F.coalesce("kleaves", zero).alias("n_leaves"),
                F.coalesce("ksaved", zero).alias("saved"),
                F.coalesce("kids", zero).alias("kids"),
            )
        )

    for batch in range(last if last is not None else -1, -1, -1):
        rows = totals(every.where(F.col("batch") == batch).drop("batch"))
        lengths = paths.where(F.col("batch") == batch).select("path", "parent", "branch", "length")
        rows = rows.join(lengths, "path")
        rows = rows.withColumn("n_children", F.col("kids") + (F.col("depth") < F.col("length")).cast("long"))
        rows = rows.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long"))
        rows = kept(suffix(rows, n_convs=F.sum, n_leaves=F.sum, first=F.min))
        rows = rows.withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("size"))
        rows = kept(suffix(rows, saved=F.sum))
        done.append(rows)
        top = rows.where(F.col("depth") == F.col("branch") + 1)
        more = top.select("path", "parent", "branch", "n_convs", "first", "n_leaves", "saved")
        hung = more if hung is None else hung.unionByName(more)
    top = totals(root).withColumn("n_children", F.col("kids"))
    top = top.withColumn("n_leaves", F.when(F.col("kids") == 0, 1).otherwise(F.col("n_leaves")).cast("long"))
    columns = ["path", "depth", "n_convs", "first", "n_children", "n_leaves", "saved"]
    nodes = top.select(*columns, F.lit(None).cast("long").alias("up"))
    for rows in done:
        up = F.when(F.col("depth") == F.col("branch") + 1, F.col("parent")).otherwise(F.col("path"))
        nodes = nodes.unionByName(rows.select(*columns, up.alias("up")))
    nodes = kept(nodes.where("n_convs > 0"))
    parent = nodes.select(F.col("path").alias("u"), (F.col("depth") + 1).alias("ud"), F.col("first").alias("parent_conv_id"))
    hashes = end_hashes(ended).select(F.col("path").alias("e"), F.col("depth").alias("ed"), "ends_sha256")
    out = nodes.join(parent, F.col("up").eqNullSafe(F.col("u")) & (F.col("depth") == F.col("ud")), "left").join(
        hashes, F.col("path").eqNullSafe(F.col("e")) & (F.col("depth") == F.col("ed")), "left"
    )
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(
        F.col("first").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per trie node.

    Conversations are put in order and rebuilt (:func:`placed_turns`, :func:`rebuilt`) and filled into a z-fast trie;
    its edges are unfolded into one node per depth. Conversations that are left without turns end at the root. Without
    any conversation there are no nodes, not even a root. Only conv_id, turn, role and text are read.
    """
    turns = kept(placed_turns(conversations))
    marks = kept(prefix_marks(rebuilt(turns, every, most)))
    lengths = marks.groupBy("conv_id").agg(F.max("depth").alias("length"))
    convs = kept(
        turns.select("conv_id").distinct().join(lengths, "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0).cast("long")).alias("length"))
    )
    paths, ends = grow(convs, marks)
    return unfold(paths, ends, marks)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


SQL = """
with recursive o as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos,
    coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
c as (
  select conv_id, conv_id - conv_id % 100 as base,
    xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 as h
  from (select distinct conv_id from o)),
u as (
  select c.conv_id, 0 as part, o.pos, role, text from c join o on o.conv_id = base and pos < h
  union all select c.conv_id, 1, o.pos, role, text from c join o on o.conv_id = c.conv_id and pos >= h),
b as (select conv_id, row_number() over (partition by conv_id order by part, pos) as depth, role, text from u),
k as (
  select conv_id, depth, length(text) as size, sha256(string_agg(sha256(concat(length(role), ':', role, text)), '')
    over (partition by conv_id order by depth)) as mark from b
  union all select conv_id, 0, 0, '' from c),
l as (select conv_id, max(depth) as length from k group by conv_id),
g as (
  select depth, mark, any_value(size) as size, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(case when depth = length then conv_id::varchar end, ',' order by conv_id), '')) as ends
  from k join l using (conv_id) group by depth, mark),
e as (
  select distinct y.depth, y.mark, x.mark as above
  from k x join k y on y.conv_id = x.conv_id and y.depth = x.depth + 1),
n as (
  select g.*, e.above, (select count(*) from e x where x.depth = g.depth + 1 and x.above = g.mark) as n_children
  from g left join e on e.depth = g.depth and e.mark = g.mark),
up as (
  select depth, mark, depth as d, mark as m, above from n
  union all select up.depth, up.mark, n.depth, n.mark, n.above from up join n on n.depth = up.d - 1 and n.mark = up.above),
s as (
  select u.d, u.m, sum((n_convs - 1) * size)::bigint as saved, count(*) filter (where n_children = 0) as leaves
  from up u join n on n.depth = u.depth and n.mark = u.mark group by u.d, u.m)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, leaves as n_leaves, saved as saved_tokens, n.ends as ends_sha256
from n join s on s.d = n.depth and s.m = n.mark left join g p on p.depth = n.depth - 1 and p.mark = n.above
"""
