"""Sharding over a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import running
from pagemill.session import cut_lineage

CELLS = 1 << 14


def ring(spark: SparkSession, n_shards: int, virtual_nodes: int, cells: int = CELLS) -> DataFrame:
    """(cell, arc, home): the virtual node that each cell of the ring meets first clockwise, and its shard.

    A virtual node sits at a cell picked by hash; of two on one cell the smaller shard stays. Arcs are numbered along
    the ring. The table has ``cells`` rows, whatever the data.
    """
    shards = spark.range(n_shards).select(F.col("id").cast("int").alias("home"))
    nodes = (
        shards.select("home", F.explode(F.sequence(F.lit(1), F.lit(virtual_nodes))).alias("copy"))
        .select("home", F.pmod(F.xxhash64(F.lit("node"), "home", "copy"), F.lit(cells)).alias("cell"))
        .groupBy("cell")
        .agg(F.min("home").alias("home"))
        .withColumn("arc", F.row_number().over(Window.orderBy("cell")) - 1)
    )
    first = nodes.orderBy("cell").limit(1).select(F.col("arc").alias("arc0"), F.col("home").alias("home0"))
    # From the last cell backwards, so that each row only looks at the one before it.
    ahead = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        spark.range(cells)
        .withColumnRenamed("id", "cell")
        .join(nodes, "cell", "left")
        .withColumn("arc", F.last("arc", ignorenulls=True).over(ahead))
        .withColumn("home", F.last("home", ignorenulls=True).over(ahead))
        .join(F.broadcast(first), F.col("arc").isNull(), "left")  # past the last node the ring starts again
        .select("cell", F.coalesce("arc", "arc0").alias("arc"), F.coalesce("home", "home0").alias("home"))
    )


def place(arcs: list[tuple[int, int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Deal each arc's keys out: (arc, lo, hi, shard, slot) puts the arc's keys lo..hi-1 into slots from ``slot`` on.

    ``arcs`` lists (arc, home shard, number of keys) in ring order. Every arc first fills its home shard, then what is
    left over walks clockwise to the next shards with room. Only counts are handled here, one per virtual node.
    """
    room, used = list(capacity), [0] * len(capacity)
    out, left = [], []

    def put(arc: int, done: int, n: int, shard: int) -> int:
        take = min(n - done, room[shard])
        if take:
            out.append((arc, done, done + take, shard, used[shard]))
            room[shard] -= take
            used[shard] += take
        return done + take

    for i, (arc, home, n) in enumerate(arcs):
        left.append((i, arc, n, put(arc, 0, n, home)))
    for i, arc, n, done in left:
        step = 1
        while done < n:
            done = put(arc, done, n, arcs[(i + step) % len(arcs)][1])
            step += 1
    return out


def assign(
    keys: DataFrame, key: list[str], n_shards: int, virtual_nodes: int = 128, slack: float = 0.0, cells: int = CELLS
) -> DataFrame:
    """Give every row of ``keys`` a shard and a slot within it.

    ``key`` names the columns that decide a row's place on the ring; other columns are carried along. A shard takes at
    most ``(1 + slack)`` times its even share. With no slack the shards' capacities are the even shares themselves,
    rounded down or up so that they add up to the rows: counts then differ by one at most. Rows of a full shard
    continue clockwise. Slots of a shard run from 0 without gaps. Adds ``home``, ``shard`` and ``slot``.

    Equal rows are counted once and told apart again at the end, so a row repeated very often stays one key. Null keys
    hash like any other value. An empty table gives no rows.
    """
    spark, columns = keys.sparkSession, keys.columns
    spot = F.pmod(F.xxhash64(*key), F.lit(1 << 32))
    rows = cut_lineage(
        keys.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_spot", spot)
    )
    cell = F.floor(F.col("_spot") / F.lit((1 << 32) // cells))
    nodes = cut_lineage(ring(spark, n_shards, virtual_nodes, cells))
    placed = rows.withColumn("cell", cell).join(F.broadcast(nodes), "cell")
    ranked = running(placed, ["arc"], ["_spot", *columns], "_copies")
    full = {
        r["arc"]: r["n"] for r in placed.groupBy("arc").agg(F.sum("_copies").alias("n")).collect()
    }  # one row per virtual node
    arcs = [
        (r["arc"], r["home"], full.get(r["arc"], 0)) for r in nodes.select("arc", "home").distinct().orderBy("arc").collect()
    ]
    total = sum(full.values())
    even = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    plan = place(arcs, [int(c * (1 + slack)) for c in even])
    runs = spark.createDataFrame(
        plan or [(0, 0, 0, 0, 0)], "arc int, _lo long, _hi long, shard int, _slot long"
    )
    after = F.col("before") + F.col("_copies")
    return (
        ranked.join(F.broadcast(runs), "arc")
        .where((F.col("_lo") < after) & (F.col("_hi") > F.col("before")))
        .withColumn("_at", F.explode(F.sequence(F.greatest("_lo", "before"), F.least("_hi", after) - 1)))
        .select(*columns, "home", "shard", (F.col("_slot") + F.col("_at") - F.col("_lo")).alias("slot"))
    )


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one; null has no bytes."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, home, shard, slot): documents dealt evenly by count.

    A null text counts as empty; only doc_id and text are read, so further columns do not matter. Rows that agree in
    all of doc_id, size and checksum are separate keys at one place of the ring.
    """
    keys = docs.select(
        "doc_id",
        text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return assign(keys, ["doc_id", "size", "text_crc32"], n_shards)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs, 8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "home",
    )
