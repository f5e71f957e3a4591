"""Neighbours, ranks and runs inside long ordered groups.

A plain window puts a whole group into one task. These forms cut each group into bounded chunks of
its order, work inside the chunks, and carry only a small summary from chunk to chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one group that one task may hold: small enough to sort in memory, large enough that few chunks remain.
CHUNK = 1_048_576


def neighbours(df: DataFrame, keys: list[str], idx: str, columns: dict[str, tuple[str, int]], chunk: int = CHUNK) -> DataFrame:
    """Values of the row ``offset`` places away, for a dense position column ``idx``.

    ``columns`` maps a new name to (column, offset), offset -1 being the previous row and +1 the next.
    Rows at a chunk's edge are also sent to the chunk beside it, so no group has to fit one task.
    """
    reach = max(abs(o) for _, o in columns.values())
    here = F.floor(F.col(idx) / chunk)
    copies = F.sequence(F.floor((F.col(idx) - reach) / chunk), F.floor((F.col(idx) + reach) / chunk))
    spread = df.withColumn("_chunk", F.explode(copies))
    w = Window.partitionBy(*keys, "_chunk").orderBy(idx)
    out = spread
    for name, (column, offset) in columns.items():
        out = out.withColumn(name, F.lead(column, offset).over(w) if offset > 0 else F.lag(column, -offset).over(w))
    return out.where(F.col("_chunk") == here).drop("_chunk")


def dense_index(df: DataFrame, keys: list[str], major: Column, minor: list[Column], name: str = "idx") -> DataFrame:
    """0-based position inside ``keys`` ordered by (major, minor).

    Rows are ranked inside (keys, major) and shifted by how many rows lie before that unit, so the
    unit (one page of a list, say) is what has to fit a task, not the whole group.
    """
    unit = df.withColumn("_major", major)
    by_unit = Window.partitionBy(*keys, "_major").orderBy(*minor)
    ranked = unit.withColumn("_in", F.row_number().over(by_unit) - 1)
    sizes = unit.groupBy(*keys, "_major").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_major").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        ranked.join(offsets, [*keys, "_major"])
        .withColumn(name, (F.col("_off") + F.col("_in")).cast("int"))
        .drop("_major", "_in", "_off")
    )


def running_max(df: DataFrame, keys: list[str], order: str, value: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """Largest ``value`` up to and including each row, rows ordered by the integer ``order``."""
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    tops = chunked.groupBy(*keys, "_chunk").agg(F.max(value).alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.withColumn("_carry", F.max("_top").over(before)).drop("_top")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        chunked.withColumn("_local", F.max(value).over(inside))
        .join(carried, [*keys, "_chunk"])
        .withColumn(name, F.greatest("_local", "_carry"))
        .drop("_chunk", "_local", "_carry")
    )
