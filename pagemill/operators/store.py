"""The store of fetched chapters, and filling its gaps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import js_trim
from ..session import cut_lineage
from .ordered import CHUNK

VERSION = 1
KEYS = ["book_id", "source_url", "book_url", "chapter_url"]
REFUSED = [403, 429]
MAX_STREAK = 3


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts written as a JSON list."""
    return F.sha2(F.to_json(F.array(*parts)), 256)


def key_columns() -> dict[str, Column]:
    return {
        "book_key": digest(F.col("book_id")),
        "source_key": digest(F.col("source_url"), F.col("book_url")),
        "chapter_key": digest(F.col("chapter_url")),
    }


def upsert(store: DataFrame, incoming: DataFrame, seq: list[str]) -> DataFrame:
    """The newest record per key; blank content is refused and never replaces anything."""
    new = incoming.withColumn("content", js_trim(F.col("content"))).where(F.col("content") != "")
    both = store.unionByName(new)
    rest = [c for c in both.columns if c not in KEYS]
    latest = F.max_by(F.struct(*rest), F.struct(*seq))
    return both.groupBy(*KEYS).agg(latest.alias("r")).select(*KEYS, *[F.col(f"r.{c}").alias(c) for c in rest])


PARTS, SPREAD = 64, 4
"""A stored table has PARTS parts by book, each in SPREAD by chapter, so that a large book is not one part."""


def _place(book: str = "book_id", chapter: str = "chapter_url") -> Column:
    return F.pmod(F.xxhash64(book), F.lit(PARTS)) * SPREAD + F.pmod(F.xxhash64(chapter), F.lit(SPREAD))


def write_parts(store: DataFrame, path: str) -> None:
    """Lay the store out under ``path`` in parts (folders ``part=n``); a part is written by one task."""
    placed = store.withColumn("part", _place().cast("int"))
    placed.repartition(PARTS * SPREAD, "part").write.partitionBy("part").parquet(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("book_id is not null").drop("part")


def _rewrite(spark: SparkSession, path: str, parts: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
    """Replace some parts by what ``change`` makes of their rows; the other parts are neither read nor written.

    The new rows are stored before the old ones go. A part that is left without rows keeps one blank row, as a write
    without rows would leave it as it was; readers pass that row over.
    """
    if not parts:
        return
    old = spark.read.parquet(path).where(F.col("part").isin(parts))
    new = change(old.where("book_id is not null").drop("part")).withColumn("part", _place().cast("int"))
    blank = spark.createDataFrame([(p,) for p in parts], "part int")
    for f in new.schema.fields:
        if f.name != "part":
            blank = blank.withColumn(f.name, F.lit(None).cast(f.dataType))
    rows = cut_lineage(new.unionByName(blank).repartition(len(parts), "part"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def merge_parts(spark: SparkSession, path: str, incoming: DataFrame, seq: list[str]) -> None:
    """:func:`upsert` of ``incoming`` into the stored table, in the parts that it reaches."""
    rows = cut_lineage(incoming)
    parts = [r[0] for r in rows.select(_place().cast("int")).distinct().collect()]  # PARTS * SPREAD numbers at most
    _rewrite(spark, path, parts, lambda old: upsert(old, rows, seq))


def clear_parts(spark: SparkSession, path: str, book_ids: DataFrame) -> None:
    """:func:`clear_books` in the stored table, in the parts of these books."""
    ids = cut_lineage(book_ids.select("book_id").distinct())
    books = ids.select(F.pmod(F.xxhash64("book_id"), F.lit(PARTS)).cast("int")).distinct().collect()  # PARTS numbers at most
    parts = [r[0] * SPREAD + i for r in books for i in range(SPREAD)]
    _rewrite(spark, path, parts, lambda old: clear_books(old, ids))


def checked_read(wanted: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wanted chapters with their text, records to purge).

    A record is used only if its version fits, its three addresses are the wanted ones and it has
    text. Records are found by book and chapter; one that is found but does not fit is purged.
    """
    w = wanted.select("book_id", "chapter_url", F.col("source_url").alias("_s"), F.col("book_url").alias("_b"))
    found = store.join(w, ["book_id", "chapter_url"])
    valid = (
        (F.col("version") == VERSION)
        & (F.col("source_url") == F.col("_s"))
        & (F.col("book_url") == F.col("_b"))
        & (js_trim(F.coalesce("content", F.lit(""))) != "")
    )
    valid = F.coalesce(valid, F.lit(False))
    return found.where(valid).drop("_s", "_b"), found.where(~valid).drop("_s", "_b")


def mark_stored(toc: DataFrame, store: DataFrame) -> DataFrame:
    """Each chapter of the table of contents with ``is_stored``."""
    have = store.select("book_id", F.col("chapter_url").alias("url")).distinct().withColumn("_have", F.lit(True))
    return toc.join(have, ["book_id", "url"], "left").withColumn("is_stored", F.col("_have").isNotNull()).drop("_have")


def coverage(toc: DataFrame, store: DataFrame) -> DataFrame:
    return (
        mark_stored(toc, store)
        .groupBy("book_id")
        .agg(F.count("*").alias("n_chapters"), F.count_if("is_stored").alias("n_stored"))
        .withColumn("pct", F.col("n_stored") * 100.0 / F.col("n_chapters"))
    )


def clear_books(store: DataFrame, book_ids: DataFrame) -> DataFrame:
    return store.join(book_ids.select("book_id").distinct(), "book_id", "left_anti")


def backfill_range(toc: DataFrame, requests: DataFrame) -> DataFrame:
    """Chapters asked for: ``n`` from the current one on, as far as the table of contents goes.

    ``requests`` has one row per book: book_id, start, n. Requests without a positive n ask for nothing.
    """
    total = toc.groupBy("book_id").agg(F.max("idx").alias("_last"))
    lo = F.least(F.greatest(F.lit(0), F.col("start")), F.col("_last"))
    ask = requests.where(F.col("n") > 0).join(total, "book_id").select(
        "book_id", lo.alias("_lo"), F.least(lo + F.col("n") - 1, F.col("_last")).alias("_hi")
    )
    inside = (F.col("idx") >= F.col("_lo")) & (F.col("idx") <= F.col("_hi"))
    return toc.join(ask, "book_id").where(inside).drop("_lo", "_hi")


def backfill_pending(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """Wanted chapters that are not stored yet."""
    have = store.select("book_id", F.col("chapter_url").alias("url"))
    return wanted.join(have, ["book_id", "url"], "left_anti")


def backfill_outcome(attempts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """What each run achieved, from its ordered attempt log (run_id, ord, outcome, http_status).

    A run stops at a refusal (403, 429), at the third failure in a row, or when storing fails;
    a saved or skipped chapter ends a row of failures. Runs are cut into chunks of ``ord``, and every
    step over attempts works inside one chunk. A chunk hands on how many failures it ends with, and
    what it counted up to the first stop inside it; runs are settled from these few chunk rows.
    """
    refusal = (F.col("outcome") == "failed") & F.coalesce(F.col("http_status").isin(REFUSED), F.lit(False))
    # One column says all, so both passes below share a shuffle.
    rows = attempts.select(
        "run_id",
        "ord",
        F.when(refusal, "refused").otherwise(F.col("outcome")).alias("_what"),
        F.floor(F.col("ord") / chunk).alias("_chunk"),
    )
    failed = F.col("_what").isin("failed", "refused")
    reset = F.col("_what").isin("saved", "skipped")
    unit = ["run_id", "_chunk"]
    inside = Window.partitionBy(*unit).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_f", F.count_if(failed).over(inside))
    rows = rows.withColumn("_base", F.max(F.when(reset, F.col("_f"))).over(inside))
    rows = rows.withColumn("_row", F.col("_f") - F.coalesce("_base", F.lit(0)))

    earlier = Window.partitionBy("run_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("run_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.groupBy(*unit).agg(F.max_by("_row", "ord").alias("_tail"), F.max("_base").isNotNull().alias("_has_reset"))
    ends = ends.withColumn("_t", F.sum("_tail").over(upto))
    ends = ends.withColumn("_cut", F.when(F.col("_has_reset"), F.col("_t") - F.col("_tail")))
    carry = F.coalesce(F.max("_t").over(earlier), F.lit(0)) - F.coalesce(F.max("_cut").over(earlier), F.lit(0))
    rows = rows.join(ends.select(*unit, carry.alias("_carry")), unit)

    streak = F.col("_row") + F.when(F.col("_base").isNull(), F.col("_carry")).otherwise(F.lit(0))
    reason = F.when(F.col("_what").isin("store_error", "refused"), F.col("_what")).when(
        failed & (streak >= MAX_STREAK), "failing"
    )
    rows = rows.withColumn("_reason", reason)
    stops = F.when(F.col("_reason").isNotNull(), F.col("ord"))
    rows = rows.withColumn("_stop", F.min(stops).over(Window.partitionBy(*unit)))
    done = F.col("_stop").isNull() | (F.col("ord") <= F.col("_stop"))
    outcomes = {"saved": F.col("_what") == "saved", "skipped": F.col("_what") == "skipped", "failed": failed}
    per_chunk = rows.groupBy(*unit).agg(
        F.count("*").alias("total"),
        *[F.count_if(done & is_it).alias(name) for name, is_it in outcomes.items()],
        F.min_by("_reason", stops).alias("reason"),
    )
    first_stop = F.min(F.when(F.col("reason").isNotNull(), F.col("_chunk"))).over(Window.partitionBy("run_id"))
    per_chunk = per_chunk.withColumn("_last", first_stop)
    counts = F.col("_last").isNull() | (F.col("_chunk") <= F.col("_last"))
    return (
        per_chunk.groupBy("run_id")
        .agg(
            F.sum("total").alias("total"),
            *[F.sum(F.when(counts, F.col(name)).otherwise(F.lit(0))).alias(name) for name in outcomes],
            F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("_chunk"))).alias("reason"),
        )
        .withColumn("processed", F.col("saved") + F.col("skipped") + F.col("failed"))
        .withColumn("status", F.when(F.col("reason").isNull(), "completed").otherwise("error"))
    )
