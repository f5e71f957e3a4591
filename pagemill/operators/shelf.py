"""Shelf, reading progress, and moving a book to another source."""

from __future__ import annotations

import sys
import unicodedata

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from .toc import unread

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: signs that do not count when two chapter titles are compared.
TITLE_NOISE = "·:：、，。!！?？_—-"


def recent(shelf: DataFrame) -> DataFrame:
    """Last read first; books read at the same time stay in shelf order."""
    return shelf.orderBy(F.col("last_read_time").desc_nulls_last(), F.col("added_ord"))


def import_books(shelf: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Append books that have an id and are not on the shelf by (source, address); first copy wins."""
    pair = ["source_url", "book_url"]
    rest = [c for c in incoming.columns if c not in pair]
    firsts = (
        incoming.where(F.coalesce("id", F.lit("")) != "")
        .groupBy(*pair)
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
        .select(*pair, *[F.col(f"r.{c}").alias(c) for c in rest])
    )
    fresh = firsts.join(shelf.select(*pair), pair, "left_anti")
    return shelf.unionByName(fresh.select(*shelf.columns))


def remove_books(tables: dict[str, tuple[DataFrame, str]], book_ids: DataFrame) -> dict[str, DataFrame]:
    """Every table (name -> (table, its book id column)) without the removed books' rows."""
    ids = book_ids.select(F.col(book_ids.columns[0]).alias("_gone")).distinct()
    return {
        name: df.join(ids, df[column] == F.col("_gone"), "left_anti") for name, (df, column) in tables.items()
    }


def latest_progress(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The last position written per book: chapter number, address and title, scroll ratio within [0, 1]."""
    position = ["ts", "seq", "chapter_index", "chapter_url", "chapter_title", "scroll_ratio"]
    keys = keys or ["book_id"]
    return (
        events.groupBy(*keys)
        .agg(F.max(F.struct(*position)).alias("r"))
        .select(*keys, *[F.col(f"r.{c}") for c in position[:-1]], clamp(F.col("r.scroll_ratio")).alias("scroll_ratio"))
    )


def clamp(ratio: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio))


def resume(progress: DataFrame, toc: DataFrame) -> DataFrame:
    """Where to open each book: by chapter address, else by the saved number within the table.

    The scroll position only holds if the very chapter was found.
    """
    hit = toc.groupBy("book_id", "url").agg(F.min("idx").alias("_found"))
    size = toc.groupBy("book_id").agg(F.count("*").alias("_n"))
    return (
        progress.join(size, "book_id", "left")
        .join(hit, (progress["book_id"] == hit["book_id"]) & (progress["chapter_url"] == hit["url"]), "left")
        .select(
            progress["book_id"],
            F.coalesce("_found", F.least(F.col("chapter_index"), F.col("_n") - 1), F.col("chapter_index")).alias("open_at"),
            F.when(F.col("_found").isNotNull(), F.coalesce("scroll_ratio", F.lit(0.0))).otherwise(F.lit(0.0)).alias("ratio"),
            F.col("_found").isNotNull().alias("found"),
        )
    )


def normalized(titles: pa.Array, rows: int = 128) -> pa.Array:
    """NFKC forms. Only so many titles at a time become Python objects, so memory is that of the Arrow batch."""

    def some(part: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in part.to_pylist()], pa.string())

    return pa.concat_arrays([some(titles.slice(i, rows)) for i in range(0, max(1, len(titles)), rows)])


def _nfkc(title: Column) -> Column:
    """Compatibility form of the title; Spark has no function for it, so this runs in Arrow batches."""
    return F.arrow_udf(lambda col: normalized(col), "string")(title)


def title_key(title: Column) -> Column:
    return F.lower(F.translate(strip_ws(_nfkc(title)), TITLE_NOISE, ""))


def match_titles(wanted: DataFrame, toc: DataFrame) -> DataFrame:
    """(book_id, title) rows with the position of the only chapter of that title; -1 if none or several."""
    keyed = toc.select("book_id", "idx", title_key(F.col("title")).alias("_key")).where(F.col("_key") != "")
    single = keyed.groupBy("book_id", "_key").agg(F.count("*").alias("_n"), F.min("idx").alias("_idx"))
    single = single.where(F.col("_n") == 1).drop("_n")
    asked = wanted.withColumn("_key", title_key(F.col("title")))
    return (
        asked.join(single, ["book_id", "_key"], "left")
        .withColumn("match_idx", F.coalesce("_idx", F.lit(-1)))
        .drop("_key", "_idx")
    )


def switch_plan(books: DataFrame, new_toc: DataFrame) -> DataFrame:
    """Position in the new source: by a unique title, else the old number, to be confirmed by the reader.

    ``books`` has book_id, title (of the chapter being read), chapter_index and was_read. It may be
    committed at once if the title matched or the book was never read. Books whose new table of
    contents is empty are refused.
    """
    size = new_toc.groupBy("book_id").agg(F.count("*").alias("n_chapters"))
    matched = F.col("match_idx") >= 0
    out = match_titles(books, new_toc).join(size, "book_id", "left")
    total = F.coalesce("n_chapters", F.lit(0))
    target = F.when(matched, F.col("match_idx")).otherwise(F.least(F.col("chapter_index"), total - 1))
    unread_yet = ~F.col("was_read") & (F.col("chapter_index") == 0)
    return out.select(
        "book_id",
        F.when(total > 0, target).alias("target_idx"),
        F.when(total == 0, "rejected").when(matched, "matched").otherwise("manual").alias("how"),
        ((total > 0) & (matched | unread_yet)).alias("auto_commit"),
    )


def switch_apply(shelf: DataFrame, plan: DataFrame, new_toc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shelf after the switch, refused plan rows with the reason).

    A row is refused if its book changed meanwhile (or left the shelf), or if the new table of contents
    has no such chapter. The scroll position and the time of reading start anew where the shelf has them. ``plan`` has id, old_source_url, old_book_url, the new source_url, source_name, book_url, toc_url,
    cover_url, intro and target_idx. Id and the time of adding stay; cover and intro only give way to
    something that is not empty.
    """
    new = ["source_url", "source_name", "book_url", "toc_url", "cover_url", "intro", "target_idx"]
    summary = new_toc.groupBy(F.col("book_id").alias("id")).agg(
        F.count("*").alias("_total"), F.max_by("title", "idx").alias("_latest")
    )
    at = new_toc.select(F.col("book_id").alias("_id"), F.col("idx").alias("_idx"), F.col("title").alias("_title"), F.col("url").alias("_url"))
    ready = (
        plan.select(
            "id",
            F.col("old_source_url").alias("_old_s"),
            F.col("old_book_url").alias("_old_b"),
            *[F.col(c).alias(f"_new_{c}") for c in new],
        )
        .join(at, (F.col("id") == F.col("_id")) & (F.col("_new_target_idx") == F.col("_idx")))
        .drop("_id")
        .join(summary, "id")
    )
    same = (F.col("source_url") == F.col("_old_s")) & (F.col("book_url") == F.col("_old_b"))
    s = shelf.join(ready, "id", "left").withColumn("_go", F.coalesce(same, F.lit(False)))

    def take(new_value: Column, old: str) -> Column:
        return F.when(F.col("_go"), new_value).otherwise(F.col(old))

    def take_filled(name: str) -> Column:
        fresh = F.col(f"_new_{name}")
        return F.when(F.col("_go") & (fresh != ""), fresh).otherwise(F.col(name))

    fresh_start = {"scroll_ratio": F.lit(0.0), "last_read_time": F.current_timestamp()}
    out = s.withColumns(
        {
            **{c: take(F.col(f"_new_{c}"), c) for c in ("source_name", "toc_url")},
            **{c: take_filled(c) for c in ("cover_url", "intro")},
            "total_chapters": take(F.col("_total"), "total_chapters"),
            "latest_chapter": take(F.col("_latest"), "latest_chapter"),
            "chapter_index": take(F.col("_idx"), "chapter_index"),
            "chapter_url": take(F.col("_url"), "chapter_url"),
            "chapter_title": take(F.col("_title"), "chapter_title"),
            "unread_count": take(unread(F.col("_total"), F.col("_idx")), "unread_count"),
            "source_url": take(F.col("_new_source_url"), "source_url"),
            "book_url": take(F.col("_new_book_url"), "book_url"),
            **{c: F.when(~F.col("_go"), F.col(c)).otherwise(v) for c, v in fresh_start.items() if c in shelf.columns},
        }
    ).select(*shelf.columns)
    present = shelf.select("id", F.col("source_url").alias("old_source_url"), F.col("book_url").alias("old_book_url"))
    changed = plan.join(present, ["id", "old_source_url", "old_book_url"], "left_anti").withColumn("reason", F.lit("changed"))
    there = plan.join(present, ["id", "old_source_url", "old_book_url"], "left_semi")
    missing = there.join(
        at, (there["id"] == at["_id"]) & (there["target_idx"] == at["_idx"]), "left_anti"
    ).withColumn("reason", F.lit("no_chapter"))
    return out, changed.unionByName(missing)
