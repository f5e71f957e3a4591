"""Detail pages and tables of contents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom
from ..functions.text import js_trim, let, nonblank
from ..functions.urls import ABSOLUTE, resolve_url
from ..sources.shred import shred_pages
from .extract import Field, item_rows, json_rows
from .ordered import dense_index, neighbours


def info_fields(base: Column, **fields: Column) -> dict[str, Column]:
    """Detail fields: blank means absent, addresses become absolute."""
    out = {}
    for name, value in fields.items():
        v = js_trim(nonblank(value))
        link = lambda x: F.when(x.isNotNull(), resolve_url(x, base))
        out[name] = let(v, link) if name.endswith("_url") else v
    return out


def reparse(pages: DataFrame, init: Column, html: str = "html") -> DataFrame:
    """Pages cut into nodes again from ``init`` where that is not blank, so later fields see only that part."""
    chosen = pages.withColumn(html, F.coalesce(nonblank(init), F.col(html))).drop("nodes")
    return shred_pages(chosen, html, keep_html=True)


def info_backfill(shelf: DataFrame, info: DataFrame) -> DataFrame:
    """Take the new toc address whenever there is one; cover and intro only where the book has none."""
    new = info.select("id", *[F.col(c).alias(f"_{c}") for c in ("toc_url", "cover_url", "intro")])
    return (
        shelf.join(new, "id", "left")
        .withColumns(
            {
                "toc_url": F.coalesce(F.when(F.col("_toc_url") != "", F.col("_toc_url")), "toc_url"),
                "cover_url": F.coalesce(F.when(F.col("cover_url") != "", F.col("cover_url")), "_cover_url", "cover_url"),
                "intro": F.coalesce(F.when(F.col("intro") != "", F.col("intro")), "_intro", "intro"),
            }
        )
        .drop("_toc_url", "_cover_url", "_intro")
    )


def link_fallback(nodes: Column, items: Column) -> Column:
    """The items, or when there are none every link with a readable text and a real target."""

    def readable(p: Column) -> Column:
        target = lambda h: (h != "") & ~h.startswith("javascript:") & (h != "#")
        return let(dom.attr(nodes, p, "href"), target) & (F.length(dom.text(nodes, p)) >= 2)

    def choose(found: Column) -> Column:
        links = F.filter(dom.select(nodes, dom.Step(tag="a", attr="href")), readable)
        return F.when(F.size(found) == 0, links).otherwise(found)

    return let(items, choose)


def toc_items(pages: DataFrame, keys: list[str], items: Column, title: Field, href: Field) -> DataFrame:
    """Chapter rows of each page; ``pages`` has keys, page_no, url and nodes."""
    fields = {
        "title": lambda n, p: js_trim(title(n, p)),
        "link": lambda n, p: resolve_url(href(n, p), F.col("url")),
    }
    rows = item_rows(
        pages, [*keys, "page_no"], items, fields, where=lambda r: (r["title"] != "") & r["link"].rlike(ABSOLUTE)
    )
    return rows.withColumnRenamed("link", "url")


def toc_json_items(
    responses: DataFrame,
    keys: list[str],
    items: Column,
    title: Callable[[Column, Column], Column],
    href: Callable[[Column, Column], Column],
) -> DataFrame:
    """Chapter rows of each JSON response; ``responses`` has keys, page_no, url and the document ``v``."""
    fields = {
        "title": lambda v, x: js_trim(title(v, x)),
        "link": lambda v, x: resolve_url(href(v, x), F.col("url")),
    }
    rows = json_rows(
        responses, [*keys, "page_no"], items, fields, where=lambda r: (r["title"] != "") & r["link"].rlike(ABSOLUTE)
    )
    return rows.withColumnRenamed("link", "url")


def toc_from_items(items: DataFrame, keys: list[str]) -> DataFrame:
    """One chapter per address, the first one over all pages, numbered from 0."""
    # One struct per address, so both passes of the numbering share this shuffle.
    firsts = (
        items.groupBy(*keys, "url").agg(F.min(F.struct("page_no", "ord", "title")).alias("r")).select(*keys, "url", "r.*")
    )
    return dense_index(firsts, keys, F.col("page_no"), [F.col("ord")]).drop("page_no", "ord")


def toc_freshness(stored: DataFrame, shelf: DataFrame) -> DataFrame:
    """Mark each stored table: usable only for the book's present source and address.

    A table stored without an address (the old form) counts as usable.
    """
    now = shelf.select(F.col("id").alias("book_id"), F.col("source_url").alias("_s"), F.col("book_url").alias("_b"))
    legacy = F.col("source_url").isNull() & F.col("book_url").isNull()
    same = (F.col("source_url") == F.col("_s")) & (F.col("book_url") == F.col("_b"))
    return (
        stored.join(now, "book_id")
        .withColumn("is_fresh", legacy | F.coalesce(same, F.lit(False)))
        .drop("_s", "_b")
    )


def toc_summary(toc: DataFrame, progress: DataFrame | None = None) -> DataFrame:
    """Chapters per book, the last title, and with ``progress`` the unread count."""
    out = toc.groupBy("book_id").agg(
        F.count("*").alias("total_chapters"), F.max_by("title", "idx").alias("latest_chapter")
    )
    if progress is None:
        return out
    return out.join(progress.select("book_id", "chapter_index"), "book_id", "left").withColumn(
        "unread_count", unread(F.col("total_chapters"), F.coalesce("chapter_index", F.lit(0)))
    )


def unread(total: Column, index: Column) -> Column:
    return F.greatest(F.lit(0), total - index - 1)


def toc_neighbours(toc: DataFrame) -> DataFrame:
    """Previous and next chapter of each chapter; the next one is also what to fetch ahead."""
    return neighbours(
        toc, ["book_id"], "idx", {"prev_title": ("title", -1), "next_title": ("title", 1), "next_url": ("url", 1)}
    )
