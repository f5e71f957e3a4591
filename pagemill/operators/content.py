"""Chapter text: extracting, stitching pages, cleaning, checking."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dom
from ..functions.rx import compiles, java_pattern
from ..functions.text import clean_lines, js_trim
from ..session import cut_lineage
from .chains import CONTENT_PAGES, follow

# Fixed value.
HAS_TAGS = r"(?is)<[a-z].*?>"


def elements_text(nodes: Column, selection: Column) -> Column:
    """Readable text of the selected elements, one after the other."""
    return F.array_join(F.transform(selection, lambda p: dom.html_to_text(nodes, p)), "\n")


def json_text(value: Column, nodes: Column) -> Column:
    """A JSON value as text; ``nodes`` is the same value shredded, used only if it has tags."""
    return F.when(value.rlike(HAS_TAGS), dom.html_to_text(nodes, F.lit(dom.DOCUMENT))).otherwise(value)


def stitched(starts: DataFrame, pages: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """(keys, n_pages, many_pages, content, reason): chapters joined over all their pages. One of which a page is blank or
    missing has no content but a reason.

    ``pages`` has url, next_url and content. Addresses are followed without the texts; the texts are joined in once at the
    end, and only those of pages that a chapter reaches. Chapters of more than CONTENT_PAGES pages are whole and marked
    ``many_pages``.
    """
    chain = follow(starts, pages.select("url", "next_url"), keys, limit)
    reached = pages.join(chain.select("url").distinct(), "url", "left_semi")
    by_url = reached.groupBy("url").agg(F.min("content").alias("content"))
    texts = chain.join(by_url, "url", "left")
    part = js_trim(F.coalesce("content", F.lit("")))
    joined = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("page_no", part.alias("part")))), lambda x: x["part"]), "\n"
    )
    whole = texts.groupBy(*keys).agg(joined.alias("content"), F.bool_or(part == "").alias("_blank"), F.count("*").alias("n_pages"))
    return whole.select(
        *keys,
        "n_pages",
        (F.col("n_pages") > CONTENT_PAGES).alias("many_pages"),
        F.when(~F.col("_blank"), F.col("content")).alias("content"),
        F.when(F.col("_blank"), F.lit("blank_page")).alias("reason"),
    )


def stitch(
    starts: DataFrame, pages: DataFrame, keys: list[str], limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """:func:`stitched`, stored once, as (chapters with their text, chapters refused with the reason)."""
    whole = cut_lineage(stitched(starts, pages, keys, limit))
    return whole.where("reason is null").drop("reason"), whole.where("reason is not null").drop("content")


def strip_pattern(spark: SparkSession, content: Column, pattern: str) -> Column:
    """Remove every match; the pattern may be percent-encoded, a bad one changes nothing."""
    try:
        pattern = unquote(pattern, errors="strict")
    except UnicodeDecodeError:
        pass
    pattern = java_pattern(pattern)
    return F.regexp_replace(content, pattern, "") if compiles(spark, pattern) else content


def nonempty(df: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(rows whose cleaned content has something in it, the others with a reason)."""
    cleaned = df.withColumn(content, clean_lines(F.coalesce(F.col(content), F.lit(""))))
    return cleaned.where(F.col(content) != ""), cleaned.where(F.col(content) == "").drop(content).withColumn(
        "reason", F.lit("empty_content")
    )


def paragraphs(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    parts = F.filter(F.split(F.col(content), "\n", -1), lambda x: x != "")
    return df.select(*keys, F.posexplode(parts).alias("ord", "paragraph"))


def drop_title_line(content: Column, title: Column) -> Column:
    """Without its first line when that line only repeats the title."""
    first_line = F.substring_index(content, "\n", 1)
    rest = F.substring(content, F.length(first_line) + 2, F.length(content))
    return F.when(js_trim(first_line) == js_trim(title), rest).otherwise(content)
