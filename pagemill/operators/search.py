"""Search results: cleaning, grouping the same title across sources, paging, shelf marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions.text import js_trim, strip_ws
from ..functions.urls import resolve_url
from ..session import cut_lineage, stored_table

# Where JSON results usually keep their address, in order of trust.
URL_FIELDS = [
    "bookUrl", "url", "book_url", "link", "href", "novelUrl", "detailUrl", "novel_url", "detail_url",
    "bookid", "bookId", "BookId", "_id", "id", "novelId",
]
ID_FIELDS = ["bookid", "bookId", "id", "_id"]
# Fixed value: beyond so many result pages a search counts as unusually long. All of them are read all the same.
MANY_PAGES = 20
# Fixed value: remarks in brackets, which do not make another book.
REMARK = r"[（(][^)）]*[)）]"
PAGE_SIZE = 20
TASK_ROWS = 500_000
VARIANT = ["source_url", "book_url"]


def required(results: DataFrame, request_url: str = "request_url") -> DataFrame:
    """Trim all text fields ('' where one is missing), make addresses absolute, drop rows without a name or an address."""
    base = F.col(request_url)
    text = [c for c in ("name", "author", "intro", "kind") if c in results.columns]
    urls = [c for c in ("book_url", "cover_url") if c in results.columns]
    ok = (js_trim(F.col("name")) != "") & (F.coalesce(js_trim(F.col("book_url")), F.lit("")) != "")
    return results.where(ok).withColumns(
        {c: js_trim(F.coalesce(F.col(c), F.lit(""))) for c in text}
        | {c: resolve_url(F.coalesce(F.col(c), F.lit("")), base) for c in urls}
    )


def url_fallback(rule_url: Column, item: Column, source_url: Column) -> Column:
    """Address of a JSON result: the rule's, else the first known field that is not null.

    An empty field stops the search; only then a numeric id is turned into a book address.
    """

    def present(name: str) -> Column:
        v = jsonx.field(item, name)
        return F.when(~F.is_variant_null(v), v)

    chosen = F.coalesce(*[present(n).cast("string") for n in URL_FIELDS], F.lit(""))
    any_id = F.lit(False)
    for n in ID_FIELDS:
        any_id = any_id | jsonx.truthy(jsonx.field(item, n))
    own_id = F.coalesce(*[present(n).cast("string") for n in ID_FIELDS], F.lit(""))
    by_id = F.when(any_id & own_id.rlike(r"\A[0-9]+\z"), resolve_url(F.concat(F.lit("/book/"), own_id), source_url))
    fallback = F.when(chosen != "", chosen).otherwise(F.coalesce(by_id, F.lit("")))
    rule = js_trim(F.coalesce(rule_url, F.lit("")))
    return F.when(rule != "", rule).otherwise(fallback)


def norm_key(name: Column, author: Column) -> Column:
    """Same book, same key: white space and bracketed remarks removed from the name, case folded. Never null."""
    bare = F.lower(F.regexp_replace(strip_ws(F.coalesce(name, F.lit(""))), REMARK, ""))
    return F.concat(bare, F.lit("|"), F.lower(js_trim(F.coalesce(author, F.lit("")))))


def all_sources(results: DataFrame, fetch_log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results of the sources that answered, one report row per source)."""
    ok = F.col("error").isNull()
    rows = results.join(fetch_log.where(ok).select("source_url"), "source_url", "left_semi")
    # Counted before the join, so a source with very many results sends one row per task.
    counts = results.groupBy("source_url").agg(F.count("*").alias("n"))
    report = fetch_log.join(counts, "source_url", "left").select(
        "source_url",
        F.when(ok, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).alias("n_results"),
        F.when(~ok, F.concat("source_name", F.lit("："), "error")).alias("failure"),
    )
    return rows, report


def variants(results: DataFrame, order: list[str], key: str = "group_key") -> DataFrame:
    """One row per (group, source, address): its first sighting. Copies are combined before the shuffle."""
    fields = [c for c in results.columns if c not in VARIANT + [key]]
    rest = [c for c in fields if c not in order]
    return (
        results.groupBy(key, *VARIANT)
        .agg(F.min(F.struct(F.struct(*order).alias("first_seen"), *rest)).alias("r"))
        .select(key, *VARIANT, "r.first_seen", *[F.col(f"r.first_seen.{c}" if c in order else f"r.{c}").alias(c) for c in fields])
    )


def group_variants(found: DataFrame, key: str = "group_key") -> DataFrame:
    """One row per group: the variant seen first stands for it, with the number of variants."""
    order = found.schema["first_seen"].dataType.names
    fields = [c for c in found.columns if c not in (key, "first_seen")]
    rest = [c for c in fields if c not in order]
    return (
        found.groupBy(key)
        .agg(F.min(F.struct("first_seen", *rest)).alias("r"), F.count("*").alias("n_alternatives"))
        .select(
            key,
            "r.first_seen",
            *[F.col(f"r.first_seen.{c}" if c in order else f"r.{c}").alias(c) for c in fields],
            "n_alternatives",
        )
    )


def with_alternatives(found: DataFrame, key: str = "group_key") -> DataFrame:
    """Flat groups: every variant, with ``is_first`` on the one that stands for its group.

    Variants and heads are stored first: variants are found once, and both sides of the join are plain shuffles (heads
    read from a table carry no partitioning that would be kept), of which Spark splits a group that is far larger than others. ``key`` must not be null (see ``norm_key``).
    """
    found = cut_lineage(found)
    heads = found.groupBy(key).agg(F.min("first_seen").alias("_head"), F.count("*").alias("n_alternatives"))
    heads = stored_table(heads, "heads")
    return found.join(heads, key).withColumn("is_first", F.col("first_seen") == F.col("_head")).drop("_head")


def merge_pages(results: DataFrame, session: list[str], page: str = "page") -> tuple[DataFrame, DataFrame]:
    """Result pages 1, 2, ... of each search, read on while a page brings something new.

    Returns (variants that were read with ``first_page``, one row per search with ``last_page``,
    ``can_fetch_more`` and ``many_pages``). A page without a new variant is still read, and is the last
    one. Variants and limits are stored before they are joined: variants are found once, and Spark can split
    a search with very many rows.
    """
    first = results.groupBy(*session, *VARIANT).agg(
        F.min(page).alias("first_page"), F.max(page).alias("_seen_page")
    )
    first = cut_lineage(first)
    # Pages that bring something new, one row each; they run on from 1 as long as the nth is page n.
    pages = first.groupBy(*session, "first_page").agg(F.max("_seen_page").alias("_seen_page"))
    nth = F.row_number().over(Window.partitionBy(*session).orderBy("first_page"))
    limits = (
        pages.withColumn("_fresh", F.when(F.col("first_page") == nth, nth))
        .groupBy(*session)
        .agg((F.coalesce(F.max("_fresh"), F.lit(0)) + 1).alias("_stale"), F.max("_seen_page").cast("int").alias("_landed"))
        .select(
            *session,
            F.least("_stale", "_landed").alias("last_page"),
            (F.col("_stale") > F.col("_landed")).alias("can_fetch_more"),
            (F.least("_stale", "_landed") > MANY_PAGES).alias("many_pages"),
        )
    )
    limits = stored_table(limits, "limits")
    read = first.drop("_seen_page").join(limits.select(*session, "last_page"), session)
    return read.where(F.col("first_page") <= F.col("last_page")).drop("last_page"), limits


def selected_variant(found: DataFrame, picks: DataFrame, key: str = "group_key") -> DataFrame:
    """Each group shown by the variant that was picked for it, else by its first one.

    ``picks`` has (key, source_url, book_url); a pick that is no variant of its group is ignored.
    """
    chosen = picks.groupBy(key).agg(F.min(F.struct(*VARIANT)).alias("v")).select(key, "v.*", F.lit(0).alias("_picked"))
    rank = F.struct(F.coalesce("_picked", F.lit(1)).alias("p"), F.col("first_seen"))
    fields = [c for c in found.columns if c not in (key, "first_seen")]
    return (
        found.join(chosen, [key, *VARIANT], "left")
        .groupBy(key)
        .agg(F.min_by(F.struct(*fields), rank).alias("r"), F.min(rank).alias("k"))
        .select(key, *[F.col(f"r.{c}").alias(c) for c in fields], (F.col("k.p") == 0).alias("picked"))
    )


def top_groups(groups: DataFrame, screens: int = 1) -> DataFrame:
    """The first 20 groups, and 20 more for every further screen."""
    return groups.orderBy("first_seen").limit(PAGE_SIZE * screens)


def mark_in_shelf(results: DataFrame, shelf: DataFrame) -> DataFrame:
    own = stored_table(shelf.select(*VARIANT).distinct().withColumn("_own", F.lit(True)), "own")
    return results.join(own, VARIANT, "left").withColumn("in_shelf", F.col("_own").isNotNull()).drop("_own")


def add_to_shelf(
    shelf: DataFrame, results: DataFrame, order: list[str], book_id: Column | None = None, n_results: int | None = None
) -> DataFrame:
    """New shelf rows for results that are not on it yet, everything else at its starting value.

    The id is made from source and address, so a task that runs again gives the same one. A task sorts about TASK_ROWS
    results at most, however many there are; ``n_results`` saves counting them. Results of one address are first
    combined in up to 16 places.
    """
    fields = [c for c in ("name", "author", "cover_url", "intro", "kind", "source_name") if c in results.columns]
    tasks = max(1, -(-(results.count() if n_results is None else n_results) // TASK_ROWS))
    ranked = results.select(*VARIANT, F.struct(*fields).alias("r"), F.struct(*order).alias("at"))
    if tasks > 1:
        place = F.pmod(F.xxhash64("at"), F.lit(16))
        ranked = ranked.withColumn("_place", place).repartition(tasks, *VARIANT, "_place").groupBy(*VARIANT, "_place")
        ranked = ranked.agg(F.min_by("r", "at").alias("r"), F.min("at").alias("at")).repartition(tasks, *VARIANT)
    firsts = ranked.groupBy(*VARIANT).agg(F.min_by("r", "at").alias("r"))
    fresh = firsts.join(shelf.select(*VARIANT), VARIANT, "left_anti")
    return fresh.select(
        (F.sha2(F.to_json(F.array(*VARIANT)), 256) if book_id is None else book_id).alias("id"),
        *[F.col(f"r.{c}").alias(c) for c in fields],
        *VARIANT,
        F.lit("").alias("latest_chapter"),
        F.lit(0).alias("unread_count"),
        F.lit(0).alias("total_chapters"),
        F.lit("").alias("toc_url"),
        F.lit(0).alias("chapter_index"),
        F.lit(None).cast("timestamp").alias("last_read_time"),
        F.current_timestamp().alias("added_time"),
    )
