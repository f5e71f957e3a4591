"""Details, tables of contents and chapter content."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import combine, dom, jsonx
from ..functions.dom import Step
from ..functions.text import clean_lines
from ..operators import chains
from ..operators import content as co
from ..operators import extract as ex
from ..operators import toc as tc
from ..sources.shred import shred_pages
from . import sqltext as q
from .extraction import NAV_LINKS, event_docs, nodes, pages_of, shredded
from .views import sql_view, tables, view


def _page_url(df):
    return df.withColumn("page_no", F.lit(1)).withColumn("book_id", F.col("page_id"))


def toc_extract(spark, sf):
    """Chapters of each book: ten pages make one book, the first of equal addresses stays."""
    pages = shredded(spark, sf).select(
        F.floor(F.col("page_id") / 10).alias("book_id"),
        (F.col("page_id") % 10 + 1).alias("page_no"),
        F.lit("https://toc.example/x").alias("url"),
        "nodes",
    )
    items = tc.toc_items(
        pages, ["book_id"], dom.select(nodes(), *NAV_LINKS), dom.text, lambda n, p: dom.attr(n, p, "href")
    )
    return tc.toc_from_items(items, ["book_id"]).select("book_id", "idx", "title", "url")


def toc_link_fallback(spark, sf):
    """Books whose list rule finds nothing fall back to all readable links."""
    pages = _page_url(shredded(spark, sf))
    listed = F.when(F.col("page_id") % 3 == 0, dom.select(nodes(), Step(tag="h1"))).otherwise(
        dom.select(nodes(), Step(cls="missing"))
    )
    chosen = tc.link_fallback(nodes(), listed)
    rows = ex.item_rows(pages, ["page_id"], chosen, {"title": dom.text})
    return rows.withColumn("ord", F.col("ord").cast("bigint"))


def info_extract(spark, sf):
    first_link = lambda: dom.first(dom.select(nodes(), *NAV_LINKS))
    fields = tc.info_fields(
        F.col("url"),
        name=dom.text(nodes(), dom.first(dom.select(nodes(), Step(tag="h1")))),
        author=dom.text(nodes(), dom.first(dom.select(nodes(), Step(cls="author")))),
        intro=combine.first_value(dom.text(nodes(), dom.first(dom.select(nodes(), Step(cls="ad"))))),
        cover_url=F.lit(" "),
        toc_url=dom.attr(nodes(), first_link(), "href"),
    )
    return shredded(spark, sf).select("page_id", *[c.alias(n) for n, c in fields.items()])


def info_extract_json(spark, sf):
    """Detail fields of JSON responses."""
    K, I = jsonx.Key, jsonx.Index
    v = F.col("v")
    fields = tc.info_fields(
        F.lit("https://api.example/book/1"),
        name=jsonx.value(v, K("data"), K("user name")),
        author=jsonx.value(v, K("data"), K("nope")),
        intro=jsonx.value(v, K("data"), K("list"), I(0), K("name")),
        cover_url=jsonx.value(v, K("data"), K("list"), I(2), K("id")),
        toc_url=F.concat(F.lit("toc/"), jsonx.value(v, K("data"), K("list"), I(1), K("id"))),
    )
    docs = event_docs(spark, sf).withColumn("v", F.try_parse_json("doc"))
    return docs.select("event_id", *[c.alias(n) for n, c in fields.items()])


def toc_extract_json(spark, sf):
    """Chapters out of JSON responses: ten responses make one book, the first of equal addresses stays."""
    K = jsonx.Key
    docs = event_docs(spark, sf).select(
        F.floor(F.col("event_id") / 10).alias("book_id"),
        F.col("event_id").alias("page_no"),
        F.lit("https://api.example/toc").alias("url"),
        F.try_parse_json("doc").alias("v"),
    )
    items = tc.toc_json_items(
        docs,
        ["book_id"],
        jsonx.items(F.col("v"), K("data"), K("list")),
        lambda v, x: F.concat(F.lit(" "), jsonx.value(x, K("id"))),
        lambda v, x: F.concat(F.lit("/c/"), jsonx.value(x, K("id"))),
    )
    return tc.toc_from_items(items, ["book_id"]).select("book_id", "idx", "title", "url")


def info_init(spark, sf):
    """Fields read only from the part of the page that an init value picked out."""
    article = dom.first(dom.select(nodes(), Step(tag="article")))
    inside = tc.reparse(shredded(spark, sf, keep_html=True), dom.inner_html(F.col("html"), nodes(), article))
    return inside.select(
        "page_id",
        dom.text(nodes(), dom.first(dom.select(nodes(), Step(tag="h1")))).alias("name"),
        F.size(dom.select(nodes(), Step(tag="p"))).cast("bigint").alias("n_paragraphs"),
        F.size(dom.select(nodes(), Step(tag="a"))).cast("bigint").alias("n_links"),
    )


def _book_shelf(spark, sf):
    return view(spark, sf, "shelf").select(
        "id",
        "source_url",
        "book_url",
        F.when(F.col("author").endswith("1"), F.lit("")).otherwise(F.lit("old-cover")).alias("cover_url"),
        F.when(F.col("author").endswith("2"), F.lit("")).otherwise(F.lit("old-intro")).alias("intro"),
        F.lit("old-toc").alias("toc_url"),
    )


def info_backfill(spark, sf):
    info = spark.sql(
        """select concat('bk', s_suppkey) as id, case when s_suppkey % 3 = 0 then '' else concat('t', s_suppkey) end as toc_url,
 concat('c', s_suppkey) as cover_url, concat('i', s_suppkey) as intro from {supplier}""",
        **tables(spark, sf, "supplier"),
    )
    return tc.info_backfill(_book_shelf(spark, sf), info)


def toc_follow_pages(spark, sf):
    links = view(spark, sf, "links")
    # Every fifth chain runs back into its own beginning.
    loop = F.when(
        F.col("next_url").isNull() & (F.col("book_id") % 5 == 0), F.concat(F.lit("https://c.example/"), "book_id", F.lit("/0"))
    ).otherwise(F.col("next_url"))
    links = links.select("book_id", "url", loop.alias("next_url"))
    starts = links.where(F.col("url").endswith("/0")).select("book_id", "url")
    pages = chains.follow(starts, links, ["book_id"])
    return pages.withColumn("many_pages", F.col("page_no") > chains.TOC_PAGES)


def toc_freshness(spark, sf):
    toc = view(spark, sf, "shelf").select(
        F.col("id").alias("book_id"),
        F.when(F.col("author").endswith("7"), F.lit("https://other.example"))
        .when(~F.col("author").endswith("3"), F.col("source_url"))
        .alias("source_url"),
        F.when(~F.col("author").endswith("3"), F.col("book_url")).alias("book_url"),
    )
    return tc.toc_freshness(toc, view(spark, sf, "shelf")).select("book_id", "is_fresh")


def toc_summary(spark, sf):
    progress = spark.sql(
        "select conv_id as book_id, cast(count(*) div 2 as int) as chapter_index from {conversations} where conv_id % 4 <> 0 group by conv_id",
        **tables(spark, sf, "conversations"),
    )
    return tc.toc_summary(view(spark, sf, "toc"), progress).select(
        "book_id", "total_chapters", "latest_chapter", "unread_count"
    )


def toc_neighbors(spark, sf):
    return tc.toc_neighbours(view(spark, sf, "toc")).select("book_id", "idx", "prev_title", "next_title", "next_url")


def content_extract(spark, sf):
    """Chapter text of HTML pages and of JSON responses, with or without tags in the value."""
    k = F.col("page_id") % 3
    body = (
        F.when(k == 1, F.to_json(F.struct(F.col("html").alias("content"))))
        .when(k == 2, F.to_json(F.struct(F.concat(F.lit(" "), "url", F.lit("  x ")).alias("content"))))
        .otherwise(F.col("html"))
    )
    raw = pages_of(spark, sf).select("page_id", body.alias("body"))
    routed = raw.withColumn("kind", ex.response_kind(F.col("body")))
    value = jsonx.value(F.try_parse_json("body"), jsonx.Key("content"))
    routed = routed.select("page_id", "kind", F.when(F.col("kind") == "json", value).otherwise(F.col("body")).alias("value"))
    with_nodes = shred_pages(routed.withColumn("html", F.col("value")))
    text = F.when(F.col("kind") == "json", co.json_text(F.col("value"), nodes())).otherwise(
        co.elements_text(nodes(), dom.select(nodes(), *(Step(tag="article") / Step(tag="p"))))
    )
    return with_nodes.select("page_id", "kind", text.alias("content"))


def _chapter_starts(spark, sf):
    links = view(spark, sf, "links")
    return links, links.where(F.col("url").endswith("/0")).select("book_id", "url")


def content_stitch(spark, sf):
    links, starts = _chapter_starts(spark, sf)
    return co.stitched(starts, links, ["book_id"])


def content_strip_regex(spark, sf):
    docs = tables(spark, sf, "documents")["documents"]
    t = F.col("text")
    return docs.select(
        "doc_id",
        co.strip_pattern(spark, t, "%5B0-9%5D+").alias("encoded"),
        co.strip_pattern(spark, t, "(?:the|les) [a-z]+").alias("plain"),
        (co.strip_pattern(spark, t, "(") == t).alias("bad_unchanged"),
    )


def content_clean_lines(spark, sf):
    docs = tables(spark, sf, "documents")["documents"]
    messy = F.concat(F.lit("\n　"), F.replace("text", F.lit(". "), F.lit(". \n \t")), F.lit("\n\n"))
    return docs.select("doc_id", clean_lines(messy).alias("content"))


def _maybe_empty(spark, sf):
    docs = tables(spark, sf, "documents")["documents"]
    return docs.select("doc_id", F.when(F.col("doc_id") % 9 == 2, F.lit("　\n \n")).otherwise(F.col("text")).alias("content"))


def content_nonempty(spark, sf):
    ok, rejected = co.nonempty(_maybe_empty(spark, sf))
    return ok.select("doc_id", F.lit("ok").alias("state")).unionByName(rejected.select("doc_id", F.col("reason").alias("state")))


def content_paragraphs(spark, sf):
    ok, _ = co.nonempty(_maybe_empty(spark, sf))
    rows = co.paragraphs(ok, ["doc_id"])
    return rows.withColumn("ord", F.col("ord").cast("bigint"))


def content_drop_title_line(spark, sf):
    docs = tables(spark, sf, "documents")["documents"]
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.substring_index("text", "\n", 1), F.lit("　"))).otherwise(F.lit("Other"))
    return docs.select("doc_id", co.drop_title_line(F.col("text"), title).alias("content"))


QUERIES = {
    "info_extract": info_extract,
    "info_init": info_init,
    "info_extract_json": info_extract_json,
    "toc_extract_json": toc_extract_json,
    "info_backfill": info_backfill,
    "toc_extract": toc_extract,
    "toc_link_fallback": toc_link_fallback,
    "toc_follow_pages": toc_follow_pages,
    "toc_freshness": toc_freshness,
    "toc_summary": toc_summary,
    "toc_neighbors": toc_neighbors,
    "content_extract": content_extract,
    "content_stitch": content_stitch,
    "content_strip_regex": content_strip_regex,
    "content_clean_lines": content_clean_lines,
    "content_nonempty": content_nonempty,
    "content_paragraphs": content_paragraphs,
    "content_drop_title_line": content_drop_title_line,
}

_ANCHORS = """(select page_id, url, i, x from (select page_id, url, unnest(l) as x, generate_subscripts(l, 1) as i from (
 select page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') as l from pages)))"""
_HREF = "regexp_extract(x, 'href=\"([^\"]*)\"', 1)"
_X = q.plain("x")
_TOC, _SHELF, _LINKS = sql_view("toc"), sql_view("shelf"), sql_view("links")
_P_TEXT = f"""array_to_string(list_transform(list_slice(string_split({q.ARTICLE}, '<p>'), 2, 1000000), lambda p: {q.html_to_text('p')}), chr(10))"""
_JSON_PAGE = q.html_to_text("html")
_MAYBE = "(select doc_id, case when doc_id % 9 = 2 then '' else text end as content from documents)"

ORACLES = {
    "info_extract": f"""select page_id, {q.plain(q.H1)} as name, cast(null as varchar) as author,
 {q.plain("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")} as intro, cast(null as varchar) as cover_url,
 {q.root_link("regexp_extract(html, '<a href=\"([^\"]*)\"', 1)", 'url')} as toc_url from pages""",
    "info_init": f"""select page_id, {q.plain(q.H1)} as name, cast(len(string_split({q.ARTICLE}, '<p>')) - 1 as bigint) as n_paragraphs,
 cast(0 as bigint) as n_links from pages""",
    "info_extract_json": """select event_id, cast(user_id as varchar) as name, cast(null as varchar) as author, event_type as intro,
 cast(null as varchar) as cover_url, concat('https://api.example/book/toc/', event_id + 1) as toc_url from events""",
    "toc_extract_json": """with i as (select event_id // 10 as book_id, event_id as page_no, o, event_id + o as id from events, (values (0), (1)) t(o)),
f as (select * from i qualify row_number() over (partition by book_id, id order by page_no, o) = 1)
select book_id, cast(row_number() over (partition by book_id order by page_no, o) - 1 as int) as idx, cast(id as varchar) as title,
 concat('https://api.example/c/', id) as url from f""",
    "info_backfill": f"""select b.id, source_url, book_url,
 case when b.author like '%1' and s.s_suppkey is not null then concat('c', s_suppkey) when b.author like '%1' then '' else 'old-cover' end as cover_url,
 case when b.author like '%2' and s.s_suppkey is not null then concat('i', s_suppkey) when b.author like '%2' then '' else 'old-intro' end as intro,
 case when s_suppkey % 3 <> 0 then concat('t', s_suppkey) else 'old-toc' end as toc_url
from {_SHELF} b left join supplier s on b.id = concat('bk', s_suppkey)""",
    "toc_extract": f"""with a as (select page_id // 10 as book_id, page_id, i, {_X} as title,
 concat('https://toc.example', {q.encode_path(_HREF)}) as url from {_ANCHORS}),
f as (select * from a where title <> '' qualify row_number() over (partition by book_id, url order by page_id, i) = 1)
select book_id, cast(row_number() over (partition by book_id order by page_id, i) - 1 as int) as idx, title, url from f""",
    "toc_link_fallback": f"""select page_id, row_number() over (partition by page_id order by i) - 1 as ord, {_X} as title from {_ANCHORS}
 where page_id % 3 <> 0 and length({_X}) >= 2
union all select page_id, 0, {q.plain(q.H1)} from pages where page_id % 3 = 0""",
    "toc_follow_pages": f"""select book_id, cast(row_number() over (partition by book_id order by length(url), url) as int) as page_no, url,
 row_number() over (partition by book_id order by length(url), url) > 20 as many_pages from {_LINKS}""",
    "toc_freshness": f"""select id as book_id, author not like '%7' as is_fresh from {_SHELF}""",
    "toc_summary": f"""with p as (select conv_id as book_id, count(*) // 2 as ci from conversations where conv_id % 4 <> 0 group by conv_id),
s as (select book_id, count(*) as total_chapters, arg_max(title, idx) as latest_chapter from {_TOC} group by book_id)
select s.book_id, total_chapters, latest_chapter, greatest(0, total_chapters - coalesce(ci, 0) - 1) as unread_count
from s left join p on s.book_id = p.book_id""",
    "toc_neighbors": f"""select book_id, idx, lag(title) over w as prev_title, lead(title) over w as next_title, lead(url) over w as next_url
from {_TOC} window w as (partition by book_id order by idx)""",
    "content_extract": f"""select page_id, case when page_id % 3 = 0 then 'html' else 'json' end as kind,
 case page_id % 3 when 0 then {_P_TEXT} when 1 then {_JSON_PAGE} else concat(' ', url, '  x ') end as content from pages""",
    "content_stitch": f"""with l as (select *, cast(string_split(url, '/')[5] as int) as n from {_LINKS}),
s as (select book_id, count(*) as n_pages, bool_or({q.trim('content')} = '') as bad,
 string_agg({q.trim('content')}, chr(10) order by n) as content from l group by book_id)
select book_id, n_pages, n_pages > 10 as many_pages, case when not bad then content end as content, case when bad then 'blank_page' end as reason from s""",
    "content_strip_regex": """select doc_id, regexp_replace(text, '[0-9]+', '', 'g') as encoded,
 regexp_replace(text, '(?:the|les) [a-z]+', '', 'g') as plain, true as bad_unchanged from documents""",
    "content_clean_lines": f"select doc_id, {q.clean_lines('t')} as content from (select doc_id, replace(text, '. ', '. ' || chr(10) || ' ' || chr(9)) as t from documents)",
    "content_nonempty": "select doc_id, case when doc_id % 9 = 2 then 'empty_content' else 'ok' end as state from documents",
    "content_paragraphs": f"""select doc_id, i - 1 as ord, p as paragraph from (select doc_id, unnest(l) as p, generate_subscripts(l, 1) as i from (
 select doc_id, string_split({q.clean_lines('content')}, chr(10)) as l from {_MAYBE} where content <> ''))""",
    "content_drop_title_line": """select doc_id, case when doc_id % 2 = 1 then text when contains(text, chr(10)) then substr(text, instr(text, chr(10)) + 1) else '' end as content
from documents""",
}
