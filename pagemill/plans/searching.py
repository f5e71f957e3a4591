"""Search results and cross-source grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import resolve_url
from ..operators import search as se
from ..sources import catalog as cat
from . import sqltext as q
from .views import sql_view, tables, view

ORDER = ["page", "item_ord", "source_ord", "book_href"]


def results(spark, sf):
    return keyed(view(spark, sf, "results"))


def keyed(df):
    return df.withColumns(
        {
            "book_url": resolve_url(F.col("book_href"), F.col("source_url")),
            "group_key": se.norm_key(F.col("name"), F.col("author")),
        }
    )


def found(spark, sf):
    return se.variants(results(spark, sf), ORDER)


def search_required(spark, sf):
    raw = view(spark, sf, "results").select(
        F.col("source_url").alias("request_url"),
        F.when(F.col("item_ord") == 7, F.lit("　 ")).otherwise(F.concat(F.lit("\t"), "name", F.lit("　"))).alias("name"),
        F.concat(F.lit(" "), "author").alias("author"),
        F.when(F.col("item_ord") > 2, F.col("kind")).alias("kind"),
        F.when(F.col("item_ord") == 6, F.lit(" "))
        .when(F.col("item_ord") == 5, F.concat(F.lit("http://x.example"), "book_href"))
        .otherwise(F.col("book_href"))
        .alias("book_url"),
        F.when(F.col("item_ord") == 4, F.lit("")).otherwise(F.lit("c.jpg")).alias("cover_url"),
    )
    return se.required(raw)


ITEM_JSON = """case p_partkey % 7 when 0 then concat('{{"url":"/b/', p_partkey, '"}}')
 when 1 then concat('{{"bookUrl":"","id":', p_partkey, '}}') when 2 then concat('{{"id":', p_partkey, '}}')
 when 3 then concat('{{"bookUrl":null,"novelId":"n', p_partkey, '"}}') when 4 then '{{"other":1}}'
 when 5 then concat('{{"link":"","bookid":"x', p_partkey, '"}}') else concat('{{"href":"h","detailUrl":"/d/', p_partkey, '"}}') end"""


def search_url_fallback(spark, sf):
    sql = "select p_partkey, case when p_partkey % 11 = 0 then ' /own ' else ' ' end as rule_url, " + ITEM_JSON + " as item from {part}"
    df = spark.sql(sql, **tables(spark, sf, "part"))
    url = se.url_fallback(F.col("rule_url"), F.try_parse_json("item"), F.lit("https://s.example/x"))
    return df.select("p_partkey", url.alias("book_url"))


def _fetch_log(spark, sf):
    active = cat.enabled_sources(view(spark, sf, "sources"), for_search=True)
    failed = F.col("ord") % 11 == 5
    return active.select("source_url", "source_name", F.when(failed, F.lit("timeout")).alias("error"))


def search_all_union(spark, sf):
    rows, _ = se.all_sources(results(spark, sf), _fetch_log(spark, sf))
    return rows.select("source_url", "group_key", "book_url", "page", "item_ord")


def search_all_report(spark, sf):
    _, report = se.all_sources(results(spark, sf), _fetch_log(spark, sf))
    return report


def search_source_filter(spark, sf):
    one = results(spark, sf).where(F.col("source_url") == "https://s7.example")
    return one.select("source_url", "group_key", "book_url", "page", "item_ord")


def search_norm_key(spark, sf):
    return results(spark, sf).groupBy("group_key").agg(F.count("*").alias("n"))


def search_group(spark, sf):
    groups = se.group_variants(found(spark, sf))
    return groups.select("group_key", "name", "author", "source_url", "book_url", "kind", "n_alternatives")


def search_alternatives(spark, sf):
    flat = se.with_alternatives(found(spark, sf))
    return flat.select("group_key", "source_url", "book_url", "n_alternatives", "is_first")


def _paged(spark, sf):
    """Result pages 1 to 60, most of which bring something new."""
    return results(spark, sf).select(
        F.col("source_url").alias("search_id"),
        "source_url",
        (F.col("page") % 60 + 1).alias("page"),
        F.concat(F.lit("/book/"), (F.substring_index("book_href", "/", -1).cast("bigint") % 4000).cast("string")).alias("book_url"),
    )


def search_page_merge(spark, sf):
    """How far each search was read on, and how many variants it gathered."""
    read, limits = se.merge_pages(_paged(spark, sf), ["search_id"])
    counts = read.groupBy("search_id").agg(F.count("*").alias("n_variants"))
    return limits.join(counts, "search_id")


def search_select_variant(spark, sf):
    df = found(spark, sf)
    picks = df.where("item_ord = 4").groupBy("group_key").agg(F.max(F.struct("source_url", "book_url")).alias("v"))
    picks = picks.select("group_key", "v.*")
    return se.selected_variant(df, picks).select("group_key", "source_url", "book_url", "name", "picked")


def search_display_topk(spark, sf):
    top = se.top_groups(se.group_variants(found(spark, sf)), screens=2)
    return top.select("group_key", "source_url", "book_url")


def search_in_shelf(spark, sf):
    out = se.mark_in_shelf(results(spark, sf), view(spark, sf, "shelf"))
    return out.select("source_url", "book_url", "page", "item_ord", "in_shelf")


def search_add_to_shelf(spark, sf):
    # Only the number of tasks follows from it, so that line items stand for their results.
    n = tables(spark, sf, "lineitem")["lineitem"].count()
    fresh = se.add_to_shelf(view(spark, sf, "shelf"), results(spark, sf), ORDER, n_results=n)
    return fresh.select("id", "name", "author", "kind", "source_url", "book_url", "unread_count", "chapter_index", "toc_url")


QUERIES = {
    "search_required": search_required,
    "search_url_fallback": search_url_fallback,
    "search_all_union": search_all_union,
    "search_all_report": search_all_report,
    "search_source_filter": search_source_filter,
    "search_norm_key": search_norm_key,
    "search_group": search_group,
    "search_alternatives": search_alternatives,
    "search_page_merge": search_page_merge,
    "search_select_variant": search_select_variant,
    "search_display_topk": search_display_topk,
    "search_in_shelf": search_in_shelf,
    "search_add_to_shelf": search_add_to_shelf,
}

_R = f"""r as (select *, concat(source_url, book_href) as book_url, {q.norm_key('name', 'author')} as group_key from {sql_view('results')})"""
_V = f"""{_R}, v as (select * from r qualify row_number() over (
 partition by group_key, source_url, book_url order by page, item_ord, source_ord, book_href) = 1),
g as (select *, count(*) over (partition by group_key) as n_alternatives,
 row_number() over (partition by group_key order by page, item_ord, source_ord, book_href) as rn from v)"""
_LOG = f"""l as (select source_url, source_name, case when ord % 11 = 5 then 'timeout' end as error from {sql_view('sources')}
 where coalesce(enabled, true) and source_type = 0 and search_url <> '')"""
_SHELF = sql_view("shelf")

ORACLES = {
    "search_required": f"""select source_url as request_url, name, coalesce(author, '') as author, case when item_ord > 2 then kind else '' end as kind,
 case when item_ord = 5 then concat('http://x.example', book_href) else concat(source_url, book_href) end as book_url,
 case when item_ord = 4 then '' else concat(source_url, '/c.jpg') end as cover_url
from {sql_view('results')} where item_ord not in (6, 7)""",
    "search_url_fallback": """select p_partkey, case when p_partkey % 11 = 0 then '/own' else case p_partkey % 7
 when 0 then concat('/b/', p_partkey) when 1 then concat('https://s.example/book/', p_partkey) when 2 then cast(p_partkey as varchar)
 when 3 then concat('n', p_partkey) when 6 then 'h' else '' end end as book_url from part""",
    "search_all_union": f"""with {_R}, {_LOG} select r.source_url, group_key, book_url, page, item_ord from r join l on r.source_url = l.source_url
where error is null""",
    "search_all_report": f"""with {_R}, {_LOG} select l.source_url, case when error is null then count(r.source_url) else 0 end as n_results,
 case when error is not null then concat(any_value(source_name), '：', error) end as failure
from l left join r on r.source_url = l.source_url group by l.source_url, error""",
    "search_source_filter": f"with {_R} select source_url, group_key, book_url, page, item_ord from r where source_url = 'https://s7.example'",
    "search_norm_key": f"with {_R} select group_key, count(*) as n from r group by group_key",
    "search_group": f"with {_V} select group_key, name, author, source_url, book_url, kind, n_alternatives from g where rn = 1",
    "search_alternatives": f"with {_V} select group_key, source_url, book_url, n_alternatives, rn = 1 as is_first from g",
    "search_page_merge": f"""with {_R}, p as (select source_url as search_id, page % 60 + 1 as page, cast(string_split(book_href, '/')[3] as bigint) % 4000 as b from r),
f as (select search_id, b, min(page) as first_page from p group by search_id, b),
m as (select search_id, max(page) as landed from p group by search_id),
st as (select s.search_id, min(i) as stale from (select distinct search_id from p) s, range(1, 62) t(i)
 where not exists (select 1 from f where f.search_id = s.search_id and f.first_page = i) group by s.search_id)
select m.search_id, cast(least(stale, landed) as int) as last_page, stale > landed as can_fetch_more, least(stale, landed) > 20 as many_pages,
 (select count(*) from f where f.search_id = m.search_id and first_page <= least(stale, landed)) as n_variants
from m join st on m.search_id = st.search_id""",
    "search_select_variant": f"""with {_V}, k as (select group_key, max(source_url || chr(1) || book_url) as pick from g where item_ord = 4 group by group_key)
select g.group_key, source_url, book_url, name, pick is not null as picked from g left join k on g.group_key = k.group_key
where case when pick is null then rn = 1 else source_url || chr(1) || book_url = pick end""",
    "search_display_topk": f"""with {_V} select group_key, source_url, book_url from g where rn = 1
order by page, item_ord, source_ord, book_href limit 40""",
    "search_in_shelf": f"""with {_R}, s as {_SHELF} select r.source_url, r.book_url, page, item_ord, s.id is not null as in_shelf
from r left join s on r.source_url = s.source_url and r.book_url = s.book_url""",
    "search_add_to_shelf": f"""with {_R}, s as {_SHELF}, f as (select * from r qualify row_number() over (
 partition by source_url, book_url order by page, item_ord, source_ord, book_href) = 1)
select sha256('["' || source_url || '","' || book_url || '"]') as id, name, author, kind, source_url, book_url, 0 as unread_count, 0 as chapter_index, '' as toc_url
from f where not exists (select 1 from s where s.source_url = f.source_url and s.book_url = f.book_url)""",
}
